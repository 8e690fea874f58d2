"""Alert episodes and breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.layout import DEFAULT, Layout
from loamline.operators.quantiles import exact_quantiles
from loamline.operators.running import block_window, core_rows, index_rows, running, with_halo


def mark_episodes(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: Column, gap: float,
                  layout: Layout = DEFAULT, bucket: str | None = None) -> DataFrame:
    """Add ``episode``, a number that rises when ``position`` is more than ``gap`` past the row before."""
    rows = with_halo(index_rows(df.withColumn("_at", position), keys, order, layout, bucket=bucket), before=1,
                     layout=layout)
    before = F.lag("_at", 1).over(block_window(keys))
    fresh = rows.withColumn("_before", before).withColumn(
        "_new", F.when(F.col("_before").isNull() | (F.col("_at") - F.col("_before") > gap), 1).otherwise(0)
    )
    marked = running(core_rows(fresh), keys, {"episode": ("sum", "_new")})
    return marked.drop("_at", "_before", "_new", "rn", "n", "block")


def site_episodes(alerts: DataFrame, gap_hours: float = 6.0, layout: Layout = DEFAULT) -> DataFrame:
    """Per station: alerts, hours with an alert, episodes more than ``gap_hours`` apart, and the compression."""
    hours = alerts.groupBy("source_id", "event_time").agg(F.count(F.lit(1)).alias("alerts"))
    seconds = F.col("event_time").cast("timestamp").cast("double")
    marked = mark_episodes(hours, ["source_id"], ["event_time"], seconds, gap_hours * 3600.0, layout)
    out = marked.groupBy("source_id").agg(
        F.sum("alerts").alias("raw_alerts"), F.count(F.lit(1)).alias("alert_hours"), F.max("episode").alias("episodes")
    )
    return out.withColumn("compression_pct", (F.lit(1.0) - F.col("episodes") / F.col("raw_alerts")) * 100.0)


def episodes_by_type(alerts: DataFrame, gap_steps: int, layout: Layout = DEFAULT,
                     keys: Sequence[str] = ("source_id", "category", "threshold_type")) -> DataFrame:
    """One row per episode of a (station, category, type): start, end, duration in steps, alerts and severities."""
    steps = alerts.withColumn("_range", F.floor(F.col("step") / F.lit(layout.block_rows)).cast("long"))
    marked = mark_episodes(steps, list(keys), ["step", "ord"], F.col("step"), gap_steps, layout, bucket="_range")
    return marked.groupBy(*keys, "episode").agg(
        F.min("step").alias("start_step"), F.max("step").alias("end_step"),
        F.min("event_time").alias("start_time"), F.max("event_time").alias("end_time"),
        (F.max("step") - F.min("step") + 1).alias("duration_steps"), F.count(F.lit(1)).alias("alert_count"),
        F.array_sort(F.collect_set("severity")).alias("severities"),
    )


def episode_summary(episodes: DataFrame, by: Sequence[str] = ("category",), layout: Layout = DEFAULT) -> DataFrame:
    """Episodes, alerts, mean/median/max size and duration per group."""
    sizes = exact_quantiles(episodes, by, "alert_count", {"median_alerts": 0.5}, layout, width=1.0)
    return episodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("alert_count").alias("alerts"),
        F.avg("alert_count").alias("mean_alerts"), F.max("alert_count").alias("max_alerts"),
        F.avg("duration_steps").alias("mean_duration"), F.max("duration_steps").alias("max_duration"),
    ).join(sizes.select(*by, "median_alerts"), list(by))


def top_episodes(episodes: DataFrame, count: int = 8, ties: Sequence[str] = ()) -> DataFrame:
    return episodes.orderBy(F.desc("duration_steps"), *ties).limit(count)


def breakdown(alerts: DataFrame) -> DataFrame:
    """Counts by category, severity, type and horizon (none = Real-Time), one long table."""
    horizon = F.coalesce(F.col("horizon").cast("string"), F.lit("Real-Time"))
    rows = F.array(*[
        F.struct(F.lit(name).alias("dimension"), c.alias("value"))
        for name, c in (("category", F.col("category")), ("severity", F.col("severity")),
                        ("threshold_type", F.col("threshold_type")), ("horizon", horizon))
    ])
    return alerts.select(F.inline(rows)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("alerts"))


def alert_cube(alerts: DataFrame, a: str = "category", b: str = "severity") -> DataFrame:
    """Cross-tabulation with margins; ALL marks a margin."""
    return alerts.cube(a, b).agg(F.count(F.lit(1)).alias("alerts")).select(
        F.coalesce(F.col(a), F.lit("ALL")).alias(a), F.coalesce(F.col(b), F.lit("ALL")).alias(b), "alerts"
    )


def cross_table(alerts: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    return alerts.groupBy(rows).pivot(columns, list(values)).count()
