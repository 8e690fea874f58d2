"""Coverage, gaps and per-variable statistics, for all stations in one aggregate each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.layout import DEFAULT, Layout
from loamline.operators.running import time_bucket


def coverage(df: DataFrame, time: str = "event_time", key: str = "source_id") -> DataFrame:
    """First and last time, records, expected hourly steps, missing steps and repeated timestamps per station.

    A missing step is an hour of the grid that starts at the first reading and has none.
    """
    counts = df.groupBy(key, time).agg(F.count(F.lit(1)).alias("_c"))
    bounds = counts.groupBy(key).agg(
        F.min(time).alias("start_time"),
        F.max(time).alias("end_time"),
        F.sum("_c").alias("records"),
        (F.sum("_c") - F.count(F.lit(1))).alias("duplicate_timestamps"),
    )
    start = F.col("start_time").cast("timestamp").cast("long")
    end = F.col("end_time").cast("timestamp").cast("long")
    present = on_grid(counts, bounds.select(key, "start_time"), time, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("_present")
    )
    expected = F.floor((end - start) / 3600) + 1
    return (
        bounds.join(present, key, "left")
        .withColumn("expected_steps", expected)
        .withColumn("missing_steps", F.col("expected_steps") - F.coalesce(F.col("_present"), F.lit(0)))
        .drop("_present")
    )


def on_grid(times: DataFrame, starts: DataFrame, time: str, key: str, salts: int = 16) -> DataFrame:
    """Distinct times that are a whole number of hours after the station's first reading."""
    spread = starts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = times.withColumn("_salt", F.pmod(F.xxhash64(time), F.lit(salts)).cast("int"))
    since = F.col(time).cast("timestamp").cast("double") - F.col("start_time").cast("timestamp").cast("double")
    return salted.join(spread, [key, "_salt"]).where(since % 3600 == 0).select(key, time)


def missing_steps(df: DataFrame, time: str = "event_time", key: str = "source_id") -> DataFrame:
    """The missing hours themselves: the station's grid minus its readings."""
    span = df.groupBy(key).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    grid = span.select(key, F.explode(F.expr("sequence(_a, _b, interval 1 hour)")).alias(time))
    return grid.join(df.select(key, time), [key, time], "left_anti")


def variable_stats(df: DataFrame, variables: Sequence[str], key: str = "source_id") -> DataFrame:
    """Counts, null share, range, mean and sample deviation of each variable (one long aggregate)."""
    long = df.select(key, F.inline(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables
    ])))
    return long.groupBy(key, "variable").agg(*stat_columns())


def stat_columns():
    n = F.count("value")
    null = F.count_if(F.col("value").isNull())
    return [
        n.alias("non_null"),
        null.alias("nulls"),
        (null / F.count(F.lit(1)) * 100.0).alias("null_pct"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"),
        F.when(n > 0, F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("std_value"),
    ]


def completeness(df: DataFrame, variables: Sequence[str], key: str = "source_id") -> DataFrame:
    """Percent of present values per station and per station and variable (grouping sets)."""
    long = df.select(key, F.inline(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables
    ])))
    return long.groupingSets([[F.col(key)], [F.col(key), F.col("variable")]], F.col(key), F.col("variable")).agg(
        (F.count("value") / F.count(F.lit(1)) * 100.0).alias("present_pct")
    )


def store_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and quarantined rows per stored table; tables without the flag count none."""
    out = None
    for name, df in tables.items():
        flag = F.count_if("quarantined") if "quarantined" in df.columns else F.lit(0).cast("long")
        part = df.agg(F.count(F.lit(1)).alias("rows"), flag.alias("quarantined")).select(
            F.lit(name).alias("table"), "rows", "quarantined"
        )
        out = part if out is None else out.unionByName(part)
    return out


def latest(df: DataFrame, columns: Sequence[str], time: str = "event_time", key: str = "source_id") -> DataFrame:
    """The newest row per station, by a map-side aggregate instead of a window."""
    picked = F.max_by(F.struct(*columns), F.struct(time, *[c for c in columns if c != time]))
    return df.groupBy(key).agg(picked.alias("_row")).select(key, "_row.*")


def last_rows(df: DataFrame, count: int, keep: Sequence[str], key: str = "source_id") -> DataFrame:
    """The newest ``count`` rows per station of an indexed series (rn, n): a filter, no window."""
    return df.where(F.col("rn") > F.col("n") - count).select(key, "rn", *keep)


def first_rows(df: DataFrame, count: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(count)


def order_inversions(df: DataFrame, time: str, arrival: str, key: str = "source_id") -> DataFrame:
    """Per station, adjacent pairs out of time order, given a gap-free arrival position (join on the next position)."""
    after = df.select(key, (F.col(arrival) - 1).alias(arrival), F.col(time).alias("_next"))
    return df.join(after, [key, arrival], "left").groupBy(key).agg(
        F.count_if(F.col(time) > F.col("_next")).alias("inversions"))


def site_status(states: DataFrame, counters: DataFrame, recent: int = 48, key: str = "source_id") -> DataFrame:
    """Latest state, mean of the recent states and ingest counters per station."""
    newest = states.where(F.col("rn") == F.col("n")).select(key, "event_time", "theta_rz", "depletion_fraction")
    window = last_rows(states, recent, ["theta_rz"], key).groupBy(key).agg(
        F.count(F.lit(1)).alias("recent_states"), F.avg("theta_rz").alias("recent_theta")
    )
    return newest.join(window, key).join(counters, key, "left")


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, layout: Layout = DEFAULT) -> DataFrame:
    """The last ``k`` rows of each key by ``order`` (first a time), with ``back``, 1 for the last.

    Counts of periods of time tell which periods hold them; only the rows of those are ordered, so neither the age of a key
    nor its size matters. Rows without a key or time have no place and are left out.
    """
    placed = df
    for c in [*keys, order[0]]:
        placed = placed.where(F.col(c).isNotNull())
    placed = placed.withColumn("_bucket", time_bucket(order[0], layout))
    counts = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    later = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.desc("_bucket"))) - F.col("_n")
    held = counts.withColumn("_later", later).where(F.col("_later") < k).select(*keys, "_bucket", "_later")
    near = placed.join(held, [*keys, "_bucket"])
    newest = Window.partitionBy(*keys, "_bucket").orderBy(*[F.desc(c) for c in order])
    return near.withColumn("back", F.col("_later") + F.row_number().over(newest)).where(F.col("back") <= k).drop("_bucket", "_later")


SEVERITY_RANK = {"INFO": 1, "WARNING": 2, "CRITICAL": 3}


def station_status(states: DataFrame, forecasts: DataFrame, alerts: DataFrame, order: Sequence[str], recent: int = 48,
                   layout: Layout = DEFAULT) -> DataFrame:
    """Every station that has states: the last one, the mean of the recent ones, its latest forecast and its top alert.

    ``forecasts`` are long rows (source_id, event_time, horizon, point); those of the station's latest origin become a map by horizon.
    ``alerts`` (source_id, event_time, ord, severity, category, threshold_type): the most severe one, of those the latest.
    """
    last = newest_rows(states, ["source_id"], order, recent, layout).groupBy("source_id").agg(
        F.max_by(F.struct("event_time", "theta_rz", "depletion_fraction"), -F.col("back")).alias("_s"), F.count(F.lit(1)).alias("recent_states"),
        F.avg("theta_rz").alias("recent_theta")).select("source_id", "_s.*", "recent_states", "recent_theta")
    origin = forecasts.groupBy("source_id").agg(F.max("event_time").alias("forecast_origin"))
    latest = forecasts.join(origin, "source_id").where(F.col("event_time") == F.col("forecast_origin")).groupBy("source_id", "forecast_origin").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("horizon", "point")))).alias("forecast"))  # one origin's horizons
    weight = F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in SEVERITY_RANK.items()], F.lit(0))
    top = alerts.groupBy("source_id").agg(
        F.max_by(F.struct("severity", "category", "threshold_type", F.col("event_time").alias("time")), F.struct(weight, "event_time", -F.col("ord"))).alias("top_alert"),
        F.count(F.lit(1)).alias("alerts"))
    out = last.join(latest, "source_id", "left").join(top, "source_id", "left")
    return out.withColumn("alerts", F.coalesce("alerts", F.lit(0)))
