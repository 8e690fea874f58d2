"""Tier-1 quality control of sensor readings.

Two forms with the same rules. ``check_wide`` takes one row per event with a column per channel and needs no
explode: it is the fast path for station files. ``check_long`` takes one row per reading, so that absent sensors and
injected faults (which leave no trace in a sensor's history) are handled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.layout import DEFAULT, Layout
from loamline.operators.running import block_of, block_window, core_rows, deal, index_rows, running
from loamline.schemas import CHANNELS, HARD_FLAGS, PHYSICAL_LIMITS

MAX_DRY_DELTA = 0.15
RAIN_EXPLAINS = 0.2
STUCK_STEPS = 12
STUCK_TOLERANCE = 1e-5
DEEP_CM = 20.0
DEEP_STEPS = 48
MOISTURE = "volumetric_water_content"
EXEMPT_AT_ZERO = ["precipitation", "solar_radiation"]


def range_flag(value: Column, variable: Column) -> Column:
    """MISSING, OUT_OF_RANGE or VALID; limits are inclusive and an unknown variable has none."""
    outside = F.lit(False)
    for name, (low, high) in PHYSICAL_LIMITS.items():
        outside = outside | ((variable == name) & ((value < low) | (value > high)))
    return (
        F.when(value.isNull(), F.lit("MISSING")).when(outside, F.lit("OUT_OF_RANGE")).otherwise(F.lit("VALID"))
    )


def spike(value: Column, previous: Column, rain: Column, max_dry_delta: float = MAX_DRY_DELTA) -> Column:
    """A jump above the limit that no rain explains; false when either value is missing."""
    jump = F.abs(value - previous) > F.lit(max_dry_delta)
    return F.coalesce(jump & ~(rain > RAIN_EXPLAINS), F.lit(False))


def stuck(count: Column, low: Column, high: Column, oldest: Column, variable: Column, depth: Column,
          steps: int = STUCK_STEPS) -> Column:
    """All values of the window present and within tolerance of the oldest one."""
    flat = (count == steps) & (high - oldest <= STUCK_TOLERANCE) & (oldest - low <= STUCK_TOLERANCE)
    calm = variable.isin(EXEMPT_AT_ZERO) & (oldest == 0.0)
    deep = (depth >= DEEP_CM) & F.lit(steps < DEEP_STEPS)
    return F.coalesce(flat & ~calm & ~deep, F.lit(False))


def combine(base: Column, variable: Column, is_spike: Column, is_stuck: Column) -> Column:
    """First rule that fires wins: range, then spike (moisture only), then stuck."""
    return (
        F.when(base != "VALID", base)
        .when((variable == MOISTURE) & is_spike, F.lit("SUSPECT_SPIKE"))
        .when(is_stuck, F.lit("SUSPECT_STUCK"))
        .otherwise(F.lit("VALID"))
    )


def channels_of(df: DataFrame):
    return [c for c in CHANNELS if c[0] in df.columns]


def check_wide(df: DataFrame, order: Sequence[str], layout: Layout = DEFAULT, key: str = "source_id",
               steps: int = STUCK_STEPS, dealt: tuple[DataFrame, DataFrame | None] | None = None) -> DataFrame:
    """Add ``flag_<channel>``, ``rain_last``, ``flag_count`` and ``quarantined`` to wide station rows.

    Also adds the event's position ``rn`` of ``n`` and its ``block``. ``dealt`` may give the rows as ``deal`` does, with ``steps - 1`` before.
    """
    channels = channels_of(df)
    rows, few = dealt or deal(df, [key], order, layout, before=steps - 1)
    has_rain = "precip_mm" in df.columns
    rows = rows if has_rain else rows.withColumn("precip_mm", F.lit(None).cast("double"))
    # The copies at the head of a block only repeat rows of the block before it, so the carried value is unchanged.
    rows = running(rows, [key], {"rain_last": ("last", "precip_mm")}, few=few)
    w = block_window([key])
    frame = w.rowsBetween(-(steps - 1), 0)
    context = {}
    for col, *_ in channels:
        context[f"_prev_{col}"] = F.lag(col, 1).over(w)
        context[f"_n_{col}"] = F.count(col).over(frame)
        context[f"_lo_{col}"] = F.min(col).over(frame)
        context[f"_hi_{col}"] = F.max(col).over(frame)
        context[f"_old_{col}"] = F.first(col).over(frame)
    seen = rows.withColumns(context)
    rain = F.coalesce(F.col("rain_last"), F.lit(0.0))
    flags = {}
    for col, _, variable, depth, _ in channels:
        value, name = F.col(col), F.lit(variable)
        flags[f"flag_{col}"] = combine(
            range_flag(value, name),
            name,
            spike(value, F.col(f"_prev_{col}"), rain),
            stuck(F.col(f"_n_{col}"), F.col(f"_lo_{col}"), F.col(f"_hi_{col}"), F.col(f"_old_{col}"), name,
                  F.lit(depth), steps),
        )
    out = core_rows(seen.withColumns(flags)).drop(*context)
    names = list(flags)
    raised = sum((F.when(F.col(f) != "VALID", 1).otherwise(0) for f in names), F.lit(0))
    hard = F.lit(False)
    for f in names:
        hard = hard | F.col(f).isin(HARD_FLAGS)
    out = out.withColumns({"rain_last": rain, "flag_count": raised, "quarantined": hard})
    return out if has_rain else out.drop("precip_mm")


def usable_moisture(flagged: DataFrame) -> DataFrame:
    """Keep moisture values with a VALID flag, null the others."""
    return flagged.withColumns({
        col: F.when(F.col(f"flag_{col}") == "VALID", F.col(col))
        for col, _, variable, _, _ in channels_of(flagged)
        if variable == MOISTURE
    })


def to_readings(df: DataFrame, keep: Sequence[str], flagged: bool = False) -> DataFrame:
    """Wide rows -> one row per channel, in emission order ``ord``; nulls are flagged MISSING."""
    parts = []
    for i, (col, sensor, variable, depth, unit) in enumerate(channels_of(df)):
        flag = F.col(f"flag_{col}") if flagged else F.when(F.col(col).isNull(), "MISSING").otherwise("VALID")
        parts.append(F.struct(
            F.lit(i).alias("ord"), F.lit(sensor).alias("sensor_id"), F.lit(variable).alias("variable_name"),
            F.lit(depth).alias("depth_cm"), F.col(col).cast("double").alias("value"), F.lit(unit).alias("unit"),
            flag.alias("qc_flag"),
        ))
    return df.select(*keep, F.inline(F.array(*parts)))


def check_long(readings: DataFrame, order: Sequence[str], layout: Layout = DEFAULT, key: str = "source_id",
               steps: int = STUCK_STEPS, position: str | None = None, dealt: DataFrame | None = None) -> DataFrame:
    """Flag readings (source, time order, ord, sensor, variable, depth, value, unit, qc_flag).

    Readings already SYNTHETIC_CORRUPTED keep their flag and are left out of their sensor's history, but an
    injected rain value still counts as the last known rain. Adds the event's position ``event_rn`` unless the
    readings have one. ``position`` names a column that numbers a station's events from 1, so that they aren't numbered again.

    All windows of a reading are inside (key, block of events): readings are moved once. ``dealt`` may give the same readings
    dealt by key and ``event_block``, from rows that were dealt before they were exploded; it keeps that column.
    """
    at = "_event_rn" if "event_rn" in readings.columns else "event_rn"
    whole = [key, *order]
    placed = lambda df: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in whole)).withColumn(at, F.col(position).cast("long"))
    if position:
        rows = placed(readings).withColumn("event_block", block_of(at, layout))
    else:
        events = index_rows(readings.select(*whole).distinct(), [key], order, layout, rn=at, n="_n").drop("_n")
        rows = readings.join(events, whole).withColumn("event_block", block_of(at, layout))
    main = rows if dealt is None else placed(dealt)
    by_block = [key, "event_block"]
    rain = F.when((F.col("variable_name") == "precipitation") & F.col("value").isNotNull(), F.struct(at, "ord", "value"))
    totals = rows.groupBy(*by_block).agg(F.max(rain).alias("_rain"), F.count(F.lit(1)).alias("_rows"))
    of_key = Window.partitionBy(key)
    blocks = totals.withColumns({
        "_carry": F.max("_rain").over(of_key.orderBy("event_block").rowsBetween(Window.unboundedPreceding, -1)),
        "_blocks": F.count(F.lit(1)).over(of_key)}).where("_blocks > 1")
    so_far = Window.partitionBy(*by_block).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = main.withColumn("_rain", F.max(rain).over(so_far)).join(blocks.select(*by_block, "_carry").hint("merge"), by_block, "left")
    known = known.withColumn("rain_last", F.coalesce("_rain.value", "_carry.value", F.lit(0.0))).drop("_rain", "_carry")

    # Whatever was injected stands in windows of its own.
    marked = lambda df: df.withColumn("_fixed", F.col("qc_flag") == "SYNTHETIC_CORRUPTED").where(
        F.col("_fixed") | (~F.col("_fixed") & F.col("sensor_id").isNotNull()))
    live = marked(known).withColumn("core", F.lit(True))
    before = _before_blocks(marked(rows).where("NOT _fixed"), blocks, key, at, steps - 1)
    w = Window.partitionBy(*by_block, "sensor_id", "_fixed").orderBy(at, "ord")
    frame = w.rowsBetween(-(steps - 1), 0)
    seen = live.unionByName(before.repartition(*by_block), allowMissingColumns=True).withColumns({
        "_prev": F.lag("value", 1).over(w),
        "_cnt": F.count("value").over(frame),
        "_lo": F.min("value").over(frame),
        "_hi": F.max("value").over(frame),
        "_old": F.first("value").over(frame),
    })
    variable = F.col("variable_name")
    flag = combine(
        range_flag(F.col("value"), variable),
        variable,
        spike(F.col("value"), F.col("_prev"), F.col("rain_last")),
        stuck(F.col("_cnt"), F.col("_lo"), F.col("_hi"), F.col("_old"), variable, F.col("depth_cm"), steps),
    )
    checked = core_rows(seen.withColumn("qc_flag", F.when(F.col("_fixed"), F.col("qc_flag")).otherwise(flag)))
    return checked.select(*readings.columns, *([at] if at == "event_rn" else []), "rain_last",
                          *(["event_block"] if dealt is not None else []))


def _before_blocks(live: DataFrame, blocks: DataFrame, key: str, at: str, reach: int) -> DataFrame:
    """The last ``reach`` readings of each sensor before each block of events, with that block as ``event_block`` and not ``core``.

    ``blocks`` has the blocks of the keys with several, at most the events over the block size. A sensor may be absent for blocks.
    """
    backwards = Window.partitionBy(key, "event_block", "sensor_id").orderBy(F.desc(at), F.desc("ord"))
    near = live.join(F.broadcast(blocks.select(key, "event_block")), [key, "event_block"])
    near = near.withColumn("_back", F.row_number().over(backwards)).where(F.col("_back") <= reach)
    after = Window.partitionBy(key, "sensor_id").orderBy(at, "ord").rowsBetween(1, reach)
    later = F.array_except(F.collect_set("event_block").over(after), F.array("event_block"))
    near = near.withColumn("_later", later).withColumn("event_block", F.explode("_later"))
    return near.drop("_back", "_later").withColumn("core", F.lit(False))


def reason_text(steps: int = STUCK_STEPS) -> Column:
    """Why a reading failed; null for MISSING and VALID."""
    f, s = F.col("qc_flag"), F.col("sensor_id")
    return (
        F.when(f == "SYNTHETIC_CORRUPTED", F.concat(F.lit("injected fault on "), s))
        .when(f == "OUT_OF_RANGE", F.concat(F.lit("outside physical limits: "), s, F.lit(" = "),
                                            F.format_string("%.4f", F.col("value")), F.lit(" "), F.col("unit")))
        .when(f == "SUSPECT_SPIKE", F.concat(F.lit("dry jump above 0.15 on "), s))
        .when(f == "SUSPECT_STUCK", F.concat(F.lit("flat for "), F.lit(str(steps)), F.lit(" steps: "), s))
    )


def summarise_events(flagged: DataFrame, event: Sequence[str]) -> DataFrame:
    """Per event: flag count (MISSING included), quarantine, all-valid, joined reasons and the first failed reading."""
    hard = F.col("qc_flag").isin(HARD_FLAGS)
    reasons = F.array_sort(F.collect_list(F.when(hard, F.struct("ord", reason_text().alias("text")))))
    first = F.min_by(F.struct("value", "unit"), F.when(hard, F.col("ord")))
    return flagged.groupBy(*event).agg(
        F.count_if(F.col("qc_flag") != "VALID").alias("flag_count"),
        F.bool_or(hard).alias("quarantined"),
        F.array_join(F.transform(reasons, lambda r: r["text"]), "; ").alias("failure_reason"),
        F.bool_or(F.col("qc_flag") == "SUSPECT_STUCK").alias("any_stuck"),
        first.alias("_first"),
    ).select(
        *event, "flag_count", "quarantined", (F.col("flag_count") == 0).alias("all_valid"), "failure_reason",
        "any_stuck", F.coalesce(F.col("_first.value"), F.lit(0.0)).alias("trigger_value"),
        F.coalesce(F.col("_first.unit"), F.lit("unitless")).alias("trigger_unit"),
    )


def quarantine_alerts(events: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One critical data-quality alert per quarantined event."""
    return events.where("quarantined").select(
        *keep,
        F.lit("DATA_QUALITY_ALERT").alias("category"),
        F.lit("CRITICAL").alias("severity"),
        F.when(F.col("any_stuck"), "SENSOR_STUCK_VALUE").otherwise("SENSOR_OUT_OF_RANGE").alias("threshold_type"),
        F.col("trigger_value").alias("threshold_value"),
        F.col("trigger_unit").alias("threshold_unit"),
        F.col("failure_reason").alias("reason"),
    )


def wide_quarantine(flagged: DataFrame) -> DataFrame:
    """The event summary of ``check_wide`` rows, column-wise: stuck marker, first failed value, reasons."""
    stuck_any = F.lit(False)
    failed, texts = [], []
    for col, sensor, _, _, unit in channels_of(flagged):
        f = F.col(f"flag_{col}")
        hard = f.isin(HARD_FLAGS)
        stuck_any = stuck_any | (f == "SUSPECT_STUCK")
        failed.append(F.when(hard, F.struct(F.col(col).cast("double").alias("value"), F.lit(unit).alias("unit"))))
        texts.append(F.when(hard, F.concat(f, F.lit(" "), F.lit(sensor))))
    return flagged.withColumns({
        "any_stuck": stuck_any,
        "_first": F.get(F.array_compact(F.array(*failed)), 0),
        "failure_reason": F.array_join(F.array_compact(F.array(*texts)), "; "),
    }).withColumns({
        "trigger_value": F.coalesce(F.col("_first.value"), F.lit(0.0)),
        "trigger_unit": F.coalesce(F.col("_first.unit"), F.lit("unitless")),
    }).drop("_first")
