"""Point forecasts without regression, and forecast rows with intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.water import clip
from loamline.layout import DEFAULT, Layout
from loamline.operators.running import block_of, running, with_halo
from loamline.operators.series import KEYS

# Forecast targets with their column, bounds and unit.
TARGET_SPECS = {
    "volumetric_water_content": ("theta_rz", 0.0, 0.6, "m3/m3"),
    "root_zone_depletion_fraction": ("depletion_fraction", -0.5, 1.5, "fraction"),
    "root_zone_storage_mm": ("storage_mm", 0.0, 600.0, "mm"),
    "fraction_of_available_water": ("available_water_fraction", -0.5, 1.5, "fraction"),
}
QUANTILE_NAMES = ["q10", "q25", "q50", "q75", "q90"]
SUPPORTED_HOURS = 48


def target(df: DataFrame, name: str) -> DataFrame:
    """Rename the target's column to ``y`` and add its unit."""
    column, _, _, unit = TARGET_SPECS[name]
    return df.withColumn("y", F.col(column)).withColumn("unit", F.lit(unit))


def bounds_of(name: str) -> tuple[float, float]:
    return TARGET_SPECS[name][1:3]


def fan_out(df: DataFrame, horizons: Sequence[int], time: str = "event_time") -> DataFrame:
    """One row per origin and horizon with the valid time."""
    return with_valid_time(df.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))), time)


def with_valid_time(rows: DataFrame, time: str = "event_time") -> DataFrame:
    """Forecast rows with the time they are for, and whether their horizon is supported."""
    return rows.withColumn("valid_time", F.col(time) + F.make_dt_interval(hours=F.col("horizon"))).withColumn(
        "support", F.when(F.col("horizon") <= SUPPORTED_HOURS, "SUPPORTED").otherwise("RESEARCH")
    )


def with_intervals(df: DataFrame, spread: Column, bounds: tuple[float, float], point: str = "point") -> DataFrame:
    """Quantile columns clip(point + residual quantile); without calibration they equal the point."""
    q = {name: clip(F.col(point) + F.coalesce(spread[name], F.lit(0.0)), *bounds) for name in QUANTILE_NAMES}
    return df.withColumns(q).withColumns({"lower_80": F.col("q10"), "upper_80": F.col("q90")})


def expanding_mean(df: DataFrame, keys: Sequence[str] = KEYS, bounds: tuple[float, float] = (0.0, 0.6),
                   layout: Layout = DEFAULT) -> DataFrame:
    """``point``: mean of all values up to the origin, clipped; the middle of the bounds before the first value."""
    blocks = with_halo(df, layout=layout).drop("core").withColumn("_one", F.col("y").isNotNull().cast("long"))
    sums = running(blocks, keys, {"_s": ("sum", "y"), "_k": ("sum", "_one")})
    mean = F.when(F.col("_k") > 0, F.col("_s") / F.nullif(F.col("_k"), F.lit(0)))
    return sums.withColumn("point", clip(F.coalesce(mean, F.lit(sum(bounds) / 2)), *bounds)).drop("_s", "_k", "_one")


def ewma_reach(alpha: float) -> int:
    """Rows after which an older value weighs less than 1e-17."""
    return math.ceil(math.log(1e-17) / math.log(1.0 - alpha))


def ewma_scan(alpha: float, digits: float = 200.0) -> int:
    """Rows that are scanned together: few enough that the weights of the first and the last stay doubles."""
    return int(min(4096, max(1, digits / -math.log10(1.0 - alpha))))


def ewma(df: DataFrame, alpha: float, keys: Sequence[str] = KEYS, bounds: tuple[float, float] = (0.0, 0.6),
         seeds: DataFrame | None = None, layout: Layout = DEFAULT) -> DataFrame:
    """``point``: exponentially weighted level up to the origin, clipped; ``y`` must be non-null.

    The level starts at the first value, or at the series' ``seed`` (one row per key with its ``n``).

    A row maps the level x to alpha * y + (1 - alpha) * x. Maps compose, so a stretch of rows is one map, and its level is a
    sum of decayed values plus the decayed level before it. Rows are summed within stretches; of the stretches before only
    those within the reach still count in a double, and their maps are added up. No list of values is kept.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    decay, size = 1.0 - alpha, ewma_scan(alpha)
    back = -(-ewma_reach(alpha) // size)
    stretch = F.floor((F.col("rn") - 1) / F.lit(size)).cast("long")
    # a value's weight in the frame of its stretch's first row
    scaled = F.col("y") * F.lit(alpha) * F.pow(F.lit(decay), -F.col("_at"))
    placed = df.withColumns({"block": block_of("rn", layout), "_stretch": stretch}).withColumn("_at", (F.col("rn") - 1) % size)
    rows = placed.withColumn("_sum", F.sum(scaled).over(Window.partitionBy(*keys, "_stretch").orderBy("rn")))
    at = F.col("_at")
    level = F.col("_sum") * F.pow(F.lit(decay), at) + F.col("_carry") * F.pow(F.lit(decay), at + 1)
    if layout.whole:
        # the stretches before are summed where the rows are
        carry = F.lit(0.0)
        for k in range(1, back + 1):
            total = F.sum(scaled).over(Window.partitionBy(*keys).orderBy("_stretch").rangeBetween(-k, -k))
            carry = carry + F.coalesce(total, F.lit(0.0)) * F.lit(decay ** (k * size - 1))
        seed = F.max(F.when(F.col("rn") == 1, F.col("y"))).over(Window.partitionBy(*keys))
        if seeds is not None:
            given = seeds.groupBy(keys[0]).agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*keys[1:]), "seed"))).alias("_given"))
            rows = rows.join(given.hint("merge"), keys[0], "left")
            seed = F.coalesce(F.col("_given")[F.struct(*keys[1:])], seed)
        later = F.coalesce(seed * F.pow(F.lit(decay), F.col("_stretch") * size), F.lit(0.0))
        first = F.when(F.col("_stretch") == 0, seed).when(F.col("_stretch") <= back, later).otherwise(0.0)
        done = rows.withColumn("_carry", carry + first).withColumn("point", clip(level, *bounds))
        return done.drop("_stretch", "_at", "_sum", "_carry", "_given")

    totals = placed.groupBy(*keys, "_stretch").agg(F.sum(scaled).alias("_t"), F.max(F.when(F.col("rn") == 1, F.col("y"))).alias("_first"))
    later = totals.select(*keys, "_t", "_stretch", F.explode(F.sequence(F.lit(1), F.lit(back))).alias("_ahead"))
    # the level a full stretch leaves behind, seen from the start of a later one
    later = later.select(*keys, (F.col("_stretch") + F.col("_ahead")).alias("_stretch"), (F.col("_t") * F.pow(F.lit(decay), F.col("_ahead") * size - 1)).alias("_c"))
    start = totals.where("_stretch = 0").select(*keys, F.col("_first").alias("_seed"))
    if seeds is not None:
        start = start.join(seeds.select(*keys, "seed"), list(keys), "left").withColumn("_seed", F.coalesce("seed", "_seed")).drop("seed")
    start = start.select(*keys, "_seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(back).cast("long"))).alias("_stretch"))
    start = start.select(*keys, "_stretch", (F.col("_seed") * F.pow(F.lit(decay), F.col("_stretch") * size)).alias("_c"))
    carry = later.unionByName(start).groupBy(*keys, "_stretch").agg(F.sum("_c").alias("_carry"))

    joined = rows.join(carry.hint("merge"), [*keys, "_stretch"])
    return joined.withColumn("point", clip(level, *bounds)).drop("_stretch", "_at", "_sum", "_carry")


def last_train_values(df: DataFrame) -> DataFrame:
    """Seed of each test series: the value of the last train row, with the test length."""
    last = df.where(F.col("is_train") & (F.col("rn") == F.col("n")))
    return last.select(
        "source_id",
        F.when(F.col("is_train"), F.lit("test")).alias("split"),
        F.col("y").alias("seed"),
        (F.col("n_all") - F.col("n")).alias("n"),
    )


def safe_route(df: DataFrame, primary: str = "primary", fallback: str = "persistence") -> DataFrame:
    """Primary forecast where there is one, else persistence, with a marker."""
    failed = F.col(primary).isNull() | F.isnan(primary)
    return df.withColumns({
        "point": F.when(failed, F.col(fallback)).otherwise(F.col(primary)),
        "used_fallback": failed,
    })


def model_hook(df: DataFrame, predict, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Run a user model on (key, block) groups; a failing group gives null ``primary`` and so the fallback.

    ``predict`` takes a pandas frame and returns one value per row. Groups are the series' blocks, so their size
    is bounded by the layout.
    """
    base = df.select(*keys, "block", "rn", *columns)
    schema = base.withColumn("primary", F.lit(None).cast("double")).schema

    def run(pdf):
        try:
            pdf["primary"] = [None if v is None else float(v) for v in predict(pdf)]
        except Exception:
            pdf["primary"] = None
        pdf["primary"] = pdf["primary"].astype("float64")
        return pdf

    return base.groupBy(*keys, "block").applyInPandas(run, schema)


def forecast_events(rows: DataFrame, model: str, version: str = "1.0.0", target_name: str = "volumetric_water_content",
                    seed: int = 42) -> DataFrame:
    """One event per origin with its predictions ordered by horizon and rounded to four decimals."""
    r = lambda c: F.round(c, 4).alias(c)
    prediction = F.struct(
        "horizon", "valid_time", F.round("point", 4).alias("point_forecast"), *[r(q) for q in QUANTILE_NAMES],
        r("lower_80"), r("upper_80"),
    )
    return rows.groupBy("source_id", F.col("event_time").alias("origin_time"), "rn").agg(
        F.array_sort(F.collect_list(prediction)).alias("predictions")
    ).select(
        F.lit("1.0.0").alias("schema_version"),
        F.sha2(F.concat_ws("|", F.col("source_id").cast("string"), F.col("origin_time").cast("string"),
                           F.col("rn").cast("string"), F.lit(model)), 256).alias("forecast_id"),
        "source_id",
        "origin_time",
        F.lit(target_name).alias("target_variable"),
        F.array(F.lit(0.0), F.lit(100.0)).alias("depth_range_cm"),
        F.struct(F.lit(model).alias("model_name"), F.lit(version).alias("model_version"),
                 F.lit(seed).alias("random_seed")).alias("model"),
        "predictions",
    )
