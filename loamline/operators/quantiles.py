"""Exact quantiles of large groups.

``percentile`` keeps a whole group in one buffer. Here equal values are first counted on the map side, then a
group is cut into value buckets; bucket totals tell which buckets hold the wanted ranks, and only those are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.layout import DEFAULT, Layout


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    layout: Layout = DEFAULT,
    width: float | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per key, plus ``samples`` and ``mean``; null and NaN values are left out.

    With ``weight``, a row stands for that many equal values. In a ``whole`` layout a key's rows are ordered in one task, where they lie.
    """
    keys = list(keys)
    if layout.whole:
        return whole_quantiles(df, keys, value, probs, weight)
    bucket = F.floor(F.col("_v") / F.lit(width or layout.value_width)).cast("long")
    # The bucket and the null tests are set before counting, so that both uses below share one shuffle.
    present = df
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    counted = (
        present.select(*keys, F.col(value).alias("_v"), (F.col(weight) if weight else F.lit(1)).alias("_w"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .withColumn("_b", bucket)
        .where(F.col("_b").isNotNull())
        .groupBy(*keys, "_b", "_v")
        .agg(F.sum("_w").alias("_c"))
    )
    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    totals = (
        counted.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_bc"), F.sum(F.col("_v") * F.col("_c")).alias("_bs"))
        .select(
            *keys,
            "_b",
            "_bc",
            F.sum("_bs").over(Window.partitionBy(*keys)).alias("_sum"),
            (F.sum("_bc").over(by_bucket) - F.col("_bc")).alias("_before"),
            F.sum("_bc").over(Window.partitionBy(*keys)).alias("samples"),
        )
    )
    low = {name: F.floor(F.lit(p) * (F.col("samples") - 1)) for name, p in probs.items()}
    high = {name: F.ceil(F.lit(p) * (F.col("samples") - 1)) for name, p in probs.items()}
    holds = F.lit(False)
    for rank in [*low.values(), *high.values()]:
        holds = holds | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_bc")))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    ranked = (
        counted.join(totals.where(holds).drop("_bc").hint("merge"), [*keys, "_b"])
        .withColumn("_end", F.col("_before") + F.sum("_c").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )

    def at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    picked = ranked.groupBy(*keys).agg(
        F.max("samples").alias("samples"),
        F.max("_sum").alias("_sum"),
        *[at(low[name]).alias(f"_lo_{name}") for name in probs],
        *[at(high[name]).alias(f"_hi_{name}") for name in probs],
    )
    return picked.select(*keys, "samples", (F.col("_sum") / F.col("samples")).alias("mean"), *_interpolated(probs))


def _interpolated(probs: Mapping[str, float]) -> list[Column]:
    out = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("samples") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out


def placed_values(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Rows with a key and a value (``_v``, of ``_w`` equal ones), with the rank ``_end`` up to which it reaches in its key's ``samples``."""
    keys = list(keys)
    present = df.withColumns({"_v": F.col(value), "_w": (F.col(weight) if weight else F.lit(1)).cast("long")})
    present = present.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    over = Window.partitionBy(*keys)
    so_far = over.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return present.withColumns({"_end": F.sum("_w").over(so_far), "samples": F.sum("_w").over(over)})


def value_at(rank: Column) -> Column:
    """The value that holds a rank (from 0), of rows of ``placed_values``; null in the others."""
    return F.when((F.col("_end") - F.col("_w") <= rank) & (rank < F.col("_end")), F.col("_v"))


def whole_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], weight: str | None = None,
                    std: bool = False) -> DataFrame:
    """``exact_quantiles`` for keys whose rows fit one task, and the population deviation if wanted."""
    at = lambda rank: F.max(value_at(rank))
    position = {name: F.lit(p) * (F.col("samples") - 1) for name, p in probs.items()}
    used = df.select(*keys, F.col(value).alias("_value"), (F.col(weight) if weight else F.lit(1)).alias("_weight"))
    picked = placed_values(used, keys, "_value", "_weight").groupBy(*keys, "samples").agg(
        F.sum(F.col("_v") * F.col("_w")).alias("_sum"), F.sum(F.col("_v") * F.col("_v") * F.col("_w")).alias("_square"),
        *[at(F.floor(x)).alias(f"_lo_{name}") for name, x in position.items()], *[at(F.ceil(x)).alias(f"_hi_{name}") for name, x in position.items()])
    mean = F.col("_sum") / F.col("samples")
    spread = [F.sqrt(F.greatest(F.lit(0.0), F.col("_square") / F.col("samples") - mean * mean)).alias("std")] if std else []
    return picked.select(*keys, "samples", mean.alias("mean"), *spread, *_interpolated(probs))


def with_median(df: DataFrame, keys: Sequence[str], value: str, name: str, weight: str | None = None) -> DataFrame:
    """Rows that have a key and a value, with the key's median, for keys whose rows fit one task; nothing is moved if they lie together."""
    over = Window.partitionBy(*keys)
    at = F.lit(0.5) * (F.col("samples") - 1)
    placed = placed_values(df, keys, value, weight)
    ends = placed.withColumns({f"_lo_{name}": F.max(value_at(F.floor(at))).over(over), f"_hi_{name}": F.max(value_at(F.ceil(at))).over(over)})
    median, = _interpolated({name: 0.5})
    return ends.withColumn(name, median).drop("_v", "_w", "_end", "samples", f"_lo_{name}", f"_hi_{name}")
