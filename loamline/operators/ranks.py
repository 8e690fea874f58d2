"""One sorted, counted table of residuals that answers all quantiles and dispersions of all calibrators.

Counted values are dealt once by (key, bucket of value) and get their rank within the bucket, over all rows and within their group. The
totals of the buckets are small; they tell which buckets hold the wanted ranks, for every calibrator together. Only those are read
again. The median absolute deviation needs no second order of the values either: the totals bound it to a few buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.layout import DEFAULT, Layout
from loamline.stage import stage

ALL = "ALL"


@dataclass(frozen=True)
class Ranks:
    """``rows``: keys, group, _b, _v, _c, _run (ranks in the bucket over all groups) and _own (within the group).
    ``buckets``: keys, group (each and ALL), _b, _n, _before, samples, _s1, _s2 (sums and squares over the whole group)."""

    keys: Sequence[str]
    rows: DataFrame
    buckets: DataFrame
    width: float


def ranks(counted: DataFrame, keys: Sequence[str], value: str, weight: str, group: str, layout: Layout = DEFAULT) -> Ranks:
    """Rank ``counted`` (keys, group, value, weight; each value once per group). Rows with a null key, null or NaN value are left out."""
    keys, width = list(keys), layout.value_width
    present = counted.select(*keys, F.col(group).alias("group"), F.col(value).alias("_v"), F.col(weight).cast("long").alias("_c"))
    for c in [*keys, "group", "_v"]:
        present = present.where(F.col(c).isNotNull())
    present = present.where(~F.isnan("_v")).withColumn("_b", F.floor(F.col("_v") / F.lit(width)).cast("long"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v", "group")
    own = Window.partitionBy(*keys, "_b", "group").orderBy("_v")
    rows = present.repartition(*keys, "_b").withColumns({"_run": F.sum("_c").over(inside), "_own": F.sum("_c").over(own)})
    rows = stage(rows, "ranks")
    each = rows.groupBy(*keys, "group", "_b").agg(
        F.sum("_c").alias("_n"), F.sum(F.col("_v") * F.col("_c")).alias("_x"), F.sum(F.col("_v") * F.col("_v") * F.col("_c")).alias("_y"))
    each = stage(each, "rank-buckets")
    whole = each.groupBy(*keys, "_b").agg(*[F.sum(c).alias(c) for c in ("_n", "_x", "_y")]).withColumn("group", F.lit(ALL))
    both = each.unionByName(whole)
    over = Window.partitionBy(*keys, "group")
    so_far = over.orderBy("_b")
    both = both.select(*keys, "group", "_b", "_n", (F.sum("_n").over(so_far) - F.col("_n")).alias("_before"), F.sum("_n").over(over).alias("samples"),
                       F.sum("_x").over(over).alias("_s1"), F.sum("_y").over(over).alias("_s2"))
    return Ranks(keys, rows, stage(both, "rank-totals"), width)


def _ends(probs: Mapping[str, float]) -> dict[str, tuple[Column, Column]]:
    """Ranks (from 0) that each quantile lies between."""
    at = lambda p: F.lit(p) * (F.col("samples") - 1)
    return {name: (F.floor(at(p)), F.ceil(at(p))) for name, p in probs.items()}


def _interpolated(probs: Mapping[str, float]) -> list[Column]:
    out = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("samples") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return out


def quantiles(r: Ranks, probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per key and group (ALL among them), with ``samples`` and ``std`` (of the population)."""
    keys, ends = list(r.keys), _ends(probs)
    holds = F.lit(False)
    for rank in (x for pair in ends.values() for x in pair):
        holds = holds | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n")))
    wanted = stage(r.buckets.where(holds), "rank-wanted")
    near = r.rows.join(wanted.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
    # a row takes part with its rank among all, and with that within its group
    views = F.array(F.struct(F.lit(ALL).alias("group"), F.col("_run").alias("_end")), F.struct(F.col("group").alias("group"), F.col("_own").alias("_end")))
    near = near.select(*keys, "_b", "_v", "_c", F.inline(views))
    ranked = near.join(wanted, [*keys, "group", "_b"]).withColumn("_end", F.col("_before") + F.col("_end"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end")), F.col("_v")))

    picked = ranked.groupBy(*keys, "group", "samples", "_s1", "_s2").agg(
        *[at(low).alias(f"_lo_{name}") for name, (low, _) in ends.items()], *[at(high).alias(f"_hi_{name}") for name, (_, high) in ends.items()])
    mean = F.col("_s1") / F.col("samples")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_s2") / F.col("samples") - mean * mean))
    return picked.select(*keys, "group", "samples", std.alias("std"), *_interpolated(probs))


def deviations(r: Ranks) -> DataFrame:
    """Per key and group: population deviation ``std`` and ``samples``, from the totals alone."""
    one = r.buckets.groupBy(*r.keys, "group").agg(*[F.max(c).alias(c) for c in ("samples", "_s1", "_s2")])
    mean = F.col("_s1") / F.col("samples")
    return one.select(*r.keys, "group", "samples", F.sqrt(F.greatest(F.lit(0.0), F.col("_s2") / F.col("samples") - mean * mean)).alias("std"))


def median_deviation(r: Ranks, center: DataFrame, bias: str = "bias") -> DataFrame:
    """keys, ``bias`` and ``mad``, the median of |value - bias| over all groups; ``center`` has ``bias`` per key.

    A bucket's values deviate by some amount between its nearest and its farthest end. In the order of the farthest ends the middle
    rank is reached at an upper bound of the median; in the order of the nearest ends, at a lower bound. Only buckets that reach into these
    bounds are read; those wholly below are counted.
    """
    keys = list(r.keys)
    low, high = F.col("_b") * F.lit(r.width), (F.col("_b") + 1) * F.lit(r.width)
    # the ends are widened by a little, so that rounding of value / width puts no value outside its bucket
    slack = F.lit(r.width * 1e-6)
    spans = r.buckets.where(F.col("group") == ALL).join(center.select(*keys, bias), keys).withColumns({
        "_near": F.greatest(F.lit(0.0), low - F.col(bias), F.col(bias) - high) - slack,
        "_far": F.greatest(F.abs(low - F.col(bias)), F.abs(high - F.col(bias))) + slack,
        "_ranks": F.lit(0.5) * (F.col("samples") - 1)})
    spans = spans.withColumns({
        "_by_near": F.sum("_n").over(Window.partitionBy(*keys).orderBy("_near")), "_by_far": F.sum("_n").over(Window.partitionBy(*keys).orderBy("_far"))})
    over = Window.partitionBy(*keys)
    spans = spans.withColumns({
        "_least": F.min(F.when(F.col("_by_near") > F.floor("_ranks"), F.col("_near"))).over(over),
        "_most": F.min(F.when(F.col("_by_far") > F.ceil("_ranks"), F.col("_far"))).over(over)})
    below = F.col("_far") < F.col("_least")
    spans = spans.withColumn("_sure", F.sum(F.when(below, F.col("_n")).otherwise(0)).over(over))
    wanted = spans.where(~below & (F.col("_near") <= F.col("_most"))).select(*keys, "_b", bias, "samples", "_sure")
    near = r.rows.join(wanted, [*keys, "_b"]).withColumn("_d", F.abs(F.col("_v") - F.col(bias)))
    counted = near.groupBy(*keys, bias, "samples", "_sure", "_d").agg(F.sum("_c").alias("_c"))
    ranked = counted.withColumn("_end", F.col("_sure") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_d")))
    (low_rank, high_rank), = _ends({"mad": 0.5}).values()
    at = lambda rank: F.max(F.when((F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end")), F.col("_d")))
    picked = ranked.groupBy(*keys, bias, "samples").agg(at(low_rank).alias("_lo_mad"), at(high_rank).alias("_hi_mad"))
    return picked.select(*keys, bias, *_interpolated({"mad": 0.5}))
