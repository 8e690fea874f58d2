"""Row numbers, halo blocks and running aggregates over ordered series, without one task per key.

Every function keeps the same contract: a key may own any share of the table and still be spread over
(key, bucket) or (key, block) partitions. Only the per-bucket totals of a key meet in one task; their number is
the time range over the bucket width, or the key's rows over the block size. Totals come back by a merge join on
the window's own keys: the rows are already shuffled and sorted that way, so the join moves only the totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.layout import DEFAULT, Layout
from loamline.stage import stage


def time_bucket(time_col: str, layout: Layout = DEFAULT) -> Column:
    """A value that never decreases with time: whole periods of ``bucket_seconds`` since 1970-01-01."""
    seconds = F.col(time_col).cast("timestamp").cast("long")
    return F.floor(seconds / F.lit(layout.bucket_seconds)).cast("long")


def index_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    layout: Layout = DEFAULT,
    rn: str = "rn",
    n: str = "n",
    bucket: str | None = None,
    rank: str | None = None,
) -> DataFrame:
    """Add the 1-based position ``rn`` of each row in its key and the key's row count ``n``.

    Rows are numbered inside a bucket, then shifted by the count of the earlier buckets. The bucket is the period
    of the time ``order[0]``, or a given column that never decreases along the order: with the ``block`` of an
    earlier window, the rows are renumbered without another shuffle. ``rank`` names a column for the position that rows
    equal in the order share.
    """
    keys = list(keys)
    if layout.whole and not bucket:
        for c in keys:
            df = df.where(F.col(c).isNotNull())
        inside = Window.partitionBy(*keys).orderBy(*order)
        placed = df.withColumns({rn: F.row_number().over(inside).cast("long"), n: F.count(F.lit(1)).over(Window.partitionBy(*keys))})
        if rank:
            placed = placed.withColumn(rank, F.rank().over(inside).cast("long"))
        # rows without a time come first: they are left out here, but count
        return placed.where(F.col(order[0]).isNotNull())
    bucketed = df.withColumn("_bucket", F.col(bucket) if bucket else time_bucket(order[0], layout))
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = counts.select(
        *keys,
        "_bucket",
        (F.sum("_c").over(by_bucket) - F.col("_c")).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias(n),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = bucketed.withColumn("_inside", F.row_number().over(inside))
    if rank:
        numbered = numbered.withColumn("_ranked", F.rank().over(inside))
    placed = numbered.join(offsets.hint("merge"), [*keys, "_bucket"]).withColumn(rn, F.col("_before") + F.col("_inside"))
    if rank:
        placed = placed.withColumn(rank, F.col("_before") + F.col("_ranked")).drop("_ranked")
    return placed.drop("_bucket", "_before", "_inside")


def deal(df: DataFrame, keys: Sequence[str], order: Sequence[str], layout: Layout = DEFAULT, before: int = 0, after: int = 0,
         bucket: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows with their position ``rn`` of ``n`` and a ``block``, moved once: numbering and later windows per (key, block) share it. Beside
    them the keys of several blocks, None if there are none, as ``running`` and ``previous`` take them.

    A key of at most ``block_rows`` rows is block 0. A longer one is cut between buckets (as in ``index_rows``) about every ``block_rows``
    rows; keys are counted at once, and the cuts of the long ones (by bucket) are written and broadcast. As in ``with_halo``, the rows ``before`` and
    ``after`` each block are copied to it, with ``core`` false. Rows without a key or bucket are left out; as in
    ``index_rows``, those without a bucket still count before the others.
    """
    keys = list(keys)
    at = F.col(bucket) if bucket else time_bucket(order[0], layout)
    placed = df.withColumn("_placed", at.isNotNull()).withColumn("_bucket", F.coalesce(at, F.lit(-(2**63)).cast("long"))).drop("block")
    for c in keys:
        placed = placed.where(F.col(c).isNotNull())
    order = ["_placed", *order]
    here = [*keys, "block"]
    inside = Window.partitionBy(*here)
    many = stage(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > layout.block_rows), "long-keys")
    if many.isEmpty():
        rows = placed.withColumn("block", F.when(F.col("_bucket").isNotNull(), 0).cast("long"))
        rows = rows.withColumns({"rn": F.row_number().over(inside.orderBy(*order)).cast("long"), "n": F.count(F.lit(1)).over(inside)})
        return rows.where("_placed").drop("_bucket", "_placed").withColumn("core", F.lit(True)), None
    counts = placed.select(*keys, "_bucket").join(F.broadcast(many), keys).groupBy(*keys, "_bucket", "_n").agg(F.count(F.lit(1)).alias("_c"))
    cuts = counts.withColumn("_end", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bucket")))
    cuts = cuts.withColumn("_block", F.floor((F.col("_end") - F.col("_c")) / F.lit(layout.block_rows)).cast("long"))
    of_block = Window.partitionBy(*keys, "_block")
    cuts = stage(cuts.select(*keys, "_bucket", "_n", "_block", F.min(F.col("_end") - F.col("_c")).over(of_block).alias("_first"),
                             F.max("_end").over(of_block).alias("_last")), "cuts")
    several = cuts.where("_block > 0").select(*keys).distinct()

    def numbered(how: str) -> DataFrame:
        rows = placed.join(F.broadcast(cuts), [*keys, "_bucket"], how).withColumn("block", F.coalesce("_block", F.lit(0).cast("long")))
        return rows.withColumns({
            "rn": F.coalesce("_first", F.lit(0).cast("long")) + F.row_number().over(inside.orderBy(*order)),
            "n": F.coalesce("_n", F.count(F.lit(1)).over(inside))})

    helpers = ["_bucket", "_placed", "_n", "_block", "_first", "_last"]
    core = numbered("left").where("_placed").drop(*helpers).withColumn("core", F.lit(True))
    if not before and not after:
        return core, several
    near = numbered("inner").where("_placed").where((F.col("rn") > F.col("_last") - before) | (F.col("rn") <= F.col("_first") + after))
    others = cuts.select(*keys, F.col("_block").alias("_to"), F.col("_first").alias("_start"), F.col("_last").alias("_stop")).distinct()
    met = near.join(F.broadcast(others), keys).where(
        F.col("rn").between(F.col("_start") - before + 1, F.col("_start")) | F.col("rn").between(F.col("_stop") + 1, F.col("_stop") + after))
    copies = met.withColumn("block", F.col("_to")).drop(*helpers, "_to", "_start", "_stop").withColumn("core", F.lit(False))
    return core.unionByName(copies.repartition(*here)), several


def placeable(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that have a place in their series, the others with ``failure_reason``).

    A row without a key, or without the time that ``order`` starts with, belongs to no series: the functions here leave it out, so
    it is to be split off and kept before. The other columns of ``order`` may be null.
    """
    reason = F.lit(None).cast("string")
    for c in reversed([*keys, order[0]]):
        reason = F.when(F.col(c).isNull(), F.lit(f"{c} is missing")).otherwise(reason)
    marked = df.withColumn("failure_reason", reason)
    return marked.where("failure_reason IS NULL").drop("failure_reason"), marked.where("failure_reason IS NOT NULL")


def block_of(rn: str = "rn", layout: Layout = DEFAULT) -> Column:
    return F.floor((F.col(rn) - 1) / F.lit(layout.block_rows)).cast("long")


def with_halo(
    df: DataFrame, before: int = 0, after: int = 0, layout: Layout = DEFAULT, rn: str = "rn", n: str = "n"
) -> DataFrame:
    """Give each row its ``block``; copy rows near a block border into the neighbour as context (``core`` false).

    Windows over (key, block) with frames of at most ``before`` / ``after`` rows are then exact on core rows.
    A key with fewer rows than a block is not copied at all.
    """
    size = layout.block_rows
    if before > size or after > size:
        raise ValueError("a frame longer than a block needs a larger block_rows")
    if layout.whole:
        return df.withColumn("block", F.lit(0).cast("long")).withColumn("core", F.lit(True))
    home = block_of(rn, layout)
    at = (F.col(rn) - 1) % size
    copies = [home]
    if before:
        copies.append(F.when((at >= size - before) & ((home + 1) * size < F.col(n)), home + 1))
    if after:
        copies.append(F.when((at < after) & (home > 0), home - 1))
    if len(copies) == 1:
        return df.withColumn("block", home).withColumn("core", F.lit(True))
    return df.withColumn("block", F.explode(F.array_compact(F.array(*copies)))).withColumn(
        "core", F.col("block") == block_of(rn, layout)
    )


def block_window(keys: Sequence[str], rn: str = "rn"):
    return Window.partitionBy(*keys, "block").orderBy(rn)


def core_rows(df: DataFrame) -> DataFrame:
    return df.where("core").drop("core")


def attach(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    layout: Layout = DEFAULT,
    n: str = "n",
    how: str = "left",
) -> DataFrame:
    """Join one-row-per-key parameters (which carry the key's ``n``) to rows that carry ``block``.

    The parameters are repeated once per block of their key, so the join runs on (key, block): the rows keep
    the partitioning and sort order of the block window, a hot key stays spread and nothing is broadcast.
    """
    if layout.whole:
        # A station is one block that lies together, and is joined by its first key alone: a join by more keys would deal the rows
        # again. The rows must be of the split that ``per_key`` is of.
        return df.join(per_key.where(F.col(n) > 0).drop(*keys[1:], n).hint("merge"), keys[0], how)
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / F.lit(layout.block_rows)).cast("long"))
    spread = per_key.where(F.col(n) > 0).withColumn("block", F.explode(blocks)).drop(n)
    return df.join(spread.hint("merge"), [*keys, "block"], how)


def long_keys(df: DataFrame, keys: Sequence[str], block: str = "block") -> DataFrame | None:
    """Keys that have more than block 0, at most one in a block's number of rows; None if there are none. ``df`` should be a written table."""
    several = stage(df.where(F.col(block) > 0).select(*keys).distinct(), "long-keys")
    return None if several.isEmpty() else several


def of_keys(df: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(F.broadcast(few), list(keys), "left_semi")


def previous(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], few: DataFrame | None, order: Sequence[str] = ("rn",),
             block: str = "block") -> DataFrame:
    """Values of the key's row before, ``{output: column}``. ``few`` has the keys of several blocks (``long_keys``)."""
    w = Window.partitionBy(*keys, block).orderBy(*order)
    if few is None:
        return df.withColumns({out: F.lag(c).over(w) for out, c in columns.items()})
    row = F.struct(*columns.values())
    used = df.select(*dict.fromkeys([*keys, block, *order, *columns.values()]))
    last = of_keys(used, few, keys).groupBy(*keys, block).agg(F.max_by(row, F.struct(*order)).alias("_t"))
    carry = last.select(*keys, block, F.lag("_t").over(Window.partitionBy(*keys).orderBy(block)).alias("_c"))
    seen = df.withColumns({"_l": F.lag(row).over(w), "_at": F.row_number().over(w)}).join(carry.hint("merge"), [*keys, block], "left")
    return seen.withColumns({
        out: F.when(F.col("_at") == 1, F.col("_c")[c]).otherwise(F.col("_l")[c]) for out, c in columns.items()}).drop("_l", "_at", "_c")


def running(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, tuple[str, str]],
    rn: str = "rn",
    order: Sequence[str] | None = None,
    block: str = "block",
    few: DataFrame | bool | None = True,
) -> DataFrame:
    """Running aggregates from a key's first row to the current one: ``{output: (kind, column)}``.

    Kinds: ``sum``, ``max``, ``min``, ``last`` (last non-null so far) and ``first_after`` (first non-null from here on).
    Each block is scanned on its own and shifted by the aggregate of the blocks before (or after) it.
    Rows must carry ``block``, a value that never decreases along the order. ``few`` has the keys of several blocks where
    they are known (``long_keys``; None: no key has several), so that totals are made of these only.
    """
    keys = list(keys)
    order = list(order or [rn])
    if few is not True:
        for c in [*keys, block]:
            df = df.where(F.col(c).isNotNull())
    mark = F.struct(*order) if len(order) > 1 else F.col(order[0])
    whole = {
        "sum": F.sum,
        "max": F.max,
        "min": F.min,
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), mark)),
        "first_after": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), mark)),
    }
    summed = df if few is True or few is None else of_keys(
        df.select(*dict.fromkeys([*keys, block, *order, *[c for _, c in values.values()]])), few, keys)
    totals = summed.groupBy(*keys, block).agg(*[whole[kind](c).alias(f"_t_{out}") for out, (kind, c) in values.items()])
    blocks = Window.partitionBy(*keys).orderBy(block)
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.rowsBetween(1, Window.unboundedFollowing)
    over_blocks = {
        "sum": lambda c: F.sum(c).over(earlier),
        "max": lambda c: F.max(c).over(earlier),
        "min": lambda c: F.min(c).over(earlier),
        "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
        "first_after": lambda c: F.first(c, ignorenulls=True).over(later),
    }
    carry = totals.select(
        *keys, block, *[over_blocks[kind](f"_t_{out}").alias(f"_c_{out}") for out, (kind, _) in values.items()]
    )
    so_far = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    from_here = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    inside = {
        "sum": lambda c: F.sum(c).over(so_far),
        "max": lambda c: F.max(c).over(so_far),
        "min": lambda c: F.min(c).over(so_far),
        "last": lambda c: F.last(c, ignorenulls=True).over(so_far),
        "first_after": lambda c: F.first(c, ignorenulls=True).over(from_here),
    }
    scanned = df.withColumns({f"_i_{out}": inside[kind](c) for out, (kind, c) in values.items()})
    merged = {
        "sum": lambda i, c: F.when(i.isNull() & c.isNull(), None).otherwise(
            F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0))
        ),
        "max": lambda i, c: F.greatest(i, c),
        "min": lambda i, c: F.least(i, c),
        "last": lambda i, c: F.coalesce(i, c),
        "first_after": lambda i, c: F.coalesce(i, c),
    }
    if few is None:
        return scanned.withColumnsRenamed({f"_i_{out}": out for out in values})
    joined = scanned.join(carry.hint("merge"), [*keys, block], "inner" if few is True else "left")
    return joined.withColumns(
        {out: merged[kind](F.col(f"_i_{out}"), F.col(f"_c_{out}")) for out, (kind, _) in values.items()}
    ).drop(*[f"_{p}_{out}" for out in values for p in "ic"])
