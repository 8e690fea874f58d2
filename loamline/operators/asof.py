"""As-of joins: each row with the nearest row of another table before it, after it, or on either side.

Both tables are put in one order per key, cut into periods of time; a period is scanned on its own and takes over what
the periods before it leave behind. So a key with any share of the rows is spread, and no row meets more than its match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.layout import DEFAULT, Layout
from loamline.operators.running import running, time_bucket

DIRECTIONS = ("backward", "forward", "nearest")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], order: Sequence[str] = (),
              right_time: str | None = None, direction: str = "backward", tolerance_seconds: float | None = None, exact: bool = True,
              layout: Layout = DEFAULT) -> DataFrame:
    """``left`` with ``values`` of its match in ``right`` and the match's time as ``matched_time`` (nulls without a match).

    ``exact``: equal times match. Of several right rows at one time the last by ``order`` (columns of ``right``) counts
    looking back, the first looking ahead. ``nearest`` prefers the row before at equal distance. Beyond ``tolerance_seconds``
    there is no match. Left rows without a key or time have none; such right rows are left out. Left rows are all kept, repeated ones too.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    right_time = right_time or time
    taken = {c.lower() for c in left.columns} - {c.lower() for c in keys}
    clash = [v for v in [*values, "matched_time"] if v.lower() in taken]
    if clash:
        raise ValueError(f"rename {clash}: the left table has such columns")
    placed = F.lit(True)
    for c in [*keys, time]:
        placed = placed & F.col(c).isNotNull()
    usable = F.lit(True)
    for c in [*keys, right_time]:
        usable = usable & F.col(c).isNotNull()

    match = F.struct(F.col(right_time).alias("matched_time"), *values)
    tie = F.struct(*order) if order else F.lit(0)
    offers = right.where(usable).select(*keys, F.col(right_time).alias("_time"), match.alias("_offer"), tie.alias("_tie"))
    asks = left.where(placed).select(*keys, F.col(time).alias("_time"), F.struct(*left.columns).alias("_row"))
    both = asks.unionByName(offers, allowMissingColumns=True)
    both = both.withColumn("_side", F.col("_row").isNotNull().cast("int")).withColumn("block", time_bucket("_time", layout))

    # looking back, equal offers come before the asking row; looking ahead, after it
    wanted = {}
    if direction != "forward":
        both = running(both.withColumn("_rank", F.col("_side") if exact else -F.col("_side")), keys, {"_before": ("last", "_offer")},
                       order=["_time", "_rank", "_tie"])
        wanted["before"] = F.col("_before")
    if direction != "backward":
        both = running(both.withColumn("_rank", -F.col("_side") if exact else F.col("_side")), keys, {"_after": ("first_after", "_offer")},
                       order=["_time", "_rank", "_tie"])
        wanted["after"] = F.col("_after")

    def gap(c: Column) -> Column:
        return F.abs(F.unix_micros(c["matched_time"].cast("timestamp")) - F.unix_micros(F.col("_time").cast("timestamp")))

    near = {k: F.when(gap(c) <= tolerance_seconds * 1e6, c) if tolerance_seconds is not None else c for k, c in wanted.items()}
    if direction == "nearest":
        found = F.when(near["before"].isNull() | (gap(near["after"]) < gap(near["before"])), near["after"]).otherwise(near["before"])
    else:
        found = next(iter(near.values()))
    out = both.where("_side = 1").withColumn("_found", found).select("_row.*", "_found.*")
    rest = left.where(~placed).select("*", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ["matched_time", *values]])
    return out.unionByName(rest)
