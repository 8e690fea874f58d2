"""Ordered series: chronological split and origin/target pairs per horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.layout import DEFAULT, Layout
from loamline.operators.running import block_window, core_rows, with_halo

KEYS = ["source_id", "split"]


def chronological_split(df: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Label the first int(n*fraction) rows ``train`` and the rest ``test``; ``rn`` and ``n`` restart per label.

    The label joins the series key, so no later window crosses the border. ``step`` and ``n_all`` keep the
    position in the whole series. Filter on ``is_train``, not on the label: a filter on a window key is pushed
    below the shuffle, and the train and test branches of a plan would then shuffle the same rows twice.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    cut = F.floor(F.col("n") * F.lit(fraction))
    train = F.col("rn") <= cut
    return df.withColumns(
        {
            "split": F.when(train, F.lit("train")).otherwise(F.lit("test")),
            "is_train": train,
            "step": F.col("rn"),
            "n_all": F.col("n"),
            "rn": F.when(train, F.col("rn")).otherwise(F.col("rn") - cut),
            "n": F.when(train, cut).otherwise(F.col("n") - cut),
        }
    )


def least_rows(horizons: Sequence[int], margin: int = 50) -> int:
    """Rows a series needs to be scored at every horizon."""
    return max(horizons) + margin


def long_enough(df: DataFrame, horizons: Sequence[int], margin: int = 50) -> DataFrame:
    """Series with enough rows to be scored; ``skipped_series`` reports the others."""
    return df.where(F.col("n_all") >= least_rows(horizons, margin))


def skipped_series(rows: DataFrame, horizons: Sequence[int], margin: int = 50) -> DataFrame:
    """Series too short to be scored: source_id, readings, reason."""
    least = least_rows(horizons, margin)
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("readings")).where(F.col("readings") < least).withColumn(
        "reason", F.lit(f"fewer than {least} readings"))


def with_targets(df: DataFrame, y: str, horizons: Sequence[int], keys: Sequence[str] = KEYS,
                 layout: Layout = DEFAULT, dealt: bool = False) -> DataFrame:
    """Add ``y_<h>``: the value h rows ahead in the same series (null past its end). One window for all horizons.

    ``dealt`` rows have their ``block``, with the rows after it (``running.deal``)."""
    w = block_window(keys)
    ahead = df if dealt else with_halo(df, after=max(horizons), layout=layout)
    return core_rows(ahead.withColumns({f"y_{h}": F.lead(y, h).over(w) for h in horizons}))


def with_targets_by_time(df: DataFrame, y: str, horizons: Sequence[int], keys: Sequence[str] = KEYS,
                         time: str = "event_time") -> DataFrame:
    """As ``with_targets`` but the target is the reading exactly h hours later, found by an equi-join on time.

    Of several readings at one time the smallest is the target, so a repeated time adds no rows. One join serves all
    horizons: a reading is offered to the origins it is the target of.
    """
    once = df.groupBy(*keys, time).agg(F.min(y).alias("_y"))
    offers = F.array(*[F.struct((F.col(time) - F.expr(f"interval {h} hours")).alias("t"), F.lit(h).alias("h")) for h in horizons])
    offered = once.select(*keys, F.inline(offers), "_y").groupBy(*keys, F.col("t").alias(time)).agg(
        *[F.max(F.when(F.col("h") == h, F.col("_y"))).alias(f"y_{h}") for h in horizons])
    return df.join(offered, [*keys, time], "left")


def by_horizon(df: DataFrame, horizons: Sequence[int], keep: Sequence[str], own: str | None = None,
               maps: Sequence[str] = ()) -> DataFrame:
    """One row per origin and horizon with a known target: ``horizon``, ``y_ahead``.

    With ``own``, that column's present value is added as horizon 0. ``maps`` are columns keyed by horizon; their
    entry of the row's horizon is looked up once, here, and takes the column's name.
    """
    ahead = {0: own, **{h: f"y_{h}" for h in horizons}} if own else {h: f"y_{h}" for h in horizons}
    pairs = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(c).alias("y_ahead"), *[F.col(m)[h].alias(m) for m in maps])
        for h, c in ahead.items()
    ])
    return df.select(*keep, F.inline(pairs)).where(F.col("y_ahead").isNotNull())
