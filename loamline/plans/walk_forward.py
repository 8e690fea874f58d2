"""Station rows -> states -> split -> targets: the trunk shared by scoring plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from loamline.layout import DEFAULT, Layout
from loamline.operators.evaluate import score_persistence
from loamline.operators.running import index_rows
from loamline.operators.series import chronological_split, long_enough, with_targets
from loamline.operators.state import integrate_depths
from loamline.schemas import HORIZONS


def valid_states(rows: DataFrame) -> DataFrame:
    return integrate_depths(rows).where("is_valid")


def split_states(rows: DataFrame, order: Sequence[str], keep: Sequence[str], fraction: float = 0.5,
                 layout: Layout = DEFAULT) -> DataFrame:
    """Valid states numbered per station and split in time order."""
    states = valid_states(rows).select("source_id", *order, *[c for c in keep if c not in order])
    indexed = index_rows(states, ["source_id"], order, layout).select("source_id", "rn", "n", *keep)
    return chronological_split(indexed, fraction)


def persistence_walk_forward(
    rows: DataFrame,
    order: Sequence[str],
    horizons: Sequence[int] = HORIZONS,
    fraction: float = 0.5,
    by: Sequence[str] = ("horizon",),
    layout: Layout = DEFAULT,
) -> DataFrame:
    series = long_enough(split_states(rows, order, ["theta_rz"], fraction, layout), horizons)
    paired = with_targets(series.withColumnRenamed("theta_rz", "y"), "y", horizons, layout=layout)
    return score_persistence(paired, horizons, fraction, by, layout=layout)
