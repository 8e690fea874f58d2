"""Causal features of an ordered series: every frame ends at the current row.

Rows are a split series (keys source_id, split; position rn of n) with ``y`` and, when weather is known,
``precip_mm``, ``solar_rad_wm2``, ``air_temp_c`` and ``event_time``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.layout import DEFAULT, Layout
from loamline.operators.running import block_window, core_rows, running, with_halo
from loamline.operators.series import KEYS

LAGS = (0, 1, 2, 6, 12, 24, 48)
RAIN_WINDOWS = (1, 6, 24, 72)
DAY = 24
# What stands for weather where none is given.
NO_WEATHER = {"air_temp_c": 15.0, "precip_mm": 0.0, "solar_rad_wm2": 0.0}


AGGREGATES = ("lag", "change", "value", "sum", "avg", "min", "max", "hour_sin", "hour_cos")


@dataclass(frozen=True)
class Feature:
    """One feature: its column, its source, how many rows back it looks, and what it makes of them.

    ``lag`` is the value so many rows ago (the first one before the series start), ``change`` the difference to it (0 there), ``value`` the present one;
    the others take all rows from there to here. ``missing`` stands for null sources.
    """

    name: str
    source: str
    lookback: int
    aggregate: str = "lag"
    missing: float | None = None

    def __post_init__(self):
        if self.lookback < 0:
            raise ValueError(f"{self.name} would look ahead")
        if self.aggregate not in AGGREGATES:
            raise ValueError(f"{self.name}: unknown aggregate {self.aggregate}")
        if self.lookback and self.aggregate in ("value", "hour_sin", "hour_cos"):
            raise ValueError(f"{self.name} looks at the present row only")


def feature_list(weather: bool = True) -> list[Feature]:
    out = [Feature(f"lag_{k}", "y", k) for k in LAGS] + [Feature("delta_24", "y", DAY, "change")]
    if weather:
        out += [Feature(f"rain_{w}", "precip_mm", w - 1, "sum", 0.0) for w in RAIN_WINDOWS]
        out += [Feature("temp_now", "air_temp_c", 0, "value"), Feature("temp_mean_24", "air_temp_c", DAY - 1, "avg")]
        out += [Feature("solar_now", "solar_rad_wm2", 0, "value", 0.0), Feature("solar_sum_24", "solar_rad_wm2", DAY - 1, "sum", 0.0)]
        out += [Feature("hour_sin", "event_time", 0, "hour_sin"), Feature("hour_cos", "event_time", 0, "hour_cos")]
    return out


def reach(features: Sequence[Feature]) -> int:
    """Rows before a block that its windows need."""
    return max((f.lookback for f in features), default=0)


AR_FEATURES = [f.name for f in feature_list(weather=False)]
ARX_FEATURES = [f.name for f in feature_list()]
LOOKBACK = reach(feature_list())


def fill_both_ways(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS,
                   layout: Layout = DEFAULT, leading: bool = True) -> DataFrame:
    """Forward fill; with ``leading``, values before the first known one take it (this looks ahead at series start)."""
    blocks = with_halo(df, layout=layout).drop("core")
    values = {f"_f_{c}": ("last", c) for c in columns}
    if leading:
        values |= {f"_b_{c}": ("first_after", c) for c in columns}
    filled = running(blocks, keys, values, few=None if layout.whole else True)
    fill = {c: F.coalesce(F.col(f"_f_{c}"), F.col(f"_b_{c}")) if leading else F.col(f"_f_{c}") for c in columns}
    return filled.withColumns(fill).drop(*values, "block")


def window_columns(features: Sequence[Feature], w) -> dict[str, Column]:
    """The columns of a feature list over the block window ``w``; every frame ends at the current row.

    Blocks must carry ``reach(features)`` rows before them, and the first one starts with the series.
    """
    rn, out = F.col("rn"), {}
    # rows nearer to the start than a lag are in the first block, whose first row is the series start
    start = {s: F.first(s).over(w.rowsBetween(-max(f.lookback for f in features if f.source == s), 0)) for s in {f.source for f in features}}
    over = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    for f in features:
        x = F.col(f.source) if f.missing is None else F.coalesce(F.col(f.source), F.lit(f.missing))
        if f.aggregate in over:
            out[f.name] = over[f.aggregate](x).over(w.rowsBetween(-f.lookback, 0))
        elif f.aggregate in ("hour_sin", "hour_cos"):
            turn = F.hour(f.source) * F.lit(2.0) * F.pi() / F.lit(24.0)
            out[f.name] = F.sin(turn) if f.aggregate == "hour_sin" else F.cos(turn)
        elif f.aggregate == "change":
            out[f.name] = F.when(rn <= f.lookback, F.lit(0.0)).otherwise(x - F.lag(x, f.lookback).over(w)) if f.lookback else F.lit(0.0)
        else:
            first = start[f.source] if f.missing is None else F.coalesce(start[f.source], F.lit(f.missing))
            out[f.name] = x if f.lookback == 0 else F.when(rn <= f.lookback, first).otherwise(F.lag(x, f.lookback).over(w))
    return out


def compiled(df: DataFrame, features: Sequence[Feature], keys: Sequence[str] = KEYS, layout: Layout = DEFAULT) -> DataFrame:
    """A series (keys, rn of n) with the columns of any feature list, from one window; the list gives the halo, too."""
    names = [f.name for f in features]
    if len(set(names)) < len(names) or set(names) & set(df.columns):
        raise ValueError("feature names must be new and different")
    rows = with_halo(df, before=reach(features), layout=layout)
    return core_rows(rows.withColumns(window_columns(features, block_window(keys))))


def regime(rain_24: Column, solar: Column) -> Column:
    return (
        F.when(rain_24 > 1.0, F.lit("WET_ANTECEDENT"))
        .when(solar >= 200.0, F.lit("HIGH_EVAP"))
        .otherwise(F.lit("DRY_QUIESCENT"))
    )


def with_features(df: DataFrame, horizons: Sequence[int] = (), weather: bool = True, oracle: bool = False,
                  layout: Layout = DEFAULT) -> DataFrame:
    """Features, ``regime`` and ``y_<h>`` targets from one window; rows keep ``block`` for later joins.

    A weather column that the input lacks takes its value of NO_WEATHER. ``oracle`` adds ``oracle_rain_<h>``, the rain of the rows i..i+h-1: it looks ahead and is no causal feature.
    """
    if weather:
        df = df.withColumns({c: F.lit(v) for c, v in NO_WEATHER.items() if c not in df.columns})
        df = fill_both_ways(df, ["air_temp_c"], layout=layout)
    ahead = max(horizons, default=0)
    rows = with_halo(df, before=LOOKBACK, after=ahead, layout=layout)
    w = block_window(KEYS)
    columns = window_columns(feature_list(weather), w)
    columns |= {f"y_{h}": F.lead("y", h).over(w) for h in horizons}
    if oracle:
        rain = F.coalesce(F.col("precip_mm"), F.lit(0.0))
        columns |= {f"oracle_rain_{h}": F.sum(rain).over(w.rowsBetween(0, h - 1)) for h in horizons}
    out = core_rows(rows.withColumns(columns))
    return out.withColumn("regime", regime(F.col("rain_24"), F.col("solar_now"))) if weather else out


def align_weather(states: DataFrame, weather: DataFrame, columns: Sequence[str], order: Sequence[str],
                  keys: Sequence[str] = ("source_id", "event_time")) -> DataFrame:
    """Left join of the first weather row per station and time (a map-side aggregate finds it)."""
    first = weather.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_w"))
    return states.join(first.select(*keys, "_w.*"), list(keys), "left")
