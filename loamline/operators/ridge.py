"""Direct ridge regressions per station and horizon from distributed cross-product sums.

One aggregate with map-side partial sums gives every moment of the features; both models are solved from it. Only
one small row per (station, horizon) reaches Python, and no group of rows is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.water import clip
from loamline.operators.features import AR_FEATURES, ARX_FEATURES

# Features are shifted by a typical value before squaring, so that variances do not cancel. Any shift is exact.
TYPICAL = {"temp_now": 15.0, "temp_mean_24": 15.0, "solar_now": 200.0, "solar_sum_24": 4800.0}
MARGIN = 50
MODELS = {"M1_AUTOREGRESSIVE": (AR_FEATURES, 1.0, False), "M2_ENVIRONMENTAL_ARX": (ARX_FEATURES, 10.0, True)}
ORACLE = "ORACLE_FUTURE_RAIN"
WEIGHTS = "source_id {key}, horizon int, model string, bias double, weights array<double>"


def shift_of(name: str, level: float) -> float:
    return level if name.startswith("lag_") else TYPICAL.get(name, 0.0)


def sum_names(count: int) -> list[str]:
    """rows, s_t, s_i, t_i and c_i_j (i <= j): the moments of ``count`` features and the target."""
    p = range(count)
    return ["rows", "s_t", *[f"s_{i}" for i in p], *[f"t_{i}" for i in p], *[f"c_{i}_{j}" for i in p for j in p if i <= j]]


def cross_sums(featured: DataFrame, horizons: Sequence[int], features: Sequence[str], level: float = 0.25,
               oracle: bool = False, keys: Sequence[str] = ("source_id", "horizon")) -> DataFrame:
    """Moments of the shifted features over the train rows with a known target, per key.

    Each Arrow batch of rows is reduced to one partial row per station and horizon by a matrix product; Spark adds the
    partial rows. ``featured`` is clustered by station, so a batch holds few stations and the shuffle is small. A
    series needs more than horizon + 50 rows. With ``oracle``, the future rain of the horizon is the last feature.
    """
    features, horizons = list(features), list(horizons)
    shifts = np.array([shift_of(f, level) for f in features])
    extra = 1 if oracle else 0
    count = len(features) + extra
    names = sum_names(count)
    upper = [(i + 1, j + 1) for i in range(count) for j in range(count) if i <= j]
    ci, cj = np.array([u[0] for u in upper]), np.array([u[1] for u in upper])
    rain = [f"oracle_rain_{h}" for h in horizons] if oracle else []
    train = featured.where("is_train").select("source_id", "n", *features, *[f"y_{h}" for h in horizons], *rain)
    kind = dict(featured.dtypes)["source_id"]
    schema = f"source_id {kind}, horizon int, " + ", ".join(f"{n} double" for n in names)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[features].to_numpy(dtype=float) - shifts
            t = batch[[f"y_{h}" for h in horizons]].to_numpy(dtype=float) - level
            more = batch[rain].to_numpy(dtype=float) if oracle else None
            length = batch["n"].to_numpy()
            complete = ~np.isnan(x).any(axis=1)
            codes, stations = pd.factorize(batch["source_id"])
            order = np.argsort(codes, kind="stable")
            ends = np.searchsorted(codes[order], np.arange(len(stations) + 1))
            out = []
            for k, station in enumerate(stations):
                rows = order[ends[k]:ends[k + 1]]
                for c, h in enumerate(horizons):
                    used = rows[complete[rows] & ~np.isnan(t[rows, c]) & (length[rows] > h + MARGIN)]
                    if len(used) == 0:
                        continue
                    z = np.empty((len(used), count + 2))
                    z[:, 0] = 1.0
                    z[:, 1:len(features) + 1] = x[used]
                    if oracle:
                        z[:, count] = more[used, c]
                    z[:, -1] = t[used, c]
                    g = z.T @ z
                    out.append((station, h, g[0, 0], g[0, -1], *g[0, 1:-1], *g[1:-1, -1], *g[ci, cj]))
            yield pd.DataFrame(out, columns=["source_id", "horizon", *names])

    parts = train.mapInPandas(partial, schema)
    return parts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def solve(sums: DataFrame, features: Sequence[str], models: dict, level: float = 0.25) -> DataFrame:
    """Weights on the unshifted, unscaled features. Each input row is one station and horizon."""
    features = list(features)
    shifts = np.array([shift_of(f, level) for f in features])
    count = len(features)
    key = dict(sums.dtypes)["source_id"]
    wide = sums.where(F.col("rows") >= MARGIN).select(
        "source_id", F.col("horizon").cast("int").alias("horizon"), "rows", "s_t",
        F.array(*[f"s_{i}" for i in range(count)]).alias("s"),
        F.array(*[f"t_{i}" for i in range(count)]).alias("t"),
        F.array(*[f"c_{min(i, j)}_{max(i, j)}" for i in range(count) for j in range(count)]).alias("c"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            rows = batch["rows"].to_numpy(dtype=float)
            mean = np.stack(batch["s"]) / rows[:, None]
            y_mean = batch["s_t"].to_numpy(dtype=float) / rows
            centered = np.stack(batch["c"]).reshape(-1, count, count) / rows[:, None, None]
            centered = centered - mean[:, :, None] * mean[:, None, :]
            cross = np.stack(batch["t"]) / rows[:, None] - mean * y_mean[:, None]
            for name, (used, alpha, scaled) in models.items():
                pick = [features.index(f) for f in used]
                gram, rhs, at = centered[:, pick][:, :, pick], cross[:, pick], mean[:, pick]
                scale = np.ones_like(at)
                if scaled:
                    var = np.clip(np.diagonal(gram, axis1=1, axis2=2), 0.0, None)
                    scale = np.where(var > 1e-13 * (1.0 + at * at), np.sqrt(var), 1.0)
                gram = gram / (scale[:, :, None] * scale[:, None, :]) * rows[:, None, None] + alpha * np.eye(len(pick))
                weights = np.linalg.solve(gram, (rhs / scale * rows[:, None])[:, :, None])[:, :, 0] / scale
                bias = y_mean + level - np.sum(weights * (at + shifts[pick]), axis=1)
                yield pd.DataFrame({"source_id": batch["source_id"], "horizon": batch["horizon"], "model": name,
                                    "bias": bias, "weights": list(weights)})

    return wide.mapInPandas(run, WEIGHTS.format(key=key))


def fit(featured: DataFrame, horizons: Sequence[int], level: float = 0.25, oracle: bool = False) -> DataFrame:
    """Weights of the autoregressive and the environmental model (and the future-rain ablation).

    Each has sums over the rows on which its own features are complete, so a station without weather keeps the
    autoregressive model.
    """
    features = [*ARX_FEATURES, *(["oracle_rain"] if oracle else [])]
    models = {k: v for k, v in MODELS.items() if not set(v[0]) <= set(AR_FEATURES)} | ({ORACLE: (features, 10.0, True)} if oracle else {})
    plain = {k: v for k, v in MODELS.items() if k not in models}
    with_weather = solve(cross_sums(featured, horizons, ARX_FEATURES, level, oracle), features, models, level)
    return solve(cross_sums(featured, horizons, AR_FEATURES, level), AR_FEATURES, plain, level).unionByName(with_weather)


def predict(weights: Column, features: Sequence[Column], bounds: tuple[float, float], current: Column) -> Column:
    """Clipped linear prediction; a station without a model keeps its current value."""
    total = weights["bias"]
    for i, f in enumerate(features):
        total = total + F.get(weights["weights"], i) * f
    return clip(F.coalesce(total, current), *bounds)
