"""Features, forecasters and calibrators against numpy/pandas on one station, with blocks far smaller than the series."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamline.layout import Layout
from loamline.operators import forecast as FC
from loamline.operators import ridge
from loamline.operators import uncertainty as U
from loamline.operators.features import AR_FEATURES, ARX_FEATURES, Feature, compiled, feature_list, reach, with_features
from loamline.operators.running import index_rows
from loamline.operators.series import chronological_split, with_targets, with_targets_by_time
from loamline.plans import models
from loamline.stage import stage

TINY = Layout(bucket_seconds=5 * 86400, block_rows=300, value_width=0.01)
HORIZONS = [1, 6, 24]
N = 700


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    y, out = 0.25, []
    for i in range(N):
        y = min(0.55, max(0.05, 0.015 + 0.94 * y + rng.gauss(0, 0.01)))
        rain = 5.0 if i % 50 == 0 else 0.0
        sun = 500.0 if 8 <= i % 24 <= 17 else 0.0
        air = None if i < 3 or i % 17 == 0 else 15 + 8 * math.sin(i / 24 * 2 * math.pi) + rng.gauss(0, 1)
        out.append(("s", dt.datetime(2023, 1, 1) + dt.timedelta(hours=i), y, rain, sun, air))
    return out


@pytest.fixture(scope="module")
def featured(spark, rows):
    schema = "source_id string, event_time timestamp, y double, precip_mm double, solar_rad_wm2 double, air_temp_c double"
    df = index_rows(spark.createDataFrame(rows, schema), ["source_id"], ["event_time"], TINY)
    return stage(with_features(chronological_split(df), HORIZONS, oracle=True, layout=TINY), "features")


def frames(rows):
    """pandas features of each half, computed on its own."""
    out = {}
    for name, part in (("train", rows[: N // 2]), ("test", rows[N // 2:])):
        p = pd.DataFrame(part, columns=["s", "t", "y", "rain", "sun", "air"])
        f = pd.DataFrame({f"lag_{k}": p.y.shift(k).fillna(p.y[0]) for k in (0, 1, 2, 6, 12, 24, 48)})
        f["delta_24"] = (p.y - p.y.shift(24)).fillna(0.0)
        for w in (1, 6, 24, 72):
            f[f"rain_{w}"] = p.rain.rolling(w, min_periods=1).sum()
        f["temp_now"] = p.air.ffill().bfill()
        f["temp_mean_24"] = f.temp_now.rolling(24, min_periods=1).mean()
        f["solar_now"] = p.sun
        f["solar_sum_24"] = p.sun.rolling(24, min_periods=1).sum()
        hours = p.t.dt.hour
        f["hour_sin"], f["hour_cos"] = np.sin(2 * np.pi * hours / 24), np.cos(2 * np.pi * hours / 24)
        f["y"] = p.y
        out[name] = f
    return out


def test_features_equal_pandas(featured, rows):
    got = featured.toPandas().sort_values(["split", "rn"])
    for name, want in frames(rows).items():
        part = got[got.split == name]
        for f in ARX_FEATURES:
            np.testing.assert_allclose(part[f].astype(float).values, want[f].values, atol=1e-9, err_msg=f)
        for h in HORIZONS:
            np.testing.assert_allclose(part[f"y_{h}"].values[:-h], want.y.values[h:])
            assert part[f"y_{h}"].isna().sum() == h


def test_looking_ahead_is_refused():
    with pytest.raises(ValueError):
        Feature("bad", "y", -1)
    assert all(f.lookback >= 0 for f in feature_list())


def numpy_ridge(x, y, alpha, scaled):
    mean, std = x.mean(0), x.std(0)
    std = np.where(std == 0, 1.0, std) if scaled else np.ones(x.shape[1])
    mean = mean if scaled else np.zeros(x.shape[1])
    d = np.hstack([np.ones((len(x), 1)), (x - mean) / std])
    penalty = alpha * np.eye(d.shape[1])
    penalty[0, 0] = 0
    w = np.linalg.solve(d.T @ d + penalty, d.T @ y)
    return lambda z: w[0] + ((z - mean) / std) @ w[1:]


@pytest.mark.parametrize("model,features,alpha,scaled", [("M1_AUTOREGRESSIVE", AR_FEATURES, 1.0, False),
                                                         ("M2_ENVIRONMENTAL_ARX", ARX_FEATURES, 10.0, True)])
def test_ridge_equals_numpy(featured, rows, model, features, alpha, scaled):
    got = {r.horizon: r for r in ridge.fit(featured, HORIZONS).where(F.col("model") == model).collect()}
    train, test = frames(rows)["train"], frames(rows)["test"]
    for h in HORIZONS:
        x, y = train[features].values[:-h], train.y.values[h:]
        want = numpy_ridge(x, y, alpha, scaled)(test[features].values)
        mine = got[h].bias + test[features].values @ np.array(got[h].weights)
        np.testing.assert_allclose(mine, want, atol=1e-9)


def test_short_series_has_no_model(spark, featured):
    assert ridge.fit(featured, [24]).count() == 2
    few = featured.where("rn <= 40").withColumn("n", F.lit(40))
    assert ridge.fit(few, [24]).count() == 0


def test_ewma_and_expanding_mean(featured, rows):
    series = featured.select("source_id", "split", "is_train", "rn", "n", "n_all", "y")
    got = FC.ewma(series, 0.2, layout=TINY).where("split = 'test'").orderBy("rn").toPandas().point.values
    y = [r[2] for r in rows[N // 2:]]
    level, want = y[0], []
    for v in y:
        level = 0.2 * v + 0.8 * level
        want.append(level)
    np.testing.assert_allclose(got, want, atol=1e-12)
    seeded = FC.ewma(series, 0.15, seeds=FC.last_train_values(series), layout=TINY).where("split = 'test'")
    level, want = rows[N // 2 - 1][2], []
    for v in y:
        level = 0.15 * v + 0.85 * level
        want.append(level)
    np.testing.assert_allclose(seeded.orderBy("rn").toPandas().point.values, want, atol=1e-12)
    mean = FC.expanding_mean(series, layout=TINY).where("split = 'test'").orderBy("rn").toPandas().point.values
    np.testing.assert_allclose(mean, pd.Series(y).expanding().mean().values, atol=1e-12)


def test_calibrators_equal_numpy(featured, rows):
    res = stage(U.residual_counts(featured, HORIZONS, ["regime"]), "res")
    y = np.array([r[2] for r in rows[: N // 2]])
    static = {r.horizon: r for r in U.fit_static(res, [0.8], TINY).collect()}
    spread = {r.horizon: r for r in U.fit_dispersion(res, TINY).collect()}
    std = {}
    for h in HORIZONS:
        e = y[h:] - y[:-h]
        std[h] = e.std()
        assert static[h].lo_80 == pytest.approx(np.percentile(e, 10), abs=1e-12)
        assert static[h].hi_80 == pytest.approx(np.percentile(e, 90), abs=1e-12)
        assert spread[h].bias == pytest.approx(np.median(e), abs=1e-12)
        assert spread[h].scale == pytest.approx(1.4826 * np.median(np.abs(e - np.median(e))), abs=1e-12)
    nu, a = np.polyfit(np.log(HORIZONS), np.log([std[h] for h in HORIZONS]), 1)
    power = U.fit_power_law(res).first()
    assert power.nu == pytest.approx(nu) and power.sigma_1 == pytest.approx(math.exp(a))
    regimes = U.fit_regimes(res, [0.8], TINY).collect()
    assert {r.regime for r in regimes} == {"ALL", "WET_ANTECEDENT", "HIGH_EVAP", "DRY_QUIESCENT"}


def test_hours_and_steps_agree_without_gaps_and_differ_with_one(spark, rows):
    gap = [r for i, r in enumerate(rows[:200]) if i != 50]
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in gap], "source_id string, event_time timestamp, y double")
    s = chronological_split(index_rows(df, ["source_id"], ["event_time"], TINY), 0.9)
    steps = {r.event_time: r.y_6 for r in with_targets(s, "y", [6], layout=TINY).collect()}
    hours = {r.event_time: r.y_6 for r in with_targets_by_time(s, "y", [6]).collect()}
    assert hours[rows[10][1]] == steps[rows[10][1]]
    assert hours[rows[48][1]] != steps[rows[48][1]] and hours[rows[44][1]] is None


def test_bounds_and_fallback(spark):
    df = spark.createDataFrame([(1.0, None, 0.2), (2.0, 0.4, 0.2), (3.0, float("nan"), 0.3)],
                               "id double, primary double, persistence double")
    out = [(r.point, r.used_fallback) for r in FC.safe_route(df).orderBy("id").collect()]
    assert out == [(0.2, True), (0.4, False), (0.3, True)]


def test_station_without_temperature_keeps_the_autoregressive_model(spark, rows, featured):
    schema = "source_id string, event_time timestamp, y double, precip_mm double, solar_rad_wm2 double, air_temp_c double"
    bare = spark.createDataFrame([(*r[:5], None) for r in rows], schema)
    numbered = chronological_split(index_rows(bare, ["source_id"], ["event_time"], TINY))
    got = {(r.horizon, r.model): r for r in ridge.fit(stage(with_features(numbered, HORIZONS, layout=TINY), "bare"), HORIZONS).collect()}
    assert set(got) == {(h, "M1_AUTOREGRESSIVE") for h in HORIZONS}
    full = {(r.horizon, r.model): r for r in ridge.fit(featured, HORIZONS).collect()}
    assert len(full) == 2 * len(HORIZONS)
    for k, r in got.items():
        assert np.allclose(r.weights, full[k].weights) and r.bias == pytest.approx(full[k].bias)
    # no weather column at all: fixed values stand in
    plain = with_features(numbered.drop("precip_mm", "solar_rad_wm2", "air_temp_c"), HORIZONS, layout=TINY)
    assert plain.select("temp_now", "temp_mean_24", "rain_72", "solar_sum_24").distinct().collect() == [(15.0, 15.0, 0.0, 0.0)]


def test_feature_lists_compile_to_causal_windows(spark):
    """Any list against a plain loop, over small blocks; names must be new, and nothing may look ahead."""
    rng = random.Random(3)
    rows = [("a", "test", i + 1, 97, rng.random(), None if rng.random() < 0.2 else rng.random()) for i in range(97)] + [("b", "test", 1, 1, 0.5, None)]
    df = spark.createDataFrame(rows, "source_id string, split string, rn long, n long, y double, rain double")
    features = [Feature("l5", "y", 5), Feature("l0", "y", 0), Feature("c3", "y", 3, "change"), Feature("s4", "rain", 3, "sum", 0.0), Feature("a4", "rain", 3, "avg"),
                Feature("lo", "rain", 7, "min", 1.0), Feature("hi", "y", 7, "max"), Feature("now", "rain", 0, "value", -1.0), Feature("lr", "rain", 2, "lag", 9.0)]
    assert reach(features) == 7
    got = {(r["source_id"], r["rn"]): r for r in compiled(df, features, layout=Layout(block_rows=10)).collect()}
    assert len(got) == 98
    for s in "ab":
        mine = [r for r in rows if r[0] == s]
        y, rain = [r[4] for r in mine], [r[5] for r in mine]
        fill = lambda v, x: x if v is None else v
        for i in range(len(mine)):
            r, last = got[s, i + 1], slice(max(0, i - 3), i + 1)
            known = [v for v in rain[last] if v is not None]
            want = {"l5": y[max(0, i - 5)], "l0": y[i], "c3": y[i] - y[i - 3] if i >= 3 else 0.0, "s4": sum(fill(v, 0.0) for v in rain[last]),
                    "a4": sum(known) / len(known) if known else None, "lo": min(fill(v, 1.0) for v in rain[max(0, i - 7): i + 1]), "hi": max(y[max(0, i - 7): i + 1]),
                    "now": fill(rain[i], -1.0), "lr": fill(rain[max(0, i - 2)], 9.0)}
            assert all(r[k] == v or abs(r[k] - v) < 1e-12 for k, v in want.items()), (i, want, r)
    for bad in (lambda: Feature("x", "y", -1), lambda: Feature("x", "y", 1, "median"), lambda: Feature("x", "y", 2, "value"),
                lambda: compiled(df, [Feature("y", "rain", 1)]), lambda: compiled(df, [Feature("x", "y", 1), Feature("x", "y", 2)])):
        with pytest.raises(ValueError):
            bad()


def test_featured_series_writes_what_its_plan_reads(spark):
    rows = [("s", i, 0.2 + (i % 9) / 100) for i in range(300)]
    frame = spark.createDataFrame(rows, "source_id string, i int, soil_moisture_10cm double").select(
        "*", (F.lit(1.6e9).cast("long") + F.col("i") * 3600).cast("timestamp").alias("event_time"),
        *[F.col("soil_moisture_10cm").alias(f"soil_moisture_{d}cm") for d in (5, 20, 50, 100)],
        F.lit(0.0).alias("precip_mm"), F.lit(10.0).alias("solar_rad_wm2"), F.lit(5.0).alias("air_temp_c"))
    whole = models.featured_series(frame, ["event_time"], horizons=(1, 6))
    few = models.featured_series(frame, ["event_time"], horizons=(1, 6), columns=["regime"])
    assert set(few.columns) == {*models.PLACE, "y", "y_1", "y_6", "regime"} < set(whole.columns)
    assert sorted(map(str, few.collect())) == sorted(map(str, whole.select(*few.columns).collect()))
