"""Stations of at most a block: the layout in which their rows stay together gives the results of the dealt one and moves them once."""

import datetime as dt
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loamline.layout import Layout
from loamline.operators import uncertainty as U
from loamline.operators.forecast import ewma, last_train_values
from loamline.operators.running import index_rows
from loamline.plans import models, operational

DEALT = Layout(bucket_seconds=20 * 86400, block_rows=300, value_width=0.01)
WHOLE = replace(DEALT, whole=True)
HORIZONS = [1, 6, 24]
ORDER = ["event_time", "id"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = []
    for station, n in ((1, 500), (2, 320), (3, 60), (None, 40)):
        y = 0.25
        for i in range(n):
            y = min(0.55, max(0.05, 0.015 + 0.94 * y + rng.gauss(0, 0.01)))
            time = None if i % 97 == 5 else dt.datetime(2023, 1, 1) + dt.timedelta(hours=i // 2)
            out.append((station, time, i, *[round(y + d, 3) for d in (0.0, 0.01, 0.02, 0.03)], None if i % 5 else round(y, 3),
                        5.0 if i % 50 == 0 else 0.0, 500.0 if 8 <= i % 24 <= 17 else 0.0, None if i < 3 or i % 17 == 0 else 15 + 8 * math.sin(i / 4)))
    schema = ("source_id int, event_time timestamp, id int, soil_moisture_5cm double, soil_moisture_10cm double, soil_moisture_20cm double, "
              "soil_moisture_50cm double, soil_moisture_100cm double, precip_mm double, solar_rad_wm2 double, air_temp_c double")
    return spark.createDataFrame(out, schema)


@pytest.fixture(scope="module")
def both(rows):
    return {lay: models.featured_series(rows, ORDER, horizons=HORIZONS, layout=lay) for lay in (DEALT, WHOLE)}


def same(first, second):
    names = sorted(set(first.columns) & set(second.columns) - {"block"})
    keys = [c for c in ("source_id", "split", "rn", "horizon", "regime", "model", "method", "nominal") if c in names]
    key = lambda r: tuple(str(r[c]) for c in keys)
    a, b = ({key(r): r for r in df.select(*names).collect()} for df in (first, second))
    assert a.keys() == b.keys() and a
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert x == (pytest.approx(y, abs=2e-9) if isinstance(y, float) else y), (k, a[k], b[k])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_layout_is_whole_only_without_long_stations(rows):
    assert not DEALT.for_stations(rows).whole
    assert replace(DEALT, block_rows=500).for_stations(rows).whole


def test_numbers_and_features(rows, both):
    for lay in (WHOLE, DEALT):
        numbered = index_rows(rows, ["source_id"], ORDER, lay, rank="place")
        got = {(r.source_id, r.id): (r.rn, r.n, r.place) for r in numbered.collect()}
        if lay is WHOLE:
            first = got
    assert got == first and min(v[0] for v in got.values()) > 1  # rows without a time count before the others
    same(both[DEALT], both[WHOLE])


def test_series_meets_its_readers_without_an_exchange(both):
    f = both[WHOLE]
    assert exchanges(U.fit_static(U.residual_counts(f, HORIZONS, layout=WHOLE), [0.8], WHOLE)) == 0
    assert exchanges(U.fit_dispersion(U.residual_counts(f, HORIZONS, layout=WHOLE), WHOLE)) == 0
    assert exchanges(ewma(f, 0.15, layout=WHOLE)) == 0


def test_quantiles_and_intervals(both):
    counted = {lay: U.residual_counts(f, HORIZONS, ["regime"], lay) for lay, f in both.items()}
    for fit in (lambda r, lay: U.residual_stats(r, {"q1": 0.1, "q5": 0.5}, lay), lambda r, lay: U.fit_dispersion(r, lay), lambda r, lay: U.fit_regimes(r, [0.8], lay),
                lambda r, lay: U.fit_power_law(r)):
        same(fit(counted[DEALT], DEALT), fit(counted[WHOLE], WHOLE))
    same(*[models.interval_benchmark(f, HORIZONS, layout=lay) for lay, f in both.items()])


@pytest.mark.parametrize("alpha", [0.15, 0.9])
def test_ewma(both, alpha):
    first, second = [ewma(f, alpha, seeds=last_train_values(f), layout=lay).select("source_id", "split", "rn", "point") for lay, f in both.items()]
    same(first, second)


def test_ladder_and_sites(both):
    same(*[models.model_ladder(f, HORIZONS, layout=lay) for lay, f in both.items()])
    same(*[models.site_evaluation(f, HORIZONS, layout=lay) for lay, f in both.items()])


def test_risk(both):
    depletion = lambda f: f.withColumns({c: (F.lit(0.32) - F.col(c)) / F.lit(0.18) for c in ["y", *[f"y_{h}" for h in HORIZONS]]})
    first, second = [operational.risk_forecasts(depletion(f), HORIZONS, 0.5, layout=lay) for lay, f in both.items()]
    assert first.columns == second.columns
    same(first, second)
