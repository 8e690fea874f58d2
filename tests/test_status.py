"""Latest rows, station status and quantile sketches against plain loops."""

import datetime as dt
import math
import random

import pytest

from loamline.layout import Layout
from loamline.operators import audit, sketch
from loamline.streaming import flows

T0 = dt.datetime(2024, 1, 1)


def test_newest_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), T0 + dt.timedelta(hours=rng.randint(0, 500)) if rng.random() > 0.02 else None, i) for i in range(900)]
    df = spark.createDataFrame(rows + [("c", T0, 1000)], "source_id string, event_time timestamp, i int").repartition(5)
    got = {}
    for r in audit.newest_rows(df, ["source_id"], ["event_time", "i"], 48, Layout(bucket_seconds=36_000)).collect():
        got.setdefault(r["source_id"], []).append((r["back"], r["i"]))
    for k in ("a", "b", "c"):
        mine = sorted(((t, i) for s, t, i in [*rows, ("c", T0, 1000)] if s == k and t is not None), reverse=True)[:48]
        assert sorted(got[k]) == [(j + 1, i) for j, (_, i) in enumerate(mine)]
    assert set(got) == {"a", "b", "c"}


def test_station_status(spark):
    states = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h), 0.2 + h / 1000, h / 100) for h in range(60)] + [("b", T0, 0.3, 0.1)],
                                   "source_id string, event_time timestamp, theta_rz double, depletion_fraction double")
    forecasts = spark.createDataFrame([("a", T0, 1, 0.1), ("a", T0 + dt.timedelta(hours=59), 24, 0.26), ("a", T0 + dt.timedelta(hours=59), 1, 0.25)] * 2,
                                      "source_id string, event_time timestamp, horizon int, point double")
    alerts = spark.createDataFrame([("a", T0, 0, "CRITICAL", "Q", "X"), ("a", T0 + dt.timedelta(hours=9), 0, "WARNING", "P", "Y"),
                                    ("a", T0 + dt.timedelta(hours=1), 0, "CRITICAL", "Q", "Z")],
                                   "source_id string, event_time timestamp, ord int, severity string, category string, threshold_type string")
    got = {r["source_id"]: r for r in audit.station_status(states, forecasts, alerts, ["event_time"]).collect()}
    a, b = got["a"], got["b"]
    assert a["event_time"] == T0 + dt.timedelta(hours=59) and a["recent_states"] == 48 and abs(a["recent_theta"] - sum(0.2 + h / 1000 for h in range(12, 60)) / 48) < 1e-12
    assert a["forecast"] == {1: 0.25, 24: 0.26} and a["top_alert"]["threshold_type"] == "Z" and a["alerts"] == 3
    assert b["forecast"] is None and b["top_alert"] is None and b["alerts"] == 0 and b["recent_states"] == 1


@pytest.mark.parametrize("error", [0.01, 0.2])
def test_sketches_merge_and_keep_their_error(spark, error):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), rng.randint(0, 6), math.exp(rng.gauss(0, 4))) for _ in range(4000)]
    rows += [("x", 1, 0.0), ("x", 1, -3.0), ("z", 0, 7.0)] + [("x", 1, v) for v in (None, float("nan"), float("inf"))]
    df = spark.createDataFrame(rows, "k string, part int, ms double")
    one = sketch.merged(sketch.sketch(df, ["k", "part"], "ms", error), ["k"])
    probs = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["k"]: r for r in sketch.sketch_quantiles(one, ["k"], probs, error).collect()}
    whole = {r["k"]: r for r in sketch.sketch_quantiles(sketch.sketch(df, ["k"], "ms", error), ["k"], probs, error).collect()}
    assert got == whole
    for k in "xyz":
        v = sorted(max(0.0, m) for s, _, m in rows if s == k and m is not None and math.isfinite(m))
        assert got[k]["samples"] == len(v)
        for name, p in probs.items():
            exact = v[max(1, math.ceil(p * len(v))) - 1]
            assert abs(got[k][name] - exact) <= error * exact * (1 + 1e-9)
    with pytest.raises(ValueError):
        sketch.gamma(1.0)


def test_operations_metrics_on_nothing(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    out = flows.operations_metrics(none("quarantined boolean"), none("source_id long, event_time timestamp, depletion_fraction double"),
                                   none("category string, severity string"), none("stage string, ms double"))
    assert {(r["metric"], r["value"]) for r in out.collect()} == {("ingested", 0.0), ("quarantined", 0.0), ("quarantined_pct", 0.0)}
