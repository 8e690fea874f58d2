"""The shared rank table and the exceedance merge against numpy."""

import random

import numpy as np
import pytest

from loamline.layout import Layout
from loamline.operators import ranks as R
from loamline.operators import uncertainty as U


def residual_rows(seed=1):
    rng = random.Random(seed)
    rows = {}
    for s, h, n in (("a", 1, 4000), ("a", 6, 300), ("b", 1, 1), ("b", 6, 2), ("c", 1, 500)):
        for _ in range(n):
            v = 0.25 if s == "c" else rng.choice([round(rng.gauss(0.01, 0.05), 3), rng.gauss(0, 0.2), 0.0])
            k = (s, h, rng.choice(["WET", "DRY", "DRY"]), v)
            rows[k] = rows.get(k, 0) + rng.randint(1, 3)
    return [(*k, w) for k, w in rows.items()]


@pytest.mark.parametrize("width", [0.02, 1e-3, 5.0])
def test_ranks_equal_numpy(spark, width):
    rows = residual_rows()
    extra = [(None, 1, "WET", 0.1, 2), ("a", 1, "WET", None, 3), ("a", 1, "WET", float("nan"), 1), ("a", 1, None, 0.1, 1)]
    df = spark.createDataFrame(rows + extra, "source_id string, horizon int, regime string, residual double, weight long").repartition(5)
    r = U.ranked(df, Layout(value_width=width))
    probs = {"q05": 0.05, "q50": 0.5, "q90": 0.9}
    got = {(x["source_id"], x["horizon"], x["group"]): x for x in R.quantiles(r, probs).collect()}
    want = {}
    for s, h, g, v, w in rows:
        for group in (g, "ALL"):
            want.setdefault((s, h, group), []).extend([v] * w)
    assert set(got) == set(want)
    for k, values in want.items():
        assert got[k]["samples"] == len(values) and abs(got[k]["std"] - np.std(values)) < 1e-9
        for name, p in probs.items():
            assert abs(got[k][name] - np.quantile(values, p)) < 1e-12
    stds = {(x["source_id"], x["horizon"], x["group"]): x["std"] for x in R.deviations(r).collect()}
    assert all(abs(stds[k] - np.std(v)) < 1e-9 for k, v in want.items())
    fitted = U.fit_all(r, [0.8])
    mads = {(x["source_id"], x["horizon"]): x for x in U.dispersion_of(r, fitted).collect()}
    for (s, h, g), values in want.items():
        if g == "ALL":
            bias = np.median(values)
            assert abs(mads[s, h]["bias"] - bias) < 1e-12
            assert abs(mads[s, h]["scale"] - max(1e-5, 1.4826 * np.median(np.abs(np.array(values) - bias)))) < 1e-12


def test_exceedance_merge(spark):
    rows = residual_rows(3)
    res = spark.createDataFrame([(s, h, v, w) for s, h, _, v, w in rows], "source_id string, horizon int, residual double, weight long")
    rng = random.Random(5)
    asked = [(rng.choice(["a", "b", "c", "x", None]), rng.choice([1, 6]), rng.choice([round(rng.random(), 2), 0.25, None]), i) for i in range(400)] + [("a", 1, 0.5, 7)] * 3
    got = U.exceedance(res, spark.createDataFrame(asked, "source_id string, horizon int, point double, id int"), 0.5, Layout(value_width=0.01))
    assert got.columns == ["source_id", "horizon", "point", "id", "exceedance"]
    have = {}
    for s, h, _, v, w in rows:
        have.setdefault((s, h), []).extend([v] * w)
    out = sorted((tuple(r) for r in got.collect()), key=repr)
    want = []
    for s, h, p, i in asked:
        known = have.get((s, h))
        if known is None or p is None:
            e = float(p is not None and p >= 0.5)
        else:
            e = float(np.mean(np.round(known, 12) >= round(0.5 - p, 12)))
        want.append((s, h, p, i, e))
    want.sort(key=repr)
    assert len(out) == len(want) and all(a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-12 for a, b in zip(out, want))
