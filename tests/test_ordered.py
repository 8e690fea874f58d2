"""Numbering, halos, running aggregates and quantiles against brute force, with one hot key and tiny blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.layout import Layout
from loamline.operators import uncertainty as U
from loamline.operators.quantiles import exact_quantiles
from loamline.operators.running import block_of, block_window, core_rows, index_rows, running, with_halo
from loamline.stage import stage

TINY = Layout(bucket_seconds=86400, block_rows=16, value_width=0.05)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = 0 if rng.random() < 0.5 else rng.randrange(1, 12)
        value = None if rng.random() < 0.3 else round(rng.uniform(-1, 1), 2)
        rows.append((key, f"2024-01-{rng.randrange(1, 29):02d} {rng.randrange(24):02d}:00:00", i, value))
    df = spark.createDataFrame(rows, "k int, t string, id int, v double").withColumn("t", F.to_timestamp("t"))
    return df, rows


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_positions_and_running_values(spark, data):
    df, rows = data
    ix = index_rows(df, ["k"], ["t", "id"], TINY)
    blocks = stage(ix.withColumn("block", block_of("rn", TINY)), "blocks")
    got = running(blocks, ["k"], {"total": ("sum", "v"), "top": ("max", "v"), "low": ("min", "v"), "last": ("last", "v"),
                                  "next": ("first_after", "v")}).collect()
    seen = {(r.k, r.rn): r for r in got}
    for k, items in by_key(rows).items():
        values = [r[3] for r in items]
        for i, r in enumerate(items):
            g = seen[(k, i + 1)]
            past = [v for v in values[: i + 1] if v is not None]
            future = [v for v in values[i:] if v is not None]
            assert g.id == r[2] and g.n == len(items)
            assert (g.total is None and not past) or g.total == pytest.approx(sum(past))
            assert g.top == (max(past) if past else None) and g.low == (min(past) if past else None)
            assert g.last == (past[-1] if past else None) and g.next == (future[0] if future else None)


def test_halo_windows_are_exact(spark, data):
    df, rows = data
    ix = index_rows(df, ["k"], ["t", "id"], TINY)
    w = block_window(["k"])
    got = core_rows(with_halo(ix, 5, 7, TINY).withColumns({
        "lag": F.lag("id", 5).over(w), "lead": F.lead("id", 7).over(w)})).collect()
    assert len(got) == len(rows)
    items = by_key(rows)
    for r in got:
        ids = [x[2] for x in items[r.k]]
        assert r.lag == (ids[r.rn - 6] if r.rn > 5 else None)
        assert r.lead == (ids[r.rn + 6] if r.rn + 6 < len(ids) else None)


def test_halo_longer_than_a_block_is_refused(data):
    with pytest.raises(ValueError):
        with_halo(data[0], before=17, layout=TINY)


def test_quantiles_equal_numpy(spark, data):
    df, rows = data
    probs = {"a": 0.1, "b": 0.5, "c": 0.9, "lo": 0.0, "hi": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, TINY).collect()}
    for k, items in by_key(rows).items():
        v = [r[3] for r in items if r[3] is not None]
        assert got[k].samples == len(v) and got[k].mean == pytest.approx(np.mean(v))
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.percentile(v, 100 * p), abs=1e-12)


def test_exceedance_counts_ties(spark):
    rng = random.Random(3)
    res = [(1, 6, round(rng.uniform(-0.2, 0.2), 2)) for _ in range(200)]
    counts = spark.createDataFrame(res, "source_id int, horizon int, residual double").groupBy(
        "source_id", "horizon", "residual").agg(F.count("*").alias("weight"))
    points = [(1, 6, round(0.3 + 0.01 * i, 2)) for i in range(40)] + [(2, 6, 0.6), (2, 6, 0.4)]
    q = spark.createDataFrame(points, "source_id int, horizon int, point double")
    got = {(r.source_id, r.point): r.exceedance for r in U.exceedance(counts, q, 0.5, TINY).collect()}
    for s, _, p in points:
        if s == 2:
            assert got[(2, p)] == (1.0 if p >= 0.5 else 0.0)
        else:
            want = np.mean([round(e, 12) >= round(0.5 - p, 12) for _, _, e in res])
            assert got[(1, p)] == pytest.approx(want)


def test_layout_grows_finer_with_size():
    small, large = Layout.for_bytes(1e6), Layout.for_bytes(1e14, 2500)
    assert small == Layout() and large.bucket_seconds < 86400 and large.value_width < small.value_width


def test_no_row_window_is_keyed_by_station_alone(spark):
    """Row numbers and leads run per bucket or block, and no side of a join is broadcast."""
    from loamline.plans.walk_forward import persistence_walk_forward

    rows = spark.range(1000).select(
        (F.col("id") % 3).alias("source_id"), F.timestamp_seconds(F.col("id") * 3600).alias("event_time"),
        *[(F.lit(0.2) + F.col("id") % d / 1000).alias(f"soil_moisture_{d}cm") for d in (5, 10, 20, 50, 100)])
    df = persistence_walk_forward(rows, ["event_time"], [1, 24])
    plan = df._jdf.queryExecution().executedPlan().toString()
    ranked = [x for x in plan.splitlines() if "Window [" in x and ("lead(" in x or "row_number()" in x)]
    assert ranked and all("_bucket" in x or "block" in x for x in ranked)
    assert "BroadcastExchange" not in plan
