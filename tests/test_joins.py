"""As-of joins, range joins and the EWMA scan against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loamline.layout import Layout
from loamline.operators import faults
from loamline.operators.asof import asof_join
from loamline.operators.forecast import ewma
from loamline.operators.range_join import range_join

T0 = dt.datetime(2023, 6, 1)


def plain_asof(left, right, direction, tolerance, exact):
    out = []
    for k, t, name in left:
        cands = sorted((rt, tie, v) for rk, rt, tie, v in right if rk == k and rk is not None and rt is not None and t is not None
                       and (tolerance is None or abs((rt - t).total_seconds()) <= tolerance))
        before = [c for c in cands if c[0] < t or exact and c[0] == t]
        after = [c for c in cands if c[0] > t or exact and c[0] == t]
        b = before[-1] if before and direction != "forward" else None
        a = after[0] if after and direction != "backward" else None
        m = b if a is None or b is not None and t - b[0] <= a[0] - t else a
        out.append((k, t, name, m[2] if m else None, m[0] if m else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance,exact", [(None, True), (3 * 3600, False)])
def test_asof(spark, direction, tolerance, exact):
    rng = random.Random(3)
    time = lambda: T0 + dt.timedelta(minutes=30 * rng.randint(0, 120))
    keys = ["a"] * 8 + ["b", "c", None]
    left = [(rng.choice(keys), time() if rng.random() > 0.03 else None, f"l{i % 150}") for i in range(300)]
    right = [(rng.choice(keys), time() if rng.random() > 0.03 else None, i, float(i)) for i in range(90)]
    ldf = spark.createDataFrame(left, "k string, t timestamp, name string")
    rdf = spark.createDataFrame(right, "k string, t timestamp, tie int, v double")
    got = asof_join(ldf, rdf, ["k"], "t", ["v"], ["tie"], direction=direction, tolerance_seconds=tolerance, exact=exact,
                    layout=Layout(bucket_seconds=7200))
    assert sorted((tuple(r) for r in got.select("k", "t", "name", "v", "matched_time").collect()), key=repr) == plain_asof(left, right, direction, tolerance, exact)


def test_asof_empty_and_clashes(spark):
    left = spark.createDataFrame([("a", T0, 1.0)], "k string, t timestamp, x double")
    none = spark.createDataFrame([], "k string, t timestamp, v double")
    assert [tuple(r) for r in asof_join(left, none, ["k"], "t", ["v"]).collect()] == [("a", T0, 1.0, None, None)]
    assert asof_join(none.select("k", "t"), none, ["k"], "t", ["v"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(left.withColumn("v", F.lit(1)), none, ["k"], "t", ["v"])
    with pytest.raises(ValueError):
        asof_join(left, none, ["k"], "t", ["v"], direction="sideways")


def test_range_join(spark):
    rng = random.Random(5)
    points = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.randint(-50, 4000), None]), i) for i in range(400)]
    spans = []
    for i in range(300):
        a = rng.randint(-60, 4000)
        spans.append((rng.choice(["a", "a", "b", None]), a, a + rng.choice([-1, 0, 1, 1, 2, 7, 8, 9, 500, 3000]), i))
    p = spark.createDataFrame(points, "s string, x long, id int")
    s = spark.createDataFrame(spans, "s string, first long, past long, spec int")
    got = sorted((r["id"], r["spec"]) for r in range_join(p, s, ["s"], "x").collect())
    want = sorted((i, j) for k, x, i in points for m, a, b, j in spans if k is not None and k == m and x is not None and a <= x < b)
    assert got == want and len(want) > 1000
    assert range_join(p, s.limit(0), ["s"], "x").count() == 0


def test_many_faults_on_one_sensor(spark):
    """100,000 specifications on one sensor: the last one that covers an event wins; repeated readings stay."""
    n = 100_000
    specs = spark.range(n).select(F.col("id").cast("int").alias("spec"), (F.col("id") % 5000).alias("first"),
                                  (F.col("id") % 5000 + 1 + F.col("id") % 3).alias("past"), F.lit("m").alias("sensor_id"),
                                  F.lit("NON_PHYSICAL_RANGE").alias("kind"), (F.col("id") * 1.0).alias("forced"))
    readings = spark.range(6000).select((F.col("id") + 1).alias("event_rn"), F.lit("m").alias("sensor_id"), F.lit(0.2).alias("value"), F.lit("VALID").alias("qc_flag"))
    readings = readings.union(readings.where("event_rn <= 10")).union(readings.where("event_rn = 7").withColumn("sensor_id", F.lit("other")))
    out = faults.inject_table(readings, specs)
    best = {}
    for i in range(n):
        for x in range(i % 5000, i % 5000 + 1 + i % 3):
            best[x] = i
    got = [(r["event_rn"] - 1, r["value"]) for r in out.where("sensor_id = 'm' AND qc_flag = 'SYNTHETIC_CORRUPTED'").collect()]
    assert len(got) == len([x for x in best if x < 6000]) + 10 and all(best[x] == v for x, v in got)
    assert out.count() == 6011 and out.where("sensor_id = 'other'").first()["synthetic_fault_type"] is None


@pytest.mark.parametrize("alpha", [0.001, 0.2, 0.9, 0.999])
def test_ewma_scan_equals_fold(spark, alpha):
    rng = random.Random(2)
    n = {"a": 9000, "b": 1, "c": 310}
    rows = [(k, "test", i + 1, m, 0.1 + 0.4 * rng.random()) for k, m in n.items() for i in range(m)]
    df = spark.createDataFrame(rows, "source_id string, split string, rn long, n long, y double")
    seeds = spark.createDataFrame([("a", "test", 0.55, 9000)], "source_id string, split string, seed double, n long")
    for given in (None, seeds):
        out = ewma(df, alpha, ["source_id", "split"], (-9.0, 9.0), given, Layout(block_rows=1000))
        assert "collect_list" not in out._jdf.queryExecution().toString()
        got = {(r["source_id"], r["rn"]): r["point"] for r in out.collect()}
        assert len(got) == len(rows)
        for k in n:
            mine = [r[4] for r in rows if r[0] == k]
            level = 0.55 if given is not None and k == "a" else mine[0]
            for i, y in enumerate(mine):
                level = alpha * y + (1 - alpha) * level
                assert abs(got[k, i + 1] - level) < 5e-15
