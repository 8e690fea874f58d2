"""Rows moved once: numbering, halos, previous rows and filters with hot keys cut between buckets, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loamline.layout import Layout
from loamline.operators.filters import FilterRules, filter_alerts
from loamline.operators.running import block_window, core_rows, deal, index_rows, previous, running
from loamline.operators.uncertainty import exceedance

TINY = Layout(bucket_seconds=86400, block_rows=16, value_width=0.05)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(500):
        key = 0 if rng.random() < 0.5 else rng.randrange(1, 40)
        out.append((key, f"2024-01-{rng.randrange(1, 29):02d} {rng.randrange(24):02d}:00:00", i, rng.choice([None, i / 10])))
    # days of many rows and of a single one, so that blocks are longer and shorter than the halo
    out += [(0, "2024-02-01 00:00:00", 1000 + i, None) for i in range(50)] + [(0, f"2024-02-{d:02d} 00:00:00", 2000 + d, 1.0) for d in range(2, 6)]
    return out


def in_order(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, t string, id int, v double").withColumn("t", F.to_timestamp("t"))


def test_dealt_rows_have_exact_positions_and_neighbours(spark, rows):
    odd = [(None, "2024-01-01 00:00:00", -1, 1.0)]
    dealt, few = deal(frame(spark, rows + odd), ["k"], ["t", "id"], TINY, before=5, after=7)
    w = block_window(["k"])
    got = core_rows(dealt.withColumns({"lag": F.lag("id", 5).over(w), "lead": F.lead("id", 7).over(w)})).collect()
    assert len(got) == len(rows) and 0 in {r.k for r in few.collect()}
    items = in_order(rows)
    assert len({r.block for r in got if r.k == 0}) > 5 and {r.block for r in got if len(items[r.k]) <= 16} == {0}
    for r in got:
        ids = [x[2] for x in items[r.k]]
        assert r.n == len(ids) and ids[r.rn - 1] == r.id
        assert r.lag == (ids[r.rn - 6] if r.rn > 5 else None)
        assert r.lead == (ids[r.rn + 6] if r.rn + 6 < len(ids) else None)


@pytest.mark.parametrize("layout", [TINY, Layout()])
def test_dealt_positions_equal_numbered_ones_with_nulls(spark, rows, layout):
    """Rows without a time are left out, but count before the others, as in ``index_rows``."""
    odd = [(k, None, -1 - i, 1.0) for i, k in enumerate([0] * 40 + [3, 3, 5, None])] + [(None, "2024-01-01 00:00:00", -100, 1.0), (77, None, -101, 1.0)]
    df = frame(spark, rows + odd)
    want = {r.id: (r.k, r.rn, r.n) for r in index_rows(df, ["k"], ["t", "id"], layout).collect()}
    dealt = deal(df, ["k"], ["t", "id"], layout, before=5, after=7)[0]
    got = {r.id: (r.k, r.rn, r.n) for r in core_rows(dealt).collect()}
    assert got == want and len(got) == len(rows)
    w = block_window(["k"])
    items = in_order(rows)
    for r in core_rows(dealt.withColumns({"lag": F.lag("id", 5).over(w), "lead": F.lead("id", 7).over(w)})).collect():
        ids = [x[2] for x in items[r.k]]
        i = ids.index(r.id)
        assert r.lag == (ids[i - 5] if i >= 5 else None) and r.lead == (ids[i + 7] if i + 7 < len(ids) else None)


@pytest.mark.parametrize("layout", [TINY, Layout()])
def test_running_and_previous_values_over_sized_blocks(spark, rows, layout):
    dealt, few = deal(frame(spark, rows), ["k"], ["t", "id"], layout)
    assert (few is None) == (layout != TINY)
    got = previous(running(dealt, ["k"], {"last": ("last", "v"), "total": ("sum", "v")}, few=few), ["k"], {"id_before": "id"}, few).collect()
    assert len(got) == len(rows)
    items = in_order(rows)
    for r in got:
        past = [x[3] for x in items[r.k][:r.rn] if x[3] is not None]
        assert r.last == (past[-1] if past else None)
        assert (r.total is None and not past) or r.total == pytest.approx(sum(past))
        assert r.id_before == (items[r.k][r.rn - 2][2] if r.rn > 1 else None)


def brute_force(alerts, rules):
    """Entries of every key in order: (counted alerts, quiet steps), and the runs of adjacent steps."""
    keys, out = {}, {}
    for a in sorted(alerts, key=lambda a: (a[1], a[2])):
        keys.setdefault((a[0], a[3], a[4]), []).append(a)
    for key, items in keys.items():
        entries, run, before = [], 0, None
        for a in items:
            counted = not (a[5] == "CRITICAL" and rules.pass_critical)
            if before is not None:
                entries += [0] * max(0, a[1] - before - 1)
            if before is None or a[1] - before > 1:
                run = 0
            if counted:
                run += 1
                entries.append(1)
            before = a[1]
            seen = run if rules.mode == "consecutive" else sum(entries[-rules.m:]) if counted else 0
            out[(key, a[1], a[2])] = seen
    return out


@pytest.mark.parametrize("rules", [FilterRules(), FilterRules(mode="n_of_m"), FilterRules(mode="n_of_m", n=1, m=1), FilterRules(mode="n_of_m", n=9, m=12)])
def test_filters_over_ranges_of_steps(spark, rules):
    rng = random.Random(5)
    alerts, step = [], 0
    for _ in range(300):
        step += rng.choice([1, 1, 1, 2, 9])
        for o in range(rng.choice([1, 1, 2])):
            alerts.append((rng.choice([1, 1, 1, 2]), step, o, "PHYSICAL_DEVIATION", rng.choice(["A", "A", "B"]), rng.choice(["WARNING", "INFO", "CRITICAL"])))
    df = spark.createDataFrame(alerts, "source_id int, step long, ord int, category string, threshold_type string, severity string")
    got = filter_alerts(df, rules, TINY).collect()
    want = brute_force(alerts, rules)
    assert len(got) == len(alerts)
    for r in got:
        assert r.seen == want[((r.source_id, r.category, r.threshold_type), r.step, r.ord)], r


def test_filtered_alerts_are_moved_once(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("source_id"), F.col("id").alias("step"), F.lit(0).alias("ord"), F.col("id").cast("string").alias("category"),
                                 F.col("id").cast("string").alias("threshold_type"), F.lit("INFO").alias("severity"))
    for rules in (FilterRules(), FilterRules(mode="n_of_m"), FilterRules(count_mode="steps")):
        plan = filter_alerts(df, rules)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 1


def test_exceedance_keeps_the_columns_of_its_queries(spark):
    counts = spark.createDataFrame([(1, 6, -0.1, 1), (1, 6, 0.1, 3)], "source_id int, horizon int, residual double, weight long")
    asked = spark.createDataFrame([("a", 6, 0.5, 1), ("b", 6, 0.65, 1)], "name string, horizon int, point double, source_id int")
    got = exceedance(counts, asked, 0.5)
    assert got.columns == [*asked.columns, "exceedance"]
    assert {r.name: r.exceedance for r in got.collect()} == {"a": 0.75, "b": 1.0}
