"""Quality rules, water state, decision rules and the eight scenarios."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from loamline.layout import Layout
from loamline.operators import decision as D
from loamline.operators import qc
from loamline.operators.filters import FilterRules, filter_alerts
from loamline.operators.state import build_states, check_sites
from loamline.plans import operational, robustness

TINY = Layout(bucket_seconds=6 * 3600, block_rows=12)
T0 = dt.datetime(2023, 6, 1)
READING = ("source_id string, event_time timestamp, ord int, sensor_id string, variable_name string, depth_cm double, "
           "value double, unit string, qc_flag string")
VWC = "volumetric_water_content"


def reading(step, value, variable=VWC, depth=5.0, source="s", sensor=None, flag=None, ord_=0):
    unit = {"precipitation": "mm", VWC: "m3/m3"}.get(variable, "degC")
    flag = flag or ("MISSING" if value is None else "VALID")
    return (source, T0 + dt.timedelta(hours=step), ord_, sensor or f"{variable}-{depth}", variable, depth, value, unit, flag)


def flags(spark, rows, layout=TINY):
    out = qc.check_long(spark.createDataFrame(rows, READING), ["event_time"], layout)
    return [r.qc_flag for r in out.orderBy("source_id", "event_time", "ord").collect()]


def test_range_is_inclusive(spark):
    rows = [reading(i, v) for i, v in enumerate([0.6, None, 0.85, None, -0.05, None, 0.0])]
    assert flags(spark, rows) == ["VALID", "MISSING", "OUT_OF_RANGE", "MISSING", "OUT_OF_RANGE", "MISSING", "VALID"]


@pytest.mark.parametrize("rain,delta,want", [(0.0, 0.20, "SUSPECT_SPIKE"), (15.0, 0.20, "VALID"), (0.2, 0.20, "SUSPECT_SPIKE"),
                                              (0.0, 0.02, "VALID")])
def test_spike_needs_a_dry_jump(spark, rain, delta, want):
    rows = [reading(0, 0.20), reading(1, rain, "precipitation", 0.0, ord_=0), reading(1, 0.20 + delta, ord_=1)]
    assert flags(spark, rows)[-1] == want


def test_stuck_after_twelve_and_its_exemptions(spark):
    same = [reading(i, 0.255) for i in range(12)]
    assert flags(spark, same) == ["VALID"] * 11 + ["SUSPECT_STUCK"]
    assert set(flags(spark, [reading(i, 0.0, "precipitation", 0.0) for i in range(14)])) == {"VALID"}
    assert set(flags(spark, [reading(i, 0.25, depth=20.0) for i in range(14)])) == {"VALID"}
    gap = [reading(i, None if i == 5 else 0.255) for i in range(16)]
    assert "SUSPECT_STUCK" not in flags(spark, gap)


def test_injected_values_leave_no_history(spark):
    rows = [reading(0, 0.25), reading(1, 0.58, flag="SYNTHETIC_CORRUPTED"), reading(2, 0.26)]
    assert flags(spark, rows) == ["VALID", "SYNTHETIC_CORRUPTED", "VALID"]


def test_stations_do_not_share_history(spark):
    rows = [reading(i, 0.2 if s == "a" else 0.5, source=s, sensor="x") for i in range(3) for s in "ab"]
    assert set(flags(spark, rows)) == {"VALID"}


def test_state_of_a_profile(spark):
    row = {f"soil_moisture_{d}cm": 0.25 for d in (5, 10, 20, 50, 100)}
    s = build_states(spark.createDataFrame([row])).first()
    assert s.theta_rz == pytest.approx(0.25) and s.depletion_fraction == pytest.approx(0.07 / 0.18) and s.is_valid
    weights = {5: 0.1, 10: 0.1, 20: 0.2, 50: 0.4, 100: 0.2}
    row = dict(zip(row, (0.30, 0.30, 0.25, 0.20, 0.15)))
    s = build_states(spark.createDataFrame([row]), weights=weights).first()
    assert s.theta_rz == pytest.approx(0.22) and s.storage_mm == pytest.approx(220) and s.deficit_mm == pytest.approx(100)


def test_site_rules(spark):
    sites = spark.createDataFrame([(0.45, 0.32, 0.14), (0.45, 0.10, 0.14)], "theta_sat double, theta_fc double, theta_wp double")
    sites = sites.withColumns({"root_depth_cm": F.lit(100.0), **{f"w{d}": F.lit(0.2) for d in (5, 10, 20, 50, 100)}})
    good, bad = check_sites(sites).orderBy(F.desc("theta_fc")).collect()
    assert good.violations == [] and good.taw_mm == pytest.approx(180) and good.theta_mad == pytest.approx(0.23)
    assert bad.violations == ["theta_fc must exceed theta_wp"]


@pytest.mark.parametrize("point,h,low,high,want", [
    (0.35, 24, 0.30, 0.42, "DEFINITELY_NOT_REACHED"), (0.46, 24, 0.42, 0.54, "PLAUSIBLY_REACHED"),
    (0.55, 24, 0.50, 0.62, "LIKELY_REACHED"), (0.48, 168, 0.40, 0.60, "HIGHLY_UNCERTAIN")])
def test_certainty_classes(spark, point, h, low, high, want):
    c = D.certainty(F.lit(point), F.lit(h), F.lit(low), F.lit(high), F.lit(None).cast("double"))
    assert spark.range(1).select(c.alias("c")).first().c == want


def test_risk_rules_are_checked():
    with pytest.raises(ValueError):
        D.RiskRules(mad=0.9, critical=0.8)


def scenario(number):
    """(value, rain, fault) per step; drifting values are built by repeated subtraction."""
    out = []
    if number == 1:
        out = [(0.55 if h == 5 else 0.26, h == 5) for h in range(12)]
    if number == 2:
        out = [(0.2615, h >= 12) for h in range(18)]
    if number == 3:
        out = [(None if 3 <= h < 9 else 0.24, 3 <= h < 9) for h in range(12)]
    if number == 4:
        v = 0.28
        for h in range(10):
            v -= 0.06 if h == 4 else 0.001
            out.append((v, False))
    if number == 5:
        v = 0.18
        for h in range(10):
            v += 0.035 if h == 4 else 0.0
            out.append((v, False))
    if number == 6:
        v = 0.236
        for h in range(12):
            v -= 0.001
            out.append((v, False))
    if number == 7:
        v = 0.22
        for h in range(24):
            v -= 0.006 if h > 0 and h % 2 == 0 else 0.0
            out.append((v, False))
    if number == 8:
        out = [(0.232 if h % 2 == 0 else 0.228, False) for h in range(12)]
    return out


RAW_AND_CONFIRMED = {1: (1, 1), 2: (7, 7), 3: (6, 6), 4: (7, 5), 5: (11, 9), 6: (7, 6), 7: (24, 23), 8: (6, 0)}


def test_eight_scenarios_at_once(spark):
    rows = []
    for number in RAW_AND_CONFIRMED:
        for h, (v, fault) in enumerate(scenario(number)):
            flag = lambda x: ("SYNTHETIC_CORRUPTED" if x is not None else "MISSING") if fault else None
            for i, d in enumerate((5.0, 10.0, 20.0, 50.0, 100.0)):
                rows.append(reading(h, v, VWC, d, f"s{number}", flag=flag(v), ord_=i))
            rows.append(reading(h, 0.0, "precipitation", 0.0, f"s{number}", flag=flag(0.0), ord_=5))
    events = operational.events_from_readings(spark.createDataFrame(rows, READING), ["event_time"], TINY)
    candidates = operational.decision_candidates(events, layout=TINY)
    alerts = filter_alerts(candidates, FilterRules(k=2), TINY)
    got = {r.source_id: (r.raw, r.confirmed) for r in alerts.groupBy("source_id").agg(
        F.count("*").alias("raw"), F.count_if(F.col("status") == "CONFIRMED").alias("confirmed")).collect()}
    assert got == {f"s{k}": v for k, v in RAW_AND_CONFIRMED.items()}
    quarantined = events.where("quarantined").select("source_id", "step")
    assert candidates.where("category = 'AGRONOMIC_RISK'").join(quarantined, ["source_id", "step"], "left_semi").isEmpty()


def test_forecast_risk_joins_the_cycle(spark):
    values = [0.24, 0.238, 0.236, 0.22, 0.219]  # the last two are past the allowed depletion already
    rows = [reading(h, v, VWC, d, "s", ord_=i) for h, v in enumerate(values) for i, d in enumerate((5.0, 10.0, 20.0, 50.0, 100.0))]
    events = operational.events_from_readings(spark.createDataFrame(rows, READING), ["event_time"], TINY)
    early = spark.createDataFrame([("s", k, 24, 0.52, 0.8, "LIKELY_REACHED") for k in (1, 2, 4)],
                                  "source_id string, step long, horizon int, point double, exceedance double, certainty string")
    risk = lambda e: {r.step: r.horizon for r in operational.decision_candidates(events, layout=TINY, early=e).where("category = 'AGRONOMIC_RISK'").collect()}
    assert risk(early) == {1: 24, 2: 24, 4: None, 5: None}
    assert risk(None) == {4: None, 5: None}


def test_skipped_series_are_reported(spark):
    from loamline.operators.series import skipped_series

    rows = spark.range(30).select((F.col("id") % 3 == 0).cast("int").alias("source_id"))
    assert [(r.source_id, r.readings, r.reason) for r in skipped_series(rows, [5], 10).collect()] == [(1, 10, "fewer than 15 readings")]


def test_long_check_in_blocks_moves_readings_once(spark):
    """Sensors absent for whole blocks of events, injected values and rain of earlier blocks, next to a plain scan."""
    rnd, rows, want = random.Random(5), [], {}
    for source in "ab":
        rain, past = 0.0, {}
        for step in range(70):
            # the third sensor is away for blocks at a time, the rain gauge reports once in a while
            there = ["x", "y"] + (["z"] if step < 9 or step > 50 else []) + (["r"] if step % 17 == 3 else [])
            now = []
            for i, sensor in enumerate(there):
                if sensor == "r":
                    value = rnd.choice([0.0, 5.0])
                    rain, flag = value, None
                else:
                    value = {"x": 0.3 if step > 20 else rnd.random() / 2, "y": rnd.random() / 2, "z": 0.21}[sensor]
                    flag = "SYNTHETIC_CORRUPTED" if rnd.random() < 0.1 else None
                now.append((sensor, value, flag))
                rows.append(reading(step, value, "precipitation" if sensor == "r" else VWC, 5.0, source, sensor, flag, i))
            for sensor, value, flag in now:
                if flag is None:
                    seen = past.setdefault(sensor, [])
                    jump = bool(seen) and abs(value - seen[-1]) > 0.15 and not rain > 0.2
                    seen.append(value)
                    last = seen[-12:]
                    flat = len(last) == 12 and max(last) - last[0] <= 1e-5 and last[0] - min(last) <= 1e-5
                    flat = flat and not (sensor == "r" and last[0] == 0.0)
                    flag = "SUSPECT_SPIKE" if jump and sensor != "r" else "SUSPECT_STUCK" if flat else "VALID"
                want[source, step + 1, sensor] = flag
    readings = spark.createDataFrame(rows, READING)
    got = lambda df: {(r.source_id, r.event_rn, r.sensor_id): r.qc_flag for r in df.collect()}
    assert got(qc.check_long(readings, ["event_time"], TINY)) == want
    numbered = readings.withColumn("number", (F.unix_timestamp("event_time") - F.lit(int(T0.replace(tzinfo=dt.timezone.utc).timestamp()))) / 3600 + 1)
    numbered = numbered.withColumn("number", F.col("number").cast("long"))
    dealt = numbered.withColumn("event_block", F.floor((F.col("number") - 1) / 12).cast("long")).repartition("source_id", "event_block")
    checked = qc.check_long(numbered, ["number"], TINY, position="number", dealt=dealt)
    assert got(checked) == want
    summary = qc.summarise_events(checked, ["source_id", "event_block", "event_rn"])
    # the readings are not dealt by sensor (but for the few before a block), nor again by event
    dealings = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", summary._jdf.queryExecution().executedPlan().toString())
    assert not [d for d in dealings if "event_rn" in d]
    assert len([d for d in dealings if "sensor_id" in d]) == 2


def test_packet_loss_orders_events_once(spark, monkeypatch):
    """The copies of an event carry its position, not the columns of the order; events without a station are counted, too."""
    written = {}
    plain = robustness.stage
    monkeypatch.setattr(robustness, "stage", lambda df, label: written.setdefault(label, plain(df, label)))
    rows = [(s, T0 + dt.timedelta(hours=i // 2), None if i == 7 else i % 2, 0.2 + i / 1000)
            for s in ("a", None) for i in range(20)]
    frame = spark.createDataFrame(rows, "source_id string, event_time timestamp, nr int, v double").select(
        "source_id", "event_time", "nr", *[F.col("v").alias(f"soil_moisture_{d}cm") for d in (5, 10, 20, 50, 100)])
    twice = frame.unionByName(frame)
    out = robustness.packet_loss_table(twice, ["event_time", "nr"], [F.col("nr").cast("string"), F.col("event_time").cast("string")],
                                       rates=(0.0, 0.5), layout=TINY)
    got = {r.loss: r for r in out.collect()}
    assert got[0.0].received == 80 and got[0.0].quarantined == 0 and got[0.0].states == 80
    assert 0 < got[0.5].received < 80 and got[0.5].states == got[0.5].received
    assert {r.state_mae for r in got.values()} == {0.0}
    assert set(written) == {"ordered", "loss"} and not {"event_time", "nr"} & set(written["loss"].columns)
    # the second of two equal events has the truth of both, one of unknown order has none
    places = {r[0] for r in written["loss"].where("loss = 0 AND station = 'a'").select("_same").collect()}
    assert places - {None} == {p for p in range(1, 41, 2) if p in places} and None in places
