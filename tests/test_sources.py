"""Station files, device packets, contracts, station lookup, sinks."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loamline import sinks
from loamline.functions.keys import natural_key
from loamline.operators import faults
from loamline.plans import contracts
from loamline.sources import device_json, station_text
from loamline.sources.stations import evaluation_sites, match_stations, stations


def line(date="20230101", clock="0100", changes=None):
    f = ["53000", date, clock, date, clock, "2.622", "-96.85", "40.70"] + ["1.0"] * 30
    for i, v in (changes or {}).items():
        f[i] = v
    return "  ".join(f)


def test_station_files(spark, tmp_path):
    a, b = tmp_path / "CRNH0203-2023-NE_Lincoln_11_SW.txt", tmp_path / "CRNH0203-2023-IL_Champaign_9_SW.txt"
    a.write_text("\n".join([
        "# header", "", line(), line(clock="2400"), "too few fields", line("20231399", "0100"),
        line(clock="0300", changes={8: "-9999.0", 9: "7.5", 12: "-99.0", 28: "-99.000", 33: "nonsense"}),
        line(clock="0400", changes={8: "0.0", 9: "7.5"})]))
    b.write_text(line(clock="0500"))
    rows, bad = station_text.read_station_files(spark, str(tmp_path))
    got = {(r.source_id, r.event_time): r for r in rows.collect()}
    assert len(got) == 5 and {k[0] for k in got} == {"NE_Lincoln_11_SW", "IL_Champaign_9_SW"}
    assert ("NE_Lincoln_11_SW", dt.datetime(2023, 1, 2, 0, 0)) in got
    three, four = (got[("NE_Lincoln_11_SW", dt.datetime(2023, 1, 1, h))] for h in (3, 4))
    assert three.air_temp_c == 7.5 and three.precip_mm is None and three.soil_moisture_5cm is None and three.soil_temp_5cm is None
    assert four.air_temp_c == 0.0
    assert [r.failure_reason for r in bad.collect()] == ["unreadable time"]
    with pytest.raises(PySparkException):
        station_text.read_station_files(spark, str(tmp_path), "failfast")[0].collect()


def packet(**changes):
    p = {"device_id": "d1", "site_id": "f1", "timestamp_utc": "2023-06-01T00:00:00Z", "is_simulated": False,
         "sensors": {"soil_moisture_5cm": 0.25, "air_temp_c": None, "rh_pct": "wet", "solar_radiation_wm2": "NaN",
                     "precipitation_mm": "-Infinity"}}
    p.update(changes)
    return json.dumps(p)


def test_device_packets(spark):
    texts = [packet(), "NOT_VALID_JSON{{", '{"foo":"bar"}', packet(sensors={}), packet(timestamp_utc="soon"),
             packet(site_id=None, is_simulated=None)]
    df = spark.createDataFrame([(t.encode(),) for t in texts], "value binary")
    out = device_json.decode(df)
    good = device_json.good_packets(out).collect()
    assert [(g.site_id, g.data_class) for g in good] == [("f1", "OBSERVED"), ("FIELD_DEFAULT", "SIMULATED_REPLAY")]
    assert [(m.sensor_id, m.value) for m in good[0].measurements] == [("d1-soil_moisture_5cm", 0.25), ("d1-rh_pct", None), ("d1-solar_radiation_wm2", None),
                                                                        ("d1-precipitation_mm", None)]
    reasons = sorted(r.failure_reason for r in device_json.dead_letters(out).collect())
    assert reasons == ["device_id, timestamp_utc or sensors object is missing", "no sensor reading in the packet",
                       "packet is not a JSON object", "timestamp_utc is not a time"]


MEASURED = {"sensor_id": "a", "variable_name": "air_temperature", "depth_cm": 0.0, "value": None, "unit": "degC", "qc_flag": "MISSING"}


def event(**changes):
    e = {"schema_version": "1.0.0", "event_id": "00000000-0000-4000-8000-000000000000", "source_id": "s", "site_id": "f",
         "event_time": "2023-06-01T00:00:00Z", "ingest_time": "2023-06-01T00:00:05Z", "provenance": {"data_class": "OBSERVED", "network": "N"},
         "measurements": [MEASURED]}
    e.update(changes)
    return json.dumps({k: v for k, v in e.items() if v != "DROP"})


@pytest.mark.parametrize("text,want", [
    (event(), []),
    (event(site_id="DROP", extra=1), ["[root] 'site_id' is required", "[root] unknown field"]),
    (event(schema_version="one", event_id="x"), ["[event_id] is not a UUID", "[schema_version] is not a version"]),
    (event(measurements=[]), ["[measurements] is empty"]),
    ("[1", ["[root] is not a JSON object"]),
    ("[1]", ["[root] is not a JSON object"]),
    (event(source_id=None), ["[root] 'source_id' is required"]),
    (event(source_id=5), ["[source_id] has the wrong type"]),
    (event(provenance={"data_class": "OBSERVED"}), ["[provenance] 'network' is required"]),
    (event(provenance={"network": "N"}), ["[provenance] 'data_class' is required"]),
    (event(provenance={"data_class": "OBSERVED", "network": "N", "owner": 1}), ["[provenance] unknown field"]),
    (event(provenance={"data_class": "OBSERVED", "network": "N", "synthetic_fault_type": None}), []),
    (event(provenance="OBSERVED"), ["[provenance] has the wrong type"]),
    (event(measurements=[MEASURED | {"more": 1}]), ["[measurements] unknown field"]),
    (event(measurements=[{k: v for k, v in MEASURED.items() if k != "value"}]), ["[measurements] 'value' is required"]),
    (event(measurements=[{k: v for k, v in MEASURED.items() if k not in ("variable_name", "qc_flag")}]),
     ["[measurements] 'qc_flag' is required", "[measurements] 'variable_name' is required"]),
    (event(measurements=[MEASURED | {"value": "wet"}]), ["[measurements.value] has the wrong type"]),
    (event(measurements=[MEASURED | {"depth_cm": "deep"}]), ["[measurements.depth_cm] has the wrong type"]),
    (event(measurements=[MEASURED, 7]), ["[measurements] is not a list of objects"]),
    (event(event_time="2023"), ["[event_time] is not a time"]),
    (event(qc_summary={"flag_count": -1}), ["[qc_summary.flag_count] is negative"]),
])
def test_event_contract(spark, text, want):
    report = contracts.event_report(spark.createDataFrame([(text,)], "value string")).first()
    assert report.violations == want and report.is_valid == (not want)


def test_alert_contract_forbids_actuation(spark):
    row = {"schema_version": "1.0.0", "alert_id": "a", "category": "AGRONOMIC_RISK", "severity": "WARNING", "source_id": "s",
           "site_id": "f", "trigger_time": dt.datetime(2023, 6, 1), "threshold_type": "MANAGEMENT_ALLOWABLE_DEPLETION",
           "threshold_value": 0.5, "threshold_unit": "fraction", "actionable_guidance": "look", "is_autonomous_actuation": True}
    df = spark.createDataFrame([row])
    assert contracts.with_violations(df, contracts.alert_rules(df.columns)).first().violations == [
        "[is_autonomous_actuation] must be false"]


def test_null_readings_stay_in_the_json(spark):
    parsed = contracts.event_report(spark.createDataFrame([(event(),)], "value string")).select("event.*")
    body = json.loads(contracts.event_json(parsed).first().value)
    assert body["measurements"][0]["value"] is None and "qc_summary" not in body


def test_station_lookup(spark):
    assert stations(spark).count() == 9 and evaluation_sites(spark).count() == 5
    names = spark.createDataFrame([("NE_Lincoln_11_SW",), ("USCRN_CO_Nunn_7_NNE",), ("x-GA_Watkinsville_5_SSE-y",), ("?",)],
                                  "name string")
    got = {r.name: r.station_key for r in match_stations(names, spark).collect()}
    assert got["NE_Lincoln_11_SW"] == "NE_Lincoln_11_SW" and got["USCRN_CO_Nunn_7_NNE"] == "CO_Nunn_7_NNE"
    assert got["x-GA_Watkinsville_5_SSE-y"] == "GA_Watkinsville_5_SSE" and got["?"] is None


def test_idempotent_sink(spark, tmp_path):
    def batch(ids):
        rows = [(i, dt.datetime(2023, 6, 1 + i % 2), n) for n, i in enumerate(ids)]
        df = spark.createDataFrame(rows, "source_id int, event_time timestamp, n int")
        key = natural_key(F.col("source_id").cast("string"), F.col("event_time").cast("string"), F.lit("OBSERVED"), F.lit("1.0.0"))
        return df.withColumn("key", key)

    path = str(tmp_path / "events")
    assert sinks.write_new(batch([1, 2, 2]), path, "key", ["n"]) == {"inserted": 2, "duplicates": 1}
    assert sinks.write_new(batch([2, 3]), path, "key", ["n"]) == {"inserted": 1, "duplicates": 1}
    assert sinks.write_new(batch([2, 3]), path, "key", ["n"]) == {"inserted": 0, "duplicates": 2}
    assert sinks.write_new(batch([]), path, "key", ["n"]) == {"inserted": 0, "duplicates": 0}
    assert sorted((r.source_id, r.n) for r in spark.read.parquet(path).collect()) == [(1, 0), (2, 1), (3, 1)]
    with pytest.raises(PySparkException):
        sinks.read_if_exists(spark, path, ["no_such_column"])


def test_json_lines_are_appended_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n int")
    path = str(tmp_path / "lines")
    assert [sinks.append_json(df, path, "k", ["n"]) for _ in range(2)] == [2, 0]
    assert sorted((r.k, r.n) for r in spark.read.schema(df.schema).json(path).collect()) == [("a", 1), ("b", 2)]


def test_run_summary_and_ledger(spark):
    counts = spark.createDataFrame([(10, 2)], "total_records long, quarantined long")
    scores = spark.createDataFrame([(24, 0.1, 0.2, 0.3, 0.8), (1, 0.01, 0.02, 0.9, 0.8)],
                                   "horizon int, mae double, rmse double, skill_vs_mean double, coverage double")
    summary = sinks.run_summary("R1", counts, scores)
    assert "| 24h | 0.1000 | 0.2000 | 80.0% | +0.300 |" in sinks.ledger_markdown(summary)
    manifest = sinks.run_manifest(summary, {"alpha": "1"}, "PERSISTENCE", 42).first()
    assert manifest.params == {"alpha": "1"} and manifest.metrics == {1: 0.01, 24: 0.1}


def test_packet_loss_does_not_depend_on_partitioning(spark):
    df = spark.range(2000)
    kept = lambda x: {(r.id, r.loss) for r in faults.packet_loss(x, [0.0, 0.3], [F.col("id").cast("string")]).collect()}
    one = kept(df)
    assert one == kept(df.repartition(7)) and len([k for k in one if k[1] == 0.0]) == 2000
    assert 0.25 < 1 - len([k for k in one if k[1] == 0.3]) / 2000 < 0.35
