"""Contracts compiled from trees: faults at every level, and the JSON of the engine's own rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loamline.operators.forecast import fan_out
from loamline.plans import contract_tree as C
from loamline.plans import contracts
from loamline.sources import event_json

T0 = dt.datetime(2024, 5, 1, 12)


def forecast():
    return {"schema_version": "1.0.0", "forecast_id": "0f8fad5b-d9cb-469f-a165-70867728950e", "source_id": "s", "site_id": "f",
            "forecast_origin_time": "2024-05-01T12:00:00Z", "generated_at": "2024-05-01T12:00:01+00:00", "target_variable": "volumetric_water_content",
            "target_depth_range_cm": [0.0, 100], "model_metadata": {"model_name": "m", "model_version": "1", "random_seed": 42},
            "predictions": [{"horizon_hours": 1, "valid_time": "2024-05-01T13:00:00Z", "point_forecast": 0.2, "unit": "m3/m3",
                             "quantiles": {"q10": 0.1, "q50": 0.2, "q90": 0.3}, "prediction_interval_80": {"lower": 0.1, "upper": 0.3}}]}


def alert():
    return {"schema_version": "1.0.0", "alert_id": "0f8fad5b-d9cb-469f-a165-70867728950e", "category": "AGRONOMIC_RISK", "severity": "WARNING", "source_id": "s",
            "site_id": "f", "trigger_time": "2024-05-01T12:00:00Z", "trigger_condition": {"threshold_type": "MANAGEMENT_ALLOWABLE_DEPLETION", "threshold_value": 0.5},
            "actionable_guidance": "look at it", "is_autonomous_actuation": False}


def changed(record, path, value=KeyError):
    out = json.loads(json.dumps(record))
    at = out
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


P = ("predictions", 0)
FORECASTS = [
    (forecast(), []), (changed(forecast(), ["target_depth_range_cm"]), []), (changed(forecast(), ["target_depth_range_cm"], None), []),
    (changed(forecast(), [*P, "quantiles"]), []), (changed(forecast(), [*P, "quantiles", "q25"], None), []),
    (changed(forecast(), ["site_id"]), ["[root] 'site_id' is required"]), (changed(forecast(), ["site_id"], None), ["[root] 'site_id' is required"]),
    (changed(forecast(), ["site_id"], ""), ["[site_id] is empty"]), (changed(forecast(), ["site_id"], 5), ["[site_id] has the wrong type"]),
    (changed(forecast(), ["extra"], 1), ["[root] unknown field"]), (changed(forecast(), ["model_metadata", "extra"], 1), ["[model_metadata] unknown field"]),
    (changed(forecast(), [*P, "extra"], 1), ["[predictions] unknown field"]), (changed(forecast(), [*P, "quantiles", "q99"], 1), ["[predictions.quantiles] unknown field"]),
    (changed(forecast(), ["forecast_id"], "x"), ["[forecast_id] is not a UUID"]), (changed(forecast(), ["schema_version"], "1"), ["[schema_version] is not a version"]),
    (changed(forecast(), ["generated_at"], "noon"), ["[generated_at] is not a time"]), (changed(forecast(), ["target_variable"], "x"), ["[target_variable] is not allowed"]),
    (changed(forecast(), ["predictions"], []), ["[predictions] is empty"]), (changed(forecast(), ["predictions"], {}), ["[predictions] has the wrong type"]),
    (changed(forecast(), ["predictions", 0], 3), ["[predictions] has items of the wrong type"]), (changed(forecast(), [*P, "unit"]), ["[predictions] 'unit' is required"]),
    (changed(forecast(), [*P, "horizon_hours"], 0), ["[predictions.horizon_hours] is below one"]),
    (changed(forecast(), [*P, "horizon_hours"], 1.5), ["[predictions.horizon_hours] is not a whole number"]),
    (changed(forecast(), [*P, "quantiles", "q10"], 0.9), ["[predictions.quantiles] quantiles are not ordered"]),
    (changed(forecast(), [*P, "prediction_interval_80", "lower"]), ["[predictions.prediction_interval_80] 'lower' is required"]),
    (changed(forecast(), ["target_depth_range_cm"], [1.0]), ["[target_depth_range_cm] has fewer than 2 items"]),
    (changed(forecast(), ["target_depth_range_cm"], [1, 2, 3]), ["[target_depth_range_cm] has more than 2 items"]),
    (changed(changed(forecast(), ["site_id"]), [*P, "unit"], "K"), ["[predictions.unit] is not allowed", "[root] 'site_id' is required"])]
ALERTS = [
    (alert(), []), (changed(alert(), ["context"], None), []), (changed(alert(), ["context"], {"crop_type": None}), []),
    (changed(alert(), ["trigger_condition", "exceedance_probability"], 1.2), ["[trigger_condition.exceedance_probability] is above 1"]),
    (changed(alert(), ["trigger_condition", "exceedance_probability"], -1), ["[trigger_condition.exceedance_probability] is negative"]),
    (changed(alert(), ["is_autonomous_actuation"], True), ["[is_autonomous_actuation] must be false"]),
    (changed(alert(), ["actionable_guidance"], "no"), ["[actionable_guidance] is shorter than 5"]),
    (changed(alert(), ["trigger_condition"]), ["[root] 'trigger_condition' is required"]), (changed(alert(), ["severity"], "BAD"), ["[severity] is not allowed"]),
    (changed(alert(), ["context"], {"mood": "x"}), ["[context] unknown field"])]


@pytest.mark.parametrize("contract,cases", [(C.FORECAST, FORECASTS), (C.ALERT, ALERTS)])
def test_faults(spark, contract, cases):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(cases)] + [(100, None), (101, "{"), (102, "[1]"), (103, "3"), (104, "null")]
    got = {r["i"]: r["violations"] for r in C.report(spark.createDataFrame(rows, "i int, value string"), contract).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, (i, got[i], want)
    assert all(got[k] == ["[root] is not a JSON object"] for k in range(100, 105))


def test_telemetry_tree_agrees_with_the_rules(spark):
    good = {"schema_version": "1.0.0", "event_id": "0f8fad5b-d9cb-469f-a165-70867728950e", "source_id": "s", "site_id": "f", "event_time": "2024-05-01T12:00:00Z",
            "ingest_time": "2024-05-01T12:00:00Z", "provenance": {"data_class": "OBSERVED", "network": "n", "dataset_version": "1"},
            "measurements": [{"sensor_id": "a", "variable_name": "precipitation", "depth_cm": 0, "value": None, "unit": "mm", "qc_flag": "MISSING"}]}
    m = ("measurements", 0)
    cases = [good] + [changed(good, p, v) for p, v in [
        (["site_id"], KeyError), (["event_id"], "x"), (["x"], 1), (["provenance", "network"], KeyError), (["provenance", "data_class"], "GUESSED"), (["provenance", "x"], 1),
        ([*m, "unit"], KeyError), ([*m, "unit"], "K"), ([*m, "depth_cm"], -1), ([*m, "value"], "wet"), ([*m, "value"], KeyError), ([*m, "x"], 1), (["measurements"], []),
        (["event_time"], "noon"), (["qc_summary"], {"flag_count": -1}), (["schema_version"], "v1"), (["source_id"], "")]]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, value string")
    ours = {r["i"]: r["violations"] for r in C.report(df, C.TELEMETRY).collect()}
    theirs = {r["i"]: r["violations"] for r in contracts.event_report(df).collect()}
    assert ours == theirs and ours[0] == [] and all(ours[i] for i in range(1, len(cases)))


def test_own_forecasts_conform_and_round_trip(spark):
    rows = spark.createDataFrame([("s\"1", T0, 0.21234567), ("s2", T0, 0.3)], "source_id string, event_time timestamp, point double")
    rows = fan_out(rows, [24, 1]).withColumns({q: F.col("point") + d for q, d in (("q10", -0.1), ("q25", -0.05), ("q50", 0.0), ("q75", 0.05), ("q90", 0.1))})
    rows = rows.withColumn("q25", F.when(F.col("source_id") != "s2", F.col("q25")))
    records = C.forecast_records(rows, "PERSISTENCE", "m3/m3", generated=F.col("event_time"))
    out = C.report(C.as_json(records, C.FORECAST), C.FORECAST).orderBy("source_id").collect()
    assert [r["violations"] for r in out] == [[], []]
    one, two = (json.loads(r["value"]) for r in out)
    assert one["source_id"] == 's"1' and [p["horizon_hours"] for p in one["predictions"]] == [1, 24] and one["predictions"][0]["point_forecast"] == 0.2123
    assert one["site_id"] == 'FIELD_s"1' and "training_cutoff_time" not in one["model_metadata"] and one["predictions"][1]["valid_time"] == "2024-05-02T12:00:00Z"
    assert "q25" not in two["predictions"][0]["quantiles"] and set(two["predictions"][0]["quantiles"]) == {"q10", "q50", "q75", "q90"}


def test_own_alerts_conform_and_prune(spark):
    rows = [("a", T0, 1, 0, "DATA_QUALITY_ALERT", "CRITICAL", "SENSOR_OUT_OF_RANGE", 0.9, "m3/m3", None, None, 0.9, "bad \\ \"reading\"", "Reading quarantined"),
            ("a", T0, 1, 10, "AGRONOMIC_RISK", "WARNING", "MANAGEMENT_ALLOWABLE_DEPLETION", 0.5, "fraction", 24, 0.8, 0.6, None, "Depletion may pass"),
            ("a", T0, 1, 2, "PHYSICAL_DEVIATION", "WARNING", "MASS_BALANCE_RESIDUAL", 0.02, "m3/m3/hr", None, None, 0.03, "dry", "Check the site")]
    df = spark.createDataFrame(rows, "source_id string, event_time timestamp, step int, ord int, category string, severity string, threshold_type string, "
                               "threshold_value double, threshold_unit string, horizon int, exceedance double, predicted_value double, reason string, guidance string")
    out = {r["ord"]: r for r in C.report(C.as_json(C.alert_records(df), C.ALERT), C.ALERT).collect()}
    assert all(r["violations"] == [] for r in out.values())
    quality, risk, dry = (json.loads(out[k]["value"]) for k in (0, 10, 2))
    assert quality["context"] == {"qc_failure_reason": 'bad \\ "reading"'} and "context" not in dry and risk["context"] == {"current_depletion_fraction": 0.6}
    assert risk["trigger_condition"]["forecast_horizon_hours"] == 24 and "forecast_horizon_hours" not in dry["trigger_condition"]


def test_event_lines_are_read_or_rejected(spark, tmp_path):
    good = {"schema_version": "1.0.0", "event_id": "0f8fad5b-d9cb-469f-a165-70867728950e", "source_id": "s", "site_id": "f", "event_time": "2024-05-01T12:00:00+02:00",
            "ingest_time": "2024-05-01T12:00:00Z", "provenance": {"data_class": "OBSERVED", "network": "n"},
            "measurements": [{"sensor_id": "a", "variable_name": "precipitation", "depth_cm": 0, "value": None, "unit": "mm", "qc_flag": "MISSING"},
                             {"sensor_id": "b", "variable_name": "air_temperature", "depth_cm": 0, "value": 1.5, "unit": "degC", "qc_flag": "VALID"}]}
    lines = [json.dumps(good), json.dumps(changed(good, ["site_id"])), "no json", ""]
    (tmp_path / "e.jsonl").write_text("\n".join(lines) + "\n")
    events, rejected = event_json.read_event_files(spark, str(tmp_path))
    one = events.collect()
    assert len(one) == 1 and one[0]["event_time"] == dt.datetime(2024, 5, 1, 10) and one[0]["qc_summary"] is None
    assert [(r["ord"], r["sensor_id"], r["value"], r["data_class"]) for r in event_json.readings(events).orderBy("ord").collect()] == [(0, "a", None, "OBSERVED"), (1, "b", 1.5, "OBSERVED")]
    assert sorted((r["value"] == "", r["violations"]) for r in rejected.collect()) == [
        (False, ["[root] 'site_id' is required"]), (False, ["[root] is not a JSON object"]), (True, ["[root] is not a JSON object"])]
    clash = spark.createDataFrame([(lines[0], 7, "x"), (None, 8, "y")], "value string, file int, source_id string")
    events, rejected = event_json.split_events(clash)
    assert [(r["file"], r["source_id"]) for r in events.collect()] == [(7, "s")] and [r["file"] for r in rejected.collect()] == [8]


def test_checks_are_not_repeated_by_filters(spark):
    """A filter on the outcome must not compute the rules, nor what the text is made of, a second time."""

    lines = spark.range(3).select(F.to_json(F.struct(F.col("id").alias("source_id"))).alias("value"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = contracts.event_report(lines).select(F.explode("violations").alias("v")).groupBy("v").count()
    assert plan(found).count("parseJson") == 1
    good, bad = event_json.split_events(lines)
    for df in (good, event_json.readings(good), bad):
        assert plan(df).count("parseJson") == 1
        assert plan(df).count("evaluate(struct(source_id") == 1


def test_several_faults_of_one_value_are_all_told(spark):
    part = C.Obj({"x": C.Leaf("integer", least=1), "y": C.Leaf(pattern=("is odd", "^a"), min_length=3)})
    out = C.report(spark.createDataFrame([('{"x": 0.5, "y": "b"}',), ('{"x": 2, "y": "abc"}',), (None,)], "value string"), part).collect()
    assert out[0].violations == ["[x] is below one", "[x] is not a whole number", "[y] is odd", "[y] is shorter than 3"]
    assert out[1].violations == [] and out[1].is_valid
    assert out[2].violations == ["[root] is not a JSON object"]


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_faults_are_joined_once_and_records_written_at_once(spark):
    """Each text of faults is computed once, not again at every level, and one writer makes the whole JSON of a record."""
    raw = spark.createDataFrame([("{}",)], "value string")
    joins = optimised(C.report(raw, C.FORECAST)).count("concat_ws")
    parts = lambda p: 1 + (sum(map(parts, p.fields.values())) if isinstance(p, C.Obj) else parts(p.item) if isinstance(p, C.List) else 0)
    assert 0 < joins <= 2 * parts(C.FORECAST)
    rows = spark.sql("select 's' source_id, timestamp'2024-01-01' event_time, 1 horizon, timestamp'2024-01-01 01:00:00' valid_time, 0.5d point, "
                     "0.1d q10, 0.2d q25, 0.3d q50, 0.4d q75, 0.5d q90 from range(2)")
    plan = optimised(C.as_json(C.forecast_records(rows, "M", "mm"), C.FORECAST)).lower()
    assert plan.count("to_json") + plan.count("structstojson") == 1


def test_records_are_written_as_part_by_part(spark):
    part = C.Obj({"a": C.Leaf("integer"), "b": C.Leaf(), "o": C.Obj({"x": C.Leaf("number"), "f": C.Leaf("flag")}), "l": C.List(C.Obj({"t": C.Leaf()}))})
    kind = "r struct<l:array<struct<t:string>>, b:string, a:double, o:struct<x:double,f:boolean>>"
    values = [([("é\"\\\n",), (None,), None], "q", 3.0, (0.1, None)), (None, None, None, (None, None)), ([], "", None, None), None,
              (None, " /", 7.9, (float("nan"), True)), ([("t",)], None, -0.0, (1e-7, False)), (None, None, None, (float("inf"), None))]
    df = spark.createDataFrame([(v,) for v in values], kind)
    got = df.select(C.json_of(part, F.col("r")).alias("now"), C._written(part, F.col("r")).alias("was")).collect()
    assert [r.now for r in got] == [r.was for r in got]


@pytest.mark.parametrize("quantiles,bad", [('{"q10":1,"q25":2}', False), ('{"q10":2,"q25":1}', True), ('{"q10":2,"q50":null,"q90":1}', True),
                                           ('{"q10":"x","q25":1,"q50":"0.5"}', True), ('{"q10":1,"q25":1.0,"q90":true}', None), ("{}", False)])
def test_order_of_quantiles(spark, quantiles, bad):
    v = F.parse_json(F.lit(quantiles))
    known = F.array_compact(F.array(*[F.try_variant_get(v, f"$.{n}", "double") for n in ("q10", "q25", "q50", "q75", "q90")]))
    now, was = spark.range(1).select(C._unordered(v), F.array_sort(known) != known).first()
    assert now == was and bad in (None, now)
