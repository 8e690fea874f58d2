"""Contract conformance as a job: every violation of every record, in one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline import schemas as S
from loamline.functions.keys import VERSION_PATTERN, is_uuid, parse_iso
from loamline.plans.contract_tree import let, with_once

EVENT_FIELDS = ["schema_version", "event_id", "source_id", "site_id", "event_time", "ingest_time", "provenance",
                "measurements", "qc_summary"]
EVENT_REQUIRED = EVENT_FIELDS[:-1]
RAW_EVENT = (
    "schema_version string, event_id string, source_id string, site_id string, event_time string, ingest_time string, "
    "provenance struct<data_class:string,network:string,dataset_version:string,replay_session_id:string,"
    "synthetic_fault_type:string>, measurements array<struct<sensor_id:string,variable_name:string,depth_cm:double,"
    "value:double,unit:string,qc_flag:string>>, qc_summary struct<all_valid:boolean,flag_count:int,quarantined:boolean>"
)
ALERT_REQUIRED = ["schema_version", "alert_id", "category", "severity", "source_id", "site_id", "trigger_time",
                  "threshold_type", "threshold_value", "threshold_unit", "actionable_guidance",
                  "is_autonomous_actuation"]


def violation(bad: Column, path: str, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(f"[{path}] {text}"))


def collect_violations(rules: list[Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*rules)))


def _short(c: Column) -> Column:
    return F.length(c) < 1


#: Fields of each object: name -> kinds of JSON value. A null counts as missing unless it is listed.
PROVENANCE = {"data_class": ("STRING",), "network": ("STRING",), "dataset_version": ("STRING",), "replay_session_id": ("STRING", "VOID"),
              "synthetic_fault_type": ("STRING", "VOID")}
NUMBER = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
MEASUREMENT = {"sensor_id": ("STRING",), "variable_name": ("STRING",), "depth_cm": NUMBER, "value": (*NUMBER, "VOID"), "unit": ("STRING",),
               "qc_flag": ("STRING",)}
SUMMARY = {"all_valid": ("BOOLEAN",), "flag_count": ("BIGINT",), "quarantined": ("BOOLEAN",)}
EVENT = {"provenance": ("OBJECT",), "measurements": ("ARRAY",), "qc_summary": ("OBJECT",)} | {
    f: ("STRING",) for f in ("schema_version", "event_id", "source_id", "site_id", "event_time", "ingest_time")}


def _kind(v: Column, path: str) -> Column:
    """Kind of the JSON value at ``path``; null if there is none."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def _field_rules(path: str, fields: Column, name: str, kinds: tuple[str, ...], required: bool) -> Column:
    """Rules of an object's field, its kind read once: missing or null though required, or of a wrong kind."""
    where = name if path == "root" else f"{path}.{name}"
    absent = lambda kind: kind.isNull() | ((kind == "VOID") & F.lit("VOID" not in kinds)) if required else F.lit(False)
    wrong = lambda kind: kind.isNotNull() & ~kind.isin(*kinds, *(["VOID"] if required else []))
    return let(_kind(F.try_element_at(fields, F.lit(name)), "$"), lambda kind: F.array(
        violation(absent(kind), path, f"'{name}' is required"), violation(wrong(kind), where, "has the wrong type")))


def _object_rules(path: str, v: Column, fields: dict[str, tuple[str, ...]], required: Sequence[str]) -> Column:
    """Rules of a JSON object and of its fields, opened once; none if it isn't an object."""

    def rules(m: Column) -> Column:
        unknown = F.size(F.array_except(F.map_keys(m), F.array(*[F.lit(f) for f in fields]))) > 0
        own = [_field_rules(path, m, f, kinds, f in required) for f, kinds in fields.items()]
        return F.when(m.isNotNull(), F.concat(*own, F.array(violation(unknown, path, "unknown field")))).otherwise(F.array().cast("array<string>"))

    return let(F.try_variant_get(v, "$", "map<string,variant>"), rules)


def event_violations(e: Column, v: Column) -> Column:
    """Sorted violations of a telemetry event: ``e`` is its struct, ``v`` the raw object as a variant."""
    m = e["measurements"]
    levels = [_object_rules("root", v, EVENT, EVENT_REQUIRED),
              _object_rules("provenance", F.try_variant_get(v, "$.provenance", "variant"), PROVENANCE, ("data_class", "network")),
              _object_rules("qc_summary", F.try_variant_get(v, "$.qc_summary", "variant"), SUMMARY, ())]
    # a fault that several items have is told once
    items = F.try_variant_get(v, "$.measurements", "array<variant>")
    each = F.transform(items, lambda x: F.when(F.coalesce(_kind(x, "$"), F.lit("")) != "OBJECT", F.array(F.lit("[measurements] is not a list of objects")))
                       .otherwise(_object_rules("measurements", x, MEASUREMENT, tuple(MEASUREMENT))))
    levels.append(F.when(items.isNotNull(), F.array_distinct(F.flatten(each))).otherwise(F.array().cast("array<string>")))
    rules = [
        violation(~e["schema_version"].rlike(VERSION_PATTERN), "schema_version", "is not a version"),
        violation(e["event_id"].isNotNull() & ~is_uuid(e["event_id"]), "event_id", "is not a UUID"),
        violation(_short(e["source_id"]), "source_id", "is empty"),
        violation(_short(e["site_id"]), "site_id", "is empty"),
        violation(e["event_time"].isNotNull() & parse_iso(e["event_time"]).isNull(), "event_time", "is not a time"),
        violation(e["ingest_time"].isNotNull() & parse_iso(e["ingest_time"]).isNull(), "ingest_time", "is not a time"),
        violation(~e["provenance"]["data_class"].isin(S.DATA_CLASSES), "provenance.data_class", "is not allowed"),
        violation(~e["provenance"]["synthetic_fault_type"].isin(S.FAULT_TYPES), "provenance.synthetic_fault_type",
                  "is not allowed"),
        violation(F.size(items) == 0, "measurements", "is empty"),
        violation(F.exists(m, lambda x: ~x["variable_name"].isin(S.VARIABLES)), "measurements.variable_name",
                  "is not allowed"),
        violation(F.exists(m, lambda x: ~x["unit"].isin(S.UNITS)), "measurements.unit", "is not allowed"),
        violation(F.exists(m, lambda x: ~x["qc_flag"].isin(S.QC_FLAGS)), "measurements.qc_flag", "is not allowed"),
        violation(F.exists(m, lambda x: x["depth_cm"] < 0), "measurements.depth_cm", "is negative"),
        violation(F.exists(m, lambda x: F.length(x["sensor_id"]) < 1), "measurements.sensor_id", "is empty"),
        violation(e["qc_summary"]["flag_count"] < 0, "qc_summary.flag_count", "is negative"),
    ]
    return F.array_sort(F.array_compact(F.concat(F.array(*rules), *levels)))


def event_report(raw: DataFrame, column: str = "value") -> DataFrame:
    """Raw JSON lines -> parsed event, sorted violations and validity. Broken JSON is one violation."""
    parsed = raw.withColumns({"event": F.from_json(column, RAW_EVENT), "_raw": F.try_parse_json(column)})
    broken = F.coalesce(_kind(F.col("_raw"), "$"), F.lit("")) != "OBJECT"
    found = F.when(broken, F.array(F.lit("[root] is not a JSON object"))).otherwise(event_violations(F.col("event"), F.col("_raw")))
    out = with_once(parsed, "violations", found)
    return out.withColumn("is_valid", F.size("violations") == 0).drop("_raw")


def alert_rules(columns: list[str]) -> list[Column]:
    """Rules of flat alert rows; a column that the table lacks counts as missing."""
    c = lambda name: F.col(name) if name in columns else F.lit(None)
    rules = [violation(c(f).isNull(), f, "is required") for f in ALERT_REQUIRED]
    return rules + [
        violation(~c("schema_version").cast("string").rlike(VERSION_PATTERN), "schema_version", "is not a version"),
        violation(~c("category").isin(S.ALERT_CATEGORIES), "category", "is not allowed"),
        violation(~c("severity").isin(S.SEVERITIES), "severity", "is not allowed"),
        violation(~c("threshold_type").isin(S.THRESHOLD_TYPES), "threshold_type", "is not allowed"),
        violation(_short(c("actionable_guidance").cast("string")), "actionable_guidance", "is empty"),
        violation(~c("exceedance_probability").cast("double").between(0.0, 1.0), "exceedance_probability", "is out of range"),
        violation(c("forecast_horizon_hours").cast("int") < 1, "forecast_horizon_hours", "is below one"),
        violation(c("is_autonomous_actuation").cast("boolean"), "is_autonomous_actuation", "must be false"),
    ]


def alert_events(candidates: DataFrame, site: Column | None = None) -> DataFrame:
    """Candidate rows -> alert contract rows with a deterministic id and no actuation."""
    key = F.concat_ws("|", F.col("source_id").cast("string"), F.col("event_time").cast("string"),
                      F.col("step").cast("string"), F.col("ord").cast("string"), "category", "threshold_type")
    return candidates.select(
        F.lit("1.0.0").alias("schema_version"),
        F.sha2(key, 256).alias("alert_id"),
        "category", "severity",
        F.col("source_id").cast("string").alias("source_id"),
        (site if site is not None else F.concat(F.lit("FIELD_"), F.col("source_id").cast("string"))).alias("site_id"),
        F.col("event_time").alias("trigger_time"),
        "threshold_type", "threshold_value", "threshold_unit",
        F.col("horizon").alias("forecast_horizon_hours"),
        F.col("exceedance").alias("exceedance_probability"),
        "predicted_value",
        F.col("guidance").alias("actionable_guidance"),
        F.lit(False).alias("is_autonomous_actuation"),
    )


def with_violations(df: DataFrame, rules: list[Column]) -> DataFrame:
    return df.withColumn("violations", collect_violations(rules))


def pass_rate(report: DataFrame) -> DataFrame:
    ok = (F.size("violations") == 0).cast("double")
    return report.agg(F.count(F.lit(1)).alias("records"), F.avg(ok).alias("pass_rate"))


def event_json(events: DataFrame) -> DataFrame:
    """Events as JSON lines. Null readings stay present, empty header fields are left out."""
    readings = F.col("measurements")
    body = F.to_json("measurements", {"ignoreNullFields": "false"})
    head = F.to_json(F.struct(*[c for c in events.columns if c != "measurements"]), {"ignoreNullFields": "true"})
    joined = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"measurements":'), F.col("_body"), F.lit("}"))
    return events.withColumns({"_head": head, "_body": body}).where(readings.isNotNull()).select(joined.alias("value"))
