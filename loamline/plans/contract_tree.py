"""Contracts as trees: one declaration gives the rules of raw JSON, and the JSON of rows.

A contract is an ``Obj`` of named parts: leaves, objects and lists. ``violations`` turns it into one expression over a variant,
so every fault of a record at every level is found in a projection, whatever else is wrong with it. ``json_of`` turns
it into the record's JSON: what is null is left out, as are objects of which nothing is left, unless a part keeps its nulls.

Defined cases: null, text that is no JSON, and JSON that is no object are one violation; a null counts as missing unless the part
is nullable; a part of the wrong kind is not looked into; fields that the contract doesn't name are faults.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline import schemas as S
from loamline.functions.keys import UUID_PATTERN, VERSION_PATTERN, iso_utc, parse_iso

#: Kinds of JSON value by kind of leaf; whole numbers may be written as decimals by some writers, so ``integer`` is checked by value.
KINDS = {"text": ("STRING",), "time": ("STRING",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "integer": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
         "flag": ("BOOLEAN",)}
SQL_TYPES = {"text": "string", "time": "string", "number": "double", "integer": "double", "flag": "boolean"}


@dataclass(frozen=True)
class Leaf:
    kind: str = "text"
    required: bool = True
    nullable: bool = False
    allowed: Sequence[str] | None = None
    pattern: tuple[str, str] | None = None
    least: float | None = None
    most: float | None = None
    min_length: int = 0
    must: bool | None = None
    #: Write nulls instead of leaving the field out.
    keep_null: bool = False


@dataclass(frozen=True)
class Obj:
    fields: Mapping[str, Leaf | Obj | List]
    required: bool = True
    nullable: bool = False
    #: Further rules on the whole object (a variant): text and when it is broken.
    checks: Sequence[tuple[str, Callable[[Column], Column]]] = ()


@dataclass(frozen=True)
class List:
    item: Leaf | Obj
    required: bool = True
    nullable: bool = False
    least: int = 0
    most: int | None = None


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(x), body)[0]


def _is(part: Leaf, x: Column) -> Column:
    """Whether a variant has the leaf's kind of value."""
    return F.coalesce(F.substring_index(F.schema_of_variant(x), "(", 1).isin(*KINDS[part.kind]), F.lit(False))


def _joined(texts: Sequence[Column]) -> Column:
    """Faults, one a line; null where there are none. ``texts`` are strings or arrays of them, null for none."""
    # not F.nullif: inside a lambda it would compute the text twice, at each level again
    return let(F.concat_ws("\n", *texts), lambda t: F.when(t != "", t)) if texts else F.lit(None).cast("string")


def _texts(faults: Sequence[tuple[str, str, Column]]) -> Column:
    found = [F.when(F.coalesce(bad, F.lit(False)), F.lit(f"[{where}] {text}")) for where, text, bad in faults]
    return found[0] if len(found) == 1 else _joined(found)


def _leaf_faults(path: str, part: Leaf, v: Column) -> Column:
    if part == Leaf(part.kind, part.required, part.nullable, keep_null=part.keep_null) and part.kind in ("text", "number", "flag"):
        return F.lit(None).cast("string")  # its kind is its only rule
    return let(F.try_variant_get(v, "$", SQL_TYPES[part.kind]), lambda x: _value_faults(path, part, x))


def _value_faults(path: str, part: Leaf, x: Column) -> Column:
    faults = []
    if part.min_length:
        faults.append((path, "is empty" if part.min_length == 1 else f"is shorter than {part.min_length}", F.length(x) < part.min_length))
    if part.pattern:
        faults.append((path, part.pattern[0], ~x.rlike(part.pattern[1])))
    if part.allowed is not None:
        faults.append((path, "is not allowed", ~x.isin(*part.allowed)))
    if part.kind == "time":
        faults.append((path, "is not a time", parse_iso(x).isNull()))
    if part.kind == "integer":
        faults.append((path, "is not a whole number", x != F.floor(x)))
    if part.least is not None:
        faults.append((path, {0: "is negative", 1: "is below one"}.get(part.least, f"is below {part.least}"), x < part.least))
    if part.most is not None:
        faults.append((path, f"is above {part.most:g}", x > part.most))
    if part.must is not None:
        faults.append((path, f"must be {str(part.must).lower()}", x != F.lit(part.must)))
    return _texts(faults)


def _child_faults(here: str, path: str, child: Leaf | Obj | List, name: str, x: Column) -> Column:
    """Faults of an object's field; ``x`` is null where the field is missing."""
    null = F.is_variant_null(x)
    if child.required:
        absent = [(here, f"'{name}' is required", x.isNull() | (null & F.lit(not child.nullable)))]
    else:
        absent = [] if child.nullable else [(path, "is null", null)]
    return F.when(x.isNull() | null, _texts(absent)).otherwise(_faults(path, child, x, f"[{path}] has the wrong type"))


def _object_faults(path: str, part: Obj, v: Column, fields: Column) -> Column:
    here, dot = (path or "root"), (f"{path}." if path else "")

    def field(name: str, child: Leaf | Obj | List) -> Column:
        return let(F.try_element_at(fields, F.lit(name)), lambda x: _child_faults(here, f"{dot}{name}", child, name, x))

    inside = [field(name, child) for name, child in part.fields.items()]
    faults = [(here, "unknown field", F.size(F.array_except(F.map_keys(fields), F.array(*[F.lit(f) for f in part.fields]))) > 0)]
    faults += [(here, text, bad(v)) for text, bad in part.checks]
    return _joined([_texts(faults), *inside])


def _list_faults(path: str, part: List, items: Column) -> Column:
    faults = []
    if part.least:
        faults.append((path, "is empty" if part.least == 1 else f"has fewer than {part.least} items", F.size(items) < part.least))
    if part.most is not None:
        faults.append((path, f"has more than {part.most} items", F.size(items) > part.most))
    # all rules of an item in one pass over the items
    each = F.transform(items, lambda x: _faults(path, part.item, x, f"[{path}] has items of the wrong type"))
    return _joined([_texts(faults), each])


def _faults(path: str, part: Leaf | Obj | List, v: Column, wrong: str) -> Column:
    """Faults of a variant; ``wrong`` alone if it isn't of the part's kind. It is opened once, one level."""
    other = F.lit(wrong)
    if isinstance(part, Obj):
        return let(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: F.when(m.isNull(), other).otherwise(_object_faults(path, part, v, m)))
    if isinstance(part, List):
        return let(F.try_variant_get(v, "$", "array<variant>"), lambda a: F.when(a.isNull(), other).otherwise(_list_faults(path, part, a)))
    return F.when(_is(part, v), _leaf_faults(path, part, v)).otherwise(other)


def violations(contract: Obj, v: Column) -> Column:
    """Sorted faults of a record given as a variant."""
    found = let(v, lambda x: _faults("", contract, x, "[root] is not a JSON object"))
    return let(found, lambda t: F.when(t.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.split(t, "\n")))))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections read but never compute again: the optimizer moves neither
    through a generator."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def report(raw: DataFrame, contract: Obj, column: str = "value") -> DataFrame:
    """The rows with their ``violations`` and ``is_valid``; each text is parsed once."""
    checked = with_once(raw.drop("violations", "is_valid"), "violations", violations(contract, F.try_parse_json(column)))
    return checked.withColumn("is_valid", F.size("violations") == 0)


def _written(part: Leaf | Obj | List, x: Column) -> Column:
    """JSON of a value, null where there is nothing to write."""
    if isinstance(part, Obj):
        inside = []
        for name, child in part.fields.items():
            text = _written(child, x[name])
            nothing = F.lit(f'"{name}":null') if getattr(child, "keep_null", False) else F.lit(None).cast("string")
            inside.append(F.coalesce(F.concat(F.lit(f'"{name}":'), text), nothing))
        return F.when(x.isNotNull(), let(F.array_compact(F.array(*inside)), lambda kept: F.when(
            F.size(kept) > 0, F.concat(F.lit("{"), F.array_join(kept, ","), F.lit("}")))))
    if isinstance(part, List):
        items = F.transform(x, lambda y: F.coalesce(_written(part.item, y), F.lit("null")))
        return F.when(x.isNotNull(), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    if part.kind in ("integer", "flag"):
        return x.cast("bigint" if part.kind == "integer" else "boolean").cast("string")
    # quotes and escapes as Spark's writer does: {"x":...}
    return F.when(x.isNotNull(), let(F.to_json(F.struct(x.alias("x"))), lambda alone: F.substr(alone, F.lit(6), F.length(alone) - 6)))


def _keeps_null(part: Leaf | Obj | List) -> bool:
    children = part.fields.values() if isinstance(part, Obj) else [part.item] if isinstance(part, List) else []
    return getattr(part, "keep_null", False) or any(_keeps_null(child) for child in children)


def _arranged(part: Leaf | Obj | List, x: Column) -> Column:
    """A value with the contract's fields in their order, null where there is nothing to write."""
    if isinstance(part, Obj):
        inside = {name: _arranged(child, x[name]) for name, child in part.fields.items()}
        some = F.coalesce(*[F.when(c.isNotNull(), True) for c in inside.values()], F.lit(False))
        return F.when(x.isNotNull() & some, F.struct(*[c.alias(name) for name, c in inside.items()]))
    if isinstance(part, List):
        return F.transform(x, lambda y: _arranged(part.item, y))
    return x.cast({"integer": "bigint", "flag": "boolean"}[part.kind]) if part.kind in ("integer", "flag") else x


def json_of(contract: Obj, record: Column) -> Column:
    """JSON of a struct with the contract's fields, in their order. Spark's writer leaves nulls out, so it writes a whole record at once
    unless a part keeps its nulls."""
    return _written(contract, record) if _keeps_null(contract) else F.to_json(_arranged(contract, record))


_TEXT = Leaf(min_length=1)
_UUID = Leaf(pattern=("is not a UUID", UUID_PATTERN))
_VERSION = Leaf(pattern=("is not a version", VERSION_PATTERN))
_OPTIONAL = {"required": False, "nullable": True}
_NUMBER = Leaf("number", **_OPTIONAL)

TELEMETRY = Obj({
    "schema_version": _VERSION, "event_id": _UUID, "source_id": _TEXT, "site_id": _TEXT, "event_time": Leaf("time"), "ingest_time": Leaf("time"),
    "provenance": Obj({"data_class": Leaf(allowed=S.DATA_CLASSES), "network": Leaf(), "dataset_version": Leaf(**_OPTIONAL),
                       "replay_session_id": Leaf(**_OPTIONAL), "synthetic_fault_type": Leaf(allowed=S.FAULT_TYPES, **_OPTIONAL)}),
    "measurements": List(Obj({
        "sensor_id": _TEXT, "variable_name": Leaf(allowed=S.VARIABLES), "depth_cm": Leaf("number", least=0),
        "value": Leaf("number", nullable=True, keep_null=True), "unit": Leaf(allowed=S.UNITS), "qc_flag": Leaf(allowed=S.QC_FLAGS)}), least=1),
    "qc_summary": Obj({"all_valid": Leaf("flag", **_OPTIONAL), "flag_count": Leaf("integer", least=0, **_OPTIONAL), "quarantined": Leaf("flag", **_OPTIONAL)}, **_OPTIONAL),
})


def _unordered(v: Column) -> Column:
    names = ("q10", "q25", "q50", "q75", "q90")
    # a value below one before it; those that are no number have no place in the order
    def falls(known: Column) -> Column:
        pairs = [F.get(known, k) > F.get(known, k + 1) for k in range(len(names) - 1)]
        return F.coalesce(*[F.when(p, True) for p in pairs], F.lit(False))

    opened = F.try_variant_get(v, "$", f"struct<{', '.join(f'{n}: double' for n in names)}>")
    return let(opened, lambda q: let(F.filter(F.array(*[q[n] for n in names]), lambda x: x.isNotNull()), falls))


FORECAST = Obj({
    "schema_version": _VERSION, "forecast_id": _UUID, "source_id": _TEXT, "site_id": _TEXT, "forecast_origin_time": Leaf("time"), "generated_at": Leaf("time"),
    "target_variable": Leaf(allowed=S.TARGETS), "target_depth_range_cm": List(Leaf("number"), least=2, most=2, **_OPTIONAL),
    "model_metadata": Obj({"model_name": _TEXT, "model_version": _TEXT, "training_cutoff_time": Leaf("time", **_OPTIONAL), "random_seed": Leaf("integer", **_OPTIONAL),
                           "feature_lineage": List(Obj({"source_id": _TEXT, "variable": _TEXT, "lag_steps": List(Leaf("integer"), **_OPTIONAL)}), **_OPTIONAL)}),
    "predictions": List(Obj({
        "horizon_hours": Leaf("integer", least=1), "valid_time": Leaf("time"), "point_forecast": Leaf("number"),
        "quantiles": Obj({q: _NUMBER for q in ("q10", "q25", "q50", "q75", "q90")}, checks=[("quantiles are not ordered", _unordered)], **_OPTIONAL),
        "prediction_interval_80": Obj({"lower": Leaf("number"), "upper": Leaf("number")}, **_OPTIONAL),
        "unit": Leaf(allowed=["m3/m3", "fraction", "mm", "percent"])}), least=1),
})

ALERT = Obj({
    "schema_version": _VERSION, "alert_id": _UUID, "category": Leaf(allowed=S.ALERT_CATEGORIES), "severity": Leaf(allowed=S.SEVERITIES), "source_id": _TEXT,
    "site_id": _TEXT, "trigger_time": Leaf("time"),
    "trigger_condition": Obj({"threshold_type": Leaf(allowed=S.THRESHOLD_TYPES), "threshold_value": Leaf("number"), "threshold_unit": Leaf(**_OPTIONAL),
                              "forecast_horizon_hours": Leaf("integer", **_OPTIONAL), "exceedance_probability": Leaf("number", least=0, most=1, **_OPTIONAL),
                              "predicted_value": _NUMBER}),
    "context": Obj({"crop_type": Leaf(**_OPTIONAL), "growth_stage": Leaf(**_OPTIONAL), "current_depletion_fraction": _NUMBER, "forecast_model_id": Leaf(**_OPTIONAL),
                    "qc_failure_reason": Leaf(**_OPTIONAL)}, **_OPTIONAL),
    "actionable_guidance": Leaf(min_length=5), "is_autonomous_actuation": Leaf("flag", must=False),
})


def uuid_of(*parts: Column) -> Column:
    """A UUID-shaped identifier fixed by its parts, so a replay gives the same one."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _site(df: DataFrame) -> Column:
    return F.col("site_id").cast("string") if "site_id" in df.columns else F.concat(F.lit("FIELD_"), F.col("source_id").cast("string"))


def forecast_records(rows: DataFrame, model: str, unit: str, version: str = "1.0.0", target: str = "volumetric_water_content", seed: int | None = 42,
                     cutoff: Column | None = None, generated: Column | None = None, depths: tuple[float, float] | None = (0.0, 100.0)) -> DataFrame:
    """Long forecast rows (source_id, event_time, horizon, valid_time, point, q10..q90) -> one ``event`` of the contract per origin,
    numbers rounded to four decimals. ``rn``, where there is one, tells origins of the same time apart.

    An origin's horizons are a handful, so the list that is collected is bounded by the horizons.
    """
    four = lambda c: F.round(F.col(c), 4)
    prediction = F.struct(
        F.col("horizon").alias("horizon_hours"), iso_utc(F.col("valid_time")).alias("valid_time"), four("point").alias("point_forecast"),
        F.struct(*[four(q).alias(q) for q in ("q10", "q25", "q50", "q75", "q90")]).alias("quantiles"),
        F.struct(four("q10").alias("lower"), four("q90").alias("upper")).alias("prediction_interval_80"), F.lit(unit).alias("unit"))
    key = ["source_id", "event_time", *(["rn"] if "rn" in rows.columns else [])]
    cutoff = iso_utc(cutoff) if cutoff is not None else F.lit(None).cast("string")
    first = rows.withColumns({"_site": _site(rows), "_cutoff": cutoff})
    events = first.groupBy(*key).agg(F.array_sort(F.collect_list(prediction)).alias("_p"), F.min("_site").alias("_site"), F.min("_cutoff").alias("_cutoff"))
    span = F.array(*[F.lit(float(d)) for d in depths]) if depths else F.lit(None).cast("array<double>")
    return events.select(*key, F.struct(
        F.lit("1.0.0").alias("schema_version"), uuid_of(*[F.col(c) for c in key], F.lit(model), F.lit(target)).alias("forecast_id"),
        F.col("source_id").cast("string").alias("source_id"), F.col("_site").alias("site_id"), iso_utc(F.col("event_time")).alias("forecast_origin_time"),
        iso_utc(generated if generated is not None else F.current_timestamp()).alias("generated_at"), F.lit(target).alias("target_variable"),
        span.alias("target_depth_range_cm"),
        F.struct(F.lit(model).alias("model_name"), F.lit(version).alias("model_version"), F.col("_cutoff").alias("training_cutoff_time"), F.lit(seed).alias("random_seed"),
                 F.lit(None).cast("array<struct<source_id:string,variable:string,lag_steps:array<int>>>").alias("feature_lineage")).alias("model_metadata"),
        F.col("_p").alias("predictions")).alias("event"))


def alert_records(candidates: DataFrame, key: Sequence[str] = ("source_id", "event_time", "step", "ord")) -> DataFrame:
    """Candidate or confirmed alert rows -> their ``event`` of the contract. ``failure_reason`` and ``depletion_fraction`` go to its context where
    the rows have them, a quality alert's reason too."""
    has = set(candidates.columns)
    text = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    quality = F.when(F.col("category") == "DATA_QUALITY_ALERT", text("reason"))
    depletion = F.col("depletion_fraction") if "depletion_fraction" in has else F.when(F.col("category") == "AGRONOMIC_RISK", F.col("predicted_value"))
    return candidates.withColumn("event", F.struct(
        F.lit("1.0.0").alias("schema_version"), uuid_of(*[F.col(c) for c in key], F.col("category"), F.col("threshold_type")).alias("alert_id"),
        "category", "severity", F.col("source_id").cast("string").alias("source_id"), _site(candidates).alias("site_id"), iso_utc(F.col("event_time")).alias("trigger_time"),
        F.struct("threshold_type", "threshold_value", "threshold_unit", F.col("horizon").alias("forecast_horizon_hours"),
                 F.col("exceedance").alias("exceedance_probability"), "predicted_value").alias("trigger_condition"),
        F.struct(F.lit(None).cast("string").alias("crop_type"), F.lit(None).cast("string").alias("growth_stage"), depletion.alias("current_depletion_fraction"),
                 text("model").alias("forecast_model_id"), quality.alias("qc_failure_reason")).alias("context"),
        F.col("guidance").alias("actionable_guidance"), F.lit(False).alias("is_autonomous_actuation")))


def as_json(records: DataFrame, contract: Obj) -> DataFrame:
    """The records with ``value``, the JSON of their ``event``."""
    return with_once(records.drop("value"), "value", json_of(contract, F.col("event"))).drop("event")
