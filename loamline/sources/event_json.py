"""Stored telemetry events: JSON lines of the contract -> typed events and readings, with all faults of the lines that break it.

The same projection serves a batch table and a stream. A line is never dropped: it is an event or a rejected row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions.keys import parse_iso
from loamline.plans.contract_tree import TELEMETRY, report, with_once
from loamline.plans.contracts import RAW_EVENT


def split_events(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, rejected) of JSON lines. Events have the contract's fields with times as timestamps; rejected rows keep the line and
    its ``violations``. Other columns of ``lines`` are kept, unless an event field has their name."""
    checked = report(lines, TELEMETRY, column)
    rejected = checked.where("NOT is_valid").drop("is_valid")
    parsed = with_once(checked.where("is_valid").drop("is_valid", "violations"), "_event", F.from_json(column, RAW_EVENT))
    time = lambda c: parse_iso(F.col(f"_event.{c}"))
    fields: dict[str, Column] = {c: F.col(f"_event.{c}") for c in ("schema_version", "event_id", "source_id", "site_id", "provenance", "measurements", "qc_summary")}
    fields |= {"event_time": time("event_time"), "ingest_time": time("ingest_time")}
    taken = {c.lower() for c in fields}
    others = [c for c in lines.columns if c.lower() not in taken and c != column]
    return parsed.select(*others, *[v.alias(k) for k, v in fields.items()]), rejected


def read_event_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``split_events`` of the lines of text files."""
    return split_events(spark.read.text(path))


def readings(events: DataFrame) -> DataFrame:
    """One row per measurement with its position in the event."""
    keep = [c for c in events.columns if c not in ("measurements", "provenance", "qc_summary")]
    rows = events.select(*keep, F.col("provenance.data_class").alias("data_class"), F.posexplode("measurements").alias("ord", "_m"))
    return rows.select(*[c for c in rows.columns if c != "_m"], "_m.*")
