"""Written intermediate tables.

A frame read by several later steps is written once instead of being recomputed by each of them. The table lives in
the shared folder of ``spark.checkpoint.dir``, so losing executors costs only the running tasks; it is columnar, so a
later step reads just the columns it needs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def stage_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set (local runs), the context's or a new temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loamline-"))
        folder = context.getCheckpointDir()
    return folder


_SCOPES: list[list[str]] = []


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back. Inside ``removed_after`` the table goes at its end; else the folder's owner removes
    old tables, as with checkpoints."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_dealt(df: DataFrame, label: str, key: str = "source_id") -> DataFrame:
    """As ``stage``, in buckets of ``key``: later windows, aggregates and joins on the key move no rows. For keys whose rows fit one task
    (``Layout.whole``)."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{stage_folder(spark)}/{name}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end: everything that reads them has to be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for path in _SCOPES.pop():
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
