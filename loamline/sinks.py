"""Idempotent table sinks, dead letters, run ledger and manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.stage import stage


def first_by_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key in the given order: a map-side aggregate, so a key with many copies is no hot task."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*").select(
        *df.columns
    )


def read_if_exists(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame | None:
    """The stored columns, or None if nothing was written there yet. Any other problem is an error."""
    try:
        return spark.read.parquet(path).select(*columns)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_new(df: DataFrame, path: str, key: str, order: Sequence[str], time: str = "event_time") -> dict[str, int]:
    """Append the rows whose key is not stored yet, partitioned by date; the first row of a key wins.

    A key belongs to one date, so only the key column of the date range of the new rows is read back. The new rows are
    staged, which makes their number a count of what is written, also when there are none. Returns inserted and
    duplicate counts.
    """
    spark = df.sparkSession
    dated = df.withColumn("event_date", F.to_date(time))
    offered = dated.agg(F.count(F.lit(1)).alias("n"), F.min("event_date").alias("a"), F.max("event_date").alias("b")).first()
    if not offered["n"]:
        return {"inserted": 0, "duplicates": 0}
    unique = first_by_key(dated, key, order)
    stored = read_if_exists(spark, path, [key, "event_date"])
    if stored is not None:
        touched = stored.where(F.col("event_date").between(F.lit(offered["a"]), F.lit(offered["b"])) | F.col("event_date").isNull())
        unique = unique.join(touched.select(key), key, "left_anti")
    new = stage(unique, "new-rows")
    inserted = new.count()
    if inserted:
        spread = new.repartition("event_date", F.pmod(F.xxhash64(key), F.lit(16)))
        spread.write.mode("append").partitionBy("event_date").parquet(path)
    return {"inserted": inserted, "duplicates": offered["n"] - inserted}


def append_json(df: DataFrame, path: str, key: str, order: Sequence[str]) -> int:
    """Append the rows whose key is not stored yet as JSON lines; returns how many there were."""
    spark = df.sparkSession
    unique = first_by_key(df, key, order)
    try:
        unique = unique.join(spark.read.schema(df.schema).json(path).select(key), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new = stage(unique, "new-lines")
    inserted = new.count()
    if inserted:
        new.write.mode("append").json(path)
    return inserted


def run_summary(run_id: str, counts: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: event counts and horizon maps of the scores."""
    def of(metric):
        entries = F.array_sort(F.collect_list(F.struct(F.col("horizon").cast("int"), F.col(metric))))
        return F.map_from_entries(entries).alias(f"persistence_{metric}")

    maps = scores.agg(*[of(m) for m in ("mae", "rmse", "skill_vs_mean", "coverage")])
    return counts.withColumn("_k", F.lit(1)).join(maps.withColumn("_k", F.lit(1)), "_k").drop("_k").select(
        F.lit(run_id).alias("run_id"), F.current_timestamp().alias("executed_at"), "*"
    )


def run_manifest(summary: DataFrame, params: dict[str, str], model: str, seed: int, status: str = "FINISHED") -> DataFrame:
    pairs = [F.lit(x) for kv in sorted(params.items()) for x in kv]
    return summary.select(
        "run_id",
        F.lit(model).alias("model_name"),
        F.lit(seed).alias("random_seed"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("params"),
        F.col("persistence_mae").alias("metrics"),
        F.lit(status).alias("status"),
    )


METRICS = ["samples", "mae", "mse", "rmse", "mbe", "coverage", "width", "skill_vs_mean"]


def experiment_manifest(series: DataFrame, scores: DataFrame, run_id: str, dataset: str, version: str, model: str, params: dict[str, str] | None = None,
                        features: Sequence[str] = (), artifacts: Sequence[str] = (), target: str = "volumetric_water_content", seed: int = 42,
                        split: str = "chronological") -> DataFrame:
    """What a run was and gave, one row per station: dataset, split with its windows, model, all metrics by horizon, artifacts.

    ``series`` (source_id, event_time, is_train) gives the windows, ``scores`` (source_id, horizon and some of METRICS) the metrics. A station
    without scores keeps its row, with no metrics. ``manifest_id`` is fixed by run and station, so that a repeated run is found as such.
    """
    window = lambda train: F.struct(
        F.min(F.when(F.col("is_train") == train, F.col("event_time"))).alias("start_time"), F.max(F.when(F.col("is_train") == train, F.col("event_time"))).alias("end_time"),
        F.count_if(F.col("is_train") == train).alias("rows"))
    windows = series.groupBy("source_id").agg(window(True).alias("train_window"), window(False).alias("test_window"))
    known = [m for m in METRICS if m in scores.columns]
    entry = F.struct(F.col("horizon").cast("int"), F.struct(*[F.col(m).cast("double").alias(m) for m in known]))
    metrics = scores.groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics"))  # a handful of horizons
    pairs = [F.lit(x) for kv in sorted((params or {}).items()) for x in kv]
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return windows.join(metrics, "source_id", "left").select(
        F.sha2(F.concat_ws("|", F.lit(run_id), F.col("source_id").cast("string")), 256).alias("manifest_id"), F.lit(run_id).alias("run_id"),
        F.current_timestamp().alias("created_at"), "source_id", F.lit(dataset).alias("dataset"), F.lit(version).alias("dataset_version"),
        F.lit(target).alias("target_variable"), F.lit(model).alias("model_name"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("params"), texts(features).alias("features"),
        F.lit(split).alias("split_strategy"), "train_window", "test_window", F.lit(seed).alias("random_seed"), "metrics", texts(artifacts).alias("artifacts"),
        F.lit("FINISHED").alias("status"))


def write_manifests(manifests: DataFrame, path: str) -> dict[str, int]:
    """Append the manifests that aren't stored yet."""
    spark = manifests.sparkSession
    new = manifests
    stored = read_if_exists(spark, path, ["manifest_id"])
    if stored is not None:
        new = new.join(stored, "manifest_id", "left_anti")
    new = stage(first_by_key(new, "manifest_id", ["created_at"]), "new-manifests")
    offered, inserted = manifests.count(), new.count()
    if inserted:
        new.write.mode("append").parquet(path)
    return {"inserted": inserted, "duplicates": offered - inserted}


def ledger_markdown(summary: DataFrame) -> str:
    """A Markdown table of one run (one row with at most seven horizons reaches the driver)."""
    row = summary.first().asDict()
    mae, rmse = row["persistence_mae"], row["persistence_rmse"]
    cover, skill = row["persistence_coverage"], row["persistence_skill_vs_mean"]
    lines = [f"## Run {row['run_id']}", "", "| Horizon | MAE | RMSE | Coverage | Skill |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {h}h | {mae[h]:.4f} | {rmse[h]:.4f} | {cover[h] * 100:.1f}% | {skill[h]:+.3f} |" for h in sorted(mae)]
    return "\n".join(lines)
