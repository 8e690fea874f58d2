"""Adapters: star-schema tables read as station telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A total order of a station's rows: time first, then the columns that tell equal times apart.
SERIES_ORDER = [
    "event_time", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier is a station, each of its shipments a reading of five depths and the weather."""
    q = F.col("l_quantity")
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source_id"),
        F.col("l_shipdate").alias("event_time"),
        *SERIES_ORDER[1:],
        (q / 100).alias("soil_moisture_5cm"),
        (F.lit(0.10) + F.lit(2.5) * F.col("l_discount")).alias("soil_moisture_10cm"),
        (F.lit(0.10) + F.lit(3.0) * F.col("l_tax")).alias("soil_moisture_20cm"),
        (F.lit(0.10) + (F.col("l_orderkey") % 300) / F.lit(1000.0)).alias("soil_moisture_50cm"),
        F.when(F.col("l_returnflag") != "R", F.lit(0.10) + (F.col("l_partkey") % 300) / F.lit(1000.0)).alias(
            "soil_moisture_100cm"
        ),
        F.when((F.col("l_linestatus") == "O") & (q > 40), F.col("l_linenumber").cast("double"))
        .otherwise(0.0)
        .alias("precip_mm"),
        (F.col("l_extendedprice") % 1000).alias("solar_rad_wm2"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") % 40 - 5).alias("air_temp_c"),
    )


def supplier_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``supplier_series``, with channels scaled so that each quality rule fires."""
    q, month = F.col("l_quantity"), F.month("l_shipdate")
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source_id"),
        F.col("l_shipdate").alias("event_time"),
        *SERIES_ORDER[1:],
        F.when(q >= 49, q / 80).otherwise(q / 250).alias("soil_moisture_5cm"),
        F.when(F.col("l_linenumber") != 3, F.lit(0.2) + F.col("l_discount")).alias("soil_moisture_10cm"),
        (F.lit(0.2) + (F.col("l_partkey") % 160) / F.lit(1000.0)).alias("soil_moisture_50cm"),
        F.when(month == 2, F.lit(4.5)).otherwise(F.col("l_extendedprice") % 30).alias("soil_temp_10cm"),
        F.when((F.col("l_linestatus") == "O") & (q > 25), F.col("l_linenumber").cast("double"))
        .otherwise(0.0)
        .alias("precip_mm"),
        F.when(month < 7, F.col("l_extendedprice") % 1505).otherwise(0.0).alias("solar_rad_wm2"),
    )


def site_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One soil parameter row per supplier, from the region of its nation."""
    region = F.col("n_regionkey")
    return (
        read_table(spark, sf_dir, "supplier")
        .join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("source_id"),
            F.lit(0.45).alias("theta_sat"),
            (F.lit(0.30) + F.lit(0.01) * region).alias("theta_fc"),
            (F.lit(0.10) + F.lit(0.005) * region).alias("theta_wp"),
            F.lit(100.0).alias("root_depth_cm"),
            F.lit(0.075).alias("w5"),
            F.lit(0.075).alias("w10"),
            F.lit(0.2).alias("w20"),
            F.lit(0.4).alias("w50"),
            F.lit(0.25).alias("w100"),
        )
    )


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application events as device readings: the user is the device, the event type the sensor."""
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("source_id"),
        F.col("ts").alias("event_time"),
        F.col("event_type").alias("sensor_id"),
        "value",
        "props",
    )


def event_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean value per event type."""
    hour = F.date_trunc("hour", F.col("event_time")).cast("timestamp_ntz")
    return (
        event_readings(spark, sf_dir)
        .groupBy(F.col("sensor_id").alias("source_id"), hour.alias("event_time"))
        .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("readings"))
    )
