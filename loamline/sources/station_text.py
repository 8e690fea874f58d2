"""Hourly station text files: one scan for any number of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = 38
# Markers of a missing number.
SENTINELS = [-99.0, -9999.0, -99999.0]
# Zero-based positions of the kept fields.
NUMBERS = {
    "longitude": 6, "latitude": 7, "air_temp_c": 8, "air_temp_hr_avg_c": 9, "precip_mm": 12, "solar_rad_wm2": 13,
    "sur_temp_c": 20, "rh_percent": 26,
    "soil_moisture_5cm": 28, "soil_moisture_10cm": 29, "soil_moisture_20cm": 30, "soil_moisture_50cm": 31,
    "soil_moisture_100cm": 32, "soil_temp_5cm": 33, "soil_temp_10cm": 34, "soil_temp_20cm": 35, "soil_temp_50cm": 36,
    "soil_temp_100cm": 37,
}
FLAGS = {"solar_rad_flag": 14, "sur_temp_flag": 21, "rh_flag": 27}
TEXTS = {"station_wbanno": 0, "crx_version": 5}


def number(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & ~value.isin(SENTINELS), value)


def station_time(date: Column, clock: Column) -> Column:
    """UTC time of YYYYMMDD and HHmm, where 2400 is the next midnight; null when it is no time."""
    day = F.try_to_timestamp(date, F.lit("yyyyMMdd"))
    digits = F.lpad(clock, 4, "0")
    hour, minute = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    ok = (F.length(digits) == 4) & (minute.between(0, 59)) & (hour.between(0, 23) | ((hour == 24) & (minute == 0)))
    return F.when(ok, day + F.make_dt_interval(hours=hour, mins=minute))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file_name"))


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected). Lines without exactly 38 fields are skipped; lines without a time are rejected."""
    text = F.trim("value")
    fields = lines.where((text != "") & ~text.startswith("#")).withColumn("_f", F.split(text, r"\s+"))
    full = fields.where(F.size("_f") == FIELDS)
    at = lambda i: F.get(F.col("_f"), i)
    parsed = full.select(
        "file_name",
        "value",
        station_time(at(1), at(2)).alias("event_time"),
        *[at(i).alias(name) for name, i in TEXTS.items()],
        *[number(at(i)).alias(name) for name, i in NUMBERS.items()],
        *[at(i).try_cast("int").alias(name) for name, i in FLAGS.items()],
    )
    station = F.regexp_extract("file_name", r"CRNH0203-\d{4}-(.+)\.txt$", 1)
    parsed = parsed.withColumn("source_id", F.when(station != "", station).otherwise(F.col("station_wbanno")))
    rejected = parsed.where(F.col("event_time").isNull()).select(
        "file_name", F.col("value").alias("source_payload"), F.lit("unreadable time").alias("failure_reason")
    )
    # A true 0.0 degrees is a value; only a missing one takes the hourly average.
    rows = parsed.where(F.col("event_time").isNotNull()).drop("value").withColumn(
        "air_temp_c", F.coalesce("air_temp_c", "air_temp_hr_avg_c")
    )
    return rows, rejected


def read_station_files(spark: SparkSession, paths: str | list[str], mode: str = "permissive") -> tuple[DataFrame, DataFrame]:
    """Parse files; ``mode='failfast'`` raises inside the job on the first unreadable time."""
    rows, rejected = parse_lines(read_lines(spark, paths))
    if mode == "failfast":
        lines = read_lines(spark, paths)
        text = F.trim("value")
        split = F.split(text, r"\s+")
        time = station_time(F.get(split, 1), F.get(split, 2))
        bad = (F.size(split) == FIELDS) & ~text.startswith("#") & time.isNull()
        checked = lines.where(F.when(bad, F.raise_error(F.concat(F.lit("unreadable time: "), "value")).cast("boolean"))
                              .otherwise(F.lit(True)))
        rows, rejected = parse_lines(checked)
    return rows, rejected
