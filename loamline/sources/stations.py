"""The station dimension: nine stations, their soil limits and suitability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "registry_order int, station_key string, station_id string, site_id string, station_name string, state string, "
    "latitude double, longitude double, elevation_m double, climate_regime string, suitability string, "
    "soil_texture string, annual_precip_mm double, probe_depths_cm array<double>, probe_completeness_pct double, "
    "weather_completeness_pct double, theta_fc double, theta_wp double, theta_sat double"
)
ALL_DEPTHS = [5.0, 10.0, 20.0, 50.0, 100.0]
BASELINE, EVALUATION = "CANONICAL_BASELINE", "INDEPENDENT_EVALUATION"
FEW_PROBES, MANY_GAPS = "EXCLUDED_INCOMPLETE_PROBES", "EXCLUDED_HIGH_MISSINGNESS"

# Key, site suffix, name, state, lat, lon, elevation, climate, suitability, texture, rain, depths,
# probe and weather completeness, field capacity, wilting point, saturation.
STATIONS = [
    ("NE_Lincoln_11_SW", "LINCOLN", "Lincoln 11 SW", "NE", 40.70, -96.85, 365.0, "HUMID_CONTINENTAL_PLAINS", BASELINE,
     "Silt Loam", 611.5, ALL_DEPTHS, 96.2, 99.9, 0.33, 0.13, 0.45),
    ("IL_Champaign_9_SW", "CHAMPAIGN", "Champaign 9 SW", "IL", 40.05, -88.37, 213.0, "MIDWEST_CORN_BELT", EVALUATION,
     "Silt Loam / Drummer Silty Clay", 832.0, ALL_DEPTHS, 99.1, 99.9, 0.34, 0.14, 0.46),
    ("NM_Las_Cruces_20_N", "LAS_CRUCES", "Las Cruces 20 N (Jornada)", "NM", 32.61, -106.74, 1330.0,
     "ARID_DESERT_SOUTHWEST", EVALUATION, "Sandy Loam / Coarse Sand", 169.8, ALL_DEPTHS, 99.6, 99.6, 0.20, 0.07, 0.38),
    ("GA_Watkinsville_5_SSE", "WATKINSVILLE", "Watkinsville 5 SSE", "GA", 33.78, -83.39, 235.0,
     "HUMID_SUBTROPICAL_SOUTHEAST", EVALUATION, "Cecil Sandy Clay Loam (Ultisol)", 1339.0, ALL_DEPTHS, 93.0, 93.8,
     0.28, 0.12, 0.42),
    ("CO_Nunn_7_NNE", "NUNN", "Nunn 7 NNE (Central Plains)", "CO", 40.81, -104.76, 1661.0, "SEMI_ARID_HIGH_PLAINS",
     EVALUATION, "Sandy Loam / Ascalon Loam", 344.8, ALL_DEPTHS, 89.8, 98.4, 0.25, 0.09, 0.40),
    ("SD_Sioux_Falls_14_NNE", "SIOUX_FALLS", "Sioux Falls 14 NNE", "SD", 43.73, -96.62, 474.0,
     "NORTHERN_GREAT_PLAINS", EVALUATION, "Silty Clay Loam", 599.2, ALL_DEPTHS, 99.9, 99.9, 0.33, 0.13, 0.45),
    ("TX_Austin_33_NW", "AUSTIN", "Austin 33 NW", "TX", 30.62, -98.08, 387.0, "HUMID_SUBTROPICAL_SOUTHEAST", FEW_PROBES,
     "Unknown (Shallow)", 711.2, [5.0, 10.0], 39.9, 99.9, 0.33, 0.13, 0.45),
    ("AL_Selma_13_WNW", "SELMA", "Selma 13 WNW", "AL", 32.46, -87.24, 56.0, "HUMID_SUBTROPICAL_SOUTHEAST", MANY_GAPS,
     "Heavy Clay", 1411.7, ALL_DEPTHS, 55.3, 99.9, 0.33, 0.13, 0.45),
    ("IA_Des_Moines_17_E", "DES_MOINES", "Des Moines 17 E", "IA", 41.56, -93.29, 283.0, "MIDWEST_CORN_BELT", MANY_GAPS,
     "Clarion Loam", 543.5, ALL_DEPTHS, 64.5, 99.6, 0.33, 0.13, 0.45),
]


def stations(spark: SparkSession) -> DataFrame:
    rows = [(i, key, f"USCRN_{key}", f"FIELD_{site}_01", *rest) for i, (key, site, *rest) in enumerate(STATIONS)]
    return spark.createDataFrame(rows, SCHEMA)


def evaluation_sites(spark: SparkSession) -> DataFrame:
    return stations(spark).where(F.col("suitability") == EVALUATION)


def match_stations(names: DataFrame, spark: SparkSession, column: str = "name") -> DataFrame:
    """First registered station whose key or id equals the name, or whose key is contained in it.

    The dimension has nine rows, so it is broadcast and the pick is an aggregate per name.
    """
    dim = F.broadcast(stations(spark))
    hit = (F.col("station_key") == F.col(column)) | (F.col("station_id") == F.col(column)) | F.col(column).contains(
        F.col("station_key"))
    fields = [c for c in dim.columns if c != "registry_order"]
    rank = F.struct((F.col("station_key") != F.col(column)).alias("inexact"), F.col("registry_order"))
    found = names.select(column).distinct().join(dim, hit).groupBy(column).agg(
        F.min_by(F.struct(*fields), rank).alias("_s"))
    return names.join(found, column, "left").select(*names.columns, "_s.*")
