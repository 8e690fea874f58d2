"""Root-zone water state per event (all stations in one frame)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions import water
from loamline.schemas import DEFAULT_PROFILE, DEFAULT_WEIGHTS, DEPTHS

MIN_WEIGHT = 0.5


def site_violations() -> list[tuple[Column, str]]:
    """Rules of the soil parameter table: (broken when true, message)."""
    weights = F.col("w5") + F.col("w10") + F.col("w20") + F.col("w50") + F.col("w100")
    return [
        (~(F.col("theta_sat") > F.col("theta_fc")), "theta_sat must exceed theta_fc"),
        (~(F.col("theta_fc") > F.col("theta_wp")), "theta_fc must exceed theta_wp"),
        (~(F.col("theta_wp") >= 0), "theta_wp must not be negative"),
        (~weights.between(0.99, 1.01), "layer weights must sum to one"),
    ]


def check_sites(sites: DataFrame) -> DataFrame:
    """Site rows with their broken rules, total available water and the moisture at half depletion."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in site_violations()]))
    return sites.withColumns(
        {
            "violations": broken,
            "taw_mm": water.total_available_water_mm(F.col("theta_fc"), F.col("theta_wp"), F.col("root_depth_cm")),
            "theta_mad": water.theta_at_depletion(F.col("theta_fc"), F.col("theta_wp")),
        }
    )


def integrate_depths(df: DataFrame, weights: Mapping[int, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Add ``weight_fraction``, ``theta_rz`` and ``is_valid`` from ``soil_moisture_<d>cm`` (only usable values kept)."""
    layers = {d: F.col(f"soil_moisture_{d}cm") for d in DEPTHS if f"soil_moisture_{d}cm" in df.columns}
    return (
        df.withColumn("weight_fraction", water.weight_fraction(layers, weights))
        .withColumn("theta_rz", water.root_zone_theta(layers, F.col("weight_fraction"), weights))
        .withColumn("is_valid", F.col("theta_rz").isNotNull() & (F.col("weight_fraction") >= MIN_WEIGHT))
    )


def join_sites(df: DataFrame, sites: DataFrame, key: str = "source_id", spread_by: str = "event_time",
               salts: int = 16) -> DataFrame:
    """Attach one parameter row per station; a hot station's rows go to ``salts`` partitions, not one."""
    copies = sites.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def water_state(df: DataFrame) -> DataFrame:
    """Depletion, available water, storage and deficit; missing site limits take the default profile."""
    limits = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        for name, value in DEFAULT_PROFILE.items()
    }
    out = df.withColumns(limits)
    theta, fc, wp, root = (F.col(c) for c in ("theta_rz", "theta_fc", "theta_wp", "root_depth_cm"))
    out = out.withColumn("depletion_fraction", water.depletion(theta, fc, wp))
    return out.withColumns(
        {
            "available_water_fraction": water.available_water(F.col("depletion_fraction")),
            "storage_mm": water.storage_mm(theta, root),
            "deficit_mm": water.deficit_mm(theta, fc, root),
        }
    )


def build_states(events: DataFrame, sites: DataFrame | None = None,
                 weights: Mapping[int, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Wide usable moisture columns -> state rows. Events with no usable depth give no row."""
    states = integrate_depths(events, weights).where(F.col("theta_rz").isNotNull())
    return water_state(join_sites(states, sites) if sites is not None else states)


def widen_moisture(readings: DataFrame, event_keys: list[str]) -> DataFrame:
    """Long readings -> one row per event with the VALID moisture of each depth (fixed pivot, one shuffle)."""
    def usable(d: int) -> Column:
        here = (F.col("variable_name") == "volumetric_water_content") & (F.col("depth_cm") == float(d))
        return F.max(F.when(here & (F.col("qc_flag") == "VALID"), F.col("value"))).alias(f"soil_moisture_{d}cm")

    return readings.groupBy(*event_keys).agg(*[usable(d) for d in DEPTHS])


def topsoil(df: DataFrame) -> DataFrame:
    return df.withColumn("theta_10", F.coalesce(F.col("soil_moisture_10cm"), F.col("theta_rz")))
