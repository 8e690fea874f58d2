"""Record shapes, closed vocabularies and fixed limits of the telemetry model."""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies of the data contracts.
DATA_CLASSES = ["OBSERVED", "MODELLED_REANALYSIS", "SIMULATED_REPLAY", "SYNTHETIC_FAULT"]
FAULT_TYPES = ["VALUE_SPIKE", "SENSOR_STUCK", "CLOCK_DRIFT", "PACKET_DROP", "NON_PHYSICAL_RANGE"]
VARIABLES = [
    "volumetric_water_content", "soil_temperature", "air_temperature", "relative_humidity", "precipitation",
    "solar_radiation", "wind_speed", "atmospheric_pressure", "vapor_pressure_deficit",
]
UNITS = ["m3/m3", "degC", "mm", "W/m2", "m/s", "kPa", "percent", "fraction"]
QC_FLAGS = ["VALID", "SUSPECT_SPIKE", "SUSPECT_STUCK", "OUT_OF_RANGE", "MISSING", "SYNTHETIC_CORRUPTED"]
HARD_FLAGS = ["OUT_OF_RANGE", "SUSPECT_SPIKE", "SUSPECT_STUCK", "SYNTHETIC_CORRUPTED"]
TARGETS = [
    "volumetric_water_content", "root_zone_depletion_fraction", "fraction_of_available_water", "root_zone_storage_mm",
]
ALERT_CATEGORIES = ["DATA_QUALITY_ALERT", "PHYSICAL_DEVIATION", "AGRONOMIC_RISK", "OPERATIONAL_WARNING"]
SEVERITIES = ["INFO", "WARNING", "CRITICAL"]
THRESHOLD_TYPES = [
    "SENSOR_OUT_OF_RANGE", "SENSOR_STUCK_VALUE", "TELEMETRY_LATENCY_BREACH", "MASS_BALANCE_RESIDUAL",
    "MANAGEMENT_ALLOWABLE_DEPLETION", "CRITICAL_WILTING_PROXIMITY",
]

# Inclusive physical limits per variable.
PHYSICAL_LIMITS = {
    "volumetric_water_content": (0.0, 0.6),
    "soil_temperature": (-30.0, 60.0),
    "air_temperature": (-50.0, 60.0),
    "precipitation": (0.0, 300.0),
    "solar_radiation": (0.0, 1500.0),
    "relative_humidity": (0.0, 100.0),
    "atmospheric_pressure": (50.0, 115.0),
    "wind_speed": (0.0, 75.0),
    "vapor_pressure_deficit": (0.0, 10.0),
}

HORIZONS = [1, 6, 12, 24, 48, 72, 168]
DEPTHS = [5, 10, 20, 50, 100]

# Default soil profile.
DEFAULT_WEIGHTS = {5: 0.075, 10: 0.075, 20: 0.2, 50: 0.4, 100: 0.25}
DEFAULT_PROFILE = {"theta_sat": 0.45, "theta_fc": 0.32, "theta_wp": 0.14, "root_depth_cm": 100.0}

_d, _s = T.DoubleType(), T.StringType()


def _fields(*spec):
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in spec])


# The sensor channels of a wide station row: column, sensor, variable, depth, unit, in emission order.
CHANNELS = (
    [(f"soil_moisture_{d}cm", f"SOIL_VWC_{d}CM", "volumetric_water_content", float(d), "m3/m3") for d in DEPTHS]
    + [(f"soil_temp_{d}cm", f"SOIL_TEMP_{d}CM", "soil_temperature", float(d), "degC") for d in DEPTHS]
    + [
        ("air_temp_c", "MET_AIR_TEMP_150CM", "air_temperature", 0.0, "degC"),
        ("precip_mm", "MET_PRECIP_GAUGE", "precipitation", 0.0, "mm"),
        ("solar_rad_wm2", "MET_SOLAR_RAD", "solar_radiation", 0.0, "W/m2"),
        ("rh_percent", "MET_REL_HUMIDITY", "relative_humidity", 0.0, "percent"),
    ]
)

MEASUREMENT = _fields(
    ("sensor_id", _s, False),
    ("variable_name", _s, False),
    ("depth_cm", _d, False),
    ("value", _d, True),
    ("unit", _s, False),
    ("qc_flag", _s, False),
)
PROVENANCE = _fields(
    ("data_class", _s, False),
    ("network", _s, True),
    ("dataset_version", _s, True),
    ("replay_session_id", _s, True),
    ("synthetic_fault_type", _s, True),
)
QC_SUMMARY = _fields(
    ("all_valid", T.BooleanType(), False),
    ("flag_count", T.IntegerType(), False),
    ("quarantined", T.BooleanType(), False),
)
TELEMETRY_EVENT = _fields(
    ("schema_version", _s, False),
    ("event_id", _s, False),
    ("source_id", _s, False),
    ("site_id", _s, False),
    ("event_time", T.TimestampType(), False),
    ("ingest_time", T.TimestampType(), False),
    ("provenance", PROVENANCE, False),
    ("measurements", T.ArrayType(MEASUREMENT, False), False),
    ("qc_summary", QC_SUMMARY, True),
)
DEAD_LETTER = _fields(
    ("dlq_id", _s, False),
    ("failed_at", T.TimestampType(), False),
    ("source_payload", _s, True),
    ("failure_reason", _s, False),
    ("exception_details", _s, True),
    ("retry_count", T.IntegerType(), False),
)
