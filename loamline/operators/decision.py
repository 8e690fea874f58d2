"""Alert candidates: data quality, physical deviation, agronomic risk."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.water import clip
from loamline.layout import DEFAULT, Layout
from loamline.operators.running import block_window, core_rows, previous, with_halo
from loamline.schemas import DEPTHS

CANDIDATE = [
    "source_id", "step", "event_time", "ord", "category", "severity", "threshold_type", "threshold_value",
    "threshold_unit", "horizon", "exceedance", "predicted_value", "reason", "guidance",
]


@dataclass(frozen=True)
class RiskRules:
    mad: float = 0.50
    critical: float = 0.85
    tau: float = 0.70
    calibrated_hours: int = 48
    near: float = 0.95
    default_probability: float = 0.75

    def __post_init__(self):
        if not self.mad < self.critical <= 1.0:
            raise ValueError("need mad < critical <= 1")
        if not 0.0 <= self.tau <= 1.0:
            raise ValueError("tau must be a probability")


@dataclass(frozen=True)
class DeviationRules:
    residual: float = 0.020
    drying: float = 0.025
    wetting: float = 0.015
    rain: float = 0.2
    deep: float = 0.015
    shallow: float = 0.005


def candidate(category: str, severity: Column, threshold_type: str | Column, value: Column, unit: str | Column,
              predicted: Column, reason: Column, guidance: Column, ord_: Column, horizon: Column | None = None,
              exceedance: Column | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        ord_.cast("int").alias("ord"),
        F.lit(category).alias("category"),
        severity.alias("severity"),
        lit(threshold_type).alias("threshold_type"),
        value.cast("double").alias("threshold_value"),
        lit(unit).alias("threshold_unit"),
        (horizon if horizon is not None else F.lit(None)).cast("int").alias("horizon"),
        (exceedance if exceedance is not None else F.lit(None)).cast("double").alias("exceedance"),
        F.round(predicted, 4).alias("predicted_value"),
        reason.alias("reason"),
        guidance.alias("guidance"),
    )


def certainty(point: Column, horizon: Column, low: Column, high: Column, probability: Column,
              rules: RiskRules = RiskRules()) -> Column:
    """How sure a threshold crossing is; ``low``/``high`` and ``probability`` may be null."""
    t = F.lit(rules.mad)
    spans = ((low <= t) & (t <= high)) | (point >= t)
    by_interval = (
        F.when(high < t, "DEFINITELY_NOT_REACHED")
        .when((point < t) & (t <= high), "PLAUSIBLY_REACHED")
        .otherwise("LIKELY_REACHED")
    )
    by_probability = (
        F.when(probability < 0.20, "DEFINITELY_NOT_REACHED")
        .when(probability < rules.tau, "PLAUSIBLY_REACHED")
        .otherwise("LIKELY_REACHED")
    )
    return (
        F.when((horizon > rules.calibrated_hours) & low.isNotNull() & spans, F.lit("HIGHLY_UNCERTAIN"))
        .when(low.isNotNull(), by_interval)
        .when(probability.isNotNull(), by_probability)
        .when(point >= t, F.lit("LIKELY_REACHED"))
        .otherwise(F.lit("DEFINITELY_NOT_REACHED"))
    )


def triggers(point: Column, level: Column, probability: Column, rules: RiskRules = RiskRules()) -> Column:
    likely = level.isin("LIKELY_REACHED", "PLAUSIBLY_REACHED") & (point >= rules.mad * rules.near)
    return F.coalesce(probability >= rules.tau, F.lit(False)) | likely


def early_risk(forecasts: DataFrame, keys: Sequence[str], rules: RiskRules = RiskRules()) -> DataFrame:
    """Earliest triggering horizon per origin, from long forecast rows (point, low, high, exceedance).

    Only origins whose current depletion is below the allowed one count. The pick is an aggregate, so no
    window over an origin's horizons is needed.
    """
    level = certainty(F.col("point"), F.col("horizon"), F.col("low"), F.col("high"), F.col("exceedance"), rules)
    rows = forecasts.where(F.col("depletion_fraction") < rules.mad).withColumn("certainty", level)
    hit = rows.where(triggers(F.col("point"), F.col("certainty"), F.col("exceedance"), rules))
    first = F.min_by(F.struct("horizon", "point", "exceedance", "certainty"), "horizon")
    return hit.groupBy(*keys).agg(first.alias("early")).select(*keys, "early.*")


def current_risk(rules: RiskRules = RiskRules(), ord_: int = 10) -> Column:
    """Candidate for the present depletion: critical, warning or none."""
    dr = F.col("depletion_fraction")
    critical = dr >= rules.critical
    text = F.concat(F.lit("Root-zone depletion "), F.format_string("%.1f%%", dr * 100.0), F.lit(" is past the "),
                    F.when(critical, "wilting limit").otherwise("allowed limit"), F.lit("; review the field."))
    return F.when(dr >= rules.mad, candidate(
        "AGRONOMIC_RISK", F.when(critical, "CRITICAL").otherwise("WARNING"),
        F.when(critical, "CRITICAL_WILTING_PROXIMITY").otherwise("MANAGEMENT_ALLOWABLE_DEPLETION"),
        F.when(critical, rules.critical).otherwise(rules.mad), "fraction", dr, F.lit(None).cast("string"), text,
        F.lit(ord_)))


def forecast_risk(rules: RiskRules = RiskRules(), ord_: int = 10) -> Column:
    """Candidate of an ``early`` struct column (horizon, point, exceedance, certainty); null without one."""
    e = F.col("early")
    p = F.coalesce(F.round(e["exceedance"], 4), F.lit(rules.default_probability))
    text = F.concat(F.lit("Depletion may pass the allowed limit at +"), e["horizon"].cast("string"), F.lit(" h ("),
                    e["certainty"], F.lit(", P="), F.format_string("%.1f%%", p * 100.0), F.lit(")."))
    return F.when(e.isNotNull(), candidate(
        "AGRONOMIC_RISK", F.lit("WARNING"), "MANAGEMENT_ALLOWABLE_DEPLETION", F.lit(rules.mad), "fraction", e["point"],
        F.concat(F.lit("certainty: "), e["certainty"]), text, F.lit(ord_), e["horizon"], p))


def baseline_risk(exceedances: DataFrame, keys: Sequence[str], rules: RiskRules = RiskRules(tau=0.75)) -> DataFrame:
    """First risk form: earliest horizon whose exceedance reaches tau while the present depletion is allowed."""
    hit = exceedances.where((F.col("exceedance") >= rules.tau) & (F.col("depletion_fraction") < rules.mad))
    first = F.min_by(F.struct("horizon", "exceedance"), "horizon")
    return hit.groupBy(*keys).agg(first.alias("early")).select(*keys, "early.*")


def with_previous_state(states: DataFrame, layout: Layout = DEFAULT, max_gap_hours: float | None = None,
                        few: DataFrame | bool | None = True) -> DataFrame:
    """Add the previous valid state of the station: ``prev_theta`` and ``prev_<d>cm`` (rows carry rn of n).

    With ``few`` (``running.long_keys``), rows have a ``block`` and are not numbered again: ``rn`` need not be gapless.
    """
    columns = {"prev_theta": "theta_rz", "prev_time": "event_time"}
    columns |= {f"prev_{d}cm": f"soil_moisture_{d}cm" for d in DEPTHS if f"soil_moisture_{d}cm" in states.columns}
    if few is not True:
        out = previous(states, ["source_id"], columns, few)
    else:
        w = block_window(["source_id"])
        rows = with_halo(states, before=1, layout=layout)
        out = core_rows(rows.withColumns({name: F.lag(c, 1).over(w) for name, c in columns.items()}))
    if max_gap_hours is None:
        return out
    seconds = F.col("event_time").cast("timestamp").cast("long") - F.col("prev_time").cast("timestamp").cast("long")
    fresh = seconds <= max_gap_hours * 3600
    return out.withColumns({c: F.when(fresh, F.col(c)) for c in columns if c != "prev_time"})


def layer_delta(depths: Sequence[int], columns: Sequence[str]) -> Column:
    """Largest rise over the given depths; a depth that was absent before counts as unchanged, absent now as none."""
    rises = [
        F.when(F.col(f"soil_moisture_{d}cm").isNotNull(),
               F.col(f"soil_moisture_{d}cm") - F.coalesce(F.col(f"prev_{d}cm"), F.col(f"soil_moisture_{d}cm")))
        for d in depths if f"soil_moisture_{d}cm" in columns
    ]
    return F.array_max(F.array(*rises)) if rises else F.lit(None).cast("double")


def deviations(columns: Sequence[str], rules: DeviationRules = DeviationRules(), prior: str | None = None) -> list[Column]:
    """Candidate structs (null when quiet): residual, drying, wetting, inversion.

    Needs theta_rz, theta_sat, prev_theta, prev_<d>cm, rain_last and, with ``prior``, the one-step forecast.
    """
    theta, before = F.col("theta_rz"), F.col("prev_theta")
    delta = theta - before
    shallow, deep = layer_delta([5, 10], columns), layer_delta([50, 100], columns)
    num = lambda c: F.format_string("%.4f", c)

    def alert(when, severity, limit, unit, predicted, text, ord_, horizon=None):
        return F.when(when, candidate(
            "PHYSICAL_DEVIATION", F.lit(severity), "MASS_BALANCE_RESIDUAL", F.lit(limit), unit, predicted, text,
            F.concat(F.lit("Check the site: "), text), F.lit(ord_), horizon))

    out = []
    if prior:
        gap = F.abs(theta - F.col(prior))
        out.append(alert(gap > rules.residual, "WARNING", rules.residual, "m3/m3", gap,
                         F.concat(F.lit("forecast residual "), num(gap)), 1, F.lit(1)))
    out.append(alert((delta < -rules.drying) & (theta < F.col("theta_sat")), "WARNING", rules.drying, "m3/m3/hr",
                     F.abs(delta), F.concat(F.lit("drying step "), num(delta)), 2))
    out.append(alert((delta > rules.wetting) & (F.col("rain_last") <= rules.rain), "INFO", rules.wetting, "m3/m3/hr",
                     delta, F.concat(F.lit("wetting without rain "), num(delta)), 3))
    out.append(alert(before.isNotNull() & (deep > rules.deep) & (shallow < rules.shallow), "INFO", rules.deep,
                     "m3/m3/hr", deep, F.concat(F.lit("deep wetting below dry surface "), num(deep)), 4))
    return out


def quality_candidate() -> Column:
    """Candidate of a quarantined event (failure_reason, any_stuck, trigger_value, trigger_unit)."""
    return F.when(F.col("quarantined"), candidate(
        "DATA_QUALITY_ALERT", F.lit("CRITICAL"),
        F.when(F.col("any_stuck"), "SENSOR_STUCK_VALUE").otherwise("SENSOR_OUT_OF_RANGE"),
        F.col("trigger_value"), F.col("trigger_unit"), F.col("trigger_value"), F.col("failure_reason"),
        F.concat(F.lit("Reading quarantined: "), F.col("failure_reason")), F.lit(0)))


def explode_candidates(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Rows with candidate structs -> one row per present candidate."""
    return df.select("source_id", "step", "event_time", F.inline(F.array_compact(F.array(*structs)))).select(*CANDIDATE)


def assessments(candidates: DataFrame) -> DataFrame:
    """Class, reason, quarantine and review markers of each candidate."""
    c = F.col("category")
    return candidates.select(
        "source_id", "step", "event_time", "ord",
        F.when(c == "DATA_QUALITY_ALERT", "DATA_QUALITY_ANOMALY")
        .when(c == "AGRONOMIC_RISK", "OPERATIONAL_WATER_RISK")
        .otherwise("PHYSICAL_DEVIATION").alias("classification"),
        F.col("guidance").alias("primary_reason"),
        (c == "DATA_QUALITY_ALERT").alias("is_quarantined"),
        F.lit(True).alias("requires_operator_review"),
    )


def cycle_class(cycles: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Overall class per cycle: quarantined, else risk, else deviation, else normal."""
    seen = confirmed.groupBy("source_id", "step").agg(
        F.bool_or(F.col("category") == "AGRONOMIC_RISK").alias("_risk"),
        F.bool_or(F.col("category") == "PHYSICAL_DEVIATION").alias("_dev"),
        F.count(F.lit(1)).alias("confirmed"),
    )
    return cycles.join(seen, ["source_id", "step"], "left").select(
        *cycles.columns,
        F.coalesce("confirmed", F.lit(0)).alias("confirmed"),
        F.when(F.col("quarantined"), "DATA_QUALITY_ANOMALY")
        .when(F.col("_risk"), "OPERATIONAL_WATER_RISK")
        .when(F.col("_dev"), "PHYSICAL_DEVIATION")
        .otherwise("NORMAL_OPERATION").alias("classification"),
    )


def interval_80(spread: Column, point: Column, bounds=(-0.5, 1.5)) -> tuple[Column, Column]:
    return clip(point + spread["q10"], *bounds), clip(point + spread["q90"], *bounds)
