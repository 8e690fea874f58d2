"""Quality control -> state -> forecast -> decision cycle, for all stations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.layout import DEFAULT, Layout
from loamline.operators import decision as D
from loamline.operators import qc
from loamline.operators import uncertainty as U
from loamline.operators.filters import FilterRules, filter_alerts
from loamline.operators.forecast import fan_out, with_valid_time
from loamline.operators.quantiles import exact_quantiles
from loamline.operators.running import attach, block_of, deal, index_rows, long_keys, running
from loamline.operators.series import chronological_split, with_targets
from loamline.operators.state import build_states, widen_moisture
from loamline.plans import models as M
from loamline.schemas import HORIZONS
from loamline.stage import stage


def checked_events(rows: DataFrame, order: Sequence[str], layout: Layout = DEFAULT, drop: Sequence[str] = ()) -> DataFrame:
    """Wide events with flags, quarantine columns and the station's cycle number ``step``.

    Moisture that is not VALID is null from here on. ``rain_last`` becomes the last rain of a non-quarantined event,
    as the deviation rules want it. Events are moved once and written with all of this; ``drop`` names columns that no later step reads.
    """
    dealt = deal(rows, ["source_id"], order, layout, before=qc.STUCK_STEPS - 1)
    checked = qc.usable_moisture(qc.wide_quarantine(qc.check_wide(rows, order, layout, dealt=dealt)))
    return stage(with_rain_memory(checked, dealt[1]).drop(*drop), "flagged")


def with_rain_memory(flagged: DataFrame, few: DataFrame | bool | None = True) -> DataFrame:
    """Number the cycles and carry the last rain of accepted events (rows have rn and block; ``few`` as in ``running``)."""
    accepted = F.when(~F.col("quarantined"), F.greatest(F.lit(0.0), F.col("precip_mm")))
    memory = running(flagged.drop("rain_last").withColumn("_rain", accepted), ["source_id"],
                     {"rain_last": ("last", "_rain")}, few=few)
    return memory.withColumn("rain_last", F.coalesce("rain_last", F.lit(0.0))).withColumn("step", F.col("rn")).drop(
        "_rain")


def events_from_readings(readings: DataFrame, order: Sequence[str], layout: Layout = DEFAULT) -> DataFrame:
    """Long readings (with injected faults or absent sensors) -> the same event rows as ``checked_events``."""
    event = ["source_id", *order]
    checked = stage(qc.check_long(readings, order, layout), "checked")
    summary = qc.summarise_events(checked, event)
    moisture = widen_moisture(checked, event)
    rain = checked.where("variable_name = 'precipitation'").groupBy(*event).agg(F.max("value").alias("precip_mm"))
    wide = summary.join(moisture, event).join(rain, event, "left")
    numbered = index_rows(wide, ["source_id"], order, layout).withColumn("block", block_of("rn", layout))
    return with_rain_memory(stage(numbered.withColumn("rain_last", F.lit(0.0)), "events"))


def accepted_states(events: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Valid states of the non-quarantined events (the event's position is kept). A station's parameters are repeated for each of its
    blocks, so that states are dealt by (station, block), as the windows over them want it."""
    accepted = events.where("not quarantined")
    if sites is not None:
        blocks = accepted.select("source_id", "block").distinct()
        accepted = accepted.join(sites.join(blocks, "source_id").hint("merge"), ["source_id", "block"], "left")
    return build_states(accepted).where("is_valid")


def decision_candidates(events: DataFrame, sites: DataFrame | None = None, prior: str | None = None,
                        risk: D.RiskRules = D.RiskRules(), layout: Layout = DEFAULT,
                        early: DataFrame | None = None) -> DataFrame:
    """Candidates of every cycle: quality alerts of quarantined events, else deviations, present and forecast risk.

    ``prior='persistence'`` compares each state with the one-step forecast made at the state before. ``early`` has the
    earliest risky horizon of a cycle (``D.early_risk`` by source_id and step); present risk goes before forecast risk.
    """
    moved = D.with_previous_state(accepted_states(events, sites), layout, few=long_keys(events, ["source_id"]))
    prior_column = "prev_theta" if prior == "persistence" else prior
    present = D.current_risk(risk)
    if early is not None:
        first = early.select("source_id", "step", F.struct("horizon", "point", "exceedance", "certainty").alias("early"))
        moved = moved.join(first, ["source_id", "step"], "left")
        present = F.coalesce(present, D.forecast_risk(risk))
    structs = [*D.deviations(moved.columns, prior=prior_column), present]
    from_states = D.explode_candidates(moved, structs)
    from_quality = D.explode_candidates(events, [D.quality_candidate()])
    return stage(from_quality.unionByName(from_states), "candidates")


def early_risks(states: DataFrame, residuals: DataFrame, horizons: Sequence[int] = HORIZONS,
                risk: D.RiskRules = D.RiskRules(), bounds: tuple[float, float] = (-0.5, 1.5),
                layout: Layout = DEFAULT) -> DataFrame:
    """Earliest risky horizon by source_id and step, of persistence forecasts of the depletion of accepted states.

    ``residuals`` are depletion residuals (source_id, horizon, residual, weight); a station without any has no interval.
    """
    spread = exact_quantiles(residuals, U.KEY, "residual", {"q10": 0.1, "q90": 0.9}, layout, weight="weight")
    # origins beyond the allowed depletion carry no forecast risk; D.early_risk would leave them out after the work
    allowed = states.where(F.col("depletion_fraction") < risk.mad).select("source_id", "step", "event_time", "depletion_fraction")
    origins = fan_out(allowed, horizons).select(*U.KEY, "step", "depletion_fraction")
    rows = origins.join(spread.select(*U.KEY, F.struct("q10", "q90").alias("spread")), U.KEY, "left")
    low, high = D.interval_80(F.col("spread"), F.col("depletion_fraction"), bounds)
    known = lambda c: F.when(F.col("spread").isNotNull(), c)
    points = rows.withColumns({"point": F.col("depletion_fraction"), "low": known(low), "high": known(high)}).drop("spread", "depletion_fraction")
    chances = U.exceedance(residuals, points, risk.mad, layout).withColumn("depletion_fraction", F.col("point"))
    return D.early_risk(chances, ["source_id", "step"], risk)


def learnt_early_risks(events: DataFrame, sites: DataFrame | None = None, horizons: Sequence[int] = HORIZONS,
                       fraction: float = 0.5, risk: D.RiskRules = D.RiskRules(), layout: Layout = DEFAULT) -> DataFrame:
    """``early_risks`` of each station's later accepted states, with the residuals of its first ``fraction``."""
    states = accepted_states(events, sites).select(
        "source_id", F.col("rn").alias("event_rn"), "event_time", "block", F.col("depletion_fraction").alias("y"))
    numbered, _ = deal(stage(states, "risk-states"), ["source_id"], ["event_rn"], layout, after=max(horizons), bucket="block")
    series = stage(with_targets(chronological_split(numbered, fraction), "y", horizons, layout=layout, dealt=True), "risk-series")
    residuals = stage(U.residual_counts(series, horizons), "risk-residuals")
    later = series.where(~F.col("is_train")).select(
        "source_id", F.col("event_rn").alias("step"), "event_time", F.col("y").alias("depletion_fraction"))
    return early_risks(later, residuals, horizons, risk, layout=layout)


def decision_cycle(rows: DataFrame, order: Sequence[str], sites: DataFrame | None = None,
                   rules: FilterRules = FilterRules(count_mode="steps"), prior: str | None = None,
                   layout: Layout = DEFAULT, early: DataFrame | None = None,
                   horizons: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cycles with their class, filtered alerts). ``early``: see ``decision_candidates``; with ``horizons`` instead, the
    forecast risk is learnt from the rows themselves (``learnt_early_risks``)."""
    events = checked_events(rows, order, layout, drop=order[1:])
    if early is None and horizons:
        early = learnt_early_risks(events, sites, horizons, layout=layout)
    alerts = filter_alerts(decision_candidates(events, sites, prior, layout=layout, early=early), rules, layout)
    cycles = events.select("source_id", "step", "event_time", "quarantined")
    return D.cycle_class(cycles, alerts.where("status = 'CONFIRMED'")), alerts


def risk_forecasts(featured: DataFrame, horizons: Sequence[int], threshold: float, fraction: float = 0.5,
                   bounds: tuple[float, float] = (-0.5, 1.5), layout: Layout = DEFAULT) -> DataFrame:
    """Depletion forecasts of the test rows with their 80 % interval and exceedance probability, one per horizon.

    ``featured`` is a series whose target ``y`` is the depletion fraction.
    """
    counted = U.residual_counts(featured, horizons, layout=layout)
    residuals = counted if layout.whole else stage(counted, "residuals")
    spread = exact_quantiles(residuals, U.KEY, "residual", {"q10": 0.1, "q90": 0.9}, layout, weight="weight")
    learnt = M.map_of(spread, F.col("horizon"), ["q10", "q90"], "spread")
    params = M.for_test_rows(learnt, M.train_summary(featured), fraction)
    if layout.whole:
        kept = attach(featured, params, M.KEYS, layout=layout).select(
            "source_id", "is_train", "rn", "event_time", "y", "spread", F.array(*[F.col(f"y_{h}") for h in horizons]).alias("_ahead"))
        pairs = kept.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("k")) for k, h in enumerate(horizons)])))
        pairs = pairs.select("source_id", "is_train", "rn", "event_time", "y", F.col("_at.horizon").alias("horizon"),
                             F.col("spread")[F.col("_at.horizon")].alias("spread"), F.get("_ahead", F.col("_at.k")).alias("y_ahead"))
        chances = U.exceedance_in_place(pairs, threshold)
        low, high = D.interval_80(F.col("spread"), F.col("y"), bounds)
        placed = with_valid_time(chances).withColumns({"depletion_fraction": F.col("y"), "point": F.col("y"), "low": low, "high": high})
        return placed.select("source_id", "rn", "event_time", "depletion_fraction", "horizon", "valid_time", "support", "point", "low", "high", "exceedance")
    test = attach(featured.where(~F.col("is_train")), params, M.KEYS, layout=layout)
    rows = fan_out(test.select("source_id", "rn", "event_time", F.col("y").alias("depletion_fraction"), "spread"), horizons)
    low, high = D.interval_80(F.col("spread")[F.col("horizon")], F.col("depletion_fraction"), bounds)
    points = rows.withColumns({"point": F.col("depletion_fraction"), "low": low, "high": high}).drop("spread")
    return U.exceedance(residuals, points, threshold, layout)
