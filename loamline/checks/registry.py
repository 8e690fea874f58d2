"""The registered queries. Each runs over its whole tables; the column names equal those of the SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.checks.sql import oracle_sql, scale
from loamline.functions.keys import ingress_key, iso_utc, natural_key
from loamline.layout import Layout
from loamline.operators import audit, episodes, faults, filters, qc, ridge, series
from loamline.operators import decision as D
from loamline.operators import forecast as FC
from loamline.operators import sketch as sketches
from loamline.operators import uncertainty as U
from loamline.operators.evaluate import QUANTILES, comparison_table
from loamline.operators.features import AR_FEATURES, ARX_FEATURES, Feature, align_weather, compiled
from loamline.operators.running import attach, block_of, index_rows, placeable
from loamline.operators.series import KEYS
from loamline.operators.state import build_states, check_sites, topsoil, water_state
from loamline import sinks
from loamline.operators.asof import asof_join
from loamline.plans import contract_tree, contracts, models, operational, robustness
from loamline.plans.walk_forward import persistence_walk_forward, split_states, valid_states
from loamline.schemas import HORIZONS
from loamline.sinks import first_by_key
from loamline.sources import device_json, event_json
from loamline.sources import tables as T
from loamline.stage import stage, stage_folder
from loamline.streaming import decide, flows, stateful
from loamline.streaming.worker import CarriedWorker

ORDER = T.SERIES_ORDER
# What the models and their scores read of a series.
MODELLED = [*ARX_FEATURES, "regime"]


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, with negative zero as zero."""
    return df.select(*[
        (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes
    ])


def r9(df: DataFrame) -> DataFrame:
    return r6(df, 9)


def _series(spark, d):
    rows = T.supplier_series(spark, d)
    return rows, Layout.of(rows, 2500)


def _stations(spark, d):
    """The series with a layout that is ``whole`` where no station is longer than a block."""
    rows, lay = _series(spark, d)
    return rows, lay.for_stations(rows)


def _readings(spark, d):
    rows = T.supplier_readings(spark, d)
    return rows, Layout.of(rows, 2500)


def _events(spark, d):
    rows = T.event_readings(spark, d)
    return rows, Layout.of(rows, 30)


def _split(spark, d):
    rows, lay = _series(spark, d)
    series = split_states(rows, ORDER, ["event_time", "theta_rz"], layout=lay)
    return series.withColumn("y", F.col("theta_rz")), lay


def _featured(spark, d, oracle=False, scored=True, columns=None):
    rows, lay = _stations(spark, d)
    return models.featured_series(rows, ORDER, oracle=oracle, layout=lay, scored=scored, columns=columns), lay


def skipped_series(spark, d):
    return series.skipped_series(T.event_readings(spark, d), HORIZONS)


def _depletion(spark, d, columns=None):
    rows, lay = _stations(spark, d)
    y = (F.lit(0.32) - F.col("theta_rz")) / (F.lit(0.32) - F.lit(0.14))
    return models.featured_series(rows, ORDER, y, layout=lay, columns=columns), lay


def walk_forward_persistence(spark, d):
    rows, lay = _series(spark, d)
    return r6(persistence_walk_forward(rows, ORDER, layout=lay))


def walk_forward_by_source(spark, d):
    rows, lay = _series(spark, d)
    return r9(persistence_walk_forward(rows, ORDER, by=("source_id", "horizon"), layout=lay))


def root_zone_state(spark, d):
    states = build_states(T.supplier_series(spark, d), T.site_parameters(spark, d))
    return r6(states.select("source_id", "event_time", "theta_rz", "depletion_fraction", "available_water_fraction",
                            "storage_mm", "deficit_mm", "weight_fraction", "is_valid"))


def topsoil_series(spark, d):
    return r6(topsoil(valid_states(T.supplier_series(spark, d))).select("source_id", "event_time", "theta_10"))


def site_parameters(spark, d):
    return r6(check_sites(T.site_parameters(spark, d)).select(
        "source_id", "theta_fc", "theta_wp", "taw_mm", "theta_mad", F.size("violations").alias("broken_rules")))


def audit_coverage(spark, d):
    return audit.coverage(T.event_hourly(spark, d))


def audit_missing_steps(spark, d):
    return audit.missing_steps(T.event_hourly(spark, d))


def _qc_columns(rows):
    return [c[0] for c in qc.channels_of(rows)]


def audit_variable_stats(spark, d):
    rows = T.supplier_readings(spark, d)
    return r6(audit.variable_stats(rows, _qc_columns(rows)))


def audit_completeness(spark, d):
    rows = T.supplier_readings(spark, d)
    return r6(audit.completeness(rows, _qc_columns(rows)))


def store_counts(spark, d):
    rows, lay = _readings(spark, d)
    events = qc.check_wide(rows, ORDER, lay)
    return audit.store_counts({"events": events, "readings": qc.to_readings(rows, ["source_id"])})


def site_status(spark, d):
    rows, lay = _series(spark, d)
    states = water_state(valid_states(rows).select("source_id", *ORDER, "theta_rz"))
    indexed = stage(index_rows(states, ["source_id"], ORDER, lay).select(
        "source_id", "event_time", "rn", "n", "theta_rz", "depletion_fraction"), "status")
    counters = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("ingested"))
    return r9(audit.site_status(indexed, counters))


def _flag_counts(flagged):
    return r6(flagged.groupBy("source_id", "sensor_id", "qc_flag").agg(
        F.count(F.lit(1)).alias("readings"), F.sum("value").alias("total")))


def qc_flags_wide(spark, d):
    rows, lay = _readings(spark, d)
    return _flag_counts(qc.to_readings(qc.check_wide(rows, ORDER, lay), ["source_id"], flagged=True))


def _long(spark, d):
    rows, lay = _readings(spark, d)
    # an event without a station or time has no place, and no number either
    rows, _ = placeable(rows, ["source_id"], ORDER)
    numbered = index_rows(rows, ["source_id"], ORDER, lay, rn="number")
    keep = ["source_id", "event_time", "number", "event_block"]
    wide = numbered.withColumn("event_block", block_of("number", lay)).select(*keep, *_qc_columns(rows))
    wide = stage(wide, "numbered")
    # Events are dealt before their readings are exploded; the event number stands in for the ten order columns.
    dealt = qc.to_readings(wide.repartition("source_id", "event_block"), keep)
    readings = qc.to_readings(wide, keep).drop("event_block")
    return qc.check_long(readings, ["event_time", "number"], lay, position="number", dealt=dealt).drop("number")


def qc_flags_long(spark, d):
    return _flag_counts(_long(spark, d))


def qc_event_summary(spark, d):
    return qc.summarise_events(_long(spark, d), ["source_id", "event_block", "event_rn"]).select(
        "source_id", "event_rn", "flag_count", "quarantined", "all_valid", "failure_reason")


def qc_quarantine_alerts(spark, d):
    events = qc.summarise_events(_long(spark, d), ["source_id", "event_block", "event_rn"])
    return r6(qc.quarantine_alerts(events, ["source_id", "event_rn"]))


def normalise_long(spark, d):
    readings = qc.to_readings(T.supplier_readings(spark, d), [])
    return r6(readings.groupBy("sensor_id", "qc_flag").agg(F.count(F.lit(1)).alias("readings"), F.sum("value").alias("total")))


def natural_keys(spark, d):
    source, time = F.col("source_id").cast("string"), iso_utc(F.col("event_time"))
    return T.event_readings(spark, d).select(
        "event_id",
        natural_key(source, time, F.lit("OBSERVED"), F.lit("1.0.0")).alias("natural_key"),
        ingress_key(source, F.lit("FIELD_DEFAULT"), time).alias("ingress_key"))


def _hour(c: str = "event_time"):
    return F.date_trunc("hour", F.col(c)).cast("timestamp_ntz")


def dedup_first(spark, d):
    hour = _hour()
    rows = T.event_readings(spark, d).withColumn("exact", F.col("event_time")).withColumn("event_time", hour)
    keyed = rows.withColumn("key", natural_key(F.col("source_id").cast("string"), F.col("event_time").cast("string"),
                                               F.col("sensor_id"), F.lit("1.0.0")))
    return r6(first_by_key(keyed, "key", ["exact", "event_id"]).select("source_id", "sensor_id", "event_time", "event_id", "value"))


def events_json_decode(spark, d):
    return T.event_readings(spark, d).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def _packets(spark, d):
    kind = F.col("sensor_id")
    vwc = F.when(kind == "error", "bad").when(kind != "signup", (F.col("value") / 1000).cast("string"))
    return T.event_readings(spark, d).select("source_id", F.to_json(F.struct(
        F.when(F.col("event_id") % 11 != 0, F.col("source_id").cast("string")).alias("device_id"),
        iso_utc(F.col("event_time")).alias("timestamp_utc"),
        F.struct(vwc.alias("soil_moisture_5cm"),
                 F.when(kind == "purchase", F.col("value")).alias("precipitation_mm")).alias("sensors"),
    )).alias("value")).withColumnRenamed("source_id", "device")


def device_packets(spark, d):
    p = device_json.decode(_packets(spark, d))
    ok = F.col("failure_reason").isNull()
    total = F.aggregate("measurements", F.lit(0.0), lambda a, m: a + F.when(
        m["variable_name"] == "volumetric_water_content", F.coalesce(m["value"], F.lit(0.0))).otherwise(F.lit(0.0)))
    return r6(p.groupBy(F.col("device").alias("device_id")).agg(
        F.count_if(ok).alias("good"),
        F.count_if(F.col("failure_reason").startswith("device_id")).alias("incomplete"),
        F.count_if(F.col("failure_reason").startswith("no sensor")).alias("empty"),
        F.sum(F.when(ok, F.size("measurements"))).alias("readings"),
        F.sum(F.when(ok, total)).alias("total_vwc")))


def _tasks(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _event_lines(spark, d):
    """The events as JSON lines of the contract, many of them with a fault; dealt out, as a small file may be one task."""
    kind, time = F.col("sensor_id"), iso_utc(F.col("event_time"))
    reading = F.struct(kind.alias("sensor_id"), F.lit("air_temperature").alias("variable_name"),
                       F.when(F.col("value") > 100, -5.0).otherwise(0.0).alias("depth_cm"), F.col("value"),
                       F.lit("degC").alias("unit"), F.lit("VALID").alias("qc_flag"))
    return T.event_readings(spark, d).repartition(_tasks(spark), "event_id").select(F.to_json(F.struct(
        F.when(F.col("event_id") % 7 == 0, "1.0").otherwise("1.0.0").alias("schema_version"),
        F.lit("00000000-0000-4000-8000-000000000000").alias("event_id"),
        F.col("source_id").cast("string").alias("source_id"),
        F.when(kind != "signup", "FIELD_01").alias("site_id"),
        time.alias("event_time"), time.alias("ingest_time"),
        F.struct(F.when(kind == "click", "GUESSED").otherwise("OBSERVED").alias("data_class"),
                 F.when(F.col("event_id") % 5 != 0, "NET").alias("network"),
                 F.when(F.col("event_id") % 13 == 0, "x").alias("owner")).alias("provenance"),
        F.array(reading).alias("measurements"),
        F.when(kind == "error", 1).alias("extra"),
    )).alias("value"))


def contract_report(spark, d):
    report = contracts.event_report(_event_lines(spark, d))
    return report.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("events"))


def features_causal(spark, d):
    f, _ = _featured(spark, d, scored=False)
    return r6(f.select("source_id", "split", "rn", *ARX_FEATURES, "regime"))


def regime_counts(spark, d):
    f, _ = _featured(spark, d, scored=False)
    return r6(f.groupBy("source_id", "split", "regime").agg(F.count(F.lit(1)).alias("rows"), F.sum("rain_72").alias("rain_72")))


def oracle_future_rain(spark, d):
    f, _ = _featured(spark, d, oracle=True, scored=False)
    return r6(f.select("source_id", "split", "rn", *[f"oracle_rain_{h}" for h in HORIZONS]))


def weather_aligned(spark, d):
    rows = T.event_readings(spark, d).withColumn("exact", F.col("event_time")).withColumn("event_time", _hour())
    states = rows.where("sensor_id <> 'view'").select("source_id", "event_time", "event_id")
    weather = rows.where("sensor_id = 'view'").withColumnRenamed("value", "rain")
    return r6(align_weather(states, weather, ["rain"], ["exact", "event_id"]).select("source_id", "event_time", "event_id", "rain"))


def _persistence(spark, d):
    f, lay = _featured(spark, d, columns=["event_time", "step"])
    q = U.residual_stats(U.residual_counts(f, HORIZONS, layout=lay), QUANTILES, lay)
    learnt = models.map_of(q, F.col("horizon"), list(QUANTILES), "spread")
    test = attach(f.where(~F.col("is_train")), models.for_test_rows(learnt, models.train_summary(f), 0.5), KEYS, layout=lay)
    rows = FC.fan_out(test.withColumn("point", F.col("y")), HORIZONS)
    return FC.with_intervals(rows, F.col("spread")[F.col("horizon")], FC.bounds_of("volumetric_water_content"))


def forecast_persistence(spark, d):
    return r9(_persistence(spark, d).select("source_id", "step", "horizon", "valid_time", "support", "point", *QUANTILES))


def forecast_events(spark, d):
    events = FC.forecast_events(_persistence(spark, d), "PERSISTENCE_BASELINE")
    return events.select("forecast_id", "source_id", "origin_time", "target_variable", F.size("predictions").alias("horizons"),
                         F.col("predictions")[0]["point_forecast"].alias("point"))


def forecast_mean_expanding(spark, d):
    s, lay = _split(spark, d)
    return r9(FC.expanding_mean(s, layout=lay).select("source_id", "split", "rn", "point"))


def forecast_ewma(spark, d):
    s, lay = _split(spark, d)
    return r6(FC.ewma(s, 0.2, layout=lay).select("source_id", "split", "rn", "point"))


def _gram(spark, d, names: Sequence[str]):
    """Mean products per horizon: the sums of the models over the rows, in units that keep them small."""
    f, _ = _featured(spark, d)
    sums = ridge.cross_sums(f, HORIZONS, names, keys=["horizon"])
    unit = [float(scale(n)) for n in names]
    mean = lambda c, u=1.0: (F.col(c) / F.col("rows") / F.lit(u)).alias(c)
    p = range(len(names))
    return r6(sums.select(
        "horizon", F.col("rows").cast("long").alias("rows"), mean("s_t"), *[mean(f"s_{i}", unit[i]) for i in p], *[mean(f"t_{i}", unit[i]) for i in p],
        *[mean(f"c_{i}_{j}", unit[i] * unit[j]) for i in p for j in p if i <= j]))


def ridge_gram_ar(spark, d):
    return _gram(spark, d, AR_FEATURES)


def ridge_gram_arx(spark, d):
    return _gram(spark, d, ARX_FEATURES)


def forecast_ridge(spark, d):
    f, _ = _featured(spark, d)
    return ridge.fit(f, HORIZONS).select("source_id", "horizon", "model", F.round("bias", 6).alias("bias"),
                                         F.transform("weights", lambda w: F.round(w, 6)).alias("weights"))


def model_ladder(spark, d):
    f, lay = _featured(spark, d, columns=MODELLED)
    return r6(models.model_ladder(f, layout=lay))


def model_ladder_depletion(spark, d):
    f, lay = _depletion(spark, d, columns=MODELLED)
    return r6(models.model_ladder(f, bounds=(-0.5, 1.5), level=0.5, layout=lay))


def model_ladder_topsoil(spark, d):
    rows, lay = _stations(spark, d)
    f = models.featured_series(rows, ORDER, F.coalesce("soil_moisture_10cm", "theta_rz"), layout=lay, columns=MODELLED)
    return r6(models.model_ladder(f, layout=lay))


def forecast_hybrid(spark, d):
    f, lay = _featured(spark, d, columns=MODELLED)
    return r6(models.hybrid_table(f, layout=lay))


def oracle_ablation(spark, d):
    f, lay = _featured(spark, d, oracle=True, columns=[*MODELLED, *[f"oracle_rain_{h}" for h in HORIZONS]])
    return r6(models.oracle_ablation(f, layout=lay))


def fallback_routing(spark, d):
    """A user model that fails on some blocks: those rows fall back to persistence."""
    f, _ = _featured(spark, d)

    def predict(pdf):
        if int(pdf["source_id"].iloc[0]) % 7 == 0:
            raise RuntimeError("model not available")
        return 0.5 * pdf["lag_0"] + 0.5 * pdf["lag_24"]

    out = FC.model_hook(f.where(~F.col("is_train")), predict, KEYS, ["lag_0", "lag_24"])
    routed = FC.safe_route(out.withColumnRenamed("lag_0", "persistence"))
    return r6(routed.groupBy("source_id", "used_fallback").agg(F.count(F.lit(1)).alias("forecasts"), F.avg("point").alias("mean_point")))


def residual_quantiles(spark, d):
    f, lay = _featured(spark, d, columns=[])
    residuals = U.residual_counts(f, HORIZONS, layout=lay)
    return r9(U.residual_stats(residuals if lay.whole else stage(residuals, "residuals"), QUANTILES, lay))


def _residuals(spark, d):
    f, lay = _featured(spark, d, columns=["regime"])
    residuals = U.residual_counts(f, HORIZONS, ["regime"], lay)
    return residuals if lay.whole else stage(residuals, "residuals"), lay


def interval_u0_static(spark, d):
    res, lay = _residuals(spark, d)
    return r9(U.fit_static(res, [0.8, 0.9], lay).select("source_id", "horizon", "lo_80", "hi_80", "lo_90", "hi_90"))


def interval_u1_mad(spark, d):
    res, lay = _residuals(spark, d)
    return r6(U.fit_dispersion(res, lay))


def interval_u2_regime(spark, d):
    res, lay = _residuals(spark, d)
    return r9(U.fit_regimes(res, [0.8], lay).select("source_id", "horizon", "regime", "lo_80", "hi_80"))


def interval_u3_power(spark, d):
    res, _ = _residuals(spark, d)
    return r6(U.fit_power_law(res))


def interval_benchmark(spark, d):
    f, lay = _featured(spark, d, columns=["regime"])
    return r6(models.interval_benchmark(f, layout=lay))


def _risk(spark, d):
    f, lay = _depletion(spark, d, columns=["event_time"])
    return operational.risk_forecasts(f, HORIZONS, D.RiskRules().mad, layout=lay)


def exceedance_probability(spark, d):
    return r6(_risk(spark, d).select("source_id", "rn", "horizon", "exceedance"))


def risk_certainty(spark, d):
    level = D.certainty(F.col("point"), F.col("horizon"), F.col("low"), F.col("high"), F.col("exceedance"))
    return _risk(spark, d).withColumn("certainty", level).groupBy("horizon", "certainty").agg(F.count(F.lit(1)).alias("origins"))


def early_risk(spark, d):
    return r6(D.early_risk(_risk(spark, d), ["source_id", "rn"]).select("source_id", "rn", "horizon", "exceedance", "certainty"))


def baseline_risk(spark, d):
    return r6(D.baseline_risk(_risk(spark, d), ["source_id", "rn"]).select("source_id", "rn", "horizon", "exceedance"))


def early_risk_baseline(spark, d):
    """The first risk form at a lower probability, which some origins reach."""
    return r6(D.baseline_risk(_risk(spark, d), ["source_id", "rn"], D.RiskRules(tau=0.2)).select("source_id", "rn", "horizon", "exceedance"))


def _checked(spark, d):
    rows, lay = _readings(spark, d)
    return operational.checked_events(rows, ORDER, lay, drop=ORDER[1:]), lay


def _candidates(spark, d, events=None):
    events, lay = (events, _readings(spark, d)[1]) if events is not None else _checked(spark, d)
    return operational.decision_candidates(events, T.site_parameters(spark, d), "persistence", layout=lay), lay


def physical_deviations(spark, d):
    c, _ = _candidates(spark, d)
    return r6(c.where("category = 'PHYSICAL_DEVIATION'").select("source_id", "step", "ord", "severity", "threshold_type", "predicted_value"))


def decision_candidates(spark, d):
    c, _ = _candidates(spark, d)
    return r6(c.select("source_id", "step", "event_time", "ord", "category", "severity", "threshold_type", "predicted_value"))


FILTERED = ["source_id", "category", "threshold_type", "step", "ord", "severity", "seen", "status"]


def alerts_consecutive(spark, d):
    c, lay = _candidates(spark, d)
    return filters.filter_alerts(c, filters.FilterRules(), lay).select(*FILTERED)


def alerts_n_of_m(spark, d):
    c, lay = _candidates(spark, d)
    out = filters.filter_alerts(c, filters.FilterRules(mode="n_of_m"), lay)
    return out.select(*FILTERED).withColumn("seen", F.col("seen").cast("long"))


def suppression_table(spark, d):
    c, lay = _candidates(spark, d)
    return r6(filters.suppression_table(c, layout=lay))


def decision_cycle(spark, d):
    rows, lay = _readings(spark, d)
    cycles, _ = operational.decision_cycle(rows, ORDER, T.site_parameters(spark, d), filters.FilterRules(), "persistence", lay)
    return cycles.select("source_id", "step", "event_time", "quarantined", "confirmed", "classification")


def decision_cycle_forecast(spark, d):
    """The cycle with forecast risk."""
    rows, lay = _readings(spark, d)
    cycles, _ = operational.decision_cycle(rows, ORDER, T.site_parameters(spark, d), filters.FilterRules(), "persistence", lay, horizons=HORIZONS)
    return cycles.select("source_id", "step", "event_time", "quarantined", "confirmed", "classification")


def alerts_forecast(spark, d):
    """Filtered alerts with forecast risk."""
    rows, lay = _readings(spark, d)
    _, alerts = operational.decision_cycle(rows, ORDER, T.site_parameters(spark, d), filters.FilterRules(), "persistence", lay, horizons=HORIZONS)
    return alerts.select(*FILTERED, "horizon", "exceedance")


def episodes_site(spark, d):
    c, lay = _candidates(spark, d)
    return r6(episodes.site_episodes(c, layout=lay))


def _by_type(spark, d, gap):
    c, lay = _candidates(spark, d)
    return episodes.episodes_by_type(c, gap, lay), lay


def episodes_by_type(spark, d):
    e, _ = _by_type(spark, d, 6)
    return e.withColumn("severities", F.array_join("severities", ","))


def episode_summary(spark, d):
    e, lay = _by_type(spark, d, 1)
    return r6(episodes.episode_summary(stage(e, "episodes"), layout=lay))


def top_episodes(spark, d):
    e, _ = _by_type(spark, d, 6)
    ties = ["source_id", "category", "threshold_type", "start_step"]
    return episodes.top_episodes(e, 8, ties).select(*ties, "duration_steps", "alert_count")


def alert_cube(spark, d):
    c, _ = _candidates(spark, d)
    return episodes.alert_cube(c)


def alert_breakdown(spark, d):
    c, _ = _candidates(spark, d)
    return episodes.breakdown(c)


def alert_schema_pass(spark, d):
    c, _ = _candidates(spark, d)
    alerts = contracts.alert_events(c)
    return contracts.pass_rate(contracts.with_violations(alerts, contracts.alert_rules(alerts.columns)))


def asof_weather(spark, d):
    """Each reading with the station's last weather value of the day before it."""
    rows, lay = _events(spark, d)
    readings = rows.where("sensor_id <> 'view'").select("source_id", "event_time", "event_id")
    weather = rows.where("sensor_id = 'view'").select("source_id", "event_time", F.col("value").alias("rain"), F.col("event_id").alias("weather_id"))
    out = asof_join(readings, weather, ["source_id"], "event_time", ["rain", "weather_id"], ["weather_id"], tolerance_seconds=86_400, layout=lay)
    return r6(out.withColumnRenamed("matched_time", "weather_time"))


def asof_nearest_weather(spark, d):
    """Each reading with the weather value nearest in time, on either side."""
    rows, lay = _events(spark, d)
    readings = rows.where("sensor_id <> 'view'").select("source_id", "event_time", "event_id")
    weather = rows.where("sensor_id = 'view'").select("source_id", "event_time", F.col("value").alias("rain"))
    out = asof_join(readings, weather, ["source_id"], "event_time", ["rain"], ["rain"], direction="nearest", layout=lay)
    return r6(out.select("source_id", "event_id", "rain"))


def forecast_contract(spark, d):
    """Persistence forecasts of all test rows as JSON of the contract, every seventh origin without its site and every eleventh with
    quantiles out of order, parsed and checked again: origins, violations and the forecast a day ahead."""
    f, lay = _split(spark, d)
    test = FC.fan_out(f.where(~F.col("is_train")).select("source_id", "event_time", "rn", F.col("y").alias("point")), HORIZONS)
    spread = {"q10": -0.02, "q25": -0.01, "q50": 0.0, "q75": 0.01, "q90": 0.02}
    upside_down = F.when(F.col("rn") % 11 == 0, -1.0).otherwise(1.0)
    rows = test.withColumns({q: F.col("point") + F.lit(v) * upside_down for q, v in spread.items()})
    rows = rows.withColumn("site_id", F.when(F.col("rn") % 7 != 0, F.concat(F.lit("FIELD_"), F.col("source_id").cast("string"))))
    records = contract_tree.forecast_records(rows, "PERSISTENCE_BASELINE", "m3/m3", generated=F.col("event_time"))
    report = contract_tree.report(contract_tree.as_json(records, contract_tree.FORECAST), contract_tree.FORECAST)
    day = F.element_at(F.from_json(F.get_json_object("value", "$.predictions"), "array<struct<horizon_hours:int,point_forecast:double>>"), 4)
    found = report.select("source_id", F.concat_ws("; ", "violations").alias("violations"), day["horizon_hours"].alias("horizon"), day["point_forecast"].alias("point"))
    return found.groupBy("source_id", "violations", "horizon").agg(
        F.count(F.lit(1)).alias("forecasts"), F.sum(F.col("point").cast("decimal(20,4)")).cast("double").alias("points"))


def alert_json(spark, d):
    """All candidates as JSON of the alert contract, parsed and checked again."""
    c, _ = _candidates(spark, d)
    report = contract_tree.report(contract_tree.as_json(contract_tree.alert_records(c), contract_tree.ALERT), contract_tree.ALERT)
    at = lambda path: F.get_json_object("value", path)
    return r6(report.groupBy(
        at("$.source_id").alias("source_id"), at("$.category").alias("category"), at("$.trigger_condition.threshold_type").alias("threshold_type"),
        at("$.context.current_depletion_fraction").isNotNull().alias("has_depletion"), at("$.trigger_condition.forecast_horizon_hours").cast("int").alias("horizon"),
    ).agg(F.count(F.lit(1)).alias("alerts"), F.count_if("is_valid").alias("valid"),
          F.sum(at("$.trigger_condition.predicted_value").cast("decimal(20,4)")).cast("double").alias("predicted"),
          F.countDistinct(at("$.alert_id")).alias("ids")))


def site_evaluation(spark, d):
    f, lay = _featured(spark, d, columns=MODELLED)
    return r6(models.site_evaluation(f, layout=lay))


def site_outcomes(spark, d):
    return models.site_outcomes(site_evaluation(spark, d))


def cross_site_summary(spark, d):
    sites = stage(site_evaluation(spark, d), "sites")
    return r6(models.cross_site_summary(sites, models.site_outcomes(sites)))


def seasonal_slices(spark, d):
    rows, lay = _series(spark, d)
    states = valid_states(rows).withColumnRenamed("air_temp_c", "soil_temp_10cm")
    return r6(robustness.seasonal_slices(states, ORDER, layout=lay))


def fault_injection(spark, d):
    rows, lay = _events(spark, d)
    numbered = index_rows(rows, ["source_id"], ["event_time", "event_id"], lay, rn="event_rn")
    readings = numbered.select("source_id", "event_id", "event_rn", "sensor_id", "value", F.lit("VALID").alias("qc_flag"))
    specs = [faults.Fault(3, "view", "SENSOR_STUCK", steps=7), faults.Fault(8, "view", "PACKET_DROP", steps=5),
             faults.Fault(5, "click", "NON_PHYSICAL_RANGE", steps=2), faults.Fault(20, "error", "VALUE_SPIKE", steps=20)]
    out = faults.inject(readings, specs)
    return r6(out.groupBy("sensor_id", "qc_flag", "synthetic_fault_type").agg(
        F.count(F.lit(1)).alias("readings"), F.sum("value").alias("total")))


def packet_loss_table(spark, d):
    rows, lay = _readings(spark, d)
    identity = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    return r6(robustness.packet_loss_table(rows, ORDER, identity, layout=lay))


def resequence_inversions(spark, d):
    rows, lay = _events(spark, d)
    numbered = index_rows(rows, ["source_id"], ["event_time", "event_id"], lay).select("source_id", "event_time", "rn", "n")
    moved = stage(faults.delayed(numbered, 0.2, [F.col("source_id").cast("string")]), "delayed")
    counts = moved.groupBy("source_id").agg(F.count(F.lit(1)).alias("packets"),
                                            F.floor(F.count_if("swapped") / 2).alias("swaps"))
    arrived = audit.order_inversions(moved, "event_time", "arrival")
    sorted_again = audit.order_inversions(moved, "event_time", "rn").withColumnRenamed("inversions", "residual")
    return counts.join(arrived, "source_id").join(sorted_again, "source_id")


def reproducibility_diff(spark, d):
    rows, lay = _series(spark, d)
    by = ("source_id", "horizon")
    other = Layout(bucket_seconds=lay.bucket_seconds // 3, block_rows=200, value_width=lay.value_width * 2)
    first = persistence_walk_forward(rows, ORDER, by=by, layout=lay)
    second = persistence_walk_forward(rows.repartition(13, "l_orderkey"), ORDER, by=by, layout=other)
    return r6(robustness.reproducibility(first, second, by, ["mae", "rmse"]))


def run_summary(spark, d):
    rows, lay = _readings(spark, d)
    counts = qc.check_wide(rows, ORDER, lay).agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if("quarantined").alias("quarantined"))
    scores = persistence_walk_forward(T.supplier_series(spark, d), ORDER, layout=lay)
    out = sinks.run_summary("RUN-CHECK", counts, scores).drop("executed_at")
    return out.select("run_id", "total_records", "quarantined",
                      *[F.round(F.col(f"persistence_{m}")[24], 6).alias(f"{m}_24") for m in ("mae", "rmse", "skill_vs_mean", "coverage")])


def operations_counters(spark, d):
    rows, lay = _readings(spark, d)
    events = qc.check_wide(rows, ORDER, lay)
    return r6(flows.operations(events, _no_alerts(spark), _no_durations(spark)).select("ingested", "quarantined", "quarantined_pct"))


def operations_alerts(spark, d):
    """The counters with the filtered alerts, forecast risk included (the tables record no durations)."""
    rows, lay = _readings(spark, d)
    cycles, alerts = operational.decision_cycle(rows, ORDER, T.site_parameters(spark, d), filters.FilterRules(), "persistence", lay, horizons=HORIZONS)
    return r6(flows.operations(cycles, alerts, _no_durations(spark)).drop("p50_ms", "p90_ms", "p95_ms", "p99_ms"))


def _no_alerts(spark):
    return spark.createDataFrame([], "severity string")


def _no_durations(spark):
    return spark.createDataFrame([], "ms double")


def _run_stream(spark: SparkSession, build: Callable[[DataFrame], DataFrame], source: DataFrame, mode: str = "append",
                files: int | None = None, watermark: str | None = None) -> DataFrame:
    """Replay a table as a stream until it is used up and read the sink back. With ``watermark``, the rows behind it are
    written to dead letters first."""
    flows.use_rocksdb(spark)
    base = f"{stage_folder(spark)}/stream-{uuid.uuid4().hex}"
    source.write.parquet(f"{base}/in")
    stream = flows.file_stream(spark, f"{base}/in", source.schema, files_per_batch=files)
    if watermark:
        flows.admit(stream, f"{base}/admitted", f"{base}/admit-state", watermark).awaitTermination()
        stream = flows.file_stream(spark, f"{base}/admitted/on_time/*", source.schema)
    flows.write_available(build(stream), f"{base}/out", f"{base}/state", mode).awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _timed(spark, d):
    return T.event_readings(spark, d).withColumn("event_time", F.col("event_time").cast("timestamp"))


def _with_end(df: DataFrame) -> DataFrame:
    """One row far ahead in time per run, so that the watermark passes every real row."""
    name = F.lit("end") if dict(df.dtypes)["source_id"] == "string" else F.lit(-1).cast("bigint")
    last = df.limit(1).withColumns({"event_time": F.lit("2100-01-01").cast("timestamp"), "source_id": name})
    return df.unionByName(last)


def stream_dedup(spark, d):
    rows = _timed(spark, d).withColumn("hour", F.date_trunc("hour", "event_time"))
    keyed = rows.withColumn("ingress_key", ingress_key(F.col("source_id").cast("string"), F.col("sensor_id"), F.col("hour").cast("string")))
    out = _run_stream(spark, lambda s: flows.drop_repeats(s, watermark="40 days"), keyed.drop("props"), watermark="40 days")
    return out.select("source_id", "sensor_id", F.col("hour").cast("timestamp_ntz").alias("hour"))


def stream_hourly(spark, d):
    rows = _timed(spark, d).select(F.col("sensor_id").alias("source_id"), "event_time", "value")
    out = _run_stream(spark, lambda s: flows.hourly(s, "40 days"), _with_end(rows), watermark="40 days")
    return r6(out.where("source_id <> 'end'").withColumn("hour", F.col("hour").cast("timestamp_ntz")))


def stream_sessions(spark, d):
    rows = _timed(spark, d).select("source_id", "event_time")
    out = _run_stream(spark, lambda s: flows.sessions(s, "6 hours", "40 days"), _with_end(rows), watermark="40 days").where("source_id >= 0")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_time", "end_time")})


def stream_resequence(spark, d):
    rows = _timed(spark, d).select("source_id", "event_time", "event_id", "value")
    out = _run_stream(spark, lambda s: stateful.resequence(s, "40 days"), _with_end(rows), watermark="40 days")
    return out.where("source_id >= 0").select("source_id", "event_id", "position")


def stream_qc(spark, d):
    rows, lay = _readings(spark, d)
    numbered = index_rows(rows, ["source_id"], ORDER, lay).withColumnRenamed("rn", "event_rn")
    readings = qc.to_readings(numbered, ["source_id", "event_rn"])
    out = _run_stream(spark, stateful.quality_stream, readings)
    return out.groupBy("source_id", "sensor_id", "qc_flag").agg(F.count(F.lit(1)).alias("readings"))


def _arriving(spark, d) -> DataFrame:
    """The shipments as wide events with a key in their order; every fifth arrives 20 days late, in ``part`` 0 to 3."""
    digits = lambda c, n: F.lpad((F.col(c) * 100).cast("decimal(38,0)").cast("string"), n, "0")
    key = F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 14, "0") for c in ORDER[1:4]], *[digits(c, 14) for c in ORDER[4:8]], *ORDER[8:])
    rows = T.supplier_readings(spark, d).withColumn("ingress_key", key).withColumn("event_time", F.col("event_time").cast("timestamp"))
    late = F.when(F.crc32("ingress_key") % 5 == 0, F.expr("interval 20 days")).otherwise(F.expr("interval 0 days"))
    arrival = F.unix_micros(F.col("event_time") + late)
    ends = rows.agg(F.min(arrival).alias("a"), F.max(arrival).alias("b")).first()
    if ends["a"] is None:
        return rows.withColumn("part", F.lit(0))
    return rows.withColumn("part", F.least(F.lit(3), ((arrival - F.lit(ends["a"])) * 4 / F.lit(max(1, ends["b"] - ends["a"]))).cast("int")))


def _worked(spark, d) -> tuple[CarriedWorker, DataFrame]:
    """The worker after the four parts of the arriving events."""
    base = f"{stage_folder(spark)}/worker-{uuid.uuid4().hex}"
    rows = stage(_arriving(spark, d).drop(*ORDER[1:]), "arriving")
    worker = CarriedWorker(base, "40 days", T.site_parameters(spark, d), rules=decide.CycleRules(filters.FilterRules(), prior=True))
    for k in range(4):
        rows.where(F.col("part") == k).drop("part").write.option("compression", "zstd").parquet(f"{base}/in/{k}")
        worker.run_events(flows.file_stream(spark, f"{base}/in/*", rows.drop("part").schema), f"{base}/state")
    return worker, rows


def _standing(spark, worker: CarriedWorker, *columns: str) -> DataFrame:
    """Standing alerts with the columns that are read; no others are moved."""
    changes = spark.read.parquet(worker.path("alerts") + "/*")
    return decide.standing_alerts(changes.select(*decide.EVENT, "ord", "version", "op", *columns))


def stream_worker(spark, d):
    """Alerts that stand after four micro-batches with late events."""
    worker, _ = _worked(spark, d)
    alerts = _standing(spark, worker, "category", "severity", "threshold_type", "seen", "predicted_value")
    return r6(alerts.select("source_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"), F.substring("ingress_key", 1, 44).alias("shipment"),
                            "ord", "category", "severity", "threshold_type", F.col("seen").cast("long").alias("seen"), "predicted_value"))


def stream_worker_quality(spark, d):
    """Events by their last version: quarantine and flags after late events."""
    worker, _ = _worked(spark, d)
    versions = spark.read.parquet(worker.path("decided") + "/*")
    events = decide.latest(versions.select(*decide.EVENT, "version", "quarantined", "flag_soil_moisture_5cm"))
    return events.groupBy("source_id", "quarantined", F.col("flag_soil_moisture_5cm").alias("qc_flag")).agg(F.count(F.lit(1)).alias("events"))


def stream_operations(spark, d):
    """Metrics of the worker's tables: counts, alerts by category and severity, latest depletion per station (its durations differ by run)."""
    worker, _ = _worked(spark, d)
    events = stage(decide.latest(spark.read.parquet(worker.path("decided") + "/*")), "operated")
    alerts = _standing(spark, worker, "category", "severity")
    states = decide.states(events).withColumn("event_time", F.struct("event_time", "ingress_key"))
    metrics = flows.operations_metrics(events, states, alerts, spark.read.parquet(worker.path("durations") + "/*"))
    return r6(metrics.where("metric NOT LIKE 'latency%'"))


def latency_sketch(spark, d):
    """Percentiles of the readings from sketches of five parts, merged."""
    rows = T.event_readings(spark, d)
    parts = sketches.sketch(rows.withColumn("part", F.col("event_id") % 5), ["sensor_id", "part"], "value")
    one = sketches.merged(parts, ["sensor_id"])
    return r6(sketches.sketch_quantiles(one, ["sensor_id"], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}))


def station_status(spark, d):
    """Last state, recent mean, latest forecasts and top alert of every station."""
    rows, lay = _readings(spark, d)
    events = operational.checked_events(rows, ORDER, lay, drop=ORDER[1:])
    sites = T.site_parameters(spark, d)
    states = operational.accepted_states(events, sites)
    candidates = operational.decision_candidates(events, sites, "persistence", layout=lay)
    alerts = filters.filter_alerts(candidates, filters.FilterRules(), lay).where("status = 'CONFIRMED'")
    # the position tells rows of one time apart, here and in the forecasts' origin
    placed = states.select("source_id", "event_time", F.col("rn").alias("position"), "theta_rz", "depletion_fraction")
    last = audit.newest_rows(placed, ["source_id"], ["event_time", "position"], 1, lay)
    forecasts = FC.fan_out(last, HORIZONS).select("source_id", "event_time", "horizon", F.col("theta_rz").alias("point"))
    out = audit.station_status(placed, forecasts, alerts, ["event_time", "position"], layout=lay)
    return r6(out.select("source_id", "event_time", "theta_rz", "depletion_fraction", "recent_states", "recent_theta", "forecast_origin",
                         F.col("forecast")[168].alias("point_168"), F.size("forecast").alias("horizons"), "alerts",
                         F.col("top_alert.severity").alias("top_severity"), F.col("top_alert.threshold_type").alias("top_type"), F.col("top_alert.time").alias("top_time")))


def stream_replay(spark, d):
    """Second and third of four batches, read again from the ledger after all of them."""
    base = f"{stage_folder(spark)}/replay-{uuid.uuid4().hex}"
    rows = stage(_timed(spark, d).select("event_id", "source_id", "sensor_id", "value"), "to-replay")
    for k in range(4):
        rows.where(F.col("event_id") % 4 == k).write.parquet(f"{base}/in/{k}")
        stream = flows.with_file(flows.file_stream(spark, f"{base}/in/*", rows.schema))
        flows.ledgered(stream, base, f"{base}/state").awaitTermination()
    again = flows.replay(spark, base, rows.schema, 1, 2)
    return r6(again.groupBy("batch", "sensor_id").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("total")))


def stream_rain_24h(spark, d):
    """Values of the day up to every hour, per event type."""
    rows = _timed(spark, d).select(F.col("sensor_id").alias("source_id"), "event_time", "value")
    out = _run_stream(spark, lambda s: flows.rain_24h(s, "40 days"), _with_end(rows), watermark="40 days")
    return r6(out.where("source_id <> 'end'").withColumn("until", F.col("until").cast("timestamp_ntz")))


def _filtered(spark, d, events=None):
    c, lay = _candidates(spark, d, events)
    return filters.filter_alerts(c, filters.FilterRules(), lay)


def alert_key_status(spark, d):
    """Latest status of each alert key; a confirmed one is resolved once its station's last step is quiet."""
    events, _ = _checked(spark, d)
    filtered = stage(_filtered(spark, d, events).select(*filters.KEY, "step", "ord", "status"), "key-status")
    last = events.groupBy("source_id").agg(F.max("step").alias("last_step"))
    return filters.key_status(filtered, last)


def alert_filter_stats(spark, d):
    return filters.filter_stats(_filtered(spark, d))


def assessment_classes(spark, d):
    c, _ = _candidates(spark, d)
    found = D.assessments(c)
    return found.groupBy("classification", "is_quarantined", "requires_operator_review").agg(
        F.count(F.lit(1)).alias("assessments"), F.count_if(F.length("primary_reason") > 0).alias("with_reason"))


def alert_cross_table(spark, d):
    c, _ = _candidates(spark, d)
    return episodes.cross_table(c, "threshold_type", "severity", ["INFO", "WARNING", "CRITICAL"])


def targets_by_time(spark, d):
    """Hourly values with those exactly h hours later."""
    hourly = T.event_hourly(spark, d)
    return r6(series.with_targets_by_time(hourly, "value", HORIZONS, ["source_id"]).drop("readings"))


def forecast_targets(spark, d):
    """The four forecast targets of all states, with their units."""
    states = build_states(T.supplier_series(spark, d), T.site_parameters(spark, d)).where("is_valid")
    out = None
    for name in FC.TARGET_SPECS:
        part = FC.target(states, name).select("source_id", F.lit(name).alias("target"), "unit", "y")
        out = part if out is None else out.unionByName(part)
    return r6(out.groupBy("source_id", "target", "unit").agg(F.count(F.lit(1)).alias("rows"), F.avg("y").alias("mean_y"), F.min("y").alias("least"), F.max("y").alias("most")))


def latest_reading(spark, d):
    """Newest reading per station and sensor."""
    return r6(audit.latest(T.event_readings(spark, d).withColumn("station", F.concat_ws("/", "source_id", "sensor_id")),
                           ["event_time", "event_id", "value"], key="station"))


def experiment_manifest(spark, d):
    """Manifest of the persistence run: windows and metrics of every station."""
    f, lay = _split(spark, d)
    rows, _ = _series(spark, d)
    scores = persistence_walk_forward(rows, ORDER, by=("source_id", "horizon"), layout=lay)
    out = sinks.experiment_manifest(f, scores, "RUN-CHECK", "supplier_series", "1.0.0", "PERSISTENCE_BASELINE", {"fraction": "0.5"}, ["lag_0"], ["scores.parquet"])
    return r6(out.select("manifest_id", "source_id", F.col("train_window.rows").alias("train_rows"), F.col("train_window.end_time").alias("train_end"),
                         F.col("test_window.rows").alias("test_rows"), F.col("test_window.start_time").alias("test_start"), F.size("metrics").alias("horizons"),
                         *[F.col("metrics")[24][m].alias(f"{m}_24") for m in ("mae", "rmse", "coverage")], F.size("artifacts").alias("artifacts"),
                         F.col("params")["fraction"].alias("fraction")))


def interval_ranking(spark, d):
    """Interval methods by how far their coverage is from the nominal one, at each horizon."""
    f, lay = _featured(spark, d, columns=["regime"])
    scores = models.interval_benchmark(f, layout=lay).where("regime IS NULL").withColumn("miss", F.round(F.abs(F.round("coverage", 6) - F.col("nominal")), 6))
    return r6(comparison_table(scores, "miss", ["nominal", "horizon"], "method").select("nominal", "horizon", "method", "rank", "best", "miss", "gap"))


def model_comparison(spark, d):
    """The ladder's models ranked by error at each horizon."""
    return r6(comparison_table(model_ladder(spark, d), "mae").select("horizon", "model", "rank", "best", "mae", "rmse", "gap"))


def seasonal_model_scores(spark, d):
    """Errors of the fitted regression against persistence in each season."""
    f, lay = _featured(spark, d)
    points = models.ladder_points(f.withColumn("season", robustness.season_of()), HORIZONS, (0.0, 0.6), intervals=False, layout=lay, also=["season"])
    return r6(robustness.seasonal_scores(points.where("season IS NOT NULL")))


EXTRA_FEATURES = [Feature("theta_3", "y", 3), Feature("change_12", "y", 12, "change"), Feature("least_7", "y", 6, "min"), Feature("most_7", "y", 6, "max"),
                  Feature("rain_max_10", "precip_mm", 9, "max", 0.0), Feature("air_mean_5", "air_temp_c", 4, "avg"), Feature("sun", "solar_rad_wm2", 0, "value", 0.0)]


def features_compiled(spark, d):
    """Windows that a feature list of its own generates."""
    rows, lay = _series(spark, d)
    series_rows = split_states(rows, ORDER, ["event_time", "theta_rz", "precip_mm", "air_temp_c", "solar_rad_wm2"], layout=lay).withColumn("y", F.col("theta_rz"))
    return r6(compiled(series_rows, EXTRA_FEATURES, layout=lay).select("source_id", "split", "rn", *[f.name for f in EXTRA_FEATURES]))


def unplaced_rows(spark, d):
    """Readings without a station or time, split off with a reason before the others are numbered."""
    rows, lay = _events(spark, d)
    n = F.col("event_id")
    damaged = rows.withColumns({"source_id": F.when(n % 17 != 0, F.col("source_id")), "event_time": F.when(n % 19 != 0, F.col("event_time"))})
    good, bad = placeable(damaged, ["source_id"], ["event_time"])
    placed = index_rows(good, ["source_id"], ["event_time", "event_id"], lay).agg(
        F.lit("placed").alias("outcome"), F.count(F.lit(1)).alias("readings"), F.sum("rn").alias("positions"))
    return placed.unionByName(bad.groupBy(F.col("failure_reason").alias("outcome")).agg(F.count(F.lit(1)).alias("readings"), F.lit(None).cast("long").alias("positions")))


def event_json_read(spark, d):
    """Stored event lines read back: readings per station of the good ones, and the rejected ones."""
    events, rejected = event_json.split_events(_event_lines(spark, d))
    good = event_json.readings(events).groupBy("source_id").agg(
        F.lit("read").alias("outcome"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("total"),
        F.max("event_time").cast("timestamp_ntz").alias("latest"))
    bad = rejected.groupBy(F.get_json_object("value", "$.source_id").alias("source_id")).agg(
        F.lit("rejected").alias("outcome"), F.count(F.lit(1)).alias("rows"), F.lit(None).cast("double").alias("total"), F.lit(None).cast("timestamp_ntz").alias("latest"))
    return r6(good.unionByName(bad))


def stream_late_split(spark, d):
    delay = F.when(F.col("event_id") % 5 == 0, F.expr("interval 3 hours")).otherwise(F.expr("interval 5 minutes"))
    rows = _timed(spark, d).withColumn("ingest_time", F.col("event_time") + delay)

    def build(s):
        good, late = flows.split_late(s, "1 hour")
        return good.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))

    return _run_stream(spark, build, rows.select("event_id", "event_time", "ingest_time")).groupBy("late").agg(
        F.count(F.lit(1)).alias("events"))


ROWS_ONLY = ["forecast_ridge", "model_ladder", "model_ladder_depletion", "model_ladder_topsoil",
             "forecast_hybrid", "oracle_ablation", "site_evaluation", "site_outcomes",
             "cross_site_summary", "model_comparison", "seasonal_model_scores"]


def _utc(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _utc(globals()[name]) for name in [*oracle_sql(), *ROWS_ONLY]}
