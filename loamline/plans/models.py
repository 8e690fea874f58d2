"""Model ladder, hybrid, interval benchmark and per-site evaluation, all stations at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.water import clip
from loamline.layout import DEFAULT, Layout
from loamline.operators import ridge
from loamline.operators import uncertainty as U
from loamline.operators.evaluate import inside, skill, test_rows_at_most
from loamline.operators.features import AR_FEATURES, ARX_FEATURES, with_features
from loamline.operators.forecast import ewma, last_train_values
from loamline.operators.quantiles import exact_quantiles
from loamline.operators.running import attach
from loamline.operators.series import KEYS, by_horizon, long_enough
from loamline.plans.walk_forward import split_states
from loamline.schemas import HORIZONS
from loamline.stage import stage, stage_dealt

WEATHER = ["event_time", "precip_mm", "solar_rad_wm2", "air_temp_c"]
# What every plan needs of a series' rows: their place in it and in the layout.
PLACE = ["source_id", "split", "is_train", "rn", "n", "n_all", "block"]
AR, ARX = "M1_AUTOREGRESSIVE", "M2_ENVIRONMENTAL_ARX"
HYBRID_HOURS = 48


def featured_series(rows: DataFrame, order: Sequence[str], target: Column | None = None,
                    horizons: Sequence[int] = HORIZONS, fraction: float = 0.5, oracle: bool = False,
                    layout: Layout = DEFAULT, scored: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Valid states, split, with features and targets; ``y`` is root-zone moisture unless a column is given.

    With ``scored``, series too short to be scored at every horizon are left out, as the experiments do. ``columns`` names those
    that a plan reads beside ``PLACE``, ``y`` and the targets; the written table has only them, where it is given.
    """
    keep = ["theta_rz", "soil_moisture_10cm", *WEATHER]
    series = split_states(rows, order, keep, fraction, layout)
    series = long_enough(series, horizons) if scored else series
    y = target if target is not None else F.col("theta_rz")
    featured = with_features(series.withColumn("y", y), horizons, oracle=oracle, layout=layout)
    if columns is not None:
        featured = featured.select(*PLACE, "y", *[f"y_{h}" for h in horizons], *columns)
    return stage_dealt(featured.drop("core"), "features") if layout.whole else stage(featured.drop("core"), "features")


def map_of(df: DataFrame, key: Column, fields: Sequence[str], name: str) -> DataFrame:
    return df.groupBy("source_id").agg(
        F.map_from_entries(F.collect_list(F.struct(key, F.struct(*fields)))).alias(name)
    )


def per_model(table: DataFrame, models: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """Rows per (station, horizon, model) -> one map per station: horizon -> struct of models."""
    pick = [F.any_value(F.when(F.col("model") == m, F.struct(*fields)), ignoreNulls=True).alias(m) for m in models]
    return map_of(table.groupBy("source_id", "horizon").agg(*pick), F.col("horizon"), models, name)


def for_test_rows(per_source: DataFrame, train_rows: DataFrame, fraction: float) -> DataFrame:
    """Key per-station parameters to the test series (label and an upper bound of its length)."""
    return train_rows.select(
        "source_id",
        F.when(F.col("train_rows") >= 0, F.lit("test")).alias("split"),
        test_rows_at_most(F.col("train_rows"), fraction).alias("n"),
        "train_mean",
    ).join(per_source, "source_id", "left")


def train_summary(featured: DataFrame) -> DataFrame:
    return featured.where("is_train").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("train_rows"), F.avg("y").alias("train_mean")
    )


def vectors(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def in_sample_spread(featured: DataFrame, weights: DataFrame, horizons: Sequence[int], bounds,
                     layout: Layout = DEFAULT) -> DataFrame:
    """10/90 % residual quantiles of each fitted model on its own train rows (unclipped, as fitted)."""
    learnt = per_model(weights, [AR, ARX], ["bias", "weights"], "w")
    train = featured.where("is_train")
    lengths = train.groupBy("source_id").agg(F.max("n").alias("n"), F.max("split").alias("split"))
    rows = attach(train, lengths.join(learnt, "source_id"), KEYS, layout=layout, how="inner")
    pairs = by_horizon(rows, horizons, ["source_id", "y", *ARX_FEATURES], maps=["w"])
    both = []
    for model, names in ((AR, AR_FEATURES), (ARX, ARX_FEATURES)):
        point = ridge.predict(F.col("w")[model], vectors(names), (-1e9, 1e9), F.lit(None).cast("double"))
        both.append(F.struct(F.lit(model).alias("model"), (F.col("y_ahead") - point).alias("residual")))
    # a row without weather has no environmental prediction, but an autoregressive one
    long = pairs.select("source_id", "horizon", F.inline(F.array(*both))).where("residual is not null")
    probs = {"q10": 0.1, "q90": 0.9}
    return exact_quantiles(long, ["source_id", "model", "horizon"], "residual", probs, layout)


def ladder_points(featured: DataFrame, horizons: Sequence[int], bounds, fraction: float = 0.5, level: float = 0.25,
                  intervals: bool = True, layout: Layout = DEFAULT, also: Sequence[str] = ()) -> DataFrame:
    """Test rows per horizon with the point of every model (and its 80 % interval); ``also`` names further columns to keep."""
    weights = stage(ridge.fit(featured, horizons, level), "weights")
    learnt = per_model(weights, [AR, ARX], ["bias", "weights"], "w")
    if intervals:
        residual = U.residual_counts(featured, horizons, layout=layout)
        b0 = exact_quantiles(residual, ["source_id", "horizon"], "residual", {"q10": 0.1, "q90": 0.9}, layout, None,
                             "weight").withColumn("model", F.lit("B0_PERSISTENCE"))
        own = in_sample_spread(featured, weights, horizons, bounds, layout)
        spread = b0.unionByName(own)
        learnt = learnt.join(
            per_model(spread, ["B0_PERSISTENCE", AR, ARX], ["q10", "q90"], "spread"), "source_id", "full",
        )
    params = for_test_rows(learnt, train_summary(featured), fraction)
    level_rows = ewma(featured.where(~F.col("is_train")) if layout.whole else featured, 0.15, bounds=bounds, seeds=last_train_values(featured), layout=layout)
    test = attach(level_rows.where(~F.col("is_train")).withColumnRenamed("point", "ewma"), params, KEYS, layout=layout)
    keep = ["source_id", "y", "ewma", "train_mean", "regime", *ARX_FEATURES, *also]
    pairs = by_horizon(test, horizons, keep, maps=["w", *(["spread"] if intervals else [])])
    at = lambda model: F.col("w")[model]
    return pairs.withColumns({
        "B0_PERSISTENCE": F.col("y"),
        "B1_CLIMATOLOGY": clip(F.col("train_mean"), *bounds),
        "B2_EWMA": F.col("ewma"),
        AR: ridge.predict(at(AR), vectors(AR_FEATURES), bounds, F.col("y")),
        ARX: ridge.predict(at(ARX), vectors(ARX_FEATURES), bounds, F.col("y")),
    }).withColumn("HYBRID", F.when(F.col("horizon") <= HYBRID_HOURS, F.col(ARX)).otherwise(F.col(AR)))


LADDER = ["B0_PERSISTENCE", "B1_CLIMATOLOGY", "B2_EWMA", AR, ARX]


def model_ladder(featured: DataFrame, horizons: Sequence[int] = HORIZONS, bounds=(0.0, 0.6), fraction: float = 0.5,
                 level: float = 0.25, by: Sequence[str] = ("horizon",), layout: Layout = DEFAULT) -> DataFrame:
    """Errors, skills, coverage and width of every model: one aggregate over columns, then a small unpivot."""
    points = ladder_points(featured, horizons, bounds, fraction, level, layout=layout)
    own_spread = {AR: AR, ARX: ARX}
    aggs = [F.count(F.lit(1)).alias("samples"),
            F.avg((F.col("y_ahead") - F.col("train_mean")) ** 2).alias("ref_mean")]
    for m in LADDER:
        e = F.col("y_ahead") - F.col(m)
        s = F.col("spread")[own_spread.get(m, "B0_PERSISTENCE")]
        low = clip(F.col(m) + F.coalesce(s["q10"], F.lit(0.0)), *bounds)
        high = clip(F.col(m) + F.coalesce(s["q90"], F.lit(0.0)), *bounds)
        aggs += [
            F.avg(F.abs(e)).alias(f"mae_{m}"), F.avg(e * e).alias(f"mse_{m}"), F.avg(e).alias(f"mbe_{m}"),
            F.avg(inside(F.col("y_ahead"), low, high).cast("double")).alias(f"cov_{m}"),
            F.avg(high - low).alias(f"wid_{m}"),
        ]
    wide = points.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(m).alias("model"), F.col(f"mae_{m}").alias("mae"), F.col(f"mse_{m}").alias("mse"),
        F.sqrt(f"mse_{m}").alias("rmse"), F.col(f"mbe_{m}").alias("mbe"),
        skill(F.col(f"mse_{m}"), F.col("mse_B0_PERSISTENCE")).alias("skill_vs_persistence"),
        skill(F.col(f"mse_{m}"), F.col("ref_mean")).alias("skill_vs_climatology"),
        F.col(f"cov_{m}").alias("coverage"), F.col(f"wid_{m}").alias("width"),
    ) for m in LADDER])
    return wide.select(*by, "samples", F.inline(rows))


def hybrid_table(featured: DataFrame, horizons: Sequence[int] = HORIZONS, bounds=(0.0, 0.6), fraction: float = 0.5,
                 layout: Layout = DEFAULT) -> DataFrame:
    """Horizon-partitioned hybrid against persistence."""
    p = ladder_points(featured, horizons, bounds, fraction, intervals=False, layout=layout)
    e, b = F.col("y_ahead") - F.col("HYBRID"), F.col("y_ahead") - F.col("y")
    out = p.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("samples"), F.avg(F.abs(e)).alias("mae_hybrid"),
        F.sqrt(F.avg(e * e)).alias("rmse_hybrid"), F.avg(e).alias("mbe_hybrid"),
        F.avg(F.abs(b)).alias("mae_persistence"), F.sqrt(F.avg(b * b)).alias("rmse_persistence"),
        (F.lit(1.0) - F.avg(e * e) / F.greatest(F.avg(b * b), F.lit(1e-12))).alias("skill"),
    )
    return out.withColumn("assigned_model", F.when(F.col("horizon") <= HYBRID_HOURS, ARX).otherwise(AR))


def oracle_ablation(featured: DataFrame, horizons: Sequence[int] = HORIZONS, bounds=(0.0, 0.6), fraction: float = 0.5,
                    layout: Layout = DEFAULT) -> DataFrame:
    """What perfect future rain would be worth. ``featured`` must carry the oracle columns."""
    weights = ridge.fit(featured, horizons, oracle=True)
    learnt = per_model(weights, [ARX, ridge.ORACLE], ["bias", "weights"], "w")
    params = for_test_rows(learnt, train_summary(featured), fraction)
    test = attach(featured.where(~F.col("is_train")), params, KEYS, layout=layout)
    rain = F.map_from_arrays(F.array(*[F.lit(h) for h in horizons]), F.array(*[f"oracle_rain_{h}" for h in horizons]))
    pairs = by_horizon(test.withColumn("oracle", rain), horizons, ["y", *ARX_FEATURES], maps=["w", "oracle"])
    at = lambda model: F.col("w")[model]
    arx = ridge.predict(at(ARX), vectors(ARX_FEATURES), bounds, F.col("y"))
    best = ridge.predict(at(ridge.ORACLE), [*vectors(ARX_FEATURES), F.col("oracle")], bounds,
                         F.col("y"))
    scored = pairs.select("horizon", *[
        ((F.col("y_ahead") - c) ** 2).alias(n) for n, c in (("b", F.col("y")), ("m", arx), ("o", best))
    ])
    base = F.greatest(F.avg("b"), F.lit(1e-12))
    return scored.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("samples"), F.sqrt(F.avg("b")).alias("rmse_persistence"),
        F.sqrt(F.avg("m")).alias("rmse_past"), F.sqrt(F.avg("o")).alias("rmse_oracle"),
        (F.lit(1.0) - F.avg("m") / base).alias("skill_past"), (F.lit(1.0) - F.avg("o") / base).alias("skill_oracle"),
    )


METHODS = ["U0_STATIC_QUANTILES", "U1_HORIZON_DISPERSION_MAD", "U2_REGIME_CONDITIONED", "U3_POWER_LAW_DISPERSION"]


def interval_params(featured: DataFrame, horizons: Sequence[int], coverages: Sequence[float], fraction: float,
                    layout: Layout = DEFAULT, methods: Sequence[str] = METHODS) -> DataFrame:
    """Parameters of the wanted calibrators, one row per station keyed to its test series."""
    residuals = U.residual_counts(featured, horizons, ["regime"], layout)
    r = None if layout.whole else U.ranked(residuals, layout)
    fitted = stage(U.fit_groups(residuals, coverages, layout) if layout.whole else U.fit_all(r, coverages), "fitted")
    whole = fitted.where(F.col("regime") == U.ALL)
    names = list(U.interval_probs(coverages))
    out = None
    parts = []
    if METHODS[0] in methods:
        parts.append(map_of(whole, F.col("horizon"), names, "u0"))
    if METHODS[1] in methods:
        spread = U.fit_dispersion(residuals, layout) if layout.whole else U.dispersion_of(r, fitted)
        parts.append(map_of(spread, F.col("horizon"), ["bias", "scale"], "u1"))
    if METHODS[2] in methods:
        entry = F.struct("regime", F.struct(*names))
        regimes = fitted.groupBy("source_id", "horizon").agg(F.map_from_entries(F.collect_list(entry)).alias("by_regime"))
        parts.append(map_of(regimes, F.col("horizon"), ["by_regime"], "u2"))
    if METHODS[3] in methods:
        parts.append(U.power_law_of(whole))
    for part in parts:
        out = part if out is None else out.join(part, "source_id", "full")
    return for_test_rows(out, train_summary(featured), fraction)


def method_interval(method: str, point: Column, coverage: float, bounds) -> tuple[Column, Column]:
    h = F.col("horizon")
    if method == METHODS[0]:
        return U.static_interval(point, F.col("u0"), coverage, bounds)
    if method == METHODS[1]:
        return U.dispersion_interval(point, F.col("u1"), coverage, bounds)
    if method == METHODS[2]:
        return U.regime_interval(point, F.col("own_regime"), F.col("any_regime"), coverage, bounds)
    return U.power_interval(point, F.col("sigma_1"), F.col("nu"), h, coverage, bounds)


def interval_pairs(test: DataFrame, horizons: Sequence[int], keep: Sequence[str], methods: Sequence[str],
                   maps: Sequence[str] = ()) -> DataFrame:
    """Origin/horizon rows of the test series with each method's parameters looked up once."""
    own = {METHODS[0]: "u0", METHODS[1]: "u1", METHODS[2]: "u2"}
    power = ["sigma_1", "nu"] if METHODS[3] in methods else []
    pairs = by_horizon(test, horizons, [*keep, *power], maps=[*maps, *[own[m] for m in methods if m in own]])
    if METHODS[2] not in methods:
        return pairs
    regimes = F.col("u2")["by_regime"]
    return pairs.withColumns({"own_regime": regimes[F.col("regime")], "any_regime": regimes["ALL"]}).drop("u2")


def interval_benchmark(featured: DataFrame, horizons: Sequence[int] = HORIZONS, coverages: Sequence[float] = (0.8, 0.9),
                       bounds=(0.0, 0.6), fraction: float = 0.5, layout: Layout = DEFAULT,
                       methods: Sequence[str] = METHODS) -> DataFrame:
    """Coverage and width per method, nominal coverage and horizon, overall (regime null) and per origin regime."""
    params = interval_params(featured, horizons, coverages, fraction, layout, methods)
    test = attach(featured.where(~F.col("is_train")), params, KEYS, layout=layout)
    pairs = interval_pairs(test, horizons, ["y", "regime"], methods)
    aggs, cells = [F.count(F.lit(1)).alias("k")], []
    for i, m in enumerate(methods):
        for j, c in enumerate(coverages):
            low, high = method_interval(m, F.col("y"), c, bounds)
            aggs.append(F.sum(inside(F.col("y_ahead"), low, high).cast("long")).alias(f"hit_{i}_{j}"))
            aggs.append(F.sum(F.greatest(F.lit(0.0), high - low)).alias(f"wid_{i}_{j}"))
            cells.append(F.struct(F.lit(m).alias("method"), F.lit(c).alias("nominal"),
                                  F.col(f"hit_{i}_{j}").alias("hit"), F.col(f"wid_{i}_{j}").alias("wid")))
    small = pairs.groupBy("horizon", "regime").agg(*aggs).select("horizon", "regime", "k", F.inline(F.array(*cells)))
    key = [F.col("method"), F.col("nominal"), F.col("horizon")]
    return small.groupingSets([key, [*key, F.col("regime")]], *key, F.col("regime")).agg(
        F.sum("k").alias("samples"),
        (F.sum("hit") / F.sum("k")).alias("coverage"),
        (F.sum("wid") / F.sum("k")).alias("width"),
    )


def site_evaluation(featured: DataFrame, horizons: Sequence[int] = HORIZONS, bounds=(0.0, 0.6), fraction: float = 0.5,
                    layout: Layout = DEFAULT) -> DataFrame:
    """Per station and horizon: persistence, both regressions, the hybrid, and U0/U2 interval quality."""
    use = [METHODS[0], METHODS[2]]
    weights = per_model(ridge.fit(featured, horizons), [AR, ARX], ["bias", "weights"], "w")
    params = interval_params(featured, horizons, [0.8], fraction, layout, use).join(weights, "source_id", "left")
    test = attach(featured.where(~F.col("is_train")), params, KEYS, layout=layout)
    pairs = interval_pairs(test, horizons, ["source_id", "y", "regime", *ARX_FEATURES], use, maps=["w"])
    at = lambda model: F.col("w")[model]
    pairs = pairs.withColumns({
        "m1": ridge.predict(at(AR), vectors(AR_FEATURES), bounds, F.col("y")),
        "m2": ridge.predict(at(ARX), vectors(ARX_FEATURES), bounds, F.col("y")),
    }).withColumn("hybrid", F.when(F.col("horizon") <= HYBRID_HOURS, F.col("m2")).otherwise(F.col("m1")))
    low0, high0 = method_interval(use[0], F.col("y"), 0.8, bounds)
    low2, high2 = method_interval(use[1], F.col("hybrid"), 0.8, bounds)
    wet = F.col("regime") == "WET_ANTECEDENT"
    hit2 = inside(F.col("y_ahead"), low2, high2).cast("double")
    errors = {"b0": F.col("y"), "m1": F.col("m1"), "m2": F.col("m2"), "hybrid": F.col("hybrid")}
    aggs = [F.count(F.lit(1)).alias("samples"), F.avg(F.col("y_ahead") - F.col("y")).alias("b0_mbe")]
    for name, c in errors.items():
        e = F.col("y_ahead") - c
        aggs += [F.avg(F.abs(e)).alias(f"{name}_mae"), F.avg(e * e).alias(f"{name}_mse")]
    aggs += [
        F.avg(inside(F.col("y_ahead"), low0, high0).cast("double")).alias("u0_coverage"),
        F.avg(high0 - low0).alias("u0_width"),
        F.avg(hit2).alias("u2_coverage"),
        F.avg(high2 - low2).alias("u2_width"),
        F.avg(F.when(wet, hit2)).alias("_wet"), F.count_if(wet).alias("_n_wet"),
        F.avg(F.when(~wet, hit2)).alias("_dry"), F.count_if(~wet).alias("_n_dry"),
    ]
    out = pairs.groupBy("source_id", "horizon").agg(*aggs)
    scores = {}
    for name in ("m1", "m2", "hybrid"):
        scores[f"{name}_mae_skill"] = skill(F.col(f"{name}_mae"), F.col("b0_mae"), 1e-7)
        scores[f"{name}_mse_skill"] = skill(F.col(f"{name}_mse"), F.col("b0_mse"), 1e-10)
    for name in errors:
        scores[f"{name}_rmse"] = F.sqrt(f"{name}_mse")
    scores["u2_wet_coverage"] = F.when(F.col("_n_wet") > 10, F.col("_wet")).otherwise(F.col("u2_coverage"))
    scores["u2_dry_coverage"] = F.when(F.col("_n_dry") > 10, F.col("_dry")).otherwise(F.col("u2_coverage"))
    return out.withColumns(scores).drop("_wet", "_n_wet", "_dry", "_n_dry")


def site_outcomes(sites: DataFrame, skill_column: str = "m2_mse_skill", hybrid_column: str = "hybrid_mse_skill") -> DataFrame:
    """Outcome class of each station from its mean skill over horizons up to 48 h."""
    mean = F.coalesce(F.avg(F.when(F.col("horizon") <= HYBRID_HOURS, F.col(skill_column))), F.lit(0.0))
    out = sites.groupBy("source_id").agg(mean.alias("mean_skill"), F.avg(hybrid_column).alias("mean_hybrid_skill"))
    return out.withColumn(
        "outcome",
        F.when(F.col("mean_skill") > 0.02, "PARTIALLY_SUPPORTED")
        .when(F.col("mean_skill") >= -0.05, "MARGINALLY_STABLE")
        .otherwise("DEGRADED"),
    )


def cross_site_summary(sites: DataFrame, outcomes: DataFrame, skill_column: str = "m2_mse_skill",
                       coverage: str = "u2_coverage") -> DataFrame:
    """One row: stations per outcome, mean skills and coverage at chosen horizons."""
    at = lambda h, c: F.avg(F.when(F.col("horizon") == h, F.col(c)))
    left = outcomes.agg(
        F.count(F.lit(1)).alias("stations"),
        *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in
          ("PARTIALLY_SUPPORTED", "MARGINALLY_STABLE", "DEGRADED")],
        F.avg("mean_skill").alias("mean_skill"),
    )
    right = sites.agg(*[at(h, skill_column).alias(f"skill_{h}h") for h in (1, 6, 24)],
                      *[at(h, coverage).alias(f"coverage_{h}h") for h in (6, 24)])
    return left.withColumn("_k", F.lit(1)).join(right.withColumn("_k", F.lit(1)), "_k").drop("_k")
