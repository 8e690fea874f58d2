"""Prediction intervals learnt from train residuals, and exceedance probabilities.

All calibrators read the same residual histogram (``residual_counts``). Their parameters are one small row per station, repeated per block where they are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.water import clip
from loamline.layout import DEFAULT, Layout
from loamline.operators.quantiles import exact_quantiles, whole_quantiles, with_median
from loamline.operators.ranks import ALL, Ranks, median_deviation, quantiles, ranks
from loamline.operators.series import by_horizon

# Two-sided normal critical values.
Z_VALUES = {0.8: 1.28155, 0.9: 1.64485, 0.95: 1.95996}
MIN_REGIME_ROWS = 20
POWER_DEFAULT = (0.0018, 0.45)
MIN_POWER_ROWS = 20
MIN_POWER_HORIZONS = 3


def z_value(coverage: float) -> float:
    return Z_VALUES.get(coverage) or NormalDist().inv_cdf(1.0 - (1.0 - coverage) / 2.0)


def residual_counts(featured: DataFrame, horizons: Sequence[int], keep: Sequence[str] = (), layout: Layout = DEFAULT) -> DataFrame:
    """Persistence residuals y(t+h)-y(t) of the train rows as value counts: ``residual`` occurs ``weight`` times. In a ``whole`` layout
    rows stay where they are and each counts once."""
    pairs = by_horizon(featured.where("is_train"), horizons, ["source_id", "y", *keep])
    residual = pairs.withColumn("residual", F.col("y_ahead") - F.col("y")).where(F.col("residual").isNotNull())
    if layout.whole:
        return residual.select("source_id", "horizon", *keep, "residual", F.lit(1).cast("long").alias("weight"))
    return residual.groupBy("source_id", "horizon", *keep, "residual").agg(F.count(F.lit(1)).alias("weight"))


def weighted_std() -> Column:
    """Population deviation of weighted residuals (their mean is near zero, so the difference does not cancel)."""
    n = F.sum("weight")
    mean = F.sum(F.col("residual") * F.col("weight")) / n
    square = F.sum(F.col("residual") * F.col("residual") * F.col("weight")) / n
    return F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))


KEY = ["source_id", "horizon"]


def residual_stats(residuals: DataFrame, probs: dict[str, float], layout: Layout = DEFAULT) -> DataFrame:
    """Per station and horizon: count, mean, population deviation and quantiles."""
    moments = residuals.groupBy(*KEY).agg(weighted_std().alias("std"))
    return exact_quantiles(residuals, KEY, "residual", probs, layout, weight="weight").join(moments, KEY)


def interval_probs(coverages: Sequence[float]) -> dict[str, float]:
    probs = {}
    for c in coverages:
        alpha = 1.0 - c
        probs[f"lo_{round(c * 100)}"] = alpha / 2.0
        probs[f"hi_{round(c * 100)}"] = 1.0 - alpha / 2.0
    return probs


def fit_static(residuals: DataFrame, coverages: Sequence[float], layout: Layout = DEFAULT) -> DataFrame:
    """U0: central residual quantiles per horizon."""
    return exact_quantiles(residuals, KEY, "residual", interval_probs(coverages), layout, weight="weight")


def fit_dispersion(residuals: DataFrame, layout: Layout = DEFAULT, use_mad: bool = True) -> DataFrame:
    """U1: median ``bias`` and ``scale`` (1.4826 x median absolute deviation, or population deviation), floor 1e-5."""
    if layout.whole and use_mad:
        used = residuals.select(*KEY, "residual", "weight")
        deviations = with_median(used, KEY, "residual", "bias", "weight").withColumn("dev", F.abs(F.col("residual") - F.col("bias")))
        mad = exact_quantiles(deviations, [*KEY, "bias"], "dev", {"mad": 0.5}, layout, weight="weight")
        return mad.select(*KEY, "bias", F.greatest(F.lit(1e-5), F.lit(1.4826) * F.col("mad")).alias("scale"))
    center = exact_quantiles(residuals, KEY, "residual", {"bias": 0.5}, layout, weight="weight").select(*KEY, "bias")
    if not use_mad:
        spread = residuals.groupBy(*KEY).agg(weighted_std().alias("spread"))
        return center.join(spread, KEY).select(*KEY, "bias", F.greatest(F.lit(1e-5), "spread").alias("scale"))
    salted = residuals.withColumn("_salt", F.pmod(F.xxhash64("residual"), F.lit(16)).cast("int"))
    copies = center.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    deviations = salted.join(copies, [*KEY, "_salt"]).withColumn("dev", F.abs(F.col("residual") - F.col("bias")))
    mad = exact_quantiles(deviations, [*KEY, "bias"], "dev", {"mad": 0.5}, layout, weight="weight")
    return mad.select(*KEY, "bias", F.greatest(F.lit(1e-5), F.lit(1.4826) * F.col("mad")).alias("scale"))


def fit_regimes(residuals: DataFrame, coverages: Sequence[float], layout: Layout = DEFAULT) -> DataFrame:
    """U2: quantiles per origin regime with at least 20 rows, and over all regimes (``ALL``) as the fallback."""
    both = residuals.withColumn("regime", F.explode(F.array(F.col("regime"), F.lit("ALL"))))
    q = exact_quantiles(both, [*KEY, "regime"], "residual", interval_probs(coverages), layout, weight="weight")
    return q.where((F.col("regime") == "ALL") | (F.col("samples") >= MIN_REGIME_ROWS))


def fit_power_law(residuals: DataFrame) -> DataFrame:
    """U3: sigma(h) = sigma_1 * h^nu by least squares on logs over horizons with more than 20 residuals."""
    return power_law_of(residuals.groupBy(*KEY).agg(weighted_std().alias("std"), F.sum("weight").alias("samples")))


def ranked(residuals: DataFrame, layout: Layout = DEFAULT) -> Ranks:
    """The residuals (source_id, horizon, regime, residual, weight) in the order that all calibrators below share."""
    return ranks(residuals, KEY, "residual", "weight", "regime", layout)


def fit_all(r: Ranks, coverages: Sequence[float]) -> DataFrame:
    """Quantiles per horizon and regime for U0 (group ALL) and U2 (regimes of enough rows, and ALL), with the median and deviation."""
    q = quantiles(r, {**interval_probs(coverages), "bias": 0.5})
    return q.where((F.col("group") == ALL) | (F.col("samples") >= MIN_REGIME_ROWS)).withColumnRenamed("group", "regime")


def fit_groups(residuals: DataFrame, coverages: Sequence[float], layout: Layout) -> DataFrame:
    """As ``fit_all``, of residuals (source_id, horizon, regime, residual, weight) in a ``whole`` layout, where no ranks are written."""
    known = residuals.where(F.col("regime").isNotNull())
    both = known.withColumn("regime", F.explode(F.array(F.col("regime"), F.lit(ALL))))
    q = whole_quantiles(both, [*KEY, "regime"], "residual", interval_probs(coverages), "weight", std=True)
    return q.where((F.col("regime") == ALL) | (F.col("samples") >= MIN_REGIME_ROWS))


def dispersion_of(r: Ranks, fitted: DataFrame) -> DataFrame:
    """U1 from ``fit_all``: median ``bias`` and ``scale``, as ``fit_dispersion``."""
    mad = median_deviation(r, fitted.where(F.col("regime") == ALL))
    return mad.select(*KEY, "bias", F.greatest(F.lit(1e-5), F.lit(1.4826) * F.col("mad")).alias("scale"))


def power_law_of(per_horizon: DataFrame) -> DataFrame:
    """U3 from rows (source_id, horizon, std, samples)."""
    x, y = F.ln("horizon"), F.ln(F.greatest(F.lit(1e-5), F.col("std")))
    used = F.col("samples") > MIN_POWER_ROWS
    fit = per_horizon.groupBy("source_id").agg(
        F.count_if(used).alias("_h"),
        F.regr_slope(F.when(used, y), F.when(used, x)).alias("_nu"),
        F.regr_intercept(F.when(used, y), F.when(used, x)).alias("_a"),
    )
    enough = F.col("_h") >= MIN_POWER_HORIZONS
    return fit.select(
        "source_id",
        F.when(enough, F.exp("_a")).otherwise(F.lit(POWER_DEFAULT[0])).alias("sigma_1"),
        F.when(enough, F.col("_nu")).otherwise(F.lit(POWER_DEFAULT[1])).alias("nu"),
    )


def static_interval(point: Column, p: Column, coverage: float, bounds) -> tuple[Column, Column]:
    c = round(coverage * 100)
    return (
        clip(point + F.coalesce(p[f"lo_{c}"], F.lit(0.0)), *bounds),
        clip(point + F.coalesce(p[f"hi_{c}"], F.lit(0.0)), *bounds),
    )


def dispersion_interval(point: Column, p: Column, coverage: float, bounds) -> tuple[Column, Column]:
    z = F.lit(z_value(coverage))
    center = point + F.coalesce(p["bias"], F.lit(0.0))
    scale = F.coalesce(p["scale"], F.lit(0.01))
    return clip(center - z * scale, *bounds), clip(center + z * scale, *bounds)


def regime_interval(point: Column, by_regime: Column, everywhere: Column, coverage: float, bounds):
    c = round(coverage * 100)
    lo = F.coalesce(by_regime[f"lo_{c}"], everywhere[f"lo_{c}"], F.lit(0.0))
    hi = F.coalesce(by_regime[f"hi_{c}"], everywhere[f"hi_{c}"], F.lit(0.0))
    return clip(point + lo, *bounds), clip(point + hi, *bounds)


def power_interval(point: Column, sigma_1: Column, nu: Column, horizon: Column, coverage: float, bounds):
    sigma = F.coalesce(sigma_1, F.lit(POWER_DEFAULT[0])) * F.pow(horizon, F.coalesce(nu, F.lit(POWER_DEFAULT[1])))
    z = F.lit(z_value(coverage))
    return clip(point - z * sigma, *bounds), clip(point + z * sigma, *bounds)


def exceedance(residuals: DataFrame, queries: DataFrame, threshold: float, layout: Layout = DEFAULT, digits: int | None = 12) -> DataFrame:
    """P(point + residual >= threshold) for each query row (source_id, horizon, point, ...), exactly.

    The gaps threshold - point and the counted residuals are merged bucket by bucket, each query carried along in its place, so
    nothing is joined by value. Values are told apart to ``digits`` decimals (None: to the last bit). Without residuals, or
    without a key or point, the answer is 1 or 0 by the point itself.
    """
    exactly = lambda c: F.round(c, digits) if digits is not None else c
    bucket = F.floor(F.col("_v") / F.lit(layout.value_width)).cast("long")
    carried = [c for c in queries.columns if c not in KEY]
    asked = queries.select(*KEY, F.struct(*carried).alias("_row"), exactly(F.lit(threshold) - F.col("point")).alias("_v"), F.lit(0).cast("long").alias("_c"))
    known = residuals.where(F.col("residual").isNotNull()).select(*KEY, exactly(F.col("residual")).alias("_v"), F.col("weight").cast("long").alias("_c"))
    line = asked.unionByName(known, allowMissingColumns=True).withColumn("_b", bucket).withColumn("_kind", F.col("_row").isNull().cast("int"))
    by_bucket = Window.partitionBy(*KEY).orderBy("_b")
    totals = line.groupBy(*KEY, "_b").agg(F.sum("_c").alias("_bc")).select(
        *KEY, "_b", (F.sum("_bc").over(by_bucket) - F.col("_bc")).alias("_before"), F.sum("_bc").over(Window.partitionBy(*KEY)).alias("_all"))
    # A gap sorts before equal residuals, so the count before it is of strictly smaller residuals.
    inside = Window.partitionBy(*KEY, "_b").orderBy("_v", "_kind")
    merged = line.withColumn("_run", F.sum("_c").over(inside)).join(totals.hint("merge"), [*KEY, "_b"], "left").where("_kind = 0")
    back = [F.col(c) if c in KEY else F.col("_row")[c].alias(c) for c in queries.columns]
    return merged.select(*back, _chance(F.col("_before") + F.col("_run"), F.col("_row")["point"], threshold).alias("exceedance"))


def _chance(below: Column, point: Column, threshold: float) -> Column:
    p = F.when(F.col("_all") > 0, (F.col("_all") - below) / F.nullif(F.col("_all"), F.lit(0)))
    return F.coalesce(p, F.when(point >= threshold, 1.0).otherwise(0.0))


def exceedance_in_place(pairs: DataFrame, threshold: float, digits: int | None = 12) -> DataFrame:
    """The test rows of origin/horizon pairs (source_id, horizon, is_train, y, y_ahead, ...) with ``exceedance`` of persistence, as ``exceedance``
    gives it from the residuals of the train rows. A key's rows are merged in one task, where they lie (a ``whole`` layout)."""
    exactly = lambda c: F.round(c, digits) if digits is not None else c
    train, residual = F.col("is_train"), F.col("y_ahead") - F.col("y")
    line = pairs.where(~train | residual.isNotNull()).withColumns({
        "_v": exactly(F.when(train, residual).otherwise(F.lit(threshold) - F.col("y"))), "_c": F.when(train, 1).otherwise(0).cast("long")})
    over = Window.partitionBy(*KEY)
    # A gap sorts before equal residuals, so the count before it is of strictly smaller residuals.
    so_far = over.orderBy("_v", "is_train").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = line.withColumns({"_run": F.sum("_c").over(so_far), "_all": F.sum("_c").over(over)}).where(~train)
    known = merged.withColumn("_all", F.when(F.col("source_id").isNotNull() & F.col("_v").isNotNull(), F.col("_all")))
    return known.withColumn("exceedance", _chance(F.col("_run"), F.col("y"), threshold)).drop("y_ahead", "_v", "_c", "_run", "_all")
