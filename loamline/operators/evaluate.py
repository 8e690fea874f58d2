"""Walk-forward scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.water import clip
from loamline.layout import DEFAULT, Layout
from loamline.operators.quantiles import exact_quantiles
from loamline.operators.running import attach
from loamline.operators.series import KEYS, by_horizon

QUANTILES = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}


TIE = 5e-10


def inside(y: Column, low: Column, high: Column) -> Column:
    """Closed-interval test; a value within 5e-10 of an end counts as equal to it."""
    return (y >= low - F.lit(TIE)) & (y <= high + F.lit(TIE))


def skill(mse: Column, reference: Column, floor: float = 0.0) -> Column:
    return F.when(reference > floor, F.lit(1.0) - mse / F.nullif(reference, F.lit(0.0))).otherwise(F.lit(0.0))


def error_metrics(error: str = "error") -> list[Column]:
    e = F.col(error)
    return [
        F.count(e).alias("samples"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("mbe"),
    ]


def interval_metrics(y: str = "y_ahead", low: str = "low", high: str = "high") -> list[Column]:
    hit = inside(F.col(y), F.col(low), F.col(high)).cast("double")
    return [F.avg(hit).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("width")]


def residual_quantiles(pairs: DataFrame, keys: Sequence[str], probs=QUANTILES, layout: Layout = DEFAULT) -> DataFrame:
    """Quantiles of the persistence residual per key."""
    residuals = pairs.withColumn("residual", F.col("y_ahead") - F.col("y"))
    return exact_quantiles(residuals, keys, "residual", probs, layout)


def test_rows_at_most(train_rows: Column, fraction: float) -> Column:
    """Upper bound of the test length when int(n*fraction) rows are train rows."""
    return F.ceil((train_rows + 1) / F.lit(fraction)) - train_rows


def learn_persistence(paired: DataFrame, horizons: Sequence[int], fraction: float, probs: Mapping[str, float],
                      layout: Layout = DEFAULT) -> DataFrame:
    """Per station: residual quantiles of each horizon (map ``spread``) and the train mean, keyed for test rows.

    Horizon 0 stands for the series itself, so one histogram gives the quantiles, the mean and the train length.
    """
    pairs = by_horizon(paired.where("is_train"), horizons, ["source_id", "y"], own="y")
    value = F.when(F.col("horizon") == 0, F.col("y")).otherwise(F.col("y_ahead") - F.col("y"))
    spread = exact_quantiles(pairs.withColumn("residual", value), ["source_id", "horizon"], "residual", probs, layout)
    entry = F.struct("horizon", F.struct("samples", "mean", *probs))
    learnt = spread.groupBy("source_id").agg(F.map_from_entries(F.collect_list(entry)).alias("spread"))
    return learnt.select(
        "source_id",
        F.when(F.col("spread")[0]["samples"] >= 0, F.lit("test")).alias("split"),
        "spread",
        F.col("spread")[0]["mean"].alias("train_mean"),
        test_rows_at_most(F.col("spread")[0]["samples"], fraction).alias("n"),
    )


def score_persistence(
    paired: DataFrame,
    horizons: Sequence[int],
    fraction: float,
    by: Sequence[str],
    bounds: tuple[float, float] = (0.0, 0.6),
    layout: Layout = DEFAULT,
) -> DataFrame:
    """Persistence scored on the test rows with intervals and reference mean learnt on the train rows.

    ``paired`` has source_id, split, is_train, block, y and y_<h>.
    """
    learnt = learn_persistence(paired, horizons, fraction, {"q10": 0.1, "q90": 0.9}, layout)
    test = attach(paired.where(~F.col("is_train")), learnt, KEYS, layout=layout)
    scored = by_horizon(test, horizons, ["source_id", "y", "train_mean"], maps=["spread"]).withColumns(
        {
            "error": F.col("y_ahead") - F.col("y"),
            "low": clip(F.col("y") + F.coalesce(F.col("spread")["q10"], F.lit(0.0)), *bounds),
            "high": clip(F.col("y") + F.coalesce(F.col("spread")["q90"], F.lit(0.0)), *bounds),
            "mean_error": F.col("y_ahead") - F.col("train_mean"),
        }
    )
    out = scored.groupBy(*by).agg(
        *error_metrics(),
        *interval_metrics(),
        F.avg(F.col("mean_error") * F.col("mean_error")).alias("mean_mse"),
    )
    return out.withColumn("skill_vs_mean", skill(F.col("mse"), F.col("mean_mse"))).drop("mean_mse")


def comparison_table(scores: DataFrame, metric: str, by: Sequence[str] = ("horizon",), model: str = "model", ascending: bool = True) -> DataFrame:
    """Scores with each model's ``rank`` by ``metric`` in its group, whether it is the ``best``, and its ``gap`` to the best.

    A group has one row per model, so its window is a handful of rows. Equal scores share a rank; a model without a score comes last.
    """
    order = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    over = Window.partitionBy(*by)
    best = (F.min if ascending else F.max)(metric).over(over)
    return scores.withColumns({"rank": F.rank().over(over.orderBy(order)), "best": F.coalesce(F.col(metric) == best, F.lit(False)), "gap": F.abs(F.col(metric) - best)})
