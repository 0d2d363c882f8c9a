"""Distributed stability models: a boosted-tree classifier and margin regressor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .aggregates import latest
from .boosting import BoostedTrees, Spec, fit_boosted
from .rules import health_score, stability_label


def scale_features(df: DataFrame, cols: Sequence[str], population: bool = True) -> DataFrame:
    """Zero mean and unit deviation; the population deviation unless told otherwise."""
    std = F.stddev_pop if population else F.stddev_samp
    stats = df.agg(*[F.avg(c).alias(f"{c}_m") for c in cols], *[std(c).alias(f"{c}_s") for c in cols])
    return df.withColumns(
        {c: (F.col(c) - stats.select(f"{c}_m").scalar()) / stats.select(f"{c}_s").scalar() for c in cols}
    )


def fit_classifier(
    train: DataFrame, features: Sequence[str], label: str, trees: int = 200, depth: int = 6, rate: float = 0.1,
    row_share: float = 0.8, column_share: float = 0.8, seed: int = 42,
) -> BoostedTrees:
    """Boosted classifier of the boolean or 0/1 `label`. Trees split a scaled feature where they split the feature, so nothing is scaled."""
    return fit_boosted(train, features, [Spec(label, "logistic", depth, trees, rate, row_share, column_share, seed=seed)])[0]


def fit_regressor(
    train: DataFrame, features: Sequence[str], target: str, trees: int = 200, depth: int = 5, rate: float = 0.1,
    seed: int = 42,
) -> BoostedTrees:
    return fit_boosted(train, features, [Spec(target, "squared", depth, trees, rate, seed=seed)])[0]


def fit_models(
    train: DataFrame, features: Sequence[str], label: str, target: str, classifier_depth: int = 6,
    regressor_depth: int = 5, trees: int = 200, rate: float = 0.1, row_share: float = 0.8, column_share: float = 0.8,
    seed: int = 42,
) -> tuple[BoostedTrees, BoostedTrees]:
    """Classifier and regressor over the same binned rows and in the same jobs."""
    specs = [Spec(label, "logistic", classifier_depth, trees, rate, row_share, column_share, seed=seed),
             Spec(target, "squared", regressor_depth, trees, rate, seed=seed)]
    classifier, regressor = fit_boosted(train, features, specs)
    return classifier, regressor


def predict_batch(df: DataFrame, classifier: BoostedTrees, regressor: BoostedTrees | None,
                  features: Sequence[str]) -> DataFrame:
    """Add probability, label, margin and health; works on batch and streaming rows. `features` are those of the models."""
    spark = df.sparkSession
    if list(features) != classifier.features:
        raise ValueError(f"the model was fitted on {classifier.features}")
    margin = F.lit(None).cast("double") if regressor is None else regressor.margin_column(spark)
    out = df.select("*", (1 / (1 + F.exp(-classifier.margin_column(spark)))).alias("pred_prob_unstable"), margin.alias("pred_stab_score"))
    p = F.col("pred_prob_unstable")
    out = out.withColumns({"pred_label": stability_label(p), "pred_health_score": health_score(p)})
    return out.select(*df.columns, "pred_prob_unstable", "pred_label", "pred_stab_score", "pred_health_score")


def evaluate(pred: DataFrame, label: str, target: str) -> DataFrame:
    """Accuracy of the label and mean absolute error of the margin."""
    hit = (F.col("pred_label") == F.when(F.col(label), "unstable").otherwise("stable")).cast("double")
    return pred.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"),
                    F.avg(F.abs(F.col("pred_stab_score") - F.col(target))).alias("mae"))


def score_latest(df: DataFrame, keys: Sequence[str], ts: str, tie: str, classifier: BoostedTrees,
                 regressor: BoostedTrees | None, features: Sequence[str]) -> DataFrame:
    """Score the newest row per key; only those rows reach the model."""
    newest = latest(df, keys, ts, tie, list(features))
    return predict_batch(newest, classifier, regressor, features)


def save_model(model: BoostedTrees, spark: SparkSession, path: str) -> None:
    model.save(spark, path)


def load_model(spark: SparkSession, path: str) -> BoostedTrees:
    return BoostedTrees.load(spark, path)
