"""Models: scaling, boosted trees, isolation forest, contributions."""

from pyspark.sql import functions as F

from ..operators import attribution, forest, stability
from ..operators.sampling import stratified_split
from ..session import work_path
from ..sources.bindings import FEATURES, feat
from . import query


def labelled(spark, d):
    margin = (F.col("l_discount") - F.col("l_tax")).alias("margin")
    return feat(spark, d).select("row_id", *FEATURES, "unstable", "grp", "ts", margin)


# Fitted once per session and input, and shared by the queries below.
_fitted: dict[tuple[str, str, str], object] = {}


def _once(kind, spark, d, build):
    key = (kind, spark.sparkContext.applicationId, d)
    if key not in _fitted:
        _fitted[key] = build()
    return _fitted[key]


def models(spark, d):
    """The split rows, the classifier and the regressor."""

    def build():
        parts = stratified_split(labelled(spark, d), "unstable", "row_id")  # its rows are stored
        train = parts.filter("part = 'train'")
        return parts, *stability.fit_models(train, FEATURES, "unstable", "margin")

    return _once("models", spark, d, build)


def fitted_forest(spark, d):
    return _once("forest", spark, d, lambda: forest.fit_forest(labelled(spark, d), "row_id", FEATURES))


@query(
    "l01_scale_features",
    "SELECT row_id, " + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM feat)) / (SELECT stddev_pop({c}) FROM feat), 4) AS {c}" for c in FEATURES)
    + " FROM feat",
    views="feat",
)
def scale_features(spark, d):
    out = stability.scale_features(feat(spark, d).select("row_id", *FEATURES), FEATURES)
    return out.select("row_id", *[F.round(c, 4).alias(c) for c in FEATURES])


@query("l02_fit_classifier")
def fit_classifier(spark, d):
    _, cls, _ = models(spark, d)
    weights = cls.importances().tolist()
    return spark.createDataFrame(list(zip(FEATURES, weights)), "feature string, importance double")


@query("l03_fit_regressor")
def fit_regressor(spark, d):
    _, _, reg = models(spark, d)
    weights = reg.importances().tolist()
    return spark.createDataFrame(list(zip(FEATURES, weights)), "feature string, importance double")


@query("l04_evaluate")
def evaluate(spark, d):
    parts, cls, reg = models(spark, d)
    return stability.evaluate(stability.predict_batch(parts.filter("part = 'test'"), cls, reg, FEATURES), "unstable", "margin")


@query("l05_predict_batch")
def predict_batch(spark, d):
    _, cls, reg = models(spark, d)
    return stability.predict_batch(labelled(spark, d), cls, reg, FEATURES)


@query("l06_score_latest")
def score_latest(spark, d):
    _, cls, reg = models(spark, d)
    return stability.score_latest(labelled(spark, d), ["grp"], "ts", "row_id", cls, reg, FEATURES)


@query("l07_isolation_forest_fit")
def isolation_forest_fit(spark, d):
    return fitted_forest(spark, d).nodes


@query("l08_isolation_forest_score")
def isolation_forest_score(spark, d):
    return forest.score_forest(labelled(spark, d), fitted_forest(spark, d), "row_id")


@query("l09_detect")
def detect(spark, d):
    return forest.detect(labelled(spark, d), fitted_forest(spark, d), "row_id", "F", "grp")


@query("t05_lowest_scores")
def lowest_scores(spark, d):
    return forest.detect(labelled(spark, d), fitted_forest(spark, d), "row_id", top=10)


@query("a17_anomaly_share")
def anomaly_share(spark, d):
    return forest.anomaly_share(forest.score_forest(labelled(spark, d), fitted_forest(spark, d), "row_id"))


@query("l10_explain_top_k")
def explain_top_k(spark, d):
    _, cls, _ = models(spark, d)
    return attribution.explain_top_k(labelled(spark, d), "row_id", cls, FEATURES, 5)


@query("s11_save_load_model")
def save_load_model(spark, d):
    _, cls, _ = models(spark, d)
    path = work_path(spark, "model")
    stability.save_model(cls, spark, f"{path}/classifier")
    forest.save_forest(fitted_forest(spark, d), f"{path}/forest")
    again = stability.load_model(spark, f"{path}/classifier")
    rows = labelled(spark, d)
    scored = forest.score_forest(rows, forest.load_forest(spark, f"{path}/forest"), "row_id")
    predicted = stability.predict_batch(rows.select("row_id", *FEATURES), again, None, FEATURES)
    return predicted.select("row_id", "pred_label", "pred_health_score").join(scored, "row_id")
