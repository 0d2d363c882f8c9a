"""What must hold for every model, row by row: facts that SQL can state although it cannot train a model."""

from pyspark.sql import functions as F

from ..operators import forest, stability
from ..operators.rules import health_score, stability_label
from ..plans import jobs
from ..session import work_path
from ..sources.bindings import FEATURES, met
from . import query
from .job_checks import zone_assessment
from .model_checks import fitted_forest, labelled, models
from .streaming_checks import score_stream

#: Accuracy that the classifier has at least on the held-out part: more often right than wrong. The labels hardly depend on the features.
FLOOR = 0.5

_NEWEST = "SELECT l_linestatus AS grp, l_shipdate AS ts, row_id FROM lines QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY l_shipdate DESC, row_id DESC)"
_LINES = "lines AS (SELECT l_linestatus, l_shipdate, l_discount - l_tax AS margin, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS row_id FROM lineitem)"


def _importance(spark, model):
    weights = model.importances()
    return spark.createDataFrame([(len(weights), bool(abs(weights.sum() - 1) < 1e-6))], "n_features int, sums_to_one boolean")


@query("l02_classifier_importance", "SELECT 4 AS n_features, TRUE AS sums_to_one")
def classifier_importance(spark, d):
    return _importance(spark, models(spark, d)[1])


@query("l03_regressor_importance", "SELECT 4 AS n_features, TRUE AS sums_to_one")
def regressor_importance(spark, d):
    return _importance(spark, models(spark, d)[2])


@query(
    "l04_held_out_quality",
    """SELECT sum(n - CAST(floor(0.8 * n) AS BIGINT))::BIGINT AS n, TRUE AS accurate, TRUE AS close
       FROM (SELECT count(*) AS n FROM feat GROUP BY unstable)""",
    views="feat",
)
def held_out_quality(spark, d):
    """Size of the held-out part, accuracy above the floor, margin error below the margin's own deviation."""
    parts, cls, reg = models(spark, d)
    test = parts.filter("part = 'test'")
    found = stability.evaluate(stability.predict_batch(test, cls, reg, FEATURES), "unstable", "margin")
    spread = test.agg(F.stddev_pop("margin").alias("s")).scalar()
    return found.select("n", (F.col("accuracy") >= FLOOR).alias("accurate"), (F.col("mae") < spread).alias("close"))


@query("l05_prediction_rules", "SELECT row_id, TRUE AS in_range, TRUE AS label_fits, TRUE AS health_fits FROM feat", views="feat")
def prediction_rules(spark, d):
    """Every row has a probability, and the label and health that follow from it."""
    _, cls, reg = models(spark, d)
    p = F.col("pred_prob_unstable")
    return stability.predict_batch(labelled(spark, d), cls, reg, FEATURES).select(
        "row_id", p.between(0, 1).alias("in_range"), (F.col("pred_label") == stability_label(p)).alias("label_fits"),
        (F.col("pred_health_score") == health_score(p)).alias("health_fits"))


@query("l06_latest_rows", f"{_NEWEST} = 1", ctes=_LINES)
def latest_rows(spark, d):
    _, cls, reg = models(spark, d)
    return stability.score_latest(labelled(spark, d), ["grp"], "ts", "row_id", cls, reg, FEATURES).select("grp", "ts", "row_id")


@query("l07_forest_shape", "SELECT range AS tree, TRUE AS binary, TRUE AS bounded FROM range(100)")
def forest_shape(spark, d):
    """Every tree is binary, and no deeper than the log of its sample."""
    leaf = F.col("feature") < 0
    return fitted_forest(spark, d).nodes.groupBy("tree").agg(
        (F.count("*") == 2 * F.count_if(leaf) - 1).alias("binary"), (F.count("*") <= 2 * forest.PSI - 1).alias("bounded"))


@query("l08_scores_of_all_rows", "SELECT row_id, TRUE AS in_range, TRUE AS flag_fits FROM feat", views="feat")
def scores_of_all_rows(spark, d):
    score = F.col("anomaly_score")
    return forest.score_forest(labelled(spark, d), fitted_forest(spark, d), "row_id").select(
        "row_id", score.between(-1, 1).alias("in_range"), (F.col("is_anomaly") == (score < 0)).alias("flag_fits"))


@query("l09_context_of_anomalies", "SELECT TRUE AS all_anomalies, TRUE AS right_group, TRUE AS from_the_table")
def context_of_anomalies(spark, d):
    """Detection gives anomalies of the asked group alone, with their context columns as in the table."""
    rows = labelled(spark, d)
    found = forest.detect(rows, fitted_forest(spark, d), "row_id", "F", "grp", keep=["grp", "ts"])
    known = found.join(rows.select("row_id", F.col("ts").alias("was")), "row_id", "left")
    return known.agg(F.coalesce(F.every("is_anomaly"), F.lit(True)).alias("all_anomalies"),
                     F.coalesce(F.every(F.col("grp") == "F"), F.lit(True)).alias("right_group"),
                     F.coalesce(F.every(F.col("ts") == F.col("was")), F.lit(True)).alias("from_the_table"))


@query("t05_lowest_ten", "SELECT 10::BIGINT AS n, TRUE AS lowest")
def lowest_ten(spark, d):
    """Ten rows, and no other row has a lower score."""
    scored = forest.score_forest(labelled(spark, d), fitted_forest(spark, d), "row_id")
    ten = forest.detect(labelled(spark, d), fitted_forest(spark, d), "row_id", top=10).agg(
        F.count("*").alias("n"), F.max("anomaly_score").alias("worst"))
    below = scored.agg(F.count_if(F.col("anomaly_score") < ten.select("worst").scalar()).alias("k")).scalar()
    return ten.select("n", (below < 10).alias("lowest"))


@query("a17_share_of_anomalies", "SELECT count(*) AS n, TRUE AS near_contamination FROM feat", views="feat")
def share_of_anomalies(spark, d):
    """The threshold is the 5 % quantile of the scores, so about that share is below it."""
    share = forest.anomaly_share(forest.score_forest(labelled(spark, d), fitted_forest(spark, d), "row_id"))
    return share.select("n", F.col("anomaly_pct").between(3, 5.1).alias("near_contamination"))


@query("s11_models_after_reload", "SELECT row_id, TRUE AS same_probability, TRUE AS same_score FROM feat", views="feat")
def models_after_reload(spark, d):
    """A saved and loaded model predicts what it did."""
    _, cls, _ = models(spark, d)
    path = work_path(spark, "reloaded")
    stability.save_model(cls, spark, f"{path}/classifier")
    forest.save_forest(fitted_forest(spark, d), f"{path}/forest")
    rows = labelled(spark, d).select("row_id", *FEATURES)

    def both(classifier, iso):
        out = stability.predict_batch(rows, classifier, None, FEATURES)
        return forest.score_forest(out, iso, "row_id", ["pred_prob_unstable"])

    again = both(stability.load_model(spark, f"{path}/classifier"), forest.load_forest(spark, f"{path}/forest"))
    again = again.select("row_id", F.col("pred_prob_unstable").alias("p"), F.col("anomaly_score").alias("s"))
    return both(cls, fitted_forest(spark, d)).join(again, "row_id").select(
        "row_id", (F.col("p") == F.col("pred_prob_unstable")).alias("same_probability"), (F.col("s") == F.col("anomaly_score")).alias("same_score"))


@query("st2_scored_stream", "SELECT count(*) AS n, TRUE AS in_range, TRUE AS no_truth FROM lineitem")
def scored_stream(spark, d):
    """Every line is scored in flight and has lost its label."""
    out = score_stream(spark, d)
    return out.agg(F.count("*").alias("n"), F.every(F.col("pred_prob_unstable").between(0, 1)).alias("in_range"),
                   F.every(F.col("unstable").isNull()).alias("no_truth"))


@query(
    "c04_zone_states",
    f"""SELECT n.grp, n.ts, n.row_id, CASE WHEN m BETWEEN 49.8 AND 50.2 THEN 'normal' WHEN abs(m - 50.0) > 0.5 THEN 'excursion'
        ELSE 'deviation' END AS grid_freq_status, TRUE AS listed_of_counted FROM ({_NEWEST} = 1) n JOIN
        (SELECT l_linestatus AS grp, avg(50 + margin) AS m FROM (SELECT * FROM lines QUALIFY row_number() OVER
         (PARTITION BY l_linestatus ORDER BY l_shipdate DESC, row_id DESC) <= 500) GROUP BY 1) USING (grp)""",
    ctes=_LINES,
)
def zone_states(spark, d):
    """Newest row and frequency state of each group; ten anomalies at most are listed of those counted."""
    listed = F.coalesce(F.size("anomaly_flags"), F.lit(0))
    fits = F.greatest(listed, F.lit(0)) == F.least("anomaly_count", F.lit(10))
    return zone_assessment(spark, d).select("grp", "ts", "row_id", "grid_freq_status", fits.alias("listed_of_counted"))


@query(
    "c05_meter_statistics_with_anomalies",
    "SELECT count(power) AS n, TRUE AS share_fits FROM met",
    views="met",
)
def meter_statistics_with_anomalies(spark, d):
    """Anomalies are counted over all rows: their share of the complete ones is near the contamination."""
    rows = met(spark, d)
    iso = forest.fit_forest(rows, "reading_id", ["power", "k"], incomplete="drop")
    out = jobs.analyse_meters(rows, "power", forest.score_forest(rows, iso, "reading_id"))
    return out.select("n", (F.col("anomaly_count") / F.col("n")).between(0.03, 0.08).alias("share_fits"))
