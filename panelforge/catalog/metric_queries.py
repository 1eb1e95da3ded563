"""Metrics and curves over the scored orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog import views as v
from panelforge.catalog.registry import query
from panelforge.operators import metrics as mt
from panelforge.plans.training import MetricEvaluator
from panelforge.sources.tables import read_table

_COUNTS = """counts AS (SELECT count(*) FILTER (y = 1 AND prediction = 1) AS tp, count(*) FILTER (y = 0 AND prediction = 1) AS fp,
  count(*) FILTER (y = 1 AND prediction = 0) AS fn, count(*) FILTER (y = 0 AND prediction = 0) AS tn FROM scored)"""
_REPORT = """report AS (
  SELECT 0 AS class, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fn + fp) AS f1, (tn + fp)::BIGINT AS support FROM counts
  UNION ALL SELECT 1, tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), (tp + fn)::BIGINT FROM counts)"""
_STEPS = """steps AS (
  SELECT threshold, pos, neg, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, sum(pos) OVER () AS total_pos, sum(neg) OVER () AS total_neg
  FROM (SELECT score AS threshold, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY 1)
  WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


def _rounded(df, *names):
    return df.withColumns({n: v.r6(n) for n in names})


def _steps(spark, folder):
    return mt.score_steps(v.scored_orders(spark, folder))


@query(
    "E1 A3",
    f"WITH {v.SCORED} SELECT y, count(*) FILTER (prediction = 0)::BIGINT AS \"0\", count(*) FILTER (prediction = 1)::BIGINT AS \"1\" FROM scored GROUP BY 1",
)
def confusion_matrix(spark, folder):
    return mt.confusion_matrix(v.scored_orders(spark, folder))


@query(
    "E2",
    f"WITH {v.SCORED}, {_COUNTS}, {_REPORT} SELECT class, {v.sql_r6('precision')} AS precision, {v.sql_r6('recall')} AS recall, "
    f"{v.sql_r6('f1')} AS f1, support FROM report",
)
def class_report(spark, folder):
    report = mt.class_report(mt.outcome_counts(v.scored_orders(spark, folder)))
    return _rounded(report, "precision", "recall", "f1")


@query(
    "E6",
    f"WITH {v.SCORED}, {_COUNTS}, {_REPORT} "
    f"SELECT 'macro' AS average, {v.sql_r6('avg(precision)')} AS precision, {v.sql_r6('avg(recall)')} AS recall, {v.sql_r6('avg(f1)')} AS f1, sum(support)::BIGINT AS support FROM report UNION ALL "
    f"SELECT 'weighted', {v.sql_r6('sum(precision * support) / sum(support)')}, {v.sql_r6('sum(recall * support) / sum(support)')}, {v.sql_r6('sum(f1 * support) / sum(support)')}, sum(support)::BIGINT FROM report",
)
def report_averages(spark, folder):
    report = mt.class_report(mt.outcome_counts(v.scored_orders(spark, folder)))
    return _rounded(mt.report_averages(report), "precision", "recall", "f1")


@query(
    "E3 E4 E5 E6 D3",
    f"WITH {v.SCORED}, {_COUNTS}, {_REPORT} SELECT {v.sql_r6('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, "
    f"{v.sql_r6('(tp + tn) / (tp + fp + fn + tn)')} AS micro_f1, {v.sql_r6('tp / (tp + fp)')} AS precision, {v.sql_r6('tp / (tp + fn)')} AS recall, "
    f"{v.sql_r6('2 * tp / (2 * tp + fn + fp)')} AS f1, {v.sql_r6('17 * tp / (17 * tp + 16 * fn + fp)')} AS f_beta_4, "
    f"{v.sql_r6('26 * tp / (26 * tp + 25 * fn + fp)')} AS f_beta_5, "
    f"{v.sql_r6('(SELECT sum(f1 * support) / sum(support) FROM report)')} AS weighted_f1 FROM counts",
)
def single_scores(spark, folder):
    out = mt.scores(mt.outcome_counts(v.scored_orders(spark, folder)))
    return _rounded(out, *out.columns)


@query(
    "D3 E4 E5",
    f"WITH {v.SCORED}, {_COUNTS} SELECT 'f_beta_5' AS metric, {v.sql_r6('26 * tp / (26 * tp + 25 * fn + fp)')} AS value FROM counts UNION ALL "
    f"SELECT 'f_beta_4', {v.sql_r6('17 * tp / (17 * tp + 16 * fn + fp)')} FROM counts UNION ALL SELECT 'recall', {v.sql_r6('tp / (tp + fn)')} FROM counts",
)
def evaluator_scores(spark, folder):
    """User metrics as evaluators, the form that cross-validation takes."""
    scored = v.scored_orders(spark, folder)
    metrics = {"f_beta_5": mt.f_beta(5.0), "f_beta_4": mt.f_beta(4.0), "recall": mt.recall()}
    rows = [(name, MetricEvaluator(metric, "y").evaluate(scored)) for name, metric in metrics.items()]
    return spark.createDataFrame(rows, "metric string, value double").withColumn("value", v.r6("value"))


@query(
    "E7",
    f"WITH {v.SCORED}, {_STEPS} SELECT threshold, {v.sql_r6('cum_pos / total_pos')} AS tpr, {v.sql_r6('cum_neg / total_neg')} AS fpr FROM steps "
    "UNION ALL SELECT max(threshold) + 1, 0.0::DOUBLE, 0.0::DOUBLE FROM steps",
)
def roc_curve(spark, folder):
    return _rounded(mt.roc_curve(_steps(spark, folder)), "tpr", "fpr")


@query(
    "E8",
    f"WITH {v.SCORED}, {_STEPS} SELECT {v.sql_r6('sum(neg * (cum_pos - pos + pos / 2)) / (max(total_pos) * max(total_neg))')} AS roc_auc FROM steps",
)
def roc_auc(spark, folder):
    return _rounded(mt.roc_auc(_steps(spark, folder)), "roc_auc")


@query(
    "E9",
    f"WITH {v.SCORED}, {_STEPS} SELECT threshold, {v.sql_r6('cum_pos / (cum_pos + cum_neg)')} AS precision, {v.sql_r6('cum_pos / total_pos')} AS recall "
    "FROM steps WHERE cum_pos - pos < total_pos UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE",
)
def precision_recall_curve(spark, folder):
    return _rounded(mt.precision_recall_curve(_steps(spark, folder)), "precision", "recall")


@query(
    "E9",
    f"WITH {v.SCORED}, {_STEPS} SELECT threshold, {v.sql_r6('cum_pos / (cum_pos + cum_neg)')} AS precision, {v.sql_r6('cum_pos / total_pos')} AS recall "
    "FROM steps",
)
def threshold_table(spark, folder):
    curve = mt.precision_recall_curve(_steps(spark, folder), stop_at_full_recall=False)
    return _rounded(mt.threshold_table(curve), "precision", "recall")


@query(
    "E10",
    f"WITH {v.SCORED}, {_STEPS} SELECT {v.sql_r6('sum(pos / total_pos * (cum_pos / (cum_pos + cum_neg)))')} AS average_precision FROM steps",
)
def average_precision(spark, folder):
    return _rounded(mt.average_precision(_steps(spark, folder)), "average_precision")


@query(
    "E10",
    f"WITH {v.SCORED.replace('scored AS', 'raw_scored AS')}, scored AS (SELECT 1 - y AS y, 1 - score AS score FROM raw_scored), {_STEPS} "
    f"SELECT {v.sql_r6('sum(pos / total_pos * (cum_pos / (cum_pos + cum_neg)))')} AS average_precision FROM steps",
)
def average_precision_class_0(spark, folder):
    flipped = v.scored_orders(spark, folder).withColumn("score", 1 - F.col("score"))
    return _rounded(mt.average_precision(mt.score_steps(flipped, pos_label=0)), "average_precision")


@query(
    "E11",
    f"WITH {v.SCORED} SELECT {v.sql_r6('1 - var_pop(y - prediction) / var_pop(y)')} AS explained_variance FROM scored",
)
def explained_variance(spark, folder):
    return _rounded(mt.explained_variance(v.scored_orders(spark, folder)), "explained_variance")


@query(
    "E12 F6",
    f"WITH {v.SCORED}, b AS (SELECT {v.sql_r6('avg(y)')} AS base FROM scored) "
    "SELECT 'no skill' AS line, 1 AS point, 0.0::DOUBLE AS recall, base AS precision FROM b UNION ALL SELECT 'no skill', 2, 1.0, base FROM b "
    "UNION ALL SELECT 'perfect', 1, 0.0, 1.0 FROM b UNION ALL SELECT 'perfect', 2, 1.0, 1.0 FROM b UNION ALL SELECT 'perfect', 3, 1.0, base FROM b",
)
def reference_lines(spark, folder):
    return _rounded(mt.reference_lines(v.scored_orders(spark, folder)), "precision")


@query(
    "E13 C8",
    "WITH s AS (SELECT o_orderpriority AS model, avg(o_totalprice) AS score FROM orders GROUP BY 1) "
    f"SELECT model, {v.sql_r6('(score / (SELECT score FROM s WHERE model = ' + chr(39) + '5-LOW' + chr(39) + ') - 1) * 100', 3)} AS lift_percent FROM s WHERE model <> '5-LOW'",
)
def lift_over_baseline(spark, folder):
    scores = read_table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.avg("o_totalprice").alias("score")
    )
    return mt.lift_over(scores, "model", "score", "5-LOW").withColumn("lift_percent", v.r6("lift_percent", 3))


@query(
    "E14 U1",
    f"WITH {v.SCORED}, f AS (SELECT fold, count(*) FILTER (y = 1 AND prediction = 1) AS tp, count(*) FILTER (y = 0 AND prediction = 1) AS fp, "
    "count(*) FILTER (y = 1 AND prediction = 0) AS fn, count(*) FILTER (y = 0 AND prediction = 0) AS tn FROM scored GROUP BY 1), "
    "c AS (SELECT fold, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp, sum(fn) OVER w AS fn, sum(tn) OVER w AS tn FROM f WINDOW w AS (ORDER BY fold)) "
    f"SELECT fold, 0 AS class, {v.sql_r6('tn / (tn + fn)')} AS precision, {v.sql_r6('tn / (tn + fp)')} AS recall, {v.sql_r6('2 * tn / (2 * tn + fn + fp)')} AS f1, (tn + fp)::BIGINT AS support FROM c "
    f"UNION ALL SELECT fold, 1, {v.sql_r6('tp / (tp + fp)')}, {v.sql_r6('tp / (tp + fn)')}, {v.sql_r6('2 * tp / (2 * tp + fp + fn)')}, (tp + fn)::BIGINT FROM c",
)
def pooled_fold_report(spark, folder):
    scored = v.scored_orders(spark, folder).withColumn("model", F.lit("score"))
    counts = mt.pooled_counts(scored, ["model"])
    report = mt.class_report(counts, ["fold"])
    return _rounded(report, "precision", "recall", "f1")


@query(
    "A4",
    f"WITH {v.SCORED}, f AS (SELECT fold, avg((y = prediction)::INTEGER) AS value FROM scored GROUP BY 1) "
    f"SELECT {v.sql_r6('avg(value)')} AS mean, {v.sql_r6('stddev_samp(value)', 4)} AS deviation FROM f",
)
def fold_summary(spark, folder):
    counts = mt.outcome_counts(v.scored_orders(spark, folder), ["fold"]).withColumn("value", mt.accuracy())
    out = mt.fold_summary(counts, "value", [])
    return out.select(v.r6("mean").alias("mean"), v.r6("deviation", 4).alias("deviation"))
