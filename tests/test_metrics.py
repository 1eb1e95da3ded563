import numpy as np
import pytest

from panelforge.operators import metrics as mt


@pytest.fixture(scope="module")
def holdout(spark):
    """Published confusion matrix: TN 82, FP 53, FN 18, TP 39."""
    rows = [(0, 0.0)] * 82 + [(0, 1.0)] * 53 + [(1, 0.0)] * 18 + [(1, 1.0)] * 39
    return spark.createDataFrame(rows, "y int, prediction double")


def test_published_report(holdout):
    report = {r["class"]: r for r in mt.class_report(mt.outcome_counts(holdout)).collect()}
    shown = {c: tuple(round(r[n], 2) for n in ("precision", "recall", "f1")) + (r["support"],) for c, r in report.items()}
    assert shown == {0: (0.82, 0.61, 0.70, 135), 1: (0.42, 0.68, 0.52, 57)}
    averages = {r["average"]: r for r in mt.report_averages(mt.class_report(mt.outcome_counts(holdout))).collect()}
    assert [round(averages["macro"][n], 2) for n in ("precision", "recall", "f1")] == [0.62, 0.65, 0.61]
    assert [round(averages["weighted"][n], 2) for n in ("precision", "recall", "f1")] == [0.70, 0.63, 0.65]


def test_published_scores(holdout):
    s = mt.scores(mt.outcome_counts(holdout)).first()
    assert round(s["accuracy"], 2) == 0.63 and round(s["recall"], 3) == 0.684
    assert round(s["f_beta_5"], 3) == 0.668 and round(s["f_beta_4"], 3) == 0.660
    assert round(s["weighted_f1"], 2) == 0.65


def test_confusion_matrix(holdout):
    assert {r["y"]: (r["0"], r["1"]) for r in mt.confusion_matrix(holdout).collect()} == {0: (82, 53), 1: (18, 39)}


def test_class_that_is_never_predicted(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0)], "y int, prediction double")
    report = {r["class"]: r for r in mt.class_report(mt.outcome_counts(df)).collect()}
    assert report[1]["precision"] == 0.0 and report[1]["f1"] == 0.0


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_curves_against_pairs(spark, digits):
    rng = np.random.default_rng(digits)
    y = rng.integers(0, 2, 400)
    score = np.round(rng.random(400) * 0.7 + y * 0.3, digits)
    df = spark.createDataFrame(list(zip(map(int, y), map(float, score))), "y int, score double").repartition(4)
    steps = mt.score_steps(df)
    pos, neg = score[y == 1], score[y == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert mt.roc_auc(steps).first()[0] == pytest.approx(wins / (len(pos) * len(neg)))
    total, before = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        hit, shown = (pos >= t).sum(), (score >= t).sum()
        total += (hit / len(pos) - before) * hit / shown
        before = hit / len(pos)
    assert mt.average_precision(steps).first()[0] == pytest.approx(total)
    points = {round(r["threshold"], 8): (r["tpr"], r["fpr"]) for r in mt.roc_curve(steps).collect()}
    assert len(points) == len(set(score)) + 1
    for t in set(score):
        assert points[round(float(t), 8)] == pytest.approx(((pos >= t).mean(), (neg >= t).mean()))
    curve = mt.precision_recall_curve(steps).collect()
    assert sum(r["threshold"] is None for r in curve) == 1
    assert sum(r["recall"] == 1.0 for r in curve) == 1


def test_constant_score_is_half(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0), (1, 0.0)], "y int, score double")
    assert mt.roc_auc(mt.score_steps(df)).first()[0] == 0.5


def test_class_0_needs_its_own_positive_label(spark):
    df = spark.createDataFrame([(0, 0.9), (0, 0.8), (1, 0.1)], "y int, score double")
    assert mt.average_precision(mt.score_steps(df, pos_label=0)).first()[0] == 1.0


def test_pooled_counts_end_in_the_total(spark):
    rows = [("m", i % 3, i % 2, float(i % 5 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "model string, fold int, y int, prediction double")
    last = mt.pooled_counts(df, ["model"]).where("fold = 2").select("tp", "fp", "fn", "tn").first()
    assert last == mt.outcome_counts(df).first()


def test_lift_leaves_the_baseline_out(spark):
    df = spark.createDataFrame([("base", 0.506), ("lr", 0.602)], "model string, score double")
    row = mt.lift_over(df, "model", "score", "base").collect()
    assert len(row) == 1 and row[0]["lift_percent"] == pytest.approx(18.97, abs=0.01)


def test_explained_variance(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (1, 0.0)], "y int, prediction double")
    y, p = np.array([0, 1, 1]), np.array([0, 1, 0])
    assert mt.explained_variance(df).first()[0] == pytest.approx(1 - np.var(y - p) / np.var(y))


def test_evaluator(holdout):
    from panelforge.plans.training import MetricEvaluator

    assert round(MetricEvaluator(mt.f_beta(5.0), "y").evaluate(holdout), 3) == 0.668
