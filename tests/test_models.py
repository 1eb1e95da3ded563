import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelforge.functions import codebook as cb
from panelforge.functions.keyed import keyed_uniform
from panelforge.operators import explain as ex
from panelforge.operators import metrics as mt
from panelforge.operators import models as md
from panelforge.plans import features as ft
from panelforge.plans import training as tr
from panelforge.session import cut, scratch_path
from panelforge.sources.tables import load_model, save_model

COLUMNS = ["a", "b.5", "noise"]


@pytest.fixture(scope="module")
def table(spark):
    """Rows whose label depends on `a` and, the other way, on `b.5`."""
    u = lambda s: keyed_uniform("respondent_id", s)
    df = spark.range(600).select(F.col("id").alias("respondent_id"), u(1).alias("a"), u(2).alias("b.5"), u(3).alias("noise"))
    odds = 1 / (1 + F.exp(-(4 * F.col("a") - 3 * F.col("`b.5`") - 1.3)))
    df = df.withColumn("label", (u(4) < odds).cast("int")).withColumn("is_test", F.col("respondent_id") % 5 == 0)
    return cut(df)


def maker(n):
    return md.tuned_logistic(ft.LABEL, n, c=1.0)


@pytest.fixture(scope="module")
def fitted(table):
    return tr.train_and_score(table, COLUMNS, maker)


def test_penalty_gives_the_smallest_objective(table):
    """|w| + C * sum(weight * loss) must not be lower for a nearby penalty."""
    rows = md.assembled(table, COLUMNS).select("label", "features")
    x = np.array([r[0] for r in rows.select(vector_to_array("features")).collect()])
    y = np.array([r["label"] for r in rows.collect()])
    total, c = 0.5 * len(y), 0.1

    def objective(model):
        margin = x @ model.coefficients.toArray() + model.intercept
        loss = np.logaddexp(0, margin) - y * margin
        return np.abs(model.coefficients.toArray()).sum() + c * 0.5 * loss.sum()

    base = md.logistic("label", total, c, l1=True)
    here = objective(base.fit(rows))
    for factor in (0.5, 0.8, 1.25, 2.0):
        other = base.copy({base.regParam: base.getRegParam() * factor})
        assert objective(other.fit(rows)) >= here - 1e-6


def test_scoring_adds_no_rows_and_beats_chance(table, fitted):
    _, scored = fitted
    assert scored.count() == table.where("is_test").count()
    assert mt.roc_auc(mt.score_steps(scored)).first()[0] > 0.65
    assert scored.where("abs(score + score_0 - 1) > 1e-9").count() == 0


def test_training_rows_are_balanced(table):
    chain = md.BalancedClassifier(keyCol="respondent_id", labelCol="label", inputCols=COLUMNS, classifier=maker)
    _, train = chain.prepare(table)
    n = [r["count"] for r in train.groupBy("label").count().collect()]
    assert len(n) == 2 and n[0] == n[1]


def test_chain_takes_parameters_of_its_classifier(table):
    inner = md.forest("label", trees=3)
    chain = md.BalancedClassifier(keyCol="respondent_id", labelCol="label", inputCols=COLUMNS, classifier=inner)
    model = chain.fit(table, {inner.numTrees: 2, inner.maxDepth: 1})
    assert model.stages[-1].getNumTrees == 2 and inner.getNumTrees() == 3


def test_stored_model_scores_the_same(spark, table, fitted):
    model, scored = fitted
    path = scratch_path(spark, "m")
    save_model(model, path)
    again = md.predictions(load_model(path), table.where("is_test"), "respondent_id", "label")
    assert again.select("id", "score").exceptAll(scored.select("id", "score")).count() == 0


def test_folds_models_and_report(table):
    folds = md.prepared_folds(table, ft.KEY, ft.LABEL, COLUMNS, 3)
    scored = tr.out_of_fold(folds, {"chance": None, "logistic": maker, "boosted": lambda n: md.boosted_trees(ft.LABEL, 2)})
    assert scored.groupBy("model").agg(F.count_distinct("id").alias("n")).where("n <> 600").count() == 0
    out = tr.compare_models(scored)
    summary = {(r["model"], r["metric"]): r["mean"] for r in out["summary"].collect()}
    assert summary[("logistic", "weighted_f1")] > summary[("chance", "weighted_f1")]
    assert out["scores"].columns == ["model", "fold", "metric", "value"]
    assert out["confusion"].agg(F.sum(F.expr("tp + fp + fn + tn"))).first()[0] == 3 * 600
    rows = tr.cross_validate(folds, maker)
    assert {r["metric"] for r in rows.collect()} == {
        "test_recall", "test_f_beta", "train_recall", "train_f_beta", "fit_time", "score_time"
    }


def test_searches(spark, table):
    grid = {"l1_share": [0.0, 1.0], "C": [1e-5, 1.0], "class_weight": [(0.5, 0.5), "balanced"]}
    out = {r["candidate"]: r["mean"] for r in tr.search_logistic(table, COLUMNS, 2, grid).collect()}
    assert len(out) == 8 and out["l1 C=1 weights=(0.5, 0.5)"] > out["l1 C=1e-05 weights=(0.5, 0.5)"] - 1e-9
    forest = tr.search_forest(table, COLUMNS, 2, {"max_depth": [1, 3], "min_leaf": [3], "trees": [3]})
    assert forest.count() == 2
    chosen = tr.choose_c(table, COLUMNS, 2, [1e-6, 1.0])
    assert chosen.avgMetrics[1] > chosen.avgMetrics[0]
    assert tr.chosen_c_table(spark, chosen, [1e-6, 1.0]).count() == 2


def test_penalties_share_passes(spark, table):
    """All folds and penalties take few passes, and the scores are those of single fits."""
    values, rounds = [1e-4, 0.1, 100.0], 3
    seen = []
    fit_many = tr.linear.fit_many
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tr.linear, "fit_many", lambda *a: seen.append(fit_many(*a)) or seen[-1])
        chosen = tr.choose_c(table, COLUMNS, rounds, values)
    assert len(seen) == 1 and len(seen[0].problems) == 9 and seen[0].passes < 60
    single = tr.choose_c(table, COLUMNS, rounds, values, tr.MulticlassClassificationEvaluator(labelCol=ft.LABEL, metricName="accuracy"))
    assert np.allclose(chosen.avgMetrics, single.avgMetrics, atol=0.01)
    assert chosen.getNumFolds() == rounds and len(chosen.stdMetrics) == 3
    assert chosen.bestModel.getRegParam() in [m[p] for m in chosen.getEstimatorParamMaps() for p in m]


def test_grids_have_the_published_size():
    g, f = cb.LOGISTIC_GRID, cb.FOREST_GRID
    assert len(g["l1_share"]) * len(g["C"]) * len(g["class_weight"]) == 80
    assert len(f["max_depth"]) * len(f["min_leaf"]) * len(f["trees"]) == 120
    assert cb.CHOSEN_C_VALUES[0] == pytest.approx(1e-4) and cb.CHOSEN_C_VALUES[-1] == pytest.approx(1e4)


def test_coefficients_are_turned_and_without_intercept(spark, fitted):
    model, _ = fitted
    rows = ex.contribution_table(ex.weight_table(spark, model.stages[-1], COLUMNS)).collect()
    by = {r["feature"]: r for r in rows}
    assert set(by) == set(COLUMNS) and by["a"]["weight"] < 0 < by["b.5"]["weight"] and by["b.5"]["is_positive"]
    assert [r["weight"] for r in rows] == sorted((r["weight"] for r in rows), reverse=True)


def test_permutation_importance_finds_the_signal(table, fitted):
    model, _ = fitted
    out = {r["feature"]: r["mean"] for r in ex.permutation_importance(model.transform, table, ft.KEY, ft.LABEL, COLUMNS).collect()}
    assert set(out) == set(COLUMNS) and out["a"] > 0.03 and out["a"] > out["noise"]


def test_attributions_add_up_to_the_margin(table):
    weights = {"a": 2.0, "b.5": -1.0}
    out = ex.linear_attributions(table, weights)
    margin = 2 * F.col("a") - F.col("`b.5`")
    mean = table.agg(F.avg(margin)).first()[0]
    gap = F.abs(F.col("shap_a") + F.col("`shap_b.5`") - (margin - mean))
    assert out.agg(F.max(gap)).first()[0] < 1e-9
    rows = {r["Variable"]: r for r in ex.attribution_summary(out, ["a", "b.5"]).collect()}
    assert rows["a"]["Corr"] == pytest.approx(1) and rows["b.5"]["Corr"] == pytest.approx(-1)
    assert rows["a"]["Sign"] == "red" and rows["b.5"]["Sign"] == "blue"


def test_elimination_keeps_the_signal(spark, table):
    rows = ex.eliminate(table, COLUMNS, lambda: md.logistic(ft.LABEL, 600), keep=2)
    assert {c: kept for c, kept, _ in rows} == {"a": True, "b.5": True, "noise": False}
    assert [r for _, _, r in rows] == [1, 1, 2]
    sizes, chosen = ex.eliminate_with_folds(table, ft.KEY, ft.LABEL, COLUMNS, lambda n: md.logistic(ft.LABEL, n), folds=2, least=1)
    assert [r["size"] for r in sizes.collect()] == [1, 2, 3] and chosen.where("kept").count() >= 1


def test_importances(spark, table):
    model, _ = tr.train_and_score(table, COLUMNS, lambda n: md.forest(ft.LABEL, trees=5))
    top = ex.importance_table(spark, model.stages[-1], COLUMNS, 1).collect()
    assert len(top) == 1 and top[0]["feature"] in ("a", "b.5")


def test_design_is_fitted_on_training_rows(spark):
    levels = {c: sorted(m) for c, m in cb.ORDINAL_RANKS.items()}
    rows = []
    for i in range(80):
        r = {"respondent_id": i, "label": i % 2, "age": float(i), "n_prescriptions": float(i % 9), "n_provider_visits": 1.0}
        r.update({c: levels[c][i % len(levels[c])] for c in cb.ORDINAL_FEATURES})
        r.update({c: ("No", "Yes")[i % 3 == 0] for c in cb.CATEGORICAL_FOR_LOGISTIC})
        r.update({c: "x" for c in cb.DROPPED_FOR_LOGISTIC})
        rows.append(r)
    df = cut(spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0])).withColumn("label", F.col("label").cast("int")))
    table, columns = ft.design_table(df)
    assert columns[:3] == cb.NUMERIC_FEATURES and columns[3:10] == cb.ORDINAL_FEATURES
    assert columns[10:] == [f"{c}_Yes" for c in cb.CATEGORICAL_FOR_LOGISTIC]
    train = table.where("not is_test").agg(F.avg("age"), F.stddev_pop("age")).first()
    assert train[0] == pytest.approx(0, abs=1e-9) and train[1] == pytest.approx(1)
    everything, _ = ft.design_table(df, fit_on="all")
    assert everything.agg(F.avg("age")).first()[0] == pytest.approx(0, abs=1e-9)
    assert {k: len(v) for k, v in ft.feature_groups(columns).items()}["demographic"] == 6
