"""Training, comparison, search and explanation on the derived survey.

Fitted models have no SQL counterpart, so most of these are checked for rows here
and for their properties in the tests. Folds, grids, trees and columns are the
defaults of the functions, and the tables are whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog import views as v
from panelforge.catalog.registry import query
from panelforge.functions import codebook as cb
from panelforge.operators import explain as ex
from panelforge.operators import metrics as mt
from panelforge.operators import models as md
from panelforge.operators.linear import Linear
from panelforge.operators.profile import per_column
from panelforge.plans import features as ft
from panelforge.plans import survey as plan
from panelforge.plans import training as tr
from panelforge.session import cut, scratch_path
from panelforge.sources.tables import load_model, read_table, save_model


def modelling(spark, folder):
    return cut(ft.modelling_rows(plan.clean_survey(v.survey(spark, folder))))


def design(spark, folder):
    """Design table of the logistic variant, without imputation."""
    return ft.design_table(modelling(spark, folder))


def _tuned(n):
    return md.tuned_logistic(ft.LABEL, n)


@query("N4 T1 T3 T4 T5 M1 M7 M8 E2 P1")
def imputed_training_report(spark, folder):
    """The whole path: impute, prepare, split, balance, fit, report on the held-out rows."""
    rows = ft.imputed_rows(modelling(spark, folder))
    table, columns = ft.design_table(rows)
    _, scored = tr.train_and_score(table, columns, _tuned)
    return mt.class_report(mt.outcome_counts(scored))


@query("M3 M7 M8 E2")
def forest_training_report(spark, folder):
    """The forest variant: its own feature list and no bound on prescriptions."""
    rows = cut(ft.modelling_rows(plan.clean_survey(v.survey(spark, folder)), None))
    table, columns = ft.design_table(
        rows, drop=cb.DROPPED_FOR_FOREST, categorical=cb.CATEGORICAL_FOR_FOREST
    )
    _, scored = tr.train_and_score(table, columns, lambda n: md.forest(ft.LABEL))
    return mt.class_report(mt.outcome_counts(scored))


@query("M8")
def held_out_predictions(spark, folder):
    table, columns = design(spark, folder)
    return tr.train_and_score(table, columns, _tuned)[1]


@query(
    "M6",
    f"WITH {v.SCORED}, p AS (SELECT avg(y) AS prior FROM scored) SELECT id, y, CASE WHEN {v.sql_uniform('id', 2)} < prior THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction, "
    f"CASE WHEN {v.sql_uniform('id', 2)} < prior THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM scored, p",
)
def chance_model(spark, folder):
    scored = v.scored_orders(spark, folder).select("id", "y")
    return md.chance_predictions(scored, "id", "y", md.positive_prior(scored, "y"))


@query("M1 M3 M4 M5 M6 M11 T2 T3 U1 A4")
def model_comparison(spark, folder):
    """Mean and deviation of each metric for seven models over the folds."""
    table, columns = design(spark, folder)
    folds = md.prepared_folds(table, ft.KEY, ft.LABEL, columns)
    return tr.compare_models(tr.out_of_fold(folds, tr.model_set()))["summary"]


@query("M12 E4 E5")
def multi_metric_folds(spark, folder):
    table, columns = design(spark, folder)
    return tr.cross_validate(md.prepared_folds(table, ft.KEY, ft.LABEL, columns, scale=True), _tuned)


@query("M2 D3")
def chosen_penalty(spark, folder):
    table, columns = design(spark, folder)
    fitted = tr.choose_c(table.where("not is_test"), columns)
    return tr.chosen_c_table(spark, fitted, cb.CHOSEN_C_VALUES)


@query("M9 E3")
def logistic_search(spark, folder):
    table, columns = design(spark, folder)
    return tr.search_logistic(table.where("not is_test"), columns)


@query("M10 E5")
def forest_search(spark, folder):
    table, columns = design(spark, folder)
    return tr.search_forest(table.where("not is_test"), columns)


@query("M13 P9 E8")
def feature_group_ablation(spark, folder):
    table, columns = design(spark, folder)
    makers = {"chance": None, "logistic": _tuned, "forest": lambda n: md.forest(ft.LABEL)}
    return tr.ablation(table, columns, makers)


@query("S8 D1")
def stored_model(spark, folder):
    """Largest difference between the scores of a model and of its stored copy."""
    table, columns = design(spark, folder)
    model, scored = tr.train_and_score(table, columns, _tuned)
    path = scratch_path(spark, "model")
    save_model(model, path)
    again = md.predictions(load_model(path), table.where("is_test"), ft.KEY, ft.LABEL)
    both = scored.select("id", "score").join(again.select("id", F.col("score").alias("again")), "id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("score") - F.col("again"))).alias("largest_gap"))


# --- explanation ------------------------------------------------------------

_ATTRIBUTED = {"n_items": 0.4, "n_orders": -0.7, "last_price": 0.00002, "c_acctbal": 0.0, "cents": 0.01}


def _numbers(spark, folder):
    return cut(
        v.customer_orders(spark, folder)
        .where("n_orders is not null")
        .select("c_custkey", *[F.col(c).cast("double").alias(c) for c in _ATTRIBUTED])
    )


_NUMBERS = f"{v.CUSTOMER_ORDERS}, numbers AS (SELECT c_custkey, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in _ATTRIBUTED) + " FROM co WHERE n_orders IS NOT NULL)"
_SHAP = ", ".join(f"{w!r}::DOUBLE * ({c} - avg({c}) OVER ()) AS shap_{c}" for c, w in _ATTRIBUTED.items())


@query(
    "X3",
    f"WITH {_NUMBERS}, s AS (SELECT *, {_SHAP} FROM numbers) SELECT c_custkey, "
    + ", ".join(v.sql_r6(f"shap_{c}", 4) + f" AS shap_{c}" for c in _ATTRIBUTED) + " FROM s",
)
def linear_attributions(spark, folder):
    out = ex.linear_attributions(_numbers(spark, folder), _ATTRIBUTED)
    return out.select("c_custkey", *[v.r6(f"shap_{c}", 4).alias(f"shap_{c}") for c in _ATTRIBUTED])


def _corr(c: str) -> str:
    plain = f"CASE WHEN stddev_pop(shap_{c}) = 0 THEN 0 ELSE corr(shap_{c}, {c}) END"
    return f"coalesce({plain}, 0)"


@query(
    "X4 A6 A7 C7 J2 O2",
    f"WITH {_NUMBERS}, s AS (SELECT *, {_SHAP} FROM numbers) SELECT \"Variable\", \"SHAP_abs\", \"Corr\", CASE WHEN \"Corr\" > 0 THEN 'red' ELSE 'blue' END AS \"Sign\" FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"Variable\", {v.sql_r6(f'avg(abs(shap_{c}))', 4)} AS \"SHAP_abs\", {v.sql_r6(_corr(c), 4)} AS \"Corr\" FROM s"
        for c in _ATTRIBUTED
    )
    + ") ORDER BY \"SHAP_abs\" DESC LIMIT 15",
)
def attribution_summary(spark, folder):
    out = ex.linear_attributions(_numbers(spark, folder), _ATTRIBUTED)
    table = ex.attribution_summary(out, list(_ATTRIBUTED), 15)
    return table.select("Variable", v.r6("SHAP_abs", 4).alias("SHAP_abs"), v.r6("Corr", 4).alias("Corr"), "Sign")


@query(
    "X1 F4 C7 C8 O1",
    "WITH w AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_quantity) AS weight FROM lineitem" for c in ("l_extendedprice", "l_discount", "l_tax"))
    + f") SELECT feature, {v.sql_r6('-weight', 4)} AS weight, -weight > 0 AS is_positive FROM w",
)
def contribution_signs(spark, folder):
    """The coefficient report over weights that are correlations of the line items."""
    weights = per_column(
        read_table(spark, folder, "lineitem"),
        ["l_extendedprice", "l_discount", "l_tax", "l_quantity"],
        weight=lambda c: F.corr(c, F.col("l_quantity")),
    ).withColumnRenamed("column", "feature")
    named = weights.withColumn("feature", F.when(F.col("feature") == "l_quantity", ex.BIAS).otherwise(F.col("feature")))
    return ex.contribution_table(named).withColumn("weight", v.r6("weight", 4))


@query("X1 M1")
def coefficient_table(spark, folder):
    table, columns = design(spark, folder)
    model, _ = tr.train_and_score(table, columns, _tuned)
    return ex.contribution_table(ex.weight_table(spark, model.stages[-1], columns))


@query("X2 M1")
def permutation_importance(spark, folder):
    table, columns = design(spark, folder)
    maker = lambda n: md.logistic(ft.LABEL, n * 0.5, cb.LOGISTIC_FLAT_C, l1=True)
    model = tr.fit_balanced(table.where("not is_test"), columns, maker, scale=False)
    return ex.permutation_importance(model.transform, table.where("is_test"), ft.KEY, ft.LABEL, columns)


def _rule(score: str, fold: str) -> str:
    return f"CASE WHEN {score} + {fold} * 0.02::DOUBLE >= 0.55 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _shuffled_rule_sql() -> str:
    ctes = [v.SCORED, "d AS (SELECT id, y, score, fold::DOUBLE AS fold FROM scored)"]
    for r in range(2):
        side = lambda name: (
            f"(SELECT *, row_number() OVER (ORDER BY {v.sql_hash('id', f'12:{r}:{name}')}, id) AS position FROM d)"
        )
        ctes.append(
            f"s{r} AS (SELECT l.y, l.score, l.fold, o.score AS other_score, o.fold AS other_fold "
            f"FROM {side('left')} l JOIN {side('right')} o USING (position))"
        )
        recall = lambda score, fold: f"avg({_rule(score, fold)}) FILTER (y = 1)"
        ctes.append(
            f"l{r} AS (SELECT {recall('score', 'fold')} - {recall('other_score', 'fold')} AS score, "
            f"{recall('score', 'fold')} - {recall('score', 'other_fold')} AS fold FROM s{r})"
        )
    losses = "SELECT * FROM l0 UNION ALL SELECT * FROM l1"
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {v.sql_r6(f'avg({c})')} AS mean, {v.sql_r6(f'stddev_pop({c})', 4)} AS deviation FROM ({losses})"
        for c in ("score", "fold")
    )


@query("X2 E5", _shuffled_rule_sql())
def permutation_importance_of_rule(spark, folder):
    """The same job over a fixed rule instead of a model, which SQL can repeat."""
    scored = v.scored_orders(spark, folder).select("id", "y", "score", F.col("fold").cast("double").alias("fold"))
    rule = lambda df: df.withColumn(
        "prediction", F.when(F.col("score") + F.col("fold") * 0.02 >= 0.55, 1.0).otherwise(0.0)
    )
    out = ex.permutation_importance(rule, scored, "id", "y", ["score", "fold"])
    return out.select("feature", v.r6("mean").alias("mean"), v.r6("deviation", 4).alias("deviation"))


@query("X5 M3")
def impurity_importance(spark, folder):
    table, columns = design(spark, folder)
    model, _ = tr.train_and_score(table, columns, lambda n: md.forest(ft.LABEL))
    return ex.importance_table(spark, model.stages[-1], columns)


@query("X6")
def feature_elimination(spark, folder):
    table, columns = design(spark, folder)
    rows = table.count()
    return ex.elimination_table(spark, ex.eliminate(table, columns, lambda: md.logistic(ft.LABEL, rows)))


@query("X7 E11 P2")
def feature_elimination_folds(spark, folder):
    table, columns = design(spark, folder)
    kind = Linear(cb.LOGISTIC_C, True, (cb.CLASS_WEIGHTS[0], cb.CLASS_WEIGHTS[1]))
    sizes, _ = ex.eliminate_with_folds(table, ft.KEY, ft.LABEL, columns, kind)
    return sizes
