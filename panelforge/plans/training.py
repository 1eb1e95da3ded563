"""Training, comparison and search over prepared folds."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions import codebook as cb
from panelforge.functions.keyed import named
from panelforge.operators import boosting, linear, trees
from panelforge.operators import metrics as mt
from panelforge.operators import models as md
from panelforge.operators.linear import Linear
from panelforge.operators.split import stratified_folds
from panelforge.plans.features import KEY, LABEL, feature_groups
from panelforge.session import cut

Maker = Callable[[int], object]


Spec = Linear | trees.Forest | boosting.Boost


def model_set(boost_rounds: int = 100, trees_each: int = 100) -> dict[str, Spec | None]:
    """The seven classifiers of the comparison by name. None is the chance model."""
    return {
        "chance": None,
        "logistic base": Linear(),
        "logistic tuned": Linear(cb.LOGISTIC_C, True, (cb.CLASS_WEIGHTS[0], cb.CLASS_WEIGHTS[1])),
        "random forest base": trees.Forest("random forest base", trees_each),
        "random forest": trees.Forest("random forest", cb.FOREST_TREES, cb.FOREST_DEPTH, cb.FOREST_LEAF, cb.FOREST_SPLIT),
        "extra trees": trees.Forest("extra trees", trees_each, bootstrap=False, extra=True),
        "boosted trees": boosting.Boost("boosted trees", boost_rounds),
    }


def fit_balanced(train: DataFrame, columns: Sequence[str], maker: Maker, scale: bool = True) -> PipelineModel:
    """Scale, balance and fit on training rows."""
    return md.BalancedClassifier(
        keyCol=KEY, labelCol=LABEL, inputCols=list(columns), classifier=maker, scale=scale
    ).fit(train)


def train_and_score(table: DataFrame, columns: Sequence[str], maker: Maker) -> tuple[PipelineModel, DataFrame]:
    """One fit on the training rows and the predictions on the held-out rows."""
    model = fit_balanced(table.where(~F.col("is_test")), columns, maker)
    return model, md.predictions(model, table.where("is_test"), KEY, LABEL)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _fits(estimators: Sequence, train: DataFrame, parallelism: int = 4) -> list:
    """The fitted models in order; a few fits at a time fill the cluster between their passes."""
    fit = inheritable_thread_target(train.sparkSession)(lambda estimator: estimator.fit(train))
    with ThreadPool(parallelism) as pool:
        return pool.map(fit, estimators, chunksize=1)


def _fold_rows(folds: Sequence[md.Fold], side: str) -> DataFrame:
    """(part, id, y, x, key columns) of the training or test rows of all folds; a part is a fold."""
    frames = [(f.number, f.train if side == "train" else f.test) for f in folds]
    copy = lambda df: F.col("copy") if "copy" in df.columns else F.lit(0)
    return _union(
        [
            df.select(F.lit(n).alias("part"), F.col(KEY).alias("id"), F.col(LABEL).alias("y"), vector_to_array("features").alias("x"), copy(df).alias("copy"))
            for n, df in frames
        ]
    )


def _features(folds: Sequence[md.Fold]) -> int:
    return folds[0].test.first()["features"].size


def _out_of_fold_specs(folds: Sequence[md.Fold], specs: Mapping[str, Spec]) -> DataFrame:
    """(model, fold, id, y, score) of models that are fitted on all folds at once."""
    own = {f.number: [f.number] for f in folds}
    width = _features(folds)
    train, test = _fold_rows(folds, "train"), cut(_fold_rows(folds, "test"))
    parts = []
    lines = {n: s for n, s in specs.items() if isinstance(s, Linear)}
    if lines:
        problems = [linear.Problem(n, f.number, s.c, s.l1, s.weights) for n, s in lines.items() for f in folds]
        fits = linear.fit_many(linear.row_blocks(train, "part", "y", "x"), problems, own, width)
        names = F.array(*[F.lit(p.name) for p in problems])
        parts.append(linear.scores_many(test, fits, own).select(F.get(names, F.col("problem")).alias("model"), F.col("part").alias("fold"), "id", "y", "score"))
    grown = {n: s for n, s in specs.items() if not isinstance(s, Linear)}
    if grown:
        layout = trees.fit_bins(train, width)
        rows, asked = trees.tree_blocks(train, layout, ["id", "copy"]), trees.tree_blocks(test, layout, ["id", "copy"])
        by_key = test.select(F.col("part").alias("fold"), "id", "y", F.xxhash64("id", "copy").alias("key"))
        forests = {n: s for n, s in grown.items() if isinstance(s, trees.Forest)}
        found = []
        if forests:
            made = trees.grow_forests(rows, list(forests.values()), own, layout)
            names = F.array(*[F.lit(n) for n in forests])
            found.append(trees.forest_scores(made, asked, own).select(F.get(names, F.col("spec")).alias("model"), F.col("group").alias("fold"), "key", "score"))
        for name, spec in grown.items():
            if isinstance(spec, boosting.Boost):
                scored = boosting.boosted_scores(boosting.boost(rows, spec, layout), asked, own)
                found.append(scored.select(F.lit(name).alias("model"), F.col("group").alias("fold"), "key", "score"))
        parts += [f.join(by_key, ["fold", "key"]).select("model", "fold", "id", "y", "score") for f in found]
    return _union(parts)


def out_of_fold(folds: Sequence[md.Fold], makers: Mapping[str, Maker | Spec | None]) -> DataFrame:
    """(model, fold, id, y, prediction, score) of every model on every fold.

    Specs are fitted on all folds at once, estimators fold by fold.
    """
    parts = []
    specs = {n: m for n, m in makers.items() if isinstance(m, Spec)}
    if specs:
        scored = _out_of_fold_specs(folds, specs)
        parts.append(scored.select("model", "fold", "id", "y", (F.col("score") > 0.5).cast("double").alias("prediction"), "score"))
    for fold in folds:
        fitted = [name for name, maker in makers.items() if maker is not None and name not in specs]
        models = dict(zip(fitted, _fits([makers[name](fold.train_rows) for name in fitted], fold.train))) if fitted else {}
        for name in makers:
            if name in specs:
                continue
            if name not in models:
                scored = md.chance_predictions(fold.test, KEY, LABEL, md.positive_prior(fold.train, LABEL))
            else:
                scored = md.predictions(models[name], fold.test, KEY, LABEL).drop("score_0")
            parts.append(scored.select(F.lit(name).alias("model"), F.lit(fold.number).alias("fold"), "*"))
    return cut(_union(parts))


def compare_models(scored: DataFrame) -> dict[str, DataFrame]:
    """Per-fold scores, their mean and deviation, the pooled report and the confusion counts."""
    per_fold = mt.scores(mt.outcome_counts(scored, ["model", "fold"]), ["model", "fold"])
    names = [c for c in per_fold.columns if c not in ("model", "fold")]
    long = per_fold.unpivot(["model", "fold"], names, "metric", "value")
    pooled = mt.outcome_counts(scored, ["model"])
    return {
        "scores": long,
        "summary": mt.fold_summary(long, "value", ["model", "metric"]),
        "report": mt.class_report(pooled, ["model"]),
        "confusion": pooled,
    }


def cross_validate(folds: Sequence[md.Fold], maker: Maker, parallelism: int = 4) -> DataFrame:
    """(fold, metric, value): recall and F-beta on test and training rows, and seconds spent.

    A few folds at a time fill the cluster between their passes; a fold's seconds are the
    time from the start to the end of its own fit and of its own scoring.
    """

    def run(fold: md.Fold) -> tuple[list, tuple]:
        start = time.perf_counter()
        model = maker(fold.train_rows).fit(fold.train)
        fitted = time.perf_counter()
        # four counts a part, worked out at once so that their time is this fold's own
        tallied = [
            (fold.number, part, *mt.outcome_counts(md.predictions(model, rows, KEY, LABEL)).first())
            for part, rows in (("test", fold.test), ("train", fold.train))
        ]
        return tallied, (fold.number, fitted - start, time.perf_counter() - fitted)

    with ThreadPool(parallelism) as pool:
        done = pool.map(inheritable_thread_target(folds[0].train.sparkSession)(run), folds, chunksize=1)
    counts, seconds = [c for own, _ in done for c in own], [s for _, s in done]
    spark = folds[0].train.sparkSession
    tallied = spark.createDataFrame(counts, "fold int, part string, tp long, fp long, fn long, tn long")
    scores = tallied.select(
        "fold", "part", mt.recall().alias("recall"), mt.f_beta(cb.F_BETA_FOLDS).alias("f_beta")
    ).unpivot(["fold", "part"], ["recall", "f_beta"], "name", "value")
    named = scores.select("fold", F.concat_ws("_", "part", "name").alias("metric"), "value")
    times = spark.createDataFrame(
        [(n, m, s) for n, fit, score in seconds for m, s in (("fit_time", fit), ("score_time", score))],
        "fold int, metric string, value double",
    )
    return named.unionByName(times)


# --- search -----------------------------------------------------------------


def logistic_problems(counts: Mapping[int, Mapping[int, int]], grid: Mapping = cb.LOGISTIC_GRID) -> list[linear.Problem]:
    """The problems of the grid for every fold; `counts` has the rows of each fold by class."""
    out = []
    for fold in counts:
        n = [sum(c.get(label, 0) for f, c in counts.items() if f != fold) for label in (0, 1)]
        for l1, c, w in product(grid["l1_share"], grid["C"], grid["class_weight"]):
            weights = tuple(sum(n) / (2 * max(1, k)) for k in n) if w == "balanced" else (float(w[0]), float(w[1]))
            out.append(linear.Problem(f"{'l1' if l1 == 1.0 else 'l2'} C={c:g} weights={w}", fold, c, l1 == 1.0, weights))
    return out


def fitted_grid(table: DataFrame, columns: Sequence[str], folds: int = cb.FOLDS, grid: Mapping = cb.LOGISTIC_GRID) -> tuple[linear.Fits, DataFrame]:
    """All candidates of the grid fitted without each fold, and the rows (part, id, y, x) by fold."""
    numbered = stratified_folds(table.select(KEY, LABEL, *[named(c) for c in columns]), KEY, LABEL, folds)
    x = F.array(*[named(c).cast("double") for c in columns])
    rows = cut(numbered.select(F.col("fold").alias("part"), F.col(KEY).alias("id"), F.col(LABEL).alias("y"), x.alias("x")))
    counts: dict[int, dict[int, int]] = {f: {} for f in range(folds)}
    # one row per fold and class
    for r in rows.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["part"]][r["y"]] = r["n"]
    others = {f: [g for g in range(folds) if g != f] for f in range(folds)}
    fits = linear.fit_many(linear.row_blocks(rows, "part", "y", "x"), logistic_problems(counts, grid), others, len(columns))
    return fits, rows


def search_logistic(table: DataFrame, columns: Sequence[str], folds: int = cb.FOLDS, grid: Mapping = cb.LOGISTIC_GRID) -> DataFrame:
    """Mean accuracy (micro F1) of each penalty, C and class weight over the folds."""
    fits, rows = fitted_grid(table, columns, folds, grid)
    blocks = linear.row_blocks(rows, "part", "y", "x")
    counted = linear.outcome_counts_many(blocks, fits, {f: [f] for f in range(folds)})
    names = table.sparkSession.createDataFrame([(i, p.name, p.group) for i, p in enumerate(fits.problems)], "problem int, candidate string, fold int")
    return _ranked_candidates(counted.join(F.broadcast(names), "problem"), mt.accuracy())


def search_forest(table: DataFrame, columns: Sequence[str], folds: int = cb.FOLDS, grid: Mapping = cb.FOREST_GRID) -> DataFrame:
    """Mean recall of each depth, split bound, leaf size and tree count, balanced inside the folds.

    One forest is grown for each leaf size, with the most trees and the deepest; the other
    candidates are read off its first trees and upper nodes.
    """
    prepared = md.prepared_folds(table, KEY, LABEL, columns, folds, scale=True)
    own = {f.number: [f.number] for f in prepared}
    train = cut(_fold_rows(prepared, "train"))
    layout = trees.fit_bins(train, len(columns))
    rows = trees.tree_blocks(train, layout, ["id", "copy"])
    asked = trees.tree_blocks(_fold_rows(prepared, "test"), layout, ["id", "copy"])
    splits = grid.get("min_split", [2])
    whole = trees.Forest("", max(grid["trees"]), max(grid["max_depth"]), 1, min(splits))
    specs = [replace(whole, name=f"leaf={leaf}", leaf=leaf) for leaf in grid["min_leaf"]]
    variants = list(product(grid["max_depth"], splits))
    grown = trees.grow_forests(rows, specs, own, layout)
    counted = trees.candidate_counts(grown, asked, own, variants, grid["trees"])
    leaf = F.get(F.array(*[F.lit(s.name) for s in specs]), F.col("spec"))
    shape = F.get(F.array(*[F.lit(f"depth={d} split={s}") for d, s in variants]), F.col("variant"))
    named_counts = counted.select(
        F.concat_ws(" ", shape, leaf, F.concat(F.lit("trees="), F.col("trees"))).alias("candidate"), F.col("group").alias("fold"), "tp", "fp", "fn", "tn"
    )
    return _ranked_candidates(named_counts, mt.recall())


def _ranked_candidates(counts: DataFrame, value) -> DataFrame:
    scored = counts.select("candidate", "fold", value.alias("value"))
    return mt.fold_summary(scored, "value", ["candidate"])


class MetricEvaluator(Evaluator):
    """A metric column over outcome counts as an evaluator, e.g. `mt.f_beta(4.0)`."""

    def __init__(self, metric, label: str = LABEL):
        super().__init__()
        self.metric, self.label = metric, label

    def _evaluate(self, dataset: DataFrame) -> float:
        return mt.outcome_counts(dataset, y=self.label).select(self.metric.alias("value")).first()["value"]

    def isLargerBetter(self) -> bool:
        return True

    def copy(self, extra=None):
        return MetricEvaluator(self.metric, self.label)


def choose_c(
    table: DataFrame, columns: Sequence[str], folds: int = cb.FOLDS, c_values: Sequence[float] = tuple(cb.CHOSEN_C_VALUES),
    evaluator: Evaluator | None = None, parallelism: int = 4,
):
    """L1 logistic regression on balanced rows, C chosen by cross-validation.

    Returns the fitted validator, whose model has seen all the balanced rows.
    """
    _, ready = md.BalancedClassifier(keyCol=KEY, labelCol=LABEL, inputCols=list(columns)).prepare(table)
    keyed = ready.withColumn("row", F.concat_ws("/", F.col(KEY).cast("string"), F.col("copy").cast("string")))
    numbered = cut(stratified_folds(keyed.select("row", LABEL, "features"), "row", LABEL, folds, 12))
    rows = numbered.count() * (folds - 1) / folds
    estimator = md.tuned_logistic(LABEL, int(rows))
    penalties = [md.penalty_for(c, rows * cb.CLASS_WEIGHTS[0]) for c in c_values]
    validator = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=ParamGridBuilder().addGrid(estimator.regParam, penalties).build(),
        evaluator=evaluator or MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy"),
        foldCol="fold",
        numFolds=folds,
        parallelism=parallelism,
    )
    if evaluator is not None:
        return validator.fit(numbered)
    values = fold_accuracies(numbered, penalties, len(columns), folds)
    means = values.mean(axis=1)
    best = estimator.fit(numbered, {estimator.regParam: penalties[int(means.argmax())]})
    return validator._copyValues(CrossValidatorModel(best, means.tolist(), stdMetrics=values.std(axis=1).tolist()))


def fold_accuracies(numbered: DataFrame, penalties: Sequence[float], features: int, folds: int) -> np.ndarray:
    """Accuracy by penalty and fold of L1 fits on the other folds of (label, features, fold).

    The fits of all folds and penalties share their passes over the rows.
    """
    # one row per fold
    counts = {r["fold"]: r["count"] for r in numbered.groupBy("fold").count().collect()}
    if any(f not in counts for f in range(folds)):
        raise ValueError("a fold has no rows")
    total = sum(counts.values())
    # a penalty on the mean loss is one on the summed loss times the rows
    problems = [
        linear.Problem(f"penalty={s:g}", f, 1.0 / (s * (total - counts[f])), True) for s in penalties for f in range(folds)
    ]
    plain = numbered.select(F.col("fold").alias("part"), F.col(LABEL).alias("y"), vector_to_array("features").alias("x"))
    blocks = linear.row_blocks(plain, "part", "y", "x")
    others = {f: [g for g in range(folds) if g != f] for f in range(folds)}
    fits = linear.fit_many(blocks, problems, others, features)
    counted = linear.outcome_counts_many(blocks, fits, {f: [f] for f in range(folds)}).select("problem", mt.accuracy().alias("value"))
    values = np.zeros(len(problems))
    # one row per problem
    for r in counted.collect():
        values[r["problem"]] = r["value"]
    return values.reshape(len(penalties), folds)


def chosen_c_table(spark: SparkSession, validator, c_values: Sequence[float]) -> DataFrame:
    """(c, accuracy) of the validated values."""
    return spark.createDataFrame(list(zip(map(float, c_values), map(float, validator.avgMetrics))), "c double, accuracy double")


def ablation(table: DataFrame, columns: Sequence[str], makers: Mapping[str, Maker | None]) -> DataFrame:
    """(features, model, roc_auc) on the held-out rows for three feature groups."""
    train, test = table.where(~F.col("is_test")), table.where("is_test")
    parts = []
    for group, names in feature_groups(columns).items():
        chain = md.BalancedClassifier(keyCol=KEY, labelCol=LABEL, inputCols=names)
        stages, ready = chain.prepare(train)
        rows = ready.count()
        for name, maker in makers.items():
            if maker is None:
                scored = md.chance_predictions(test, KEY, LABEL, md.positive_prior(ready, LABEL), 42)
            else:
                model = PipelineModel([*stages, maker(rows).fit(ready)])
                scored = md.predictions(model, test, KEY, LABEL).drop("score_0")
            area = mt.roc_auc(mt.score_steps(scored))
            parts.append(area.select(F.lit(group).alias("features"), F.lit(name).alias("model"), "roc_auc"))
    return _union(parts)
