"""Classifiers, the balanced fit chain, and predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, functions as F

from panelforge.functions import codebook as cb
from panelforge.functions.keyed import keyed_uniform, named
from panelforge.operators.balance import oversampled
from panelforge.operators.encode import moments, sql_literal
from panelforge.operators.split import stratified_folds
from panelforge.session import cut

WEIGHT = "weight"


def class_weight(label: str, weights: Mapping[int, float]):
    """Row weight from the class."""
    return F.when(F.col(label) == 1, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0])))


def balanced_weights(df: DataFrame, label: str) -> dict[int, float]:
    """n / (2 * n_class): both classes weigh the same in total."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def penalty_for(c: float, total_weight: float) -> float:
    """The penalty strength that gives the same optimum as cost C on summed losses."""
    return 1.0 / (c * total_weight)


def logistic(
    label: str, total_weight: float, c: float = 1.0, l1: bool = False, weighted: bool = False, max_iter: int = 3000
) -> LogisticRegression:
    """Logistic regression at cost C. The penalty leaves the intercept out."""
    model = LogisticRegression(
        labelCol=label,
        elasticNetParam=1.0 if l1 else 0.0,
        regParam=penalty_for(c, total_weight),
        standardization=False,
        maxIter=max_iter,
    )
    return model.setWeightCol(WEIGHT) if weighted else model


def tuned_logistic(label: str, rows: int, c: float = cb.LOGISTIC_C) -> LogisticRegression:
    """L1 at the tuned C. Both classes weigh 0.5, so the total weight is half the rows."""
    return logistic(label, rows * cb.CLASS_WEIGHTS[0], c, l1=True)


def forest(label: str, trees: int = cb.FOREST_TREES, depth: int = cb.FOREST_DEPTH, leaf: int = cb.FOREST_LEAF) -> RandomForestClassifier:
    """Gini forest. A leaf of three implies splits of six, so a split bound of four is met."""
    return RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf,
        featureSubsetStrategy="sqrt", impurity="gini", seed=42,
    )


def boosted_trees(label: str, rounds: int = 100) -> GBTClassifier:
    """Boosting by levels at the usual step size; `boosting.Boost` grows its trees by leaf."""
    return GBTClassifier(labelCol=label, maxIter=rounds, stepSize=0.1, maxDepth=5, seed=42)


def chance_predictions(df: DataFrame, key: str, label: str, prior: float, seed=2) -> DataFrame:
    """Random classes at the frequency seen in training; the score is the drawn class."""
    drawn = F.when(keyed_uniform(key, seed) < F.lit(prior), 1.0).otherwise(0.0)
    return df.select(F.col(key).alias("id"), F.col(label).alias("y"), drawn.alias("prediction"), drawn.alias("score"))


def positive_prior(df: DataFrame, label: str) -> float:
    return df.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]


def predictions(model, df: DataFrame, key: str, label: str, said: str = "prediction") -> DataFrame:
    """(id, y, prediction, score_0, score) where score is the probability of class 1."""
    shares = vector_to_array("probability")
    return model.transform(df).select(
        F.col(key).alias("id"), F.col(label).alias("y"), F.col(said).alias("prediction"), shares[0].alias("score_0"), shares[1].alias("score")
    )


def slots(columns: Sequence[str]) -> list[str]:
    """Names without special characters for features, by position."""
    return [f"feature_{i}" for i in range(len(columns))]


def feature_stages(df: DataFrame, columns: Sequence[str], scale: bool) -> list:
    """Features into numbered slots, scaled on request, and slots into a vector.

    Scaling takes one aggregate row and becomes plain SQL text, so the stages are
    stored without any Python.
    """
    names = slots(columns)
    if scale:
        fitted = moments(df, columns)
        terms = [
            f"(`{c}` - {sql_literal(float(fitted[c][0]))}) / {sql_literal(float(fitted[c][1]) or 1.0)}" for c in columns
        ]
    else:
        terms = [f"CAST(`{c}` AS DOUBLE)" for c in columns]
    picked = ", ".join(f"{t} AS {n}" for t, n in zip(terms, names))
    return [
        SQLTransformer(statement=f"SELECT *, {picked} FROM __THIS__"),
        VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"),
    ]


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` with the columns as a `features` vector."""
    return PipelineModel(feature_stages(df, columns, False)).transform(df).drop(*slots(columns))


class BalancedClassifier(Estimator):
    """Scale, balance and fit. Rows are balanced while fitting only.

    The fitted result is a plain pipeline of the scaling, the assembly and the
    classifier, so scoring never adds rows and the model is stored natively.
    `classifier` is an estimator or a function of the balanced row count. The
    training rows are read twice: pass a written or cached table.
    """

    keyCol = Param(Params._dummy(), "keyCol", "row key", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    neighbours = Param(Params._dummy(), "neighbours", "neighbours per row for synthetic rows", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the synthetic rows", TypeConverters.toInt)
    scale = Param(Params._dummy(), "scale", "scale the features first", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, keyCol="id", labelCol="label", inputCols=(), classifier=None, neighbours=5, seed=33, scale=True):
        super().__init__()
        self.classifier = classifier
        given = {k: v for k, v in self._input_kwargs.items() if k != "classifier"}
        given["inputCols"] = list(given.get("inputCols", ()))
        self._setDefault(keyCol="id", labelCol="label", neighbours=5, seed=33, scale=True)
        self._set(**given)

    def copy(self, extra=None):
        other = super().copy(extra)
        if isinstance(self.classifier, Estimator):
            other.classifier = self.classifier.copy(extra)
        return other

    def prepare(self, dataset: DataFrame) -> tuple[list, DataFrame]:
        """The fitted stages in front of the classifier, and the balanced training rows.

        A row is named by its key and `copy`, which is 0 for the original.
        """
        key, label = self.getOrDefault("keyCol"), self.getOrDefault("labelCol")
        columns = self.getOrDefault("inputCols")
        stages = feature_stages(dataset, columns, self.getOrDefault("scale"))
        filled = cut(stages[0].transform(dataset).select(key, label, *slots(columns)))
        balanced = oversampled(
            filled, key, label, slots(columns), self.getOrDefault("neighbours"), self.getOrDefault("seed")
        )
        # Even partitions for the many passes of a fit.
        return stages, cut(stages[1].transform(balanced).select(key, "copy", label, "features").hint("rebalance"))

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        stages, train = self.prepare(dataset)
        classifier = self.classifier
        if not isinstance(classifier, Estimator):
            classifier = classifier(train.count())
        return PipelineModel([*stages, classifier.fit(train)])


@dataclass(frozen=True)
class Fold:
    """One fold, prepared once and read by every model."""

    number: int
    train: DataFrame
    train_rows: int
    test: DataFrame


def prepared_folds(
    df: DataFrame, key: str, label: str, columns: Sequence[str], folds: int = cb.FOLDS, seed=42,
    scale: bool = False, balance: bool = True,
) -> list[Fold]:
    """Stratified folds with balanced training rows, each written once.

    Balancing is the costly step, so it runs once per fold and not once per model. A few
    folds at a time fill the cluster between their passes.
    """
    numbered = cut(stratified_folds(df.select(key, label, *[named(c) for c in columns]), key, label, folds, seed))

    def prepare(i: int) -> Fold:
        train, test = numbered.where(F.col("fold") != i), numbered.where(F.col("fold") == i)
        if balance:
            chain = BalancedClassifier(keyCol=key, labelCol=label, inputCols=list(columns), scale=scale)
            stages, ready = chain.prepare(train)
        else:
            stages = feature_stages(train, columns, scale)
            ready = cut(PipelineModel(stages).transform(train).select(key, label, "features").hint("rebalance"))
        scored = PipelineModel(stages).transform(test).select(key, label, "features")
        return Fold(i, ready, ready.count(), cut(scored))

    with ThreadPool(4) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(prepare), range(folds), chunksize=1)
