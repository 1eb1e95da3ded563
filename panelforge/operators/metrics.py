"""Classification metrics as aggregates over (y, prediction, score) rows.

Everything starts from one grouped pass: four counts for the metrics of classes,
one row per distinct score for the curves. `by` repeats a metric per group, for
example per model and fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.functions.recode import percent_over
from panelforge.operators.profile import cross_table
from panelforge.operators.ranks import in_order


def _count(test: Column, name: str) -> Column:
    return F.coalesce(F.sum(test.cast("long")), F.lit(0)).alias(name)


def _ratio(part: Column, whole: Column) -> Column:
    """Zero instead of an error where nothing was predicted or present."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def outcome_counts(df: DataFrame, by: Sequence[str] = (), y: str = "y", prediction: str = "prediction") -> DataFrame:
    """tp, fp, fn, tn with class 1 as the positive class."""
    actual, predicted = F.col(y) == 1, F.col(prediction) == 1
    return df.groupBy(*by).agg(
        _count(actual & predicted, "tp"),
        _count(~actual & predicted, "fp"),
        _count(actual & ~predicted, "fn"),
        _count(~actual & ~predicted, "tn"),
    )


def confusion_matrix(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    return cross_table(df.withColumn(prediction, F.col(prediction).cast("int")), y, prediction, [0, 1])


def precision() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def f_beta(beta: float) -> Column:
    weight = beta * beta
    hits = (1 + weight) * F.col("tp")
    return _ratio(hits, hits + weight * F.col("fn") + F.col("fp"))


def accuracy() -> Column:
    return _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))


def class_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class from outcome counts."""
    sides = F.array(
        F.struct(F.lit(0).alias("class"), F.col("tn").alias("hit"), F.col("fn").alias("wrong"), F.col("fp").alias("missed")),
        F.struct(F.lit(1).alias("class"), F.col("tp").alias("hit"), F.col("fp").alias("wrong"), F.col("fn").alias("missed")),
    )
    each = counts.select(*by, F.inline(sides))
    hit, wrong, missed = F.col("hit"), F.col("wrong"), F.col("missed")
    return each.select(
        *by,
        "class",
        _ratio(hit, hit + wrong).alias("precision"),
        _ratio(hit, hit + missed).alias("recall"),
        _ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
        (hit + missed).alias("support"),
    )


def report_averages(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro and support-weighted averages over a class report."""
    names = ["precision", "recall", "f1"]
    total = F.sum("support")
    flat = report.groupBy(*by).agg(
        *[F.avg(n).alias(f"macro_{n}") for n in names],
        *[(F.sum(F.col(n) * F.col("support")) / total).alias(f"weighted_{n}") for n in names],
        total.alias("support"),
    )
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("average"), *[F.col(f"{kind}_{n}").alias(n) for n in names], F.col("support"))
            for kind in ("macro", "weighted")
        ]
    )
    return flat.select(*by, F.inline(kinds))


def scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The single-number metrics: accuracy, recall, micro, weighted and beta F."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1_zero, f1_one = _ratio(2 * tn, 2 * tn + fn + fp), _ratio(2 * tp, 2 * tp + fp + fn)
    return counts.select(
        *by,
        accuracy().alias("accuracy"),
        accuracy().alias("micro_f1"),
        precision().alias("precision"),
        recall().alias("recall"),
        f_beta(1.0).alias("f1"),
        f_beta(4.0).alias("f_beta_4"),
        f_beta(5.0).alias("f_beta_5"),
        ((f1_zero * (tn + fp) + f1_one * (tp + fn)) / (tp + fp + fn + tn)).alias("weighted_f1"),
    )


def score_steps(df: DataFrame, y: str = "y", score: str = "score", pos_label: int = 1) -> DataFrame:
    """One row per distinct score, high to low, with running class counts.

    The grouping comes first, so tied scores are combined on the map side and a
    score shared by a third of all rows is still a single row afterwards.
    """
    positive = F.col(y) == F.lit(pos_label)
    grouped = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        _count(positive, "pos"), _count(~positive, "neg")
    )
    return in_order(grouped, F.col("threshold").desc(), running=["pos", "neg"])


def roc_curve(steps: DataFrame) -> DataFrame:
    """(threshold, tpr, fpr); the start point has the highest threshold plus one."""
    points = steps.select(
        "threshold",
        _ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
        _ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
    )
    start = steps.agg((F.max("threshold") + 1).alias("threshold")).select(
        "threshold", F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")
    )
    return points.unionByName(start)


def roc_auc(steps: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties by half."""
    above = F.col("cum_pos") - F.col("pos")
    area = F.sum(F.col("neg") * (above + F.col("pos") / 2))
    return steps.agg((area / (F.max("total_pos") * F.max("total_neg"))).alias("roc_auc"))


def precision_recall_curve(steps: DataFrame, stop_at_full_recall: bool = True) -> DataFrame:
    """(threshold, precision, recall) and the end point (null, 1, 0).

    Points below the threshold that first reaches full recall add nothing and
    are left out unless asked for.
    """
    points = steps
    if stop_at_full_recall:
        points = steps.where(F.col("cum_pos") - F.col("pos") < F.col("total_pos"))
    curve = points.select(
        "threshold",
        _ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        _ratio(F.col("cum_pos"), F.col("total_pos")).alias("recall"),
    )
    end = steps.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return curve.unionByName(end)


def threshold_table(curve: DataFrame) -> DataFrame:
    """The curve without its end point, for plots over the threshold."""
    return curve.where("threshold is not null")


def average_precision(steps: DataFrame) -> DataFrame:
    """Sum of recall steps times precision. Not the trapezoid area under the curve."""
    share = F.col("pos") / F.col("total_pos")
    level = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return steps.agg(F.sum(share * level).alias("average_precision"))


def explained_variance(df: DataFrame, by: Sequence[str] = (), y: str = "y", prediction: str = "prediction") -> DataFrame:
    gap = F.col(y).cast("double") - F.col(prediction)
    return df.groupBy(*by).agg(
        (1 - F.var_pop(gap) / F.nullif(F.var_pop(F.col(y).cast("double")), F.lit(0.0))).alias("explained_variance")
    )


def reference_lines(df: DataFrame, y: str = "y") -> DataFrame:
    """The no-skill and the perfect line of a precision-recall plot."""
    base = df.agg(F.avg((F.col(y) == 1).cast("double")).alias("base"))
    point = lambda line, order, x, v: F.struct(
        F.lit(line).alias("line"), F.lit(order).alias("point"), F.lit(x).alias("recall"), v.alias("precision")
    )
    points = F.array(
        point("no skill", 1, 0.0, F.col("base")),
        point("no skill", 2, 1.0, F.col("base")),
        point("perfect", 1, 0.0, F.lit(1.0)),
        point("perfect", 2, 1.0, F.lit(1.0)),
        point("perfect", 3, 1.0, F.col("base")),
    )
    return base.select(F.inline(points))


def lift_over(df: DataFrame, model: str, score: str, baseline: str) -> DataFrame:
    """Percent difference of each model's score to the baseline model's."""
    base = df.where(F.col(model) == baseline).select(F.max(score)).scalar()
    others = df.where(~F.col(model).eqNullSafe(F.lit(baseline)))
    return others.select(model, percent_over(F.col(score), base).alias("lift_percent"))


def fold_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over folds."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))


def pooled_counts(df: DataFrame, by: Sequence[str], fold: str = "fold") -> DataFrame:
    """Outcome counts added up over folds 1..i; the last fold holds the total."""
    so_far = Window.partitionBy(*by).orderBy(fold).rowsBetween(Window.unboundedPreceding, 0)
    return outcome_counts(df, [*by, fold]).select(
        *by, fold, *[F.sum(c).over(so_far).alias(c) for c in ("tp", "fp", "fn", "tn")]
    )
