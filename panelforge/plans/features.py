"""Clean survey to a numeric design table, as a fitted and storable pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, functions as F

from panelforge.functions import codebook as cb
from panelforge.functions.keyed import named
from panelforge.operators.columns import drop_columns, feature_group
from panelforge.operators.encode import moments, require_levels, sql_literal
from panelforge.operators.filters import below
from panelforge.operators.impute import impute_in_order
from panelforge.operators.split import stratified_holdout
from panelforge.session import cut

KEY = "respondent_id"
LABEL = "label"


def with_label(clean: DataFrame) -> DataFrame:
    """0 = adherent, 1 = not: the sorted order of the two labels."""
    return clean.withColumn(LABEL, F.when(F.col(cb.TARGET) == cb.NON_ADHERENT, 1).otherwise(0)).drop(cb.TARGET)


def modelling_rows(clean: DataFrame, max_prescriptions: float | None = cb.MAX_PRESCRIPTIONS) -> DataFrame:
    """Label and features; the forest variant passes no bound."""
    kept = clean if max_prescriptions is None else below(clean, "n_prescriptions", max_prescriptions)
    return with_label(kept)


def imputed_rows(rows: DataFrame, mask: str = "column", fit_on: str = "train") -> DataFrame:
    """The six gaps filled in order. The label takes no part in the distances.

    Answers come from the training rows of `design_table`'s split, which depends on keys
    and labels only; with `fit_on='all'` held-out rows give answers too. A column without
    a gap is left as it is.
    """
    if fit_on not in ("train", "all"):
        raise ValueError(f"unknown fit_on {fit_on!r}")
    features = [c for c in rows.columns if c not in (KEY, LABEL)]
    present = {r["column"] for r in _gap_counts(rows).collect() if r["n"]}
    steps = [s for s in cb.IMPUTE_STEPS if s[0] in present]
    if fit_on == "all":
        return impute_in_order(rows, KEY, steps, features, mask=mask)
    split = stratified_holdout(rows, KEY, LABEL, cb.TEST_SHARE).withColumn("__train", ~F.col("is_test")).drop("is_test")
    return impute_in_order(split, KEY, steps, features, mask=mask, donors="__train").drop("__train")


def _gap_counts(rows: DataFrame) -> DataFrame:
    """(column, n) of the values marked as missing: one row per imputed column."""
    flat = rows.agg(*[F.sum((F.col(c) == F.lit(v)).cast("long")).alias(c) for c, v in cb.IMPUTE_STEPS])
    names = [c for c, _ in cb.IMPUTE_STEPS]
    return flat.unpivot([], names, "column", "n")


@dataclass(frozen=True)
class Design:
    """Fitted preprocessing and the names of the columns it makes.

    The input features are replaced by the design columns; all others stay.
    """

    model: PipelineModel
    columns: list[str]

    def apply(self, df: DataFrame, keep: Sequence[str] = (KEY, LABEL)) -> DataFrame:
        return self.model.transform(df).select(*keep, *[named(c) for c in self.columns])


def fit_design(
    rows: DataFrame,
    numeric: Sequence[str] = tuple(cb.NUMERIC_FEATURES),
    ordinal: Sequence[str] = tuple(cb.ORDINAL_FEATURES),
    categorical: Sequence[str] = tuple(cb.CATEGORICAL_FOR_LOGISTIC),
    passthrough: Sequence[str] = (),
) -> Design:
    """Scale the numeric, rank the ordinal and one-hot the categorical features.

    Fitting reads two aggregate rows: means with deviations, and category levels.
    The fitted stage is SQL text, so a stored model needs no Python to run.
    """
    fitted = moments(rows, numeric)
    found = require_levels(rows, categorical)
    terms = {}
    for c in numeric:
        mean, deviation = fitted[c]
        terms[c] = f"(`{c}` - {sql_literal(float(mean))}) / {sql_literal(float(deviation) or 1.0)}"
    for c in ordinal:
        arms = " ".join(f"WHEN {sql_literal(k)} THEN {float(r)}D" for k, r in cb.ORDINAL_RANKS[c].items())
        terms[c] = f"coalesce(CASE `{c}` {arms} END, try_cast(`{c}` AS DOUBLE))"
    for c in categorical:
        for level in sorted(found[c])[1:]:
            terms[f"{c}_{level}"] = f"CAST(`{c}` <=> {sql_literal(level)} AS DOUBLE)"
    for c in passthrough:
        terms[c] = f"CAST(`{c}` AS DOUBLE)"
    used = ", ".join(f"`{c}`" for c in [*numeric, *ordinal, *categorical, *passthrough])
    made = ", ".join(f"{sql} AS `{name.replace('`', '``')}`" for name, sql in terms.items())
    stage = SQLTransformer(statement=f"SELECT * EXCEPT ({used}), {made} FROM __THIS__")
    return Design(PipelineModel([stage]), list(terms))


def design_table(
    rows: DataFrame, fit_on: str = "train", drop: Sequence[str] = tuple(cb.DROPPED_FOR_LOGISTIC), **kinds
) -> tuple[DataFrame, list[str]]:
    """(key, label, is_test, features...) as a written table, and the feature names.

    Preprocessing is fitted on the training rows. `fit_on='all'` uses every row,
    which lets test rows shape the scaling.
    """
    if fit_on not in ("train", "all"):
        raise ValueError(f"unknown fit_on {fit_on!r}")
    split = cut(stratified_holdout(drop_columns(rows, drop), KEY, LABEL, cb.TEST_SHARE))
    source = split if fit_on == "all" else split.where(~F.col("is_test"))
    design = fit_design(source, **kinds)
    return cut(design.apply(split, (KEY, LABEL, "is_test"))), design.columns


def feature_groups(columns: Sequence[str]) -> dict[str, list[str]]:
    """The three column groups of the ablation."""
    return {
        "all": list(columns),
        "demographic": feature_group(columns, cb.DEMOGRAPHIC_FEATURES),
        "health": feature_group(columns, cb.HEALTH_FEATURES),
    }


