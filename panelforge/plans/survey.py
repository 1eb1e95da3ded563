"""Coded survey to labelled analysis table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelforge.functions import codebook as cb
from panelforge.functions.recode import bracketed, either_is, labelled_code, merged_labels
from panelforge.operators.columns import copied, renamed, reordered
from panelforge.operators.filters import filled, without_refusals

KEY = "respondent_id"


def named_answers(raw: DataFrame) -> DataFrame:
    """Source codes under readable names. Every value comes from its own row."""
    present = {c: n for c, n in cb.SURVEY_NAMES.items() if c in raw.columns or c != "age2"}
    return copied(raw, {**present, **{c: c for c in cb.SURVEY_KEPT}}, keep=[KEY])


def with_target(df: DataFrame) -> DataFrame:
    return df.withColumn(
        cb.TARGET, either_is("stopped_taking", "didnt_fill_rx", 1.0, cb.NON_ADHERENT, cb.ADHERENT)
    )


def coded_answers(raw: DataFrame) -> DataFrame:
    """Valid respondents with the target, still coded: 26 columns and the key."""
    named = filled(named_answers(raw), {"have_medicare": cb.MEDICARE_NOT_ELIGIBLE})
    valid = with_target(without_refusals(named, cb.REFUSED_CODES))
    return reordered(valid, [KEY, *cb.SURVEY_CLEAN])


def labelled_answers(coded: DataFrame) -> DataFrame:
    """Codes to labels, in one projection."""

    def value(name: str):
        if name == "income":
            return bracketed("income", cb.INCOME_BRACKETS, "income").alias(name)
        if name in cb.LABELS:
            labels = merged_labels(cb.LABELS[name], cb.MERGED_LABELS.get(name, {}))
            return labelled_code(name, labels).alias(name)
        return F.col(name)

    return renamed(coded.select(KEY, *[value(c) for c in cb.SURVEY_CLEAN]), cb.SURVEY_RENAMED)


def clean_survey(raw: DataFrame) -> DataFrame:
    return labelled_answers(coded_answers(raw))
