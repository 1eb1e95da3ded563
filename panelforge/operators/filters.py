"""Row filters and constant fills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.functions.recode import is_not_code


def not_refused(codes: Sequence[tuple[str, float]]) -> Column:
    """One conjunction over all refusal codes; rows without an answer pass."""
    return reduce(lambda a, b: a & b, [is_not_code(c, float(v)) for c, v in codes])


def without_refusals(df: DataFrame, codes: Sequence[tuple[str, float]]) -> DataFrame:
    return df.where(not_refused(codes))


def answered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def below(df: DataFrame, column: str, bound: float) -> DataFrame:
    """Rows under a bound. Null and NaN both fail the test."""
    return df.where(F.col(column) < bound)


def without_value(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(is_not_code(column, value))


def one_of(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def filled(df: DataFrame, values: Mapping) -> DataFrame:
    return df.fillna(dict(values))


def share_of(column: str, value) -> Column:
    """Share of rows that hold a value, as an aggregate."""
    return F.avg((F.col(column) == F.lit(value)).cast("double"))
