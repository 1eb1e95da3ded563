"""Recoding expressions: labels, brackets, flags and scalar helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F

from panelforge.functions.keyed import as_column


def is_not_code(column, code) -> Column:
    """True unless the value equals the code. A missing value counts as different."""
    return ~as_column(column).eqNullSafe(F.lit(code))


def labelled(column, labels: Mapping, passthrough: bool = True) -> Column:
    """Look a value up in a dictionary; a value without an entry stays as text."""
    value = as_column(column)
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(str(v))) for k, v in labels.items()))
    found = table[value]
    return F.coalesce(found, value.cast("string")) if passthrough else found


def labelled_code(column, labels: Mapping) -> Column:
    """`labelled` for numeric survey codes, which arrive as doubles."""
    return labelled(as_column(column).cast("double"), {float(k): v for k, v in labels.items()})


def merged_labels(labels: Mapping, merge: Mapping) -> dict:
    """Compose two passes over the same column into one dictionary."""
    return {code: merge.get(label, label) for code, label in labels.items()}


def bracketed(column, brackets: Mapping[str, Sequence], what: str = "value") -> Column:
    """Many codes to one label. A code outside every bracket is an error, a null stays null."""
    value = as_column(column)
    picked = None
    for label, codes in brackets.items():
        test = value.isin(*codes)
        picked = F.when(test, label) if picked is None else picked.when(test, label)
    message = F.concat(F.lit(f"no bracket for {what} "), value.cast("string"))
    return picked.when(value.isNull(), F.lit(None)).otherwise(F.raise_error(message))


def either_is(first, second, code, yes: str, no: str) -> Column:
    """`yes` when one of two columns holds the code; a missing answer counts as no."""
    hit = as_column(first).eqNullSafe(F.lit(code)) | as_column(second).eqNullSafe(F.lit(code))
    return F.when(hit, yes).otherwise(no)


def ranked(column, ranks: Mapping[str, int]) -> Column:
    """Ordinal label to rank as double; text that already is a number passes through."""
    value = as_column(column)
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in ranks.items()))
    return F.coalesce(table[value], value.try_cast("double"))


def whole_number(column) -> Column:
    """Integer cast that gives null on dirty text. Numbers written as 2015.0 are accepted."""
    return as_column(column).try_cast("double").try_cast("int")


def default_text(column, default: str) -> Column:
    value = as_column(column)
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def zero_if_undefined(column) -> Column:
    """Zero for null and NaN, as for the correlation of a constant column."""
    value = as_column(column)
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def correlation(first, second) -> Column:
    """Pearson correlation as an aggregate; null for a constant column."""
    a, b = as_column(first), as_column(second)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def is_positive(column) -> Column:
    return as_column(column) > 0


def sign_colour(column) -> Column:
    return F.when(as_column(column) > 0, "red").otherwise("blue")


def percent_over(value, base) -> Column:
    return (as_column(value) / as_column(base) - 1) * 100


def root_of_negated(column) -> Column:
    """sqrt(-x); NaN where x is positive."""
    return F.sqrt(-as_column(column))


def mean_with_deviation(mean, deviation) -> Column:
    return F.format_string("%.3f +/- %.2f", as_column(mean), as_column(deviation))
