"""Counts, summaries, ordering and sampling of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.functions.keyed import keyed_hash


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for several columns in one pass, most frequent first, without missing values."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot([], list(columns), "column", "value")
    counts = long.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("column", F.desc("n"), "value")


def distinct_with_null(column: str) -> Column:
    """Distinct count in which null is one more value."""
    return F.count_distinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def cross_table(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of row value by column value; the column values are given, not searched."""
    return df.groupBy(row).pivot(column, list(values)).count().fillna(0)


def per_column(df: DataFrame, columns: Sequence[str], value: str = "value", **aggregates) -> DataFrame:
    """One row per column with several aggregates, computed in one pass.

    Each keyword is a function name -> aggregate, e.g. `var=F.var_samp`.
    """
    flat = df.agg(*[fn(F.col(c)).alias(f"{name}__{i}") for i, c in enumerate(columns) for name, fn in aggregates.items()])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"{name}__{i}").alias(name) for name in aggregates])
            for i, c in enumerate(columns)
        ]
    )
    return flat.select(F.inline(rows))


def zipped(df: DataFrame, **lists) -> DataFrame:
    """Rows out of parallel array columns."""
    return df.select(F.inline(F.arrays_zip(*[F.col(c).alias(n) for n, c in lists.items()])))


def ordered(df: DataFrame, column: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    first = F.col(column).desc() if descending else F.col(column).asc()
    return df.orderBy(first, *([tie] if tie else []))


def largest(df: DataFrame, column: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(column).desc(), tie).limit(k)


def keyed_sample(df: DataFrame, key: str, n: int, seed) -> DataFrame:
    """n rows chosen by a keyed hash. Each task keeps n rows, then those are merged."""
    return df.orderBy(keyed_hash(key, seed), key).limit(n)


def long_scores(df: DataFrame, keep: str, columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keep, list(columns), name, value)
