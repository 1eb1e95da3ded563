"""Stratified hold-out, folds and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelforge.functions.keyed import keyed_uniform, named
from panelforge.operators.ranks import hashed_rank


def stratified_holdout(df: DataFrame, key: str, label: str, share: float = 0.2, seed=42) -> DataFrame:
    """Add `is_test`: exactly ceil(share * n) rows of every class."""
    ranked = hashed_rank(df, key, seed, by=[label], out="__position", total="__n")
    return ranked.select(*[named(c) for c in df.columns], (F.col("__position") <= F.ceil(F.col("__n") * share)).alias("is_test"))


def threshold_holdout(df: DataFrame, key: str, share: float = 0.2, seed=42) -> DataFrame:
    """Add `is_test` without any shuffle; class shares hold in expectation only."""
    return df.withColumn("is_test", keyed_uniform(key, seed) < share)


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 10, seed=42) -> DataFrame:
    """Add `fold` 0..folds-1; per class the fold sizes differ by at most one."""
    ranked = hashed_rank(df, key, seed, by=[label], out="__position")
    return ranked.select(*[named(c) for c in df.columns], F.pmod(F.col("__position") - 1, F.lit(folds)).cast("int").alias("fold"))
