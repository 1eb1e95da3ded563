"""Projections: named and positional column choices with checked names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {', '.join(missing)}")


def lower_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def drop_columns(df: DataFrame, names: Sequence[str], strict: bool = True) -> DataFrame:
    """Drop by name. Spark ignores unknown names, so `strict` checks them first."""
    if strict:
        require_columns(df, names)
    return df.drop(*names)


def column_slice(df: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    return df.select(*df.columns[start:stop])


def reordered(df: DataFrame, names: Sequence[str]) -> DataFrame:
    require_columns(df, names)
    return df.select(*names)


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    require_columns(df, list(names))
    return df.withColumnsRenamed(dict(names))


def new_header(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def copied(df: DataFrame, names: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Pick source columns under readable names in a single projection."""
    require_columns(df, [*keep, *names])
    return df.select(*keep, *[F.col(code).alias(name) for code, name in names.items()])


def replaced(df: DataFrame, name: str, value: Column, position: int | None = None) -> DataFrame:
    """Replace a column, by default where it stands, else at a given position."""
    out = df.withColumn(name, value)
    if position is None:
        return out
    others = [c for c in out.columns if c != name]
    return out.select(*others[:position], name, *others[position:])


def target_and_features(df: DataFrame, target: str, key: Sequence[str] = ()) -> tuple[str, list[str]]:
    """Label and feature names; both stay in the same DataFrame."""
    require_columns(df, [target, *key])
    return target, [c for c in df.columns if c != target and c not in key]


def feature_group(columns: Sequence[str], sources: Sequence[str]) -> list[str]:
    """Design columns that come from the named features, one-hot columns included."""
    return [c for c in columns if any(c == s or c.startswith(f"{s}_") for s in sources)]


def on_every_column(df: DataFrame, columns: Sequence[str], function) -> DataFrame:
    """Apply a function of (name) -> Column to several columns in one projection."""
    changed = {c: function(c) for c in columns}
    return df.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in df.columns])


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """A key for a source without one. Stable only while the input files stay as they are."""
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())
