"""Randomness that depends on row keys only, so reruns and other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def named(name: str) -> Column:
    """A column by its literal name; design columns may hold dots, as in `visits_9.0`."""
    return F.col(f"`{name}`")


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def keyed_hash(key, seed) -> Column:
    """32 hex digits from a row key and a seed."""
    return F.md5(F.concat_ws(":", as_column(key).cast("string"), F.lit(str(seed))))


def hash_to_uniform(digest: Column) -> Column:
    """The first 32 bits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def keyed_uniform(key, seed) -> Column:
    return hash_to_uniform(keyed_hash(key, seed))
