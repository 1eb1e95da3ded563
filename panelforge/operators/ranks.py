"""Ranks and running sums over a whole table without a one-task window.

A window without a partition, or one partition per class, sends a large table
through a handful of tasks. Both operators here cut the order into pieces,
number the rows inside each piece and add the size of the pieces before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelforge.functions.keyed import keyed_hash, named
from panelforge.session import cut

# Hex digits of the hash that name a piece: 16**3 = 4096 pieces per group.
PIECE_DIGITS = 3


def hashed_rank(
    df: DataFrame, key: str, seed, by: Sequence[str] = (), out: str = "position", total: str | None = None
) -> DataFrame:
    """Number rows 1..n in the order of a keyed hash, within each `by` group.

    Pieces are hash prefixes, so they are even whatever the data looks like. The
    row numbers and the piece offsets are partitioned the same way, so joining
    them moves only the small side. `total` names a column for the group size.
    `by` values must not be null.
    """
    by = list(by)
    digest, piece, before = "__digest", "__piece", "__before"
    hashed = df.withColumn(digest, keyed_hash(key, seed)).withColumn(
        piece, F.substring(digest, 1, PIECE_DIGITS)
    )
    sizes = hashed.groupBy(*by, piece).agg(F.count(F.lit(1)).alias("__size"))
    # At most 4096 rows per group reach this window.
    group = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by,
        piece,
        F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias(before),
        *([F.sum("__size").over(group).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*by, piece).orderBy(digest, key)
    numbered = hashed.withColumn("__row", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*by, piece])
        .withColumn(out, F.col("__row") + F.col(before))
        .select(*[named(c) for c in df.columns], out, *([total] if total else []))
    )


def in_order(df: DataFrame, *order, out: str = "position", running: Sequence[str] = ()) -> DataFrame:
    """Number rows 0..n-1 in the order of values, with optional running sums.

    For each name in `running` the result has `cum_<name>` up to and with the row
    and `total_<name>` over the table. The sorted rows are written once, because
    the piece numbers have to stay the same for both uses.
    """
    piece, row = "__piece", "__row"
    ident = F.monotonically_increasing_id()
    ordered = cut(
        df.sort(*order)
        .withColumn("__id", ident)
        .select(
            "*",
            F.shiftright("__id", 33).alias(piece),
            F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias(row),
        )
        .drop("__id")
    )
    # One row per sort partition, so this side is as small as the task count.
    sizes = ordered.groupBy(piece).agg(
        F.count(F.lit(1)).alias("__size"), *[F.sum(c).alias(f"__sum_{c}") for c in running]
    )
    whole = Window.partitionBy(F.lit(0))
    earlier = whole.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        piece,
        F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"),
        *[F.coalesce(F.sum(f"__sum_{c}").over(earlier), F.lit(0)).alias(f"__before_{c}") for c in running],
        *[F.sum(f"__sum_{c}").over(whole).alias(f"total_{c}") for c in running],
    )
    inside = Window.partitionBy(piece).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    if running:
        ordered = ordered.select("*", *[F.sum(c).over(inside).alias(f"__inside_{c}") for c in running])
    joined = ordered.join(F.broadcast(offsets), piece)
    return joined.select(
        *[named(c) for c in df.columns],
        (F.col(row) + F.col("__before")).alias(out),
        *[(F.col(f"__inside_{c}") + F.col(f"__before_{c}")).alias(f"cum_{c}") for c in running],
        *[F.col(f"total_{c}") for c in running],
    )
