"""A tree of boxes over the rows of a table, built and searched as tables.

A pass looks at a bounded sample of every node that is still too large, splits it at
medians of its widest dimensions into up to 64 children, and moves the rows on. A node is
a number whose last six bits say which child of its parent it is, so all levels are
prefixes of the leaves. Each level's bounding boxes are a table. A search takes groups of
queries from the coarsest level down and follows only boxes within a group's radius.
Gaps are allowed: a dimension counts towards a bound only where both sides have it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelforge.session import cut

FAN_BITS = 6
# 1 + 6 * 10 bits of a node number are at most 61.
MOST_PASSES = 10
SAMPLED = 1000
# Splits of at most this many nodes are sent to every task; of more, they are joined by node.
SENT_NODES = 4096

SPLITS = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("steps", T.IntegerType()),
        T.StructField("dims", T.ArrayType(T.IntegerType())),
        T.StructField("cuts", T.ArrayType(T.DoubleType())),
    ]
)


def _cut_of(points: np.ndarray) -> tuple[int, float] | None:
    """The widest dimension and a cut with rows on both sides; None when all rows are equal.

    A dimension with gaps is first cut into gaps and values.
    """
    present = ~np.isnan(points)
    filled = np.where(present, points, 0.0)
    n = np.maximum(present.sum(axis=0), 1)
    centred = np.where(present, points - filled.sum(axis=0) / n, 0.0)
    spread = (centred * centred).sum(axis=0) / n * present.mean(axis=0)
    mixed = present.any(axis=0) & ~present.all(axis=0)
    dim = int(spread.argmax())
    if spread[dim] <= 0:
        return (int(mixed.argmax()), -np.inf) if mixed.any() else None
    if mixed[dim]:
        return dim, -np.inf
    values = np.sort(points[:, dim])
    middle = values[(len(values) - 1) // 2]
    return dim, float(middle if middle < values[-1] else values[values < values[-1]][-1])


def _splits(leaf_rows: int):
    """Up to 63 cuts of a node in heap order, from its sample and its number of rows."""

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        steps = min(FAN_BITS, max(1, int(np.ceil(np.log2(sample["n"].iloc[0] / leaf_rows)))))
        points = {1: np.stack(sample["vec"].to_numpy()).astype(float)}
        dims, cuts = [-1] * (1 << FAN_BITS), [0.0] * (1 << FAN_BITS)
        for place in range(1, 1 << steps):
            own = points.pop(place, None)
            found = _cut_of(own) if own is not None and len(own) > 1 else None
            if found is None:
                continue
            dims[place], cuts[place] = found
            right = own[:, found[0]] > found[1]
            points[2 * place], points[2 * place + 1] = own[~right], own[right]
        return pd.DataFrame({"node": [sample["node"].iloc[0]], "steps": [steps], "dims": [dims], "cuts": [cuts]})

    return run


def _child() -> Column:
    """The node of a row one level down; rows of nodes without splits go to the first child."""
    def down(place: Column, _) -> Column:
        dim = F.get("dims", place)
        right = F.coalesce((dim >= 0) & (F.get("vec", dim) > F.get("cuts", place)), F.lit(False))
        return place * 2 + right.cast("int")

    path = F.aggregate(F.sequence(F.lit(1), F.col("steps")), F.lit(1), down) - F.expr("shiftleft(1, steps)")
    return F.shiftleft(F.col("node"), FAN_BITS) + F.coalesce(path, F.lit(0)).cast("long")


def _moved(rows: DataFrame, splits: DataFrame, nodes: int) -> DataFrame:
    splits = F.broadcast(splits) if nodes <= SENT_NODES else splits
    return rows.join(splits, "node", "left").withColumn("node", _child()).drop("steps", "dims", "cuts")


@dataclass(frozen=True)
class BoxTree:
    """Rows with their leaf as `node`, the splits of each level, and the levels' boxes."""

    rows: DataFrame
    splits: list[tuple[DataFrame, int]]
    boxes: list[DataFrame]

    def place(self, queries: DataFrame) -> DataFrame:
        """Queries (with `vec`) in the leaf they fall into."""
        placed = queries.withColumn("node", F.lit(1).cast("long"))
        for splits, nodes in self.splits:
            placed = _moved(placed, splits, nodes)
        return placed


def build(rows: DataFrame, dims: int, key: str, leaf_rows: int) -> BoxTree:
    """The tree over a written table with a column `vec` of `dims` doubles.

    Leaves hold about `leaf_rows` rows at most. Nodes whose sample is all equal stay whole.
    """
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    done, splits = None, []
    for _ in range(MOST_PASSES):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.where(F.col("n") > leaf_rows)
        if done is not None:
            large = large.join(done, "node", "left_anti")
        large = cut(large)
        nodes = large.count()
        if not nodes:
            break
        large = F.broadcast(large) if nodes <= SENT_NODES else large
        # Thinned by hash first, so that what is ranked for a node does not grow with its rows.
        draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
        order = Window.partitionBy("node").orderBy(F.xxhash64(key), key)
        thin = rows.join(large, "node").where(draw < 4.0 * SAMPLED / F.col("n"))
        sample = thin.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLED)
        found = cut(sample.select("node", "n", "vec").groupBy("node").applyInPandas(_splits(leaf_rows), SPLITS))
        # A node whose sample is all equal is not looked at again, at any level below.
        same = found.where(F.get("dims", F.lit(1)) < 0).select(F.shiftleft("node", FAN_BITS).alias("node"))
        if done is not None:
            same = same.unionByName(done.select(F.shiftleft("node", FAN_BITS).alias("node")))
        done = cut(same)
        rows = cut(_moved(rows, found, nodes))
        splits.append((found, nodes))
    return BoxTree(rows, splits, _boxes(rows, dims, len(splits)))


def _boxes(rows: DataFrame, dims: int, depth: int) -> list[DataFrame]:
    """(node, parent, n, low, high) from the level below the root down to the leaves.

    `low` and `high` are null in dimensions that not every row of the node has.
    """
    present = [F.get("vec", F.lit(i)) for i in range(dims)]
    summed = [f(x).alias(f"{name}{i}") for i, x in enumerate(present) for name, f in (("low", F.min), ("high", F.max), ("has", F.count))]
    level = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *summed))
    out = []
    for _ in range(max(1, depth)):
        whole = [F.when(F.col(f"has{i}") == F.col("n"), F.col(f"low{i}")) for i in range(dims)]
        top = [F.when(F.col(f"has{i}") == F.col("n"), F.col(f"high{i}")) for i in range(dims)]
        parent = F.shiftright("node", FAN_BITS).alias("parent")
        out.append(level.select("node", parent, "n", F.array(*whole).alias("low"), F.array(*top).alias("high")))
        again = [f(f"{name}{i}").alias(f"{name}{i}") for i in range(dims) for name, f in (("low", F.min), ("high", F.max), ("has", F.sum))]
        level = cut(level.withColumn("node", F.shiftright("node", FAN_BITS)).groupBy("node").agg(F.sum("n").alias("n"), *again)) if len(out) < depth else level
    return out[::-1]


def query_groups(queries: DataFrame, dims: int) -> DataFrame:
    """(group, low, high, present, radius) of queries that have a `group`, `vec` and `radius`.

    A dimension that not every query of a group has is null; `present` is the greatest
    number of dimensions that a query of the group has.
    """
    each = [F.get("vec", F.lit(i)) for i in range(dims)]
    whole = lambda f, x: F.when(F.count(x) == F.count(F.lit(1)), f(x))
    present = F.size(F.filter("vec", lambda x: x.isNotNull()))
    return queries.groupBy("group").agg(
        F.array(*[whole(F.min, x) for x in each]).alias("group_low"),
        F.array(*[whole(F.max, x) for x in each]).alias("group_high"),
        F.max(present).alias("present"),
        F.max("radius").alias("radius"),
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _within(total: int):
    """(group, node) of the boxes that may hold a row within the group's radius."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.iloc[at : at + 4096]
                low, high, group_low, group_high = (_matrix(batch[c]) for c in ("low", "high", "group_low", "group_high"))
                gap = np.fmax(np.fmax(low - group_high, group_low - high), 0.0)
                gap = np.where(np.isnan(low) | np.isnan(group_low), 0.0, gap)
                bound = (gap * gap).sum(axis=1) * (total / np.maximum(batch["present"].to_numpy(), 1))
                # Rounding must never hide a box that holds an equally near row.
                yield batch.loc[bound * (1 - 1e-9) <= batch["radius"].to_numpy(), ["group", "node"]]

    return run


def visited(tree: BoxTree, groups: DataFrame, total: int) -> DataFrame:
    """(group, node) of the leaves that may hold a row within the radius of a group's queries."""
    kind = groups.schema["group"].dataType.simpleString()
    front = groups.select("group", F.lit(1).cast("long").alias("parent"))
    for level, boxes in enumerate(tree.boxes):
        # The upper levels have few boxes whatever the table; below, boxes are joined by parent.
        few = 1 << FAN_BITS * (level + 1) <= SENT_NODES
        near = front.join(F.broadcast(boxes) if few else boxes, "parent").join(groups, "group")
        found = near.select("group", "node", "low", "high", "group_low", "group_high", "present", "radius")
        front = cut(found.mapInPandas(_within(total), f"`group` {kind}, node long").withColumnRenamed("node", "parent"))
    return front.withColumnRenamed("parent", "node")
