"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v): every node hands its neighbours its least neighbour.

    The large step links larger neighbours to it, the small step smaller ones. A node with
    very many neighbours is one key of a join that adaptive execution can split; its
    minimum is summed up before the shuffle.
    """
    if large:
        pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    joined = pairs.join(least, "u")
    if large:
        new = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        new = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return new.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): the least node it can reach.

    Edges with a null end and edges from a node to itself are ignored; nodes without
    another edge are not in the result. Each round's edges are a table in the shared
    folder, never more than the edges before.
    """
    edges = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    edges = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    edges = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        edges = kept(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    child = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return child.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each of `n` rows reaches by the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    return label
