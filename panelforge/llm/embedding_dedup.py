"""Near-duplicate embeddings by cross-polytope hashing with fast Hadamard rotations.

A rotation is three rounds of random signs and a Hadamard transform; the hash is the
nearest signed axis. A table's bucket joins the hashes of several rotations. Vectors also
visit the buckets next to theirs, in which one hash is replaced by its runner-up. Pairs
that meet in a bucket are verified in double precision by blocks of matrix products; a
pair that meets several times is counted at its first meeting only, and no pair leaves
its task: a block gives each vector's number of links and a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.components import connected_components, least_labels
from panelforge.llm.frames import binaries, by_slices, kept, key_runs, rows_of
from panelforge.llm.words import combine

COSINE = 0.95


@dataclass(frozen=True)
class Polytopes:
    """Least number of tables, rows of a block, and the share of pairs at the threshold to find.

    Each table joins as many rotations as give about as many buckets as there are vectors.
    More rotations part more pairs, so their number sets the number of tables.
    """

    tables: int = 5
    slice_rows: int = 1024
    seed: int = 11
    recall: float = 0.99

    def rotations(self, vectors: int, width: int) -> int:
        return max(1, int(np.ceil(np.log(max(2, vectors)) / np.log(2 * _padded(width)))))

    def enough(self, rotations: int, width: int, cosine: float) -> Polytopes:
        """The same with as many tables as find `recall` of the pairs at the cosine, or more."""
        missed = 1 - meeting_share(rotations, _padded(width), cosine)
        needed = int(np.ceil(np.log(1 - self.recall) / np.log(missed))) if missed > 0 else 1
        return replace(self, tables=max(self.tables, needed))


@lru_cache
def meeting_share(rotations: int, width: int, cosine: float) -> float:
    """The share of pairs at the cosine that share a bucket of one table, own or next to it.

    Drawn pairs give the shares of one rotation: nearest axes equal; else an axis of one
    nearest and the other's second, both so, or second axes equal. Rotations of a table are
    independent: at most one may differ, or two that cross, one in each direction.
    """
    pairs = max(512, min(16384, (1 << 21) // width))
    a, b = np.random.default_rng(5).normal(size=(2, pairs, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    first_a, second_a = _nearest_axes(a)
    first_b, second_b = _nearest_axes(cosine * a + np.sqrt(max(0.0, 1 - cosine * cosine)) * b)
    apart = first_a != first_b
    forth, back = apart & (second_a == first_b), apart & (first_a == second_b)
    same, one = 1 - apart.mean(), (forth | back | apart & (second_a == second_b)).mean()
    two = 2 * forth.mean() * back.mean() - (forth & back).mean() ** 2
    k = rotations
    return float(same**k + k * same ** (k - 1) * one + (k * (k - 1) / 2 * same ** (k - 2) * two if k > 1 else 0))


def _nearest_axes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the second nearest signed axis of each row."""
    line, size = np.arange(len(y)), np.abs(y)
    best = size.argmax(axis=1)
    size[line, best] = -1
    second = size.argmax(axis=1)
    return 2 * best + (y[line, best] < 0), 2 * second + (y[line, second] < 0)


def _padded(width: int) -> int:
    return 1 << max(1, (width - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Hadamard transform of each row; the width is a power of two."""
    width, step = x.shape[1], 1
    while step < width:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
        x = x.reshape(len(x), width)
    return x / np.sqrt(width)


def buckets(x: np.ndarray, p: Polytopes, rotations: int) -> np.ndarray:
    """(rows, tables, 1 + rotations) bucket numbers: a vector's own, then its neighbours'."""
    width = _padded(x.shape[1])
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    signs = np.random.default_rng(p.seed).choice([-1.0, 1.0], (p.tables, rotations, 3, width))
    out = np.zeros((len(x), p.tables, 1 + rotations), np.int64)
    for t in range(p.tables):
        first, second = [], []
        for r in range(rotations):
            y = padded
            for k in range(3):
                y = hadamard(y * signs[t, r, k])
            nearest, next_ = _nearest_axes(y)
            first.append(nearest)
            second.append(next_)
        for probe in range(1 + rotations):
            number = np.full(len(x), 2 * t + 1 + x.shape[1] * 1000, np.uint64)
            for r in range(rotations):
                number = mix_step(number, second[r] if probe == r + 1 else first[r])
            out[:, t, probe] = number.astype(np.int64)
    return out


def mix_step(number: np.ndarray, part: np.ndarray) -> np.ndarray:
    return combine([number, part.astype(np.uint64)])


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, without overflow or underflow on the way."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bucket_lists(kind: type, shapes: dict[int, tuple[Polytopes, int]]):
    """(cls, width, raw, buckets): the vector's bytes and all buckets that it visits."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("embedding")
        widths = np.asarray(lists.value_lengths(), np.int64)
        flat, ends = np.asarray(lists.flatten()).astype(kind), np.cumsum(widths)
        order, raw, found = [], [], []
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            x = flat[(ends[rows] - width)[:, None] + np.arange(width)]
            visited = buckets(_unit(x), *shapes[int(width)])
            order.append(rows)
            raw.append(binaries(x))
            found.append(binaries(visited.reshape(len(rows), -1)))
        rows = pa.array(np.concatenate(order))
        columns = [batch.column("cls").take(rows), batch.column("n").take(rows), pa.array(widths).take(rows), pa.concat_arrays(raw), pa.concat_arrays(found)]
        return pa.RecordBatch.from_arrays(columns, names=["cls", "n", "width", "raw", "buckets"])

    return by_slices(work, 1024)


def _visits():
    """(bucket, cls) for every bucket that a vector visits, once each."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.unique(np.frombuffer(b, np.int64)) for b in batch.column("buckets").to_pylist()]
        cls = np.repeat(batch.column("cls").to_numpy(), [len(b) for b in own])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(cls)], names=["bucket", "cls"])

    return by_slices(work, 1024)


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least bucket that both of two vectors visit, as their own or as a neighbour's."""
    least = np.full(len(a), np.iinfo(np.int64).max)
    for one in range(a.shape[2]):
        for other in range(b.shape[2]):
            rows, tables = np.nonzero(a[:, :, one] == b[:, :, other])
            np.minimum.at(least, rows, a[rows, tables, one])
    return least


def _meetings(kind: type, cosine: float, shapes: dict[int, tuple[Polytopes, int]]):
    """(cls, links, root) of the vectors with links in a block: a bucket's slice, or two of them.

    `root` is the least vector of the block that it is connected with.
    """

    def block(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        own = rows.column("slice").to_numpy()
        left, right = (np.flatnonzero(own == rows.column(c)[0].as_py()) for c in ("block_a", "block_b"))
        if not len(left) or not len(right) or len(own) < 2:
            return None
        cls, copies = rows.column("cls").to_numpy(), rows.column("n").to_numpy()
        x = _unit(rows_of(rows.column("raw"), kind))
        seen = rows_of(rows.column("buckets"), np.int64)
        seen = seen.reshape(len(rows), shapes[rows.column("width")[0].as_py()][0].tables, -1)
        same, bucket = left[0] == right[0], rows.column("bucket")[0].as_py()
        pairs_i, pairs_j = [], []
        for at in range(0, len(left), 256):
            i, j = np.nonzero(x[left[at : at + 256]] @ x[right].T >= cosine)
            i, j = left[at : at + 256][i], right[j]
            once = i < j if same else np.ones(len(i), bool)
            i, j = i[once], j[once]
            for begin in range(0, len(i), 16384):
                some_i, some_j = i[begin : begin + 16384], j[begin : begin + 16384]
                first = _first_meeting(seen[some_i], seen[some_j]) == bucket
                pairs_i.append(some_i[first])
                pairs_j.append(some_j[first])
        if not pairs_i:
            return None
        i, j = np.concatenate(pairs_i), np.concatenate(pairs_j)
        if not len(i):
            return None
        links = np.bincount(i, copies[j], len(cls)) + np.bincount(j, copies[i], len(cls))
        hit = np.flatnonzero(links)
        root = cls[least_labels(len(cls), i, j)[hit]]
        return pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root)], names=["cls", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches, ("bucket", "width", "block_a", "block_b")):
            out = block(rows)
            if out is not None:
                yield out

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, p: Polytopes = Polytopes()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors are one class with a count, so copies cost no pairs. Vectors that are
    null, empty or zero or hold null or non-finite components, and vectors of different
    widths, are not linked; such a row is its own component. Repeated ids are rows of
    their own that share an id; rows without an id count as links and never name a
    component that has ids. A bucket of many vectors is cut into slices, and each pair of
    slices is a block of bounded size.
    """
    element = df.schema[vector].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64
    plain = F.transform(F.col(vector).cast("array<float>" if kind is np.float32 else "array<double>"), lambda x: x + F.lit(0).cast("float" if kind is np.float32 else "double"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), plain.alias("embedding"))
    rows = rows.withColumn("cls", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("embedding")))
    classes = rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    classes = kept(classes, "vectors")
    # one row per vector width
    rotations = {r["w"]: p.rotations(r["n"], r["w"]) for r in classes.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).collect()}
    shapes = {w: (p.enough(k, w, cosine), k) for w, k in rotations.items()}

    schema = "cls long, n long, width long, raw binary, buckets binary"
    hashed = kept(classes.select("cls", "n", "embedding").mapInArrow(_bucket_lists(kind, shapes), schema), "hashed")
    visits = kept(hashed.select("cls", "buckets").mapInArrow(_visits(), "bucket long, cls long"), "visits")
    crowded = visits.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    crowded = crowded.select("bucket", F.ceil(F.col("size") / p.slice_rows).cast("int").alias("slices"))
    met = visits.join(crowded, "bucket").withColumn("slice", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    met = met.select("bucket", "cls", "slice", F.least("slice", "other").alias("block_a"), F.greatest("slice", "other").alias("block_b"))
    met = met.join(hashed, "cls")
    blocks = met.repartition("bucket", "width", "block_a", "block_b").sortWithinPartitions("bucket", "width", "block_a", "block_b", "cls")
    found = kept(blocks.mapInArrow(_meetings(kind, cosine, shapes), "cls long, links long, root long"), "links")

    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    reach = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.select("cls", "n", "least").join(reach, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    result = named.join(names, "component").join(links, "cls", "left")
    result = result.select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cls").join(result, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
