"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words count as themselves and by their first letters, so that inflected forms share a
feature; pairs are neighbours or skip words in between.

Training rows are dealt to shards of about `shard_rows`. In each round every shard continues
from the shared state with per-coordinate rates, and the states are averaged per
coordinate over the shards that touched it. The state is a table in the shared folder, of a
few ranges of coordinates with one row each; a round's shards get it as one broadcast of
packed arrays, at most 20 bytes for each of 2^bits coordinates, dropped after the round. The
L1 term leaves few weights, and only those are collected and broadcast for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.frames import discard, free_names, held_out, kept, texts, written
from panelforge.llm.words import combine, mix, word_hashes

THRESHOLD = 0.3


@dataclass(frozen=True)
class Ftrl:
    """Parameters; `sample` bounds the labelled rows of each class that are learned from."""

    bits: int = 18
    skips: tuple[int, ...] = (1, 2)
    stems: tuple[int, ...] = (4, 5, 6, 8)
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    shard_rows: int = 1000
    rounds: int = 6
    sample: int = 3000
    ranges: int = 8


def occurrences(hashes: np.ndarray, offsets: np.ndarray, p: Ftrl) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature number) of every word, stem, neighbouring pair and skip-gram."""
    words, n, mask = hashes[0], hashes.shape[1], np.uint64((1 << p.bits) - 1)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for line in hashes:
        yield row_of, (mix(line) & mask).astype(np.int64)
    for s in p.skips:
        if n > s:
            same = row_of[: n - s] == row_of[s:]
            yield row_of[: n - s][same], (combine([words[: n - s][same], words[s:][same]], seed=s) & mask).astype(np.int64)


def features(hashes: np.ndarray, offsets: np.ndarray, p: Ftrl) -> list[np.ndarray]:
    """Distinct feature numbers of each row."""
    found = list(occurrences(hashes, offsets, p))
    key = np.unique(np.concatenate([row << p.bits | at for row, at in found]))
    return np.split(key & ((1 << p.bits) - 1), np.searchsorted(key >> p.bits, np.arange(1, len(offsets) - 1)))


def weights_of(z: np.ndarray, n: np.ndarray, p: Ftrl) -> np.ndarray:
    w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
    return np.where(np.abs(z) <= p.l1, 0.0, w)


def learn(rows: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray, p: Ftrl, weight: float = 1.0) -> None:
    """One pass over `rows`, updating the state in place. Coordinate 0 is the bias.

    Rows of label 1 count `weight` times.
    """
    for row, label in zip(rows, labels, strict=True):
        at = np.append(row + 1, 0)
        w = weights_of(z[at], n[at], p)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        g *= weight if label else 1.0
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
        z[at] += g - sigma * w
        n[at] += g * g


def training_rows(docs: DataFrame, labels: DataFrame, label: str, p: Ftrl) -> DataFrame:
    """(doc_id, text, y): at most `p.sample` rows of each class, chosen by hashes of id and text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter(~held_out() & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit("ftrl"))
    zero, one = (known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(p.sample) for y in (0, 1))
    rows = texts(docs).join(zero.unionByName(one), "doc_id").filter(F.col("text").isNotNull())
    rows = kept(rows, "labelled")
    # an id may have any number of rows
    zero, one = (rows.filter(F.col("y") == y).orderBy(order, "doc_id", F.xxhash64("text")).limit(p.sample) for y in (0, 1))
    return zero.unionByName(one)


STATE = "part int, at binary, z binary, n binary"


def _pack(parts: np.ndarray, at: np.ndarray, z: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """One row for each part of the coordinates `at`."""
    if not len(at):
        return pd.DataFrame({c: [] for c in ("part", "at", "z", "n")})
    order = np.argsort(parts, kind="stable")
    names, begin = np.unique(parts[order], return_index=True)
    cut = [np.split(v[order], begin[1:]) for v in (at.astype(np.int32), z, n)]
    return pd.DataFrame({"part": names.astype(np.int32), **{c: [x.tobytes() for x in v] for c, v in zip(("at", "z", "n"), cut, strict=True)}})


def _unpack(rows: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    kinds = {"at": np.int32, "z": np.float64, "n": np.float64}
    return [tuple(np.frombuffer(row[c], kind) for c, kind in kinds.items()) for row in rows.to_dict("records")]


def _shard_pass(weight: float, p: Ftrl, sent):
    """The state of the coordinates that a shard's rows touched, after one pass over them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        size = (1 << p.bits) + 1
        z, n = np.zeros(size), np.zeros(size)
        for at, some_z, some_n in _unpack(pd.DataFrame(sent.value, columns=["at", "z", "n"])):
            z[at], n[at] = some_z, some_n
        before = n.copy()
        rows = rows.assign(order=mix(rows["doc_id"].to_numpy().astype(np.uint64))).sort_values(["order", "text"], kind="stable")
        y = rows["y"].to_numpy()
        for first, hashes, offsets in word_hashes(pa.array(rows["text"]), p.stems):
            learn(features(hashes, offsets, p), y[first : first + len(offsets) - 1], z, n, p, weight)
        at = np.flatnonzero(n != before)
        return _pack(at % p.ranges, at, z[at], n[at])

    return run


def _average(p: Ftrl):
    """A range's new state: the mean over the shards that touched a coordinate, else the old state."""

    def run(moved: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        size = (1 << p.bits) + 1
        z, n, times = np.zeros(size), np.zeros(size), np.zeros(size)
        for at, some_z, some_n in _unpack(moved):
            z[at] += some_z
            n[at] += some_n
            times[at] += 1
        for at, some_z, some_n in _unpack(old):
            left = times[at] == 0
            z[at[left]], n[at[left]], times[at[left]] = some_z[left], some_n[left], 1
        at = np.flatnonzero(times)
        return _pack(at % p.ranges, at, z[at] / times[at], n[at] / times[at])

    return run


def _weights(p: Ftrl):
    """(at, w) of a range's weights that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, z, n in _unpack(batch.select(["at", "z", "n"]).to_pandas()):
                w = weights_of(z, n, p)
                used = np.flatnonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array([at[used].tobytes()]), pa.array([w[used].tobytes()])], names=["at", "w"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, weights) that are not zero; feature 0 is the bias.

    Rows of label 1 count more where they are few. Without rows of both classes nothing
    is learned, and every text scores 0.5.
    """
    spark = docs.sparkSession
    rows = kept(training_rows(docs, labels, label, p), "training")
    # one row per class
    count = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(count) < 2:
        return np.empty(0, np.int64), np.empty(0)
    shards = 1 + sum(count.values()) // p.shard_rows
    weight = min(8.0, max(1.0, 0.5 * count[0] / count[1]))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    state, place = written(spark.createDataFrame([], STATE), "ftrl")
    for _ in range(p.rounds):
        # bounded: one row per range, the packed state of 2^bits coordinates
        sent = spark.sparkContext.broadcast([(bytes(r["at"]), bytes(r["z"]), bytes(r["n"])) for r in state.collect()])
        moved = dealt.groupBy("shard").applyInPandas(_shard_pass(weight, p, sent), STATE)
        mean = moved.groupBy("part").cogroup(state.groupBy("part")).applyInPandas(_average(p), STATE)
        before = place
        state, place = written(mean, "ftrl")
        discard(spark, before)
        sent.destroy()
    # bounded: one row per range, with the weights that L1 leaves of 2^bits
    found = state.mapInArrow(_weights(p), "at binary, w binary").collect()
    at = np.concatenate([np.frombuffer(r["at"], np.int32) for r in found]).astype(np.int64)
    w = np.concatenate([np.frombuffer(r["w"], np.float64) for r in found])
    order = np.argsort(at)
    return at[order], w[order]


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray], p: Ftrl = Ftrl(), keep: tuple[str, ...] = (), text: str = "text", name: str = "score") -> DataFrame:
    """`keep` columns and the score `name` (0 to 1) of every row; null and empty texts score the bias."""
    stay = [f for f in df.schema.fields if f.name in keep]
    (text_name,) = free_names(keep, "text")
    schema = T.StructType([*stay, T.StructField(name, T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        weights = np.zeros((1 << p.bits) + 1, np.float32)
        weights[at] = w
        for batch in batches:
            sums = np.full(batch.num_rows, float(weights[0]))
            for first, hashes, offsets in word_hashes(batch.column(text_name), p.stems):
                sums[first : first + len(offsets) - 1] += row_sums(hashes, offsets, weights, p)
            out = pa.array(1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35))))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in stay), out], names=[f.name for f in schema])

    return df.select(*(F.col(f"`{f.name}`") for f in stay), F.col(text).cast("string").alias(text_name)).mapInArrow(work, schema)


def row_sums(hashes: np.ndarray, offsets: np.ndarray, weights: np.ndarray, p: Ftrl) -> np.ndarray:
    """Sum of the weights of each row's distinct features.

    Only occurrences whose weight is not zero are kept, which L1 makes few.
    """
    keys = []
    for row, at in occurrences(hashes, offsets, p):
        hit = weights[at + 1] != 0
        keys.append(row[hit] << p.bits | at[hit])
    key = np.unique(np.concatenate(keys))
    return np.bincount(key >> p.bits, weights[(key & ((1 << p.bits) - 1)) + 1], minlength=len(offsets) - 1)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", p: Ftrl = Ftrl(), threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`.

    Labels are learned from rows that are not held out. Labels other than 0 and 1 and
    labels without a document are ignored; of repeated labels of an id the largest counts.
    Null and empty texts get the score of the bias. Rows are scored one by one, so
    repeated rows and null keys stay.
    """
    model = fit(docs, labels, label, p)
    rows = texts(docs).withColumn("held_out", held_out())
    scored = score(rows, model, p, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", flagged(F.col("score"), threshold).cast("int"))


def flagged(score: Column, threshold: float = THRESHOLD) -> Column:
    return score >= threshold
