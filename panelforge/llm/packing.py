"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Pieces are dealt to shards of a bounded number of pieces. Each shard is packed by several
islands, each a population of groupings. A child takes whole well-filled bins of one
parent into the other, drops the bins that hold the same pieces twice, and puts displaced
pieces back by best fit. Between two rounds every island's elite moves on to the next
island of its shard; the best grouping of all islands is the shard's packing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import kept, texts
from panelforge.llm.token_counts import encoder

CAPACITY = 2048
END = 0


@dataclass(frozen=True)
class Islands:
    """Pieces of a shard, islands of a shard, groupings of an island, children of a round."""

    shard_pieces: int = 4000
    islands: int = 4
    population: int = 6
    children: int = 16
    rounds: int = 3
    seed: int = 3


# --- cutting -------------------------------------------------------------------------


def cut_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the pieces of every row, with `ids` if asked for.

    A document's ids end with END, so a null or empty text is one piece of length 1. Of a
    document longer than `capacity` all pieces are full but the first.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, _ = encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for doc_id, text_ in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.append(tool.encode_to_numpy(text_ or "", allowed_special="all"), END).astype("<u4")
                    first = len(ids) % capacity or capacity
                    starts = [0, *range(first, len(ids), capacity)]
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        part = ids[a:b]
                        rows.append((doc_id, piece, a, b - a, zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return texts(df, key, text).mapInArrow(work, schema)


# --- one shard -----------------------------------------------------------------------


def best_fit(order: list[int], sizes: list[int], capacity: int, room: list[int], bin_of: np.ndarray) -> None:
    """Put the pieces of `order` into bins of `room`, each where the least room is left over."""
    open_bins = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for piece in order:
        size = sizes[piece]
        at = bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            left, b = open_bins.pop(at)
            left -= size
        else:
            b, left = len(room), capacity - size
            room.append(left)
        room[b] = left
        bin_of[piece] = b
        if left:
            insort(open_bins, (left, b))


def grouping(sizes: np.ndarray, capacity: int, noise: np.ndarray | None = None) -> np.ndarray:
    """Best fit by falling size; `noise` disturbs the order."""
    keys = sizes if noise is None else sizes + noise
    bin_of, room = np.zeros(len(sizes), np.int64), []
    best_fit(np.argsort(-keys, kind="stable").tolist(), sizes.tolist(), capacity, room, bin_of)
    return bin_of


def merit(bin_of: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: (-bins, mean square of the fill)."""
    fill = np.bincount(bin_of, sizes) / capacity
    fill = fill[fill > 0]
    return -len(fill), float((fill * fill).sum() / max(1, len(fill)))


def crossover(into: np.ndarray, donor: np.ndarray, sizes: np.ndarray, capacity: int, random: np.random.Generator) -> np.ndarray:
    """`into` with some well-filled bins of `donor` injected whole."""
    fill = np.bincount(donor, sizes)
    full = np.flatnonzero(fill >= max(0.995 * capacity, np.quantile(fill, 0.5)))
    chosen = full[random.random(len(full)) < 0.5]
    injected = np.isin(donor, chosen)
    broken = np.zeros(into.max() + 1, bool)
    broken[into[injected]] = True
    displaced = broken[into] & ~injected
    child = np.full(len(into), -1, np.int64)
    stay = ~injected & ~displaced
    _, child[stay] = np.unique(into[stay], return_inverse=True)
    first = int(child.max()) + 1
    _, child[injected] = np.unique(donor[injected], return_inverse=True)
    child[injected] += first
    room = (capacity - np.bincount(child[child >= 0], sizes[child >= 0])).astype(int).tolist() if (child >= 0).any() else []
    order = np.flatnonzero(displaced)
    order = order[np.argsort(-(sizes[order] + random.integers(0, 24, len(order))), kind="stable")]
    best_fit(order.tolist(), sizes.tolist(), capacity, room, child)
    return child


def evolve(sizes: np.ndarray, visitors: list[np.ndarray], capacity: int, p: Islands, seed: int) -> np.ndarray:
    """The best grouping an island finds, starting from its own population and `visitors`."""
    random = np.random.default_rng(seed)
    people = [*visitors, grouping(sizes, capacity)]
    least = -int(np.ceil(sizes.sum() / capacity))
    # nothing has fewer bins than the bound
    while len(people) < p.population and merit(people[-1], sizes, capacity)[0] < least:
        people.append(grouping(sizes, capacity, random.integers(0, capacity // 16, len(sizes))))
    ranked = sorted(((merit(g, sizes, capacity), k, g) for k, g in enumerate(people)), key=lambda x: (x[0], -x[1]), reverse=True)
    for step in range(p.children):
        if ranked[0][0][0] >= least:
            break
        a, b = random.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
        child = crossover(ranked[min(a, b)][2], ranked[max(a, b)][2], sizes, capacity, random)
        ranked.append((merit(child, sizes, capacity), len(people) + step, child))
        ranked = sorted(ranked, key=lambda x: (x[0], -x[1]), reverse=True)[: max(2, p.population)]
    return ranked[0][2]


# --- on Spark ------------------------------------------------------------------------


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable", na_position="first").reset_index(drop=True)


def _first_round(capacity: int, p: Islands):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = np.sort(rows["length"].to_numpy())[::-1].astype(np.int64)
        best = evolve(sizes, [], capacity, p, p.seed + 1000 * int(key[1]) + int(key[0]))
        return pd.DataFrame({"shard": [key[0]], "island": [key[1]], "sizes": [sizes.tolist()], "bins": [best.tolist()]})

    return run


def _next_round(capacity: int, p: Islands, step: int):
    """An island goes on from its own elite and the one that came from the island before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = []
            for row in batch.itertuples():
                sizes = np.asarray(row.sizes, np.int64)
                elites = [np.asarray(row.bins, np.int64), np.asarray(row.visitor, np.int64)]
                new.append(evolve(sizes, elites, capacity, p, p.seed + 1000 * int(row.island) + int(row.shard) + 7919 * step).tolist())
            yield pd.DataFrame({"shard": batch["shard"], "island": batch["island"], "sizes": batch["sizes"], "bins": new})

    return run


def _placed(capacity: int):
    """The pieces of a shard with their sequence and place, by its best island."""

    def run(key: tuple, rows: pd.DataFrame, islands: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
        rows = _ordered(rows)
        sizes = rows["length"].to_numpy()
        ranked = [(merit(np.asarray(b, np.int64), sizes, capacity), -int(i), b) for i, b in zip(islands["island"], islands["bins"], strict=True)]
        best = np.asarray(max(ranked, key=lambda x: x[:2])[2], np.int64)
        _, bins = np.unique(best, return_inverse=True)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.append(True, bins[order][1:] != bins[order][:-1])
        offset = np.zeros(len(rows), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        rows["sequence_id"] = int(key[0]) * SHARD_IDS + bins
        rows["offset"] = offset
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


#: Sequence numbers of a shard; full pieces have negative numbers of their own.
SHARD_IDS = 1 << 24


def pack(pieces: DataFrame, capacity: int = CAPACITY, p: Islands = Islands()) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids_crc32) with `sequence_id` and `offset`.

    A full piece is a sequence by itself. Sequence ids are distinct numbers without further
    meaning, offsets of a sequence are gapless from 0. Repeated rows are pieces of their
    own; null ids are allowed; no piece gives no sequence.
    """
    pieces = kept(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    full = pieces.filter(F.col("length") >= capacity)
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    part = pieces.filter(F.col("length") < capacity)
    shards = max(1, -(-part.count() // p.shard_pieces))
    # the salt deals copies of a document to different shards
    part = part.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    part = kept(part, "shards")

    state = "shard long, island int, sizes array<int>, bins array<int>"
    isles = part.select("shard", "length", F.explode(F.sequence(F.lit(0), F.lit(p.islands - 1))).alias("island"))
    solved = isles.groupBy("shard", "island").applyInPandas(_first_round(capacity, p), state)
    for step in range(1, p.rounds):
        solved = kept(solved, "islands")
        elite = solved.select("shard", F.pmod(F.col("island") + 1, F.lit(p.islands)).cast("int").alias("island"), F.col("bins").alias("visitor"))
        met = solved.join(elite, ["shard", "island"]).repartition("shard", "island")
        solved = met.mapInPandas(_next_round(capacity, p, step), state)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = part.groupBy("shard").cogroup(solved.select("shard", "island", "bins").groupBy("shard")).applyInPandas(_placed(capacity), schema)
    return placed.unionByName(alone)


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, given pieces cut `with_ids`.

    Pieces are told apart by doc_id, piece and start, which must be unique here.
    """
    keys = ["doc_id", "piece", "start"]
    rows = packed.select(*keys, "sequence_id", "offset").join(pieces.select(*keys, "ids"), keys)
    parts = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
