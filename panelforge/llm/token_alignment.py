"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

Tokens of both tokenizers are nodes; tokens whose byte ranges overlap belong together.
Every token points to its farthest-right overlapping token, which is the other
tokenizer's token that holds its last byte; where both end there, the second tokenizer's
token is the terminal and points to itself. Doubling all pointers of a batch at once
brings every token to the terminal of its group. How often two ids end together in the
whole corpus is counted by Spark and joined back: frequent pairs by a broadcast table of
bounded size, the rest by a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import Once, by_slices, kept, texts
from panelforge.llm.token_counts import VOCABULARY, read_ranks

PIECES = "piece_bpe_32k.model"
#: Segments a task remembers and their greatest length; both only bound memory.
REMEMBERED, SHORT = 200_000, 40


@dataclass(frozen=True)
class Alignment:
    """Most id pairs whose counts are broadcast; the counts of all others are shuffled."""

    most_frequent: int = 500_000


class TokenBytes:
    """The bytes of the tokens of a vocabulary, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.widths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.widths)))[:-1]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        widths = self.widths[ids]
        ends = np.cumsum(widths)
        if not len(ends):
            return b""
        return self.data[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + widths, widths)].tobytes()


class RankedBytes:
    """Ids of `space + text` by byte-level merges; special strings are plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = read_ranks(path)
        self.tool = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = TokenBytes(tokens)

    def encode(self, values: list[str]) -> list[np.ndarray]:
        return [self.tool.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in values]


class SpacedPieces:
    """Ids of a text by a piece model, which puts a space before it.

    Where no piece of the vocabulary holds a space after anything else, no merge can cross
    such a place, so a text is encoded segment by segment and short segments are remembered.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.tool = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.tool.id_to_piece(i) for i in range(self.tool.get_piece_size())]
        self.tokens = TokenBytes([bytes([int(p[3:5], 16)]) if self.tool.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        crossed = any(re.search("[^▁]▁", p) for p in pieces)
        self.segments = re.compile("(?s:.+)" if crossed else "[ ▁]*[^ ▁]+|[ ▁]+").findall
        self.known: dict[str, list[int]] = {}

    def encode(self, values: list[str]) -> list[np.ndarray]:
        rows = [self.segments(" " + t) for t in values]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({s for row in rows for s in row if s not in self.known})
        # the model adds each segment's first space; it gives no id at all for an empty text
        found = dict(zip(new, self.tool.encode([s[1:] for s in new], num_threads=1), strict=True)) if new else {}
        # the model writes a space as this mark, so the mark itself is one
        found.update((s, [self.tool.piece_to_id("▁")]) for s in (" ", "▁") if s in found)
        self.known.update((s, ids) for s, ids in found.items() if len(s) <= SHORT)
        found = self.known | found if any(len(s) > SHORT for s in found) else self.known
        return [np.array([i for s in row for i in found[s]], np.int64) for row in rows]


@Once
def ranked_bytes(path: str | None = None) -> RankedBytes:
    import public_tokenizers

    return RankedBytes(path or public_tokenizers.path(VOCABULARY))


@Once
def spaced_pieces(path: str | None = None) -> SpacedPieces:
    import public_tokenizers

    return SpacedPieces(path or public_tokenizers.path(PIECES))


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each token of A, then of B, the B token that ends its group.

    Both arguments are rising byte offsets at which tokens end, over the same bytes.
    """
    n = len(ends_a)
    to_b = np.searchsorted(ends_b, ends_a)
    to_a = np.searchsorted(ends_a, ends_b)
    successor = np.concatenate((n + to_b, np.where(ends_a[to_a] == ends_b, n + np.arange(len(ends_b)), to_a)))
    while True:
        farther = successor[successor]
        if (farther == successor).all():
            return successor - n
        successor = farther


def aligned_groups(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids in order, what follows each: 0 `,` 1 `|` 2 `;`, first tokens of links) of aligned tokens.

    The ids are group by group, those of A before those of B. The last array has for each
    group the places in A and B of the tokens that end it.
    """
    end = terminals(ends_a, ends_b)
    last = np.zeros(len(ends_b), np.int64)
    last[end] = 1
    group = (np.cumsum(last) - last)[end]
    group_a, group_b = group[: len(ends_a)], group[len(ends_a) :]
    count_a, count_b = np.bincount(group_a), np.bincount(group_b)
    through_a, through_b = np.cumsum(count_a), np.cumsum(count_b)
    place_a = np.arange(len(ids_a)) + (through_b - count_b)[group_a]
    place_b = np.arange(len(ids_b)) + through_a[group_b]
    ids, marks = np.empty(len(ids_a) + len(ids_b), np.int64), np.zeros(len(ids_a) + len(ids_b), np.int64)
    ids[place_a], ids[place_b] = ids_a, ids_b
    marks[place_a[through_a - 1]] = 1
    marks[place_b[through_b - 1]] = 2
    return ids, marks, np.stack((through_a - 1, through_b - 1))


@Once
def written_ids(n: int) -> list[str]:
    """Decimal ids below `n`, each followed by `,`, `|` and `;`."""
    return [f"{i}{mark}" for i in range(n) for mark in ",|;"]


OUT = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"


def align_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_a: str | None = None, vocabulary_b: str | None = None) -> DataFrame:
    """One row per document: its tokens, groups and distinct linked id pairs with their counts.

    A pair is `id of A << 32 | id of B`. A text that is null or empty, or that one of the
    tokenizers does not give back, has no tokens: zeros, no pairs and '' as hash.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool_a, tool_b = ranked_bytes(vocabulary_a), spaced_pieces(vocabulary_b)
        values = [t or "" for t in batch.column("text").to_pylist()]
        all_a, all_b = tool_a.encode(values), tool_b.encode(values)
        good = []
        for k, (value, a, b) in enumerate(zip(values, all_a, all_b, strict=True)):
            want = (" " + value).encode()
            if value and tool_a.tokens.join(a) == want and tool_b.tokens.join(b) == want:
                good.append(k)
        n = len(values)
        counts, hashes, pairs, times = np.zeros((3, n), np.int64), [""] * n, [()] * n, [()] * n
        if good:
            a, b = np.concatenate([all_a[k] for k in good]), np.concatenate([all_b[k] for k in good])
            # documents lie end to end, so both tokenizers' tokens end where a document does
            ids, marks, ends = aligned_groups(a, b, np.cumsum(tool_a.tokens.widths[a]), np.cumsum(tool_b.tokens.widths[b]))
            names = written_ids(max(len(tool_a.tokens.widths), len(tool_b.tokens.widths)))
            linked = a[ends[0]] << 32 | b[ends[1]]
            counts[0, good], counts[1, good] = [len(all_a[k]) for k in good], [len(all_b[k]) for k in good]
            stops = np.searchsorted(ends[0], np.cumsum(counts[0, good]))
            counts[2, good] = np.diff(stops, prepend=0)
            at = begin = 0
            for k, stop in zip(good, stops.tolist(), strict=True):
                to = at + len(all_a[k]) + len(all_b[k])
                said = "".join(map(names.__getitem__, (3 * ids[at:to] + marks[at:to]).tolist()))
                hashes[k] = hashlib.sha256(said[:-1].encode()).hexdigest()
                pairs[k], times[k] = np.unique(linked[begin:stop], return_counts=True)
                at, begin = to, stop
        arrays = [batch.column("doc_id"), *map(pa.array, counts), pa.array(hashes), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in OUT.split(", ")])

    return texts(df, key, text).mapInArrow(by_slices(work), OUT)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n, best): how often a pair is linked, and whether no pair of its B id is oftener."""
    counts = pairs.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    counts = kept(counts, "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """A least count that at most `most` pairs reach, a power of two."""
    # one row per power of two
    sizes = {r["power"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("pairs")).collect()}
    total, least = 0, 1 << 62
    for power in sorted(sizes, reverse=True):
        total += sizes[power]
        if total > most:
            break
        least = 1 << power
    return least if total > most else 1


def align(df: DataFrame, key: str = "doc_id", text: str = "text", p: Alignment = Alignment(), **vocabularies: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Links are the token pairs that end together, one for each group. Repeated rows and ids
    and null ids stay rows of their own, and each adds to the counts of the corpus. Null
    and empty texts, and texts that a tokenizer changes, give zeros and ''; an empty table
    gives an empty one.
    """
    rows = align_documents(df, key, text, **vocabularies).withColumn("row", F.monotonically_increasing_id())
    rows = kept(rows, "aligned")
    pairs = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    counts = kept(pair_counts(pairs), "counts")
    least = frequent_from(counts, p.most_frequent)
    found = pairs.join(F.broadcast(counts.filter(F.col("n") >= least)), "pair", "left")
    if least > 1:
        rare = found.filter(F.col("n").isNull()).select("row", "pair", "times").join(counts.filter(F.col("n") < least), "pair")
        found = found.filter(F.col("n").isNotNull()).unionByName(rare)
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    zero = F.lit(0).cast("long")
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
