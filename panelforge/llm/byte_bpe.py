"""Byte-level BPE encoding and decoding with numpy matrices.

Distinct pieces of a slice of documents are put into padded matrices of pieces of similar
length. In each round every row merges its leftmost pair of lowest rank, so every row
loses one column; rows without a pair leave the matrix. Ranks of pairs come from an
open-addressing hash table over (left id, right id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import Once, by_slices, texts
from panelforge.llm.token_counts import read_ranks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Cells of one matrix, and pieces a task remembers; both only bound memory.
MATRIX_CELLS = 1 << 18
REMEMBERED = 400_000
#: From this width on, rows are merged one at a time in place.
LONG_PIECE = 2048

NONE = np.int32(2**31 - 1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, which is also the rank of the merge."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        self.probes = 1
        key, value = np.array(keys, np.int64), np.array(merged, np.int32)
        slot = self._home(key)
        while len(key):
            free = self.keys[slot] < 0
            first = np.zeros(len(key), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            key, value, slot = key[~put], value[~put], (slot[~put] + 1) & self.mask
            self.probes += 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * SPREAD >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs, NONE where the pair is no merge or holds padding (-1)."""
        shape, left, right = left.shape, left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        found = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[todo] << 32 | right[todo]
        slot = self._home(key)
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == key
            found[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (there >= 0)
            if not go.any():
                break
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & self.mask
        return found.reshape(shape)


class BytePairs:
    """Encoder and decoder of one vocabulary of byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.whole = ranks
        self.pairs = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.widths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.widths)))[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece; a piece that is a token itself is that token."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        open_rows = []
        for i, piece in enumerate(pieces):
            rank = self.whole.get(piece)
            if rank is not None or not piece:
                out[i] = np.array([] if rank is None else [rank], np.int32)
            else:
                open_rows.append(i)
        open_rows.sort(key=lambda i: len(pieces[i]))
        at = 0
        while at < len(open_rows):
            least = len(pieces[open_rows[at]])
            if least >= LONG_PIECE:
                i = open_rows[at]
                out[i] = self._merge_long(self.of_byte[np.frombuffer(pieces[i], np.uint8)])
                at += 1
                continue
            to = at
            while to < len(open_rows) and len(pieces[open_rows[to]]) <= least + least // 4 and (to - at) * least < MATRIX_CELLS:
                to += 1
            rows = open_rows[at:to]
            for i, ids in zip(rows, self._merge_matrix([pieces[i] for i in rows]), strict=True):
                out[i] = ids
            at = to
        return out

    def _merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(rows):
            if ranks.shape[1]:
                best = ranks.argmin(axis=1)
                rank = ranks[np.arange(len(rows)), best]
                done = rank == NONE
            else:
                done = np.ones(len(rows), bool)
            for k in np.flatnonzero(done):
                row = ids[k]
                out[rows[k]] = row[row >= 0].copy()
            live = ~done
            if not live.any():
                break
            rows, ids, ranks, best, rank = rows[live], ids[live], ranks[live], best[live], rank[live]
            line = np.arange(len(rows))
            ids[line, best] = rank
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > best[:, None]), axis=1)
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= best[:, None]), axis=1)
            for shift in (-1, 0):
                spot = best + shift
                fits = (spot >= 0) & (spot < ranks.shape[1])
                ranks[line[fits], spot[fits]] = self.pairs.ranks(ids[line[fits], spot[fits]], ids[line[fits], spot[fits] + 1])
        return out

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same rounds on one long row, whose columns close up in place."""
        ids, ranks, n = ids.copy(), self.pairs.ranks(ids[:-1], ids[1:]), len(ids)
        while n > 1:
            j = int(ranks[: n - 1].argmin())
            if ranks[j] == NONE:
                break
            ids[j] = ranks[j]
            ids[j + 1 : n - 1] = ids[j + 2 : n]
            ranks[j : n - 2] = ranks[j + 1 : n - 1]
            n -= 1
            low, high = max(0, j - 1), min(n - 1, j + 1)
            ranks[low:high] = self.pairs.ranks(ids[low:high], ids[low + 1 : high + 1])
        return ids[:n].copy()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of token ids."""
        widths = self.widths[ids]
        ends = np.cumsum(widths)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + widths, widths)]


@Once
def byte_pairs(path: str | None = None) -> BytePairs:
    import public_tokenizers

    return BytePairs(read_ranks(path or public_tokenizers.path(VOCABULARY)))


@Once
def splitter():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row, without special tokens; null texts give no ids.

    Rows are encoded one by one: repeated rows, null keys and empty tables need no care.
    """
    known: dict[str, bytes] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, split = byte_pairs(vocabulary), splitter().findall
        pieces = [split(t or "") for t in batch.column("text").to_pylist()]
        if len(known) > REMEMBERED:
            known.clear()
        new = list({p for row in pieces for p in row if p not in known})
        for piece, ids in zip(new, coder.encode([p.encode() for p in new]), strict=True):
            known[piece] = ids.tobytes()
        packed = [b"".join(map(known.__getitem__, row)) for row in pieces]
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return texts(df, key, text).mapInArrow(by_slices(work), "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """The columns `keep`, and `decoded`, the bytes that the ids of a row stand for.

    A null list gives no bytes; null ids inside a list are passed over.
    """
    kept = [f for f in df.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "decoded binary"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, column = byte_pairs(vocabulary), batch.column("__ids")
        counts = np.asarray(column.value_lengths().fill_null(0), np.int64)
        flat = np.asarray(column.flatten(), np.int64)
        data = coder.decode(flat)
        ends = np.concatenate(([0], np.cumsum(coder.widths[flat])))[np.concatenate(([0], np.cumsum(counts)))]
        decoded = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), decoded], names=[*(f.name for f in kept), "decoded"])

    plain = F.filter(F.col(ids), lambda x: x.isNotNull()).alias("__ids")
    return df.select(*(f.name for f in kept), plain).mapInArrow(by_slices(work), schema)
