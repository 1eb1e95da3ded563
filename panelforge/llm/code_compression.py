"""Product codes of vectors, by a Lloyd iteration that only looks again at what moved.

Vectors lie in blocks together with each part's entry and its exact squared distance to
it. After the codebooks are updated, a part whose entry stayed where it was still has its
stored distance, and no entry that stayed can have become nearer: it is compared with the
moved entries only. A part whose entry moved is compared with all. All arithmetic is on
integers, so sums do not depend on the order of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import binaries, discard, written
from panelforge.llm.vectors import exact_kind, finite_vectors, integer_rows

LONGEST = 2**63 - 1


@dataclass(frozen=True)
class Codebooks:
    """Components per unit, equal parts of a vector, entries of a codebook, rounds.

    A block holds at most `block_cells` components and 4096 vectors.
    """

    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    block_cells: int = 1 << 18


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    kind = exact_kind(most, most, x.shape[1])
    x, book = x.astype(kind), book.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)).astype(np.int64)


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, codes: np.ndarray, nearest: np.ndarray) -> int:
    """Bring `codes` and `nearest` of one part up to date in place; returns the distances computed.

    `moved` marks the entries that changed since both were right.
    """
    stale = moved[codes]
    again, held, active = np.flatnonzero(stale), np.flatnonzero(~stale), np.flatnonzero(moved)
    if len(again):
        d = distances(x[again], book)
        best = d.argmin(axis=1)
        codes[again], nearest[again] = best, d[np.arange(len(again)), best]
    if len(held) and len(active):
        d = distances(x[held], book[active])
        best = d.argmin(axis=1)
        d, entry = d[np.arange(len(held)), best], active[best]
        nearer = (d < nearest[held]) | (d == nearest[held]) & (entry < codes[held])
        codes[held[nearer]], nearest[held[nearer]] = entry[nearer], d[nearer]
    return len(again) * len(book) + len(held) * len(active)


def block_schema(label: str) -> str:
    return f"ids array<long>, labels array<{label}>, kind string, vectors binary, codes binary, nearest binary, counts array<long>, sums array<long>"


def _packed(width: int, p: Codebooks):
    """Rows (vec_id, label, vector) as blocks that no entry is assigned in yet."""
    rows = max(1, min(4096, p.block_cells // width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                x = integer_rows(batch.column("vector"), p.scale, width, 2)
                n, most = len(x), np.abs(x).max(initial=0)
                kind = "int16" if most < 1 << 15 else "int32"
                one = pa.array([0, n], pa.int32())
                columns = [pa.ListArray.from_arrays(one, batch.column("vec_id")), pa.ListArray.from_arrays(one, batch.column("label"))]
                empty = [b"", b"", []], [pa.binary(), pa.binary(), pa.list_(pa.int64())]
                columns += [pa.array([kind]), pa.array([x.astype(kind).tobytes()]), *(pa.array([v], t) for v, t in zip(*empty, strict=True)), pa.array([[]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "kind", "vectors", "codes", "nearest", "counts", "sums"])

    return run


def _block(batch: pa.RecordBatch, k: int, p: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, codes, nearest) of one block; the last two by part."""
    n = len(batch.column("ids")[k])
    x = np.frombuffer(batch.column("vectors")[k].as_buffer(), batch.column("kind")[k].as_py()).reshape(n, -1).astype(np.int64)
    codes = np.frombuffer(batch.column("codes")[k].as_buffer(), np.uint8)
    nearest = np.frombuffer(batch.column("nearest")[k].as_buffer(), np.int64)
    if not len(codes):
        codes, nearest = np.zeros(p.parts * n, np.uint8), np.zeros(p.parts * n, np.int64)
    return x, codes.reshape(p.parts, n).astype(np.int64), nearest.reshape(p.parts, n).copy()


def _assigned(book: np.ndarray, moved: np.ndarray, p: Codebooks):
    """Blocks with codes and distances for `book`, and the counts and sums of its entries."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = {name: [] for name in ("codes", "nearest", "counts", "sums")}
        for k in range(batch.num_rows):
            x, codes, nearest = _block(batch, k, p)
            w = x.shape[1] // p.parts
            counts, sums = np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)
            for part in range(p.parts):
                piece = x[:, part * w : (part + 1) * w]
                reassign(piece, book[part], moved[part], codes[part], nearest[part])
                counts[part] = np.bincount(codes[part], minlength=book.shape[1])
                order = np.argsort(codes[part], kind="stable")
                used = np.flatnonzero(counts[part])
                sums[part, used] = np.add.reduceat(piece[order], (np.cumsum(counts[part]) - counts[part])[used])
            new["codes"].append(codes.astype(np.uint8).tobytes())
            new["nearest"].append(nearest.tobytes())
            new["counts"].append(counts.ravel())
            new["sums"].append(sums.ravel())
        kinds = {"codes": pa.binary(), "nearest": pa.binary(), "counts": pa.list_(pa.int64()), "sums": pa.list_(pa.int64())}
        columns = [pa.array(new[n], kinds[n]) if n in new else batch.column(n) for n in batch.schema.names]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield work(batch.slice(at, 1))

    return run


def _rows(p: Codebooks):
    """(vec_id, code, error, label) of the vectors of blocks."""
    digits = np.frombuffer(b"".join(b"%02x" % c for c in range(256)), "S2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, codes, nearest = _block(batch, k, p)
                code = binaries(digits[codes.T]).cast(pa.string())
                columns = [batch.column("ids")[k].values, code, pa.array(nearest.sum(axis=0)), batch.column("labels")[k].values]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "code", "error", "label"])

    return run


def _tallied(blocks: DataFrame, name: str, shape: tuple[int, ...]) -> np.ndarray:
    """The sums over all blocks of an array column; one row per component of the codebooks."""
    places = blocks.select(F.posexplode(name).alias("place", "value")).groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = np.zeros(int(np.prod(shape)), object)
    for row in places.collect():
        out[row["place"]] = int(row["value"])
    return out.reshape(shape)


def trained(blocks: DataFrame, book: np.ndarray, p: Codebooks) -> tuple[DataFrame, np.ndarray]:
    """The blocks assigned to the codebooks that `rounds` rounds give, and these codebooks.

    Each round writes the blocks anew and removes the table of the round before. Rounds
    end early when no entry moves, as further ones would change nothing.
    """
    moved, before = np.ones(book.shape[:2], bool), None
    for turn in range(p.rounds + 1):
        blocks, place = written(blocks.mapInArrow(_assigned(book, moved, p), blocks.schema), "codes")
        if before:
            discard(blocks.sparkSession, before)
        before = place
        if turn == p.rounds:
            break
        counts, sums = _tallied(blocks, "counts", book.shape[:2]), _tallied(blocks, "sums", book.shape)
        mean = sums // np.maximum(counts, 1)[:, :, None]
        mean = np.where((counts > 0)[:, :, None], mean, book).astype(np.int64)
        moved = (mean != book).any(axis=2)
        if not moved.any():
            break
        book = mean
    return blocks, book


def product_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", p: Codebooks = Codebooks()) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the rows with finite vectors.

    Vectors that are null or hold null or non-finite components are left out. Repeated ids
    and equal vectors stay rows of their own; among the first entries they are ordered by
    their components, rows without an id come last. Vectors shorter than the longest, and
    widths that the parts do not divide, end in zeros. Components of a size with which a
    distance could not be a long are taken as the limit of that size. Sums of a label
    beyond a long are the greatest long. Fewer rows than entries give as many entries; an
    empty table gives an empty one.
    """
    kind = df.schema[label].dataType.simpleString()
    rows = finite_vectors(df, key, vector, F.col(label).alias("label"))
    # at most one vector per entry, and one row
    firsts = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(p.entries).select("vector").collect()
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = p.parts * max(1, -(-longest // p.parts))
    book = integer_rows(pa.array([r["vector"] for r in firsts], pa.list_(pa.float64())), p.scale, width, 2)
    book = np.ascontiguousarray(book.reshape(len(firsts), p.parts, -1).transpose(1, 0, 2))
    blocks, book = trained(rows.mapInArrow(_packed(width, p), block_schema(kind)), book, p)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    coded = blocks.mapInArrow(_rows(p), f"vec_id long, code string, error long, label {kind}")
    most = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    totals = coded.groupBy(F.col("label").alias("same")).agg(most.alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("same"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
