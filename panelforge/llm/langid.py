"""Language identification with a string kernel.

The kernel of two texts is the share of character n-grams (one to three letters, blended)
that both hold, regardless of how often. A few training texts per language are landmarks;
their kernel matrix gives Nystroem features, on which one ridge regression per language
separates it from the rest. Texts are scored in batches by two matrix products.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelforge.llm.frames import Once, free_names, held_out

UNKNOWN = "und"


@dataclass(frozen=True)
class Kernel:
    """Parameters. Samples are per language, of at most `languages` languages (the most frequent)."""

    bits: int = 13
    landmarks: int = 24
    sample: int = 400
    languages: int = 200
    ridge: float = 1e-2
    rows: int = 64


def _letters() -> np.ndarray:
    """Lower-case letters as themselves, everything else as a space."""
    table = np.full(1 << 16, 32, np.uint32)
    for code in range(1 << 16):
        char = chr(code)
        if unicodedata.category(char)[0] == "L":
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


LETTERS = Once(_letters)
CHUNK = 1 << 20


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = LETTERS()
    codes = table[np.minimum(raw, 0xFFFF)]
    high = raw > 0xFFFF
    if high.any():
        codes[high] = [c if chr(c).isalpha() else 32 for c in raw[high].tolist()]
    return codes


def mark(text: str, row: np.ndarray, bits: int) -> bool:
    """Set the places of the text's n-grams in `row`; False if it has no letter."""
    found = False
    shift = np.uint32(32 - bits)
    for at in range(0, max(1, len(text)), CHUNK):
        c = _codes(text[max(0, at - 2) : at + CHUNK])
        if not (c != 32).any():
            continue
        found = True
        one = c * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        row[one >> shift] = 1
        if len(c) > 1:
            two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
            row[two >> shift] = 1
            if len(c) > 2:
                row[((two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)) >> shift] = 1
    return found


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sizes = np.sqrt(np.maximum(a.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(b.sum(axis=1), 1))[None, :]
    return a @ b.T / sizes


def sample(docs: DataFrame, p: Kernel) -> DataFrame:
    """(lang, doc_id, text): at most `p.sample` learnable rows of each language.

    Rows are thinned by a hash before they are ranked, so that a language's ranking holds
    about twice its sample, whatever its share of the table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(p.languages)
    order = F.xxhash64("doc_id", "text")
    part = F.pmod(order, F.lit(1_000_000)) / F.lit(1_000_000.0)
    thin = rows.join(F.broadcast(counts), "lang").filter(part < 2.0 * p.sample / F.col("n") + 0.001)
    ranked = thin.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", "text")))
    return ranked.filter(F.col("rank") <= p.sample).select("lang", "doc_id", "text")


def landmark_rows(rows: list[tuple[str, bytes]], most: int) -> np.ndarray:
    """Up to `most` places of each language in the order of a hash of the set, equal sets once."""
    first = {row: k for k, row in reversed(list(enumerate(rows)))}
    order = sorted(first, key=lambda row: (row[0], blake2b(row[1], digest_size=8).digest(), row[1]))
    return np.array([first[row] for _, group in groupby(order, key=lambda row: row[0]) for row in list(group)[:most]])


def fit(docs: DataFrame, p: Kernel = Kernel()) -> Model:
    """The landmarks and ridge weights; what reaches the driver is a bit set for each sampled text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, letters = [], []
            for text in batch.column("text").to_pylist():
                row = np.zeros(1 << p.bits, np.uint8)
                letters.append(mark(text, row, p.bits))
                sets.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("doc_id"), pa.array(sets, pa.binary()), pa.array(letters)],
                names=["lang", "doc_id", "bits", "letters"],
            )

    found = sample(docs, p).mapInArrow(work, "lang string, doc_id long, bits binary, letters boolean")
    rows = sorted((r["lang"], bytes(r["bits"])) for r in found.filter("letters").collect())
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], np.zeros((0, 1 << p.bits), np.float32), np.zeros((0, 0)))
    sets = np.unpackbits(np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    place = np.array([languages.index(lang) for lang, _ in rows])
    marks = landmark_rows(rows, p.landmarks)
    landmarks = sets[marks]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.hstack([kernel(sets, landmarks) @ root, np.ones((len(rows), 1))])
    target = np.where(place[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # classes weigh alike, however many samples each has
    share = 1.0 / np.bincount(place, minlength=len(languages))[place][:, None]
    solved = np.linalg.solve(features.T @ (features * share) + p.ridge * np.eye(features.shape[1]) / 10, features.T @ (target * share))
    return Model(languages, landmarks, np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32))


def predict(df: DataFrame, model: Model, p: Kernel = Kernel(), keep: tuple[str, ...] = (), text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep`, the predicted language and its score (`names`) of every row.

    The score is the winner's regression value, moved from -1..1 to 0..1. Texts that are
    null or have no letter are `und` with score 0, and so are all without a learned
    language. Of equal values the first language by name wins.
    """
    kept = [f for f in df.schema.fields if f.name in keep]
    (text_name,) = free_names(keep, "text")
    schema = T.StructType([*kept, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast((model.languages, np.packbits(model.landmarks.astype(np.uint8), axis=1), model.weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, packed, weights = sent.value
        landmarks = np.unpackbits(packed, axis=1).astype(np.float32) if languages else None
        labels = np.array([*languages, UNKNOWN], object)
        for whole in batches:
            for at in range(0, whole.num_rows, p.rows):
                batch = whole.slice(at, p.rows)
                best, score = np.full(batch.num_rows, len(languages)), np.zeros(batch.num_rows)
                if languages:
                    sets = np.zeros((batch.num_rows, 1 << p.bits), np.float32)
                    known = np.array([t is not None and mark(t, sets[i], p.bits) for i, t in enumerate(batch.column(text_name).to_pylist())])
                    margins = kernel(sets, landmarks) @ weights[:-1] + weights[-1]
                    best[known] = margins.argmax(axis=1)[known]
                    score[known] = np.clip((margins.max(axis=1)[known].astype(float) + 1) / 2, 0, 1)
                columns = [*(batch.column(f.name) for f in kept), pa.array(labels[best], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text).cast("string").alias(text_name)).mapInArrow(work, schema)


def identify(docs: DataFrame, p: Kernel = Kernel()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Learns from texts with a language that are not held out. Rows are scored one by one,
    so repeated rows and null keys stay; an empty table gives an empty one.
    """
    model = fit(docs, p)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, model, p, keep=("doc_id", "held_out"))


def recognised(lang: Column, score: Column) -> Column:
    """Texts with letters that not every language's regression clearly turns down."""
    return (lang != UNKNOWN) & (score >= 0.25)
