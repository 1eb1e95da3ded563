"""From documents to packed training sequences, in five stages.

Each stage works on the documents that the stage before kept, as a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import langid, ngram_join, packing, pii, toxicity
from panelforge.llm.frames import free_names, read
from panelforge.session import scratch_path

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not flag; it learns from the labels of `docs`."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    (score,) = free_names(docs.columns, "toxicity")
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), name=score)
    return scored.filter(~toxicity.flagged(F.col(score))).select(*docs.columns)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the kernel recognises; a missing `lang` is filled in."""
    model = langid.fit(docs)
    found, score = free_names(docs.columns, "found", "score")
    predicted = langid.predict(docs, model, keep=tuple(docs.columns), names=(found, score))
    kept = predicted.filter(langid.recognised(F.col(found), F.col(score)))
    return kept.withColumn("lang", F.coalesce("lang", found)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of linked documents."""
    return ngram_join.first_of_groups(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked; `n_chars` follows the new text."""
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, placed in sequences of at most 2048 tokens."""
    return packing.pack(packing.cut_documents(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_languages),
    ("ngram_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
