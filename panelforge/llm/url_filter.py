"""URL rules: a blocked Bloom filter lets possible hits through to an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Bits of the filter per listed key, and its largest number of 64-bit blocks (16 MB).
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 21
PROBES = 4


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url and for one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """PROBES bits of one 64-bit block, taken from a second hash."""
    second = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def bloom_blocks(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """(block, bits) of the filter over column `key`, at most MAX_BLOCKS rows.

    Beyond that bound the filter lets more false hits through; the exact join removes them.
    """
    blocks = min(MAX_BLOCKS, max(1, n_keys * BITS_PER_KEY // 64))
    filled = keys.select(_block(F.col("key"), blocks).alias("block"), _mask(F.col("key")).alias("bits"))
    return filled.groupBy("block").agg(F.expr("bit_or(bits)").alias("bits")), blocks


def bloom_hits(rows: DataFrame, filled: DataFrame, blocks: int) -> DataFrame:
    """The rows whose `key` the filter may hold."""
    met = rows.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(filled), "block")
    return met.filter(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).drop("block", "bits")


def bloom_misses(rows: DataFrame, filled: DataFrame, blocks: int) -> DataFrame:
    """The rows whose `key` the filter cannot hold."""
    met = rows.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(filled), "block", "left")
    held = F.coalesce(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")), F.lit(False))
    return met.filter(~held).drop("block", "bits")


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    The listed keys are the rules' `host` + `path`. A url offers the keys made of each
    suffix of its host with as many labels as some rule's, and each prefix of its path
    whose length some rule has, so a very long url offers no more than others. Keys that
    pass the filter are joined with the rules exactly, and the longest fitting rule wins
    (of equally long ones, the smallest by verdict). An url without a fitting rule gets
    `default`.

    Null urls have an empty host and path and fit only rules with empty ones. Rules with
    null fields are ignored, repeated rules count once. Each row is judged by its host and
    path alone, so repeated rows and null keys stay; an empty rule table gives `default`.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = rules.select("verdict", "host", "path").dropna().groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    depth = F.size(F.split("host", r"\."))
    size = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths"), F.collect_set(depth).alias("depths")).first()
    if not size["n"]:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    listed = rules.select(_key(F.col("host"), F.col("path")).alias("key"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    filled, blocks = bloom_blocks(listed, size["n"])

    distinct = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    depths = F.array(*(F.lit(n) for n in sorted(size["depths"])))
    suffixes = F.transform(F.filter(depths, lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    lengths = F.array(*(F.lit(n) for n in sorted(size["lengths"])))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    offered = (
        distinct.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .withColumn("key", _key(F.col("suffix"), F.col("prefix")))
    )
    exact = bloom_hits(offered, filled, blocks).join(listed, "key").filter((F.col("suffix") == F.col("rule_host")) & (F.col("prefix") == F.col("rule_path")))
    order = F.struct(F.length("key"), F.length("rule_host"))
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct(F.col("key").alias("rule"), "verdict"), order).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")
    )
