"""Quality rules by distribution divergence, in DataFrame functions only.

Each document gets a histogram of character classes and one of common words. Summed over
all documents of a language they are that language's references. A document passes when
for some language both Jensen-Shannon distances are small; texts too short for a
histogram are not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import kept, texts

#: Frequent words of English, French, German and Spanish.
COMMON_WORDS = (
    "the of and to in is that was for with "
    "le la les de des et que une un pas "
    "der die das und ist für von den nicht mit "
    "el los y en una por con se del su"
).split()

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Character classes, counted in this order in what the ones before leave; the last is the rest.
CLASSES = {
    "lower": "[a-z]",
    "space": r"[\x20\x09-\x0D]",
    "upper": "[A-Z]",
    "letter": r"\p{L}",
    "stop": r"[.,;:!?]",
    "digit": "[0-9]",
}
N_CLASSES = len(CLASSES) + 1

MIN_WORDS = 50
MIN_CLASS_CHARS = 200
MIN_COMMON_WORDS = 100
MAX_CLASS_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.26
#: Languages with the most documents that give references; the others' documents are
#: compared with these. Bounds what reaches the driver.
MAX_LANGUAGES = 200


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def text_features(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts and both histograms of each row, without leaving the row."""
    rows = texts(df, key, text, F.col(lang).cast("string").alias("lang")).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select(
        "doc_id",
        "lang",
        F.length("text").alias("n_chars"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
        F.regexp_replace("text", "[a-z]+", "").alias("left0"),
    )
    n = F.size("words")
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    for at, (name, pattern) in enumerate(list(CLASSES.items())[1:]):
        rows = rows.withColumn(f"left{at + 1}", F.regexp_replace(f"left{at}", f"{pattern}+", ""))
    edges = [F.col("n_chars"), *(F.length(f"left{at}") for at in range(len(CLASSES)))]
    histogram = F.array(*(edges[i] - edges[i + 1] for i in range(len(CLASSES))), edges[-1]).cast("array<bigint>")
    rows = rows.select(
        "doc_id",
        "lang",
        _size(F.col("words")).alias("n_words"),
        "word_chars",
        "n_symbols",
        (_size(F.col("lines")) - _size(F.array_distinct("lines"))).alias("n_dup_lines"),
        histogram.alias("class_counts"),
        windows.alias("windows"),
        F.filter("words", lambda w: w.isin(COMMON_WORDS)).alias("common"),
    )
    # windows that occur twice stand beside each other once sorted
    marked = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    rows = rows.withColumn("marked", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), marked).otherwise(none))
    twice = F.filter(
        "marked",
        lambda x, i: x["h"].eqNullSafe(F.get("marked", i - 1)["h"]) | x["h"].eqNullSafe(F.get("marked", i + 1)["h"]),
    )
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["p"])))
    covered = F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - p, F.lit(3))))
    word_counts = [F.size("common") - F.size(F.array_remove("common", w)) for w in COMMON_WORDS]
    return rows.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        "class_counts",
        F.array(*word_counts, F.col("n_words") - F.size("common")).cast("array<bigint>").alias("word_counts"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def language_references(features: DataFrame) -> list[tuple[list[float], list[float]]]:
    """Class and word shares of each language, over all its documents that the base rules keep.

    What reaches the driver is one row for each of at most MAX_LANGUAGES languages.
    """
    sums = [F.sum(F.get("class_counts", F.lit(i))) for i in range(N_CLASSES)]
    word_sums = [F.sum(F.get("word_counts", F.lit(i))) for i in range(len(COMMON_WORDS) + 1)]
    rows = (
        features.filter(~base_failed() & F.col("lang").isNotNull())
        .groupBy("lang")
        .agg(F.count("*").alias("n"), F.array(*sums).alias("c"), F.array(*word_sums).alias("w"))
        .orderBy(F.desc("n"), "lang")
        .limit(MAX_LANGUAGES)
        .collect()
    )
    return [([x / sum(r["c"]) for x in r["c"]], [x / sum(r["w"]) for x in r["w"]]) for r in rows]


def js_distance(counts: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) between counts and given shares."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(
        F.transform(counts, lambda x: x / total),
        F.array(*map(F.lit, shares)),
        lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2),
    )
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2))


def within_references(references: list[tuple[list[float], list[float]]]) -> Column:
    """Whether some language is near in both histograms, as far as those are long enough."""
    chars = F.aggregate("class_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    near = F.lit(not references)
    for classes, words in references:
        near = near | (
            ((chars < MIN_CLASS_CHARS) | (js_distance(F.col("class_counts"), classes) <= MAX_CLASS_DISTANCE))
            & ((F.col("n_words") < MIN_COMMON_WORDS) | (js_distance(F.col("word_counts"), words) <= MAX_WORD_DISTANCE))
        )
    return near


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    Null and empty texts have no words and fail the base rules. Documents without a
    language are judged but give no reference; if no document has one, the base rules
    decide alone. Rows are judged one by one, so repeated rows and null keys stay.
    """
    features = kept(text_features(df, key, text, lang), "quality")
    near = within_references(language_references(features))
    return features.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & near).alias("kept"),
    )
