"""Page extraction, review cleaning and the incremental job."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog import views as v
from panelforge.catalog.registry import query
from panelforge.functions import codebook as cb
from panelforge.functions.recode import default_text
from panelforge.functions.text import element_text, number_after
from panelforge.operators.profile import value_counts
from panelforge.sources import pages as pg
from panelforge.sources.tables import load_keys, read_csv, read_table, save_keys, write_csv
from panelforge.session import scratch_path
from panelforge.streaming.pages import append_parsed, page_stream

MOST_BATCHES = 10

_WORDS = """words AS (SELECT page_id, lower(split_part(w, ' ', 1)) AS word FROM
  (SELECT page_id, unnest(regexp_extract_all(html, '<li><a[^>]*>([^<]*)', 1)) AS w FROM pages))"""


@query("S5 H1 C11", f"WITH {_WORDS} SELECT page_id, word, count(*)::BIGINT AS n FROM words GROUP BY 1, 2")
def page_key_words(spark, folder):
    words = pg.key_words(read_table(spark, folder, "pages"), "li")
    return words.groupBy("page_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("S7 H1", f"WITH {_WORDS} SELECT DISTINCT word FROM words")
def page_key_list(spark, folder):
    path = scratch_path(spark, "words")
    save_keys(pg.key_words(read_table(spark, folder, "pages"), "li"), "word", path)
    return load_keys(spark, path)


_NUMBER = "coalesce(TRY_CAST(nullif(regexp_extract(url, 'page=(\\d+)', 1), '') AS INTEGER), 1)"


@query(
    "H2 H3 H8",
    f"SELECT page_id, {_NUMBER} AS n_pages, unnest(range(1, {_NUMBER}::BIGINT + 1))::INTEGER AS page FROM pages WHERE {_NUMBER} <= {cb.MOST_PAGES}",
)
def page_numbers(spark, folder):
    counted = read_table(spark, folder, "pages").select("page_id", number_after("url", r"page=(\d+)").alias("n_pages"))
    return pg.numbered(counted)


def _element(tag: str) -> str:
    found = f"regexp_extract(html, '(?s)<{tag}[^>]*>(.*?)</{tag}>', 1)"
    return f"nullif(regexp_replace({found}, '<[^>]*>', '', 'g'), '')"


@query(
    "H5 H6 H7 N2",
    f"SELECT page_id, {_element('h1')} AS heading, {_element('p')} AS first_paragraph, coalesce({_element('footer')}, 'NA') AS footer, "
    f"coalesce({_element('h6')}, 'NA') AS missing FROM pages",
)
def page_elements(spark, folder):
    return read_table(spark, folder, "pages").select(
        "page_id",
        element_text("html", "h1").alias("heading"),
        element_text("html", "p").alias("first_paragraph"),
        default_text(element_text("html", "footer"), cb.NOT_GIVEN).alias("footer"),
        default_text(element_text("html", "h6"), cb.NOT_GIVEN).alias("missing"),
    )


@query(
    "H2 H3 C12",
    f"WITH {v._REVIEW_ROWS}, n AS (SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 6 + 2)::INTEGER ELSE 1 END AS n_pages FROM review_rows), "
    "e AS (SELECT *, unnest(range(1, n_pages::BIGINT + 1))::INTEGER AS page FROM n) "
    "SELECT *, printf('https://reviews.example/browse/%s?sheet=%s', page_id::VARCHAR, page::VARCHAR) AS url FROM e",
)
def review_page_addresses(spark, folder):
    return pg.page_addresses(v.review_pages(spark, folder), "page_id", v.ADDRESS)


@query(
    "H1 H3 C12",
    f"WITH {v._REVIEW_ROWS}, k AS (SELECT count(DISTINCT lower(c_mktsegment))::INTEGER AS n_pages FROM review_rows) "
    "SELECT n_pages, unnest(range(1, n_pages::BIGINT + 1))::INTEGER AS page, printf('https://reviews.example/listing?cat=1&page=%s', unnest(range(1, n_pages::BIGINT + 1))::VARCHAR) AS url FROM k",
)
def listing_addresses(spark, folder):
    """One listing with a page for every key word."""
    words = pg.key_words(v.review_pages(spark, folder)).agg(F.count_distinct("word").cast("int").alias("n_pages"))
    return pg.listing_addresses(words, "https://reviews.example/listing?cat=1&page=%s")


_RAW = ", ".join(cb.REVIEW_RAW)


@query("S5 H4 H5 H6 H7 H9 C11 C13 N2", f"WITH {v.REVIEWS} SELECT page_id, position, {_RAW} FROM reviews")
def review_records(spark, folder):
    return pg.flat_conditions(pg.parse_reviews(v.review_pages(spark, folder), personal=True))


@query(
    "H8",
    f"WITH {v._REVIEW_ROWS} SELECT o_orderkey AS page_id, 3 AS position, lower(c_mktsegment) AS drug_name FROM review_rows WHERE o_orderkey % 10 = 0",
)
def review_rejects(spark, folder):
    return pg.parse_rejects(v.review_pages(spark, folder), block=False)


_CLEAN = f"""{v.REVIEWS}, cleaned AS (SELECT CASE adherence WHEN 'Always' THEN '4' WHEN 'Usually' THEN '3' WHEN 'Sometimes' THEN '2'
  WHEN 'Never taken as prescribed' THEN '1' ELSE adherence END AS adherence, drug_name, username, age, sex, country, burden, cost, side_effects,
  coalesce(TRY_CAST(first_diagnosis_date AS INTEGER), 0) AS first_diagnosis_date, primary_condition
  FROM reviews WHERE age IS NOT NULL AND sex IS NOT NULL AND primary_condition IS NOT NULL)"""


@query("F2 P1 P3 N1 C1 C6", f"WITH {_CLEAN} SELECT * FROM cleaned")
def reviews_clean(spark, folder):
    return pg.clean_reviews(pg.parse_reviews(v.review_pages(spark, folder), personal=True))


@query(
    "F5 P1 A2",
    f"WITH {_CLEAN} SELECT country, count(*)::BIGINT AS n, count(DISTINCT username)::BIGINT AS users FROM cleaned "
    "WHERE country IN ('United States', 'Canada', 'United Kingdom', 'Mexico') GROUP BY 1",
)
def reviews_by_country(spark, folder):
    clean = pg.clean_reviews(pg.parse_reviews(v.review_pages(spark, folder), personal=True), cb.REVIEW_COUNTRIES)
    return clean.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("username").alias("users"))


@query(
    "S3 S4 P1",
    f"WITH {_CLEAN} SELECT drug_name, age, sex, country, burden, nullif(cost, 'NA') AS cost, side_effects, first_diagnosis_date, primary_condition FROM cleaned",
)
def published_reviews_csv(spark, folder):
    clean = pg.clean_reviews(pg.parse_reviews(v.review_pages(spark, folder), personal=True))
    published = pg.published_reviews(clean)
    path = scratch_path(spark, "published")
    write_csv(published, path)
    return read_csv(spark, path, published.schema)


@query(
    "A1",
    f"WITH {_CLEAN} "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*)::BIGINT AS n FROM cleaned GROUP BY 2" for c in ("adherence", "cost", "burden", "age")),
)
def review_value_counts(spark, folder):
    clean = pg.clean_reviews(pg.parse_reviews(v.review_pages(spark, folder), personal=True))
    return value_counts(clean, ["adherence", "cost", "burden", "age"])


@query("S5 S6 H1 H8", f"WITH {_WORDS} SELECT page_id, word, count(*)::BIGINT AS n FROM words GROUP BY 1, 2")
def incremental_key_words(spark, folder):
    """The streaming job over the page folder; equal to the batch result."""
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    append_parsed(page_stream(spark, folder, "pages.parquet"), lambda p: pg.key_words(p, "li"), out, state)
    return spark.read.parquet(out).groupBy("page_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("S6 H1", f"WITH {_WORDS} SELECT page_id, word, count(*)::BIGINT AS n FROM words GROUP BY 1, 2")
def key_words_in_batches(spark, folder):
    """Pages arrive in four parts and once more with a longer text; each is parsed once, over several batches."""
    arrived, out, state = (scratch_path(spark, n) for n in ("pages", "words", "words-state"))
    pages = read_table(spark, folder, "pages")
    parts = [pages.where(F.pmod(F.xxhash64("page_id"), F.lit(4)) == i) for i in range(4)]
    again = pages.withColumn("html", F.concat("html", F.lit("<ul><li><a>again</a></li></ul>")))
    for part in [*parts, again]:
        part.write.mode("append").parquet(arrived)
    # Each batch costs seconds of its own and meets all keys before, so their number stays and their size grows.
    files = max(2, -(-len(spark.read.parquet(arrived).inputFiles()) // MOST_BATCHES))
    append_parsed(page_stream(spark, arrived, files=files), lambda p: pg.key_words(p, "li"), out, state)
    return spark.read.parquet(out).groupBy("page_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("S5 S6 H4 H9", f"WITH {v.REVIEWS} SELECT page_id, position, {_RAW} FROM reviews")
def incremental_reviews(spark, folder):
    """Review pages arrive as files, are parsed in micro-batches and appended."""
    arrived, out, state = (scratch_path(spark, n) for n in ("arrived", "reviews", "reviews-state"))
    v.review_pages(spark, folder).write.parquet(arrived)
    append_parsed(page_stream(spark, arrived), lambda p: pg.parse_reviews(p, personal=True), out, state)
    return pg.flat_conditions(spark.read.parquet(out).drop("batch"))
