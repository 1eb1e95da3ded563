"""Listing and review pages to typed records.

Pages are rows of (page_id, url, html). Extraction is made of column expressions
only, over the whole text of a page, so it runs the same in batch and streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelforge.functions import codebook as cb
from panelforge.functions.recode import default_text, labelled, whole_number
from panelforge.functions.text import address, link_words, number_after, unescaped_all, without_tags, word_at, words_between
from panelforge.operators.columns import drop_columns, reordered
from panelforge.operators.filters import answered, filled, one_of

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField(name, T.ArrayType(T.StringType()) if field == "secondary_condition" else T.StringType())
        for name, field in cb.PROFILE_FIELDS.items()
    ]
)


def key_words(pages: DataFrame, cell: str = "td") -> DataFrame:
    """One row per linked cell: its first word in lower case."""
    return pages.select("page_id", F.posexplode(link_words("html", cell)).alias("position", "word"))


def page_count(html="html") -> Column:
    """The number in front of the next-page link; one page where there is none."""
    pattern = rf'(?s)<a(?:\s[^>]*)?>\s*(\d+)\s*</a>\s*<a\s[^>]*class="{cb.NEXT_PAGE_CLASS}"'
    return number_after(html, pattern)


def plausible(count="n_pages") -> Column:
    """Page counts that are followed; a page may claim any number."""
    return F.col(count).between(1, cb.MOST_PAGES)


def numbered(counted: DataFrame, count: str = "n_pages") -> DataFrame:
    """One row per page 1..count; none for counts of 0 or beyond what is plausible."""
    return counted.where(plausible(count)).withColumn("page", F.explode(F.sequence(F.lit(1), F.col(count))))


def page_addresses(first_pages: DataFrame, key: str, template: str, names: str | None = None) -> DataFrame:
    """One row per (key, page) with its address, from the first page of each key.

    `names` is the column that the address holds, the key if not given.
    """
    counted = first_pages.select(*dict.fromkeys([key, names or key]), page_count().alias("n_pages"))
    return numbered(counted).withColumn("url", address(template, names or key, "page"))


def count_rejects(first_pages: DataFrame, key: str) -> DataFrame:
    """First pages whose page count is not followed."""
    return first_pages.select(key, page_count().alias("n_pages")).where(~plausible())


def listing_addresses(listings: DataFrame, template: str) -> DataFrame:
    """One row per page of a listing, from rows with its `n_pages`."""
    return numbered(listings).withColumn("url", address(template, "page"))


def profile_blocks(pages: DataFrame) -> DataFrame:
    """One row per profile element: the element with all that follows until the next one."""
    start = rf'(?=<div[^>]*data-react-class="{cb.PROFILE_CLASS}")'
    pieces = F.split("html", start)
    blocks = pages.select(
        *[c for c in pages.columns if c != "html"], F.posexplode(pieces).alias("position", "block")
    )
    return blocks.where(F.col("position") > 0)


def latest_evaluation(block="block") -> Column:
    """What follows the first date heading, up to the next one."""
    return F.regexp_replace(word_at(block, 1, "<h3"), r"(?s)^.*?</h3>", "")


def _whole_element(text) -> Column:
    """A text up to the end tag that closes the element it starts in."""
    pieces = F.split(text, r"(?U)(?=</?div\b[^>]*>)")
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("taken"))

    def step(at: Column, piece: Column) -> Column:
        change = F.when(piece.rlike(r"(?U)^</div\b[^>]*>"), -1).when(piece.rlike(r"(?U)^<div\b[^>]*>"), 1).otherwise(0)
        depth = F.when(at.depth > 0, at.depth + change).otherwise(0)
        return F.struct(depth.alias("depth"), (at.taken + (depth > 0).cast("int")).alias("taken"))

    return F.array_join(F.slice(pieces, F.lit(1), F.aggregate(pieces, start, step, lambda at: at.taken)), "")


def _headed(section, label: str, ending: str) -> Column:
    """What follows the start of the element after a heading, up to `ending`."""
    return F.regexp_extract(section, rf"(?s)<span[^>]*+>{label}</span>\s*+</div>\s*+<div[^>]*+>{ending}", 1)


def _paragraph(block, label: str) -> Column:
    """Markup of the element that a bold label opens, of whatever kind; empty when there is none.

    Blocks without the label are not searched, and no part of the pattern is tried shorter.
    """
    label = f"{label}</strong>".replace("&", "&amp;")
    pattern = rf"(?s)<([A-Za-z]\w*+)(?:\s[^>]*+)?+>([^<]*+<strong[^>]*+>{label}.*?)</\1>"
    return F.when(~F.contains(block, F.lit(label)), "").otherwise(F.regexp_extract(block, pattern, 2))


def _once(df: DataFrame, columns: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """The given columns of the rows that pass a test, each worked out once.

    Filters, and projections that read a column twice, would move below a projection or
    merge with it and extract everything again; a list of one row or none holds them off.
    """
    row = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(F.inline(row if keep is None else F.when(keep, row)))


def _records(pages: DataFrame, drug: Column, block: bool = False) -> DataFrame:
    """Blocks with every field and a mark for those that have the required parts.

    Each step is worked out once and read several times by the next one. Python sees the
    texts with rare references.
    """
    own = ["page_id", "position", "drug_name"]
    same = lambda *names: {n: F.col(n) for n in names}
    kept = [*own, *(["block"] if block else [])]
    blocks = profile_blocks(pages.withColumn("drug_name", drug))
    parts = _once(
        blocks,
        {
            **same(*kept),
            "__props": F.regexp_extract("block", 'data-react-props="([^"]*)"', 1),
            "__section": latest_evaluation(),
            **{name: without_tags(_paragraph(F.col("block"), label)) for name, label in cb.OPTIONAL_FIELDS.items()},
        },
    )
    short = {name: _headed("__section", label, "(.*?)</div>") for name, label in cb.HEADED_FIELDS.items()}
    found = _once(parts, {**same(*kept, "__props", "__section", *cb.OPTIONAL_FIELDS), **short})
    inner = {
        f"__whole_{name}": F.when(F.col(name).rlike(r"<div\b"), _headed("__section", label, "(.*)")) for name, label in cb.HEADED_FIELDS.items()
    }
    found = _once(found, {**same(*kept, "__props", *cb.OPTIONAL_FIELDS, *cb.HEADED_FIELDS), **inner})
    headed = [word_at(without_tags(F.coalesce(_whole_element(f"__whole_{n}"), F.col(n))), 2, "\n") for n in cb.HEADED_FIELDS]
    texts = found.select(*kept, F.array("__props", *headed, *cb.OPTIONAL_FIELDS).alias("__texts"))
    texts = _once(texts, same(*kept, "__texts")).select(*kept, unescaped_all("__texts").alias("__texts"))
    plain = {name: F.col("__texts")[i] for i, name in enumerate(["__props", *cb.HEADED_FIELDS, *cb.OPTIONAL_FIELDS])}
    values = _once(
        texts,
        {
            **same(*kept),
            "__profile": F.from_json(plain["__props"], PROFILE_SCHEMA),
            **{name: F.nullif(plain[name], F.lit("")) for name in cb.HEADED_FIELDS},
            "dosage": default_text(words_between(plain["dosage"], 2, 4), cb.NOT_GIVEN),
            "advice": default_text(F.lower(word_at(plain["advice"], 2, "\n")), cb.NOT_GIVEN),
            "cost": default_text(word_at(plain["cost"], 2, "\n"), cb.NOT_GIVEN),
        },
    )
    fields = values.select("*", *[F.col(f"__profile.{name}").alias(field) for name, field in cb.PROFILE_FIELDS.items()])
    required = ["__profile", "username", *cb.HEADED_FIELDS]
    return fields.withColumn("__whole", F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in required)))


def drug_of_url(url="url") -> Column:
    return F.regexp_extract(url, r"/browse/([^/?#]+)\?", 1)


def parse_reviews(pages: DataFrame, drug: Column | None = None, personal: bool = False) -> DataFrame:
    """Review records in their fixed order, led by (page_id, position).

    User names and biographies are personal data and left out unless asked for.
    """
    drug = drug_of_url() if drug is None else drug
    fields = [c for c in cb.REVIEW_RAW if personal or c not in ("username", "profile_bio")]
    return _once(_records(pages, drug), {n: F.col(n) for n in ("page_id", "position", *fields)}, F.col("__whole"))


def parse_rejects(pages: DataFrame, block: bool = True) -> DataFrame:
    """Blocks that miss a required part, for inspection; the run goes on without them.

    Without `block` their markup is not carried through the steps.
    """
    rejected = {n: F.col(n) for n in ("page_id", "position", "drug_name", *(["block"] if block else []))}
    return _once(_records(pages, drug_of_url(), block=block), rejected, ~F.col("__whole"))


def flat_conditions(reviews: DataFrame) -> DataFrame:
    """Condition names as one text, which CSV can hold."""
    return reviews.withColumn("secondary_condition", F.array_join("secondary_condition", ", "))


def clean_reviews(raw: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """Reviews with the basic facts known, 11 columns (10 without user names)."""
    known = answered(raw, cb.REVIEW_REQUIRED)
    if countries is not None:
        known = one_of(known, "country", countries)
    dated = known.withColumn("first_diagnosis_date", whole_number("first_diagnosis_date"))
    dated = filled(dated, {"first_diagnosis_date": 0})
    coded = dated.withColumn("adherence", labelled("adherence", cb.REVIEW_ADHERENCE))
    return reordered(coded, [c for c in cb.REVIEW_CLEAN if c in coded.columns])


def published_reviews(clean: DataFrame) -> DataFrame:
    return drop_columns(clean, [c for c in ("adherence", "username") if c in clean.columns])
