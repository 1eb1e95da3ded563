"""String, address and markup expressions."""

from __future__ import annotations

import html as markup
import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from panelforge.functions.keyed import as_column


def word_at(column, position: int, separator: str = " ") -> Column:
    """The n-th piece of a text counted from zero; null when there are fewer."""
    return F.get(F.split(as_column(column), re.escape(separator)), F.lit(position))


def words_between(column, start: int, stop: int, separator: str = "\n", joiner: str = " ") -> Column:
    """Pieces start..stop-1 joined again; fewer when the text is shorter."""
    pieces = F.split(as_column(column), re.escape(separator))
    return F.array_join(F.slice(pieces, start + 1, stop - start), joiner)


def address(template: str, *parts) -> Column:
    """Fill a `%s` template with columns."""
    return F.format_string(template, *[as_column(p).cast("string") for p in parts])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_references(rows: pd.Series) -> pd.Series:
    return rows.map(lambda texts: [t if t is None else markup.unescape(t) for t in json.loads(texts)], na_action="ignore")


def _own_references(text: Column) -> Column:
    """Undo the five references that markup itself needs."""
    for reference, character in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


def unescaped_all(column) -> Column:
    """Undo the character references in a list of texts.

    The five that markup itself needs are built-in replacements; only lists with any
    other reference go through Python's table of them, each as one text, as that is nearly
    always null and the cheapest to hand over.
    """
    texts = as_column(column)
    other = F.exists(texts, lambda t: F.coalesce(t.rlike("&(?!(quot|#39|lt|gt|amp);)[#A-Za-z]"), F.lit(False)))
    return F.coalesce(_all_references(F.when(other, F.to_json(texts))), F.transform(texts, _own_references))


def unescaped(column) -> Column:
    return unescaped_all(F.array(as_column(column)))[0]


def without_tags(column) -> Column:
    return F.regexp_replace(as_column(column), "<[^>]*>", "")


def link_words(html, cell: str) -> Column:
    """First word, lower case, of the first link text in every `cell` element."""
    pattern = rf"(?s)<{cell}[^>]*>(?:(?!</{cell}>|<a[\s>]).)*<a(?:\s[^>]*)?>([^<]*)"
    texts = F.regexp_extract_all(as_column(html), F.lit(pattern), F.lit(1))
    return F.transform(texts, lambda t: F.lower(F.get(F.split(t, " "), F.lit(0))))


def number_after(column, pattern: str, default: int = 1) -> Column:
    """The number a pattern captures, or the default when there is none."""
    found = F.regexp_extract(as_column(column), pattern, 1)
    return F.coalesce(found.try_cast("int"), F.lit(default))


def element_text(html, tag: str) -> Column:
    """Text of the first `tag` element, null when the page has none."""
    found = F.regexp_extract(as_column(html), rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(without_tags(found), F.lit(""))
