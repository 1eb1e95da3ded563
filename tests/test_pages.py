import html as entities
import json

import pytest
from pyspark.sql import functions as F

from panelforge.functions import codebook as cb
from panelforge.functions.text import unescaped, unescaped_all
from panelforge.sources import pages as pg
from panelforge.sources.tables import read_csv, write_csv
from panelforge.streaming.pages import append_parsed, page_stream, progress

PROFILE = {
    "userName": "u<1>", "userAge": 44, "sex": "female", "country": "Canada", "state": None,
    "firstDiagnosisDate": "2009", "primaryConditionName": "ALS", "secondaryConditionNames": ["A & B", "C"],
    "briefBio": 'says "hi"', "other": {"x": [1]},
}


def rating(name, value):
    return f'<div class="r"><span class="l">{name}</span></div>\n<div class="v">\n<i>x</i>\n{value}\n</div>'


def block(profile, attributes_first=False, evaluation=True, extras=""):
    props = entities.escape(json.dumps(profile)) if isinstance(profile, dict) else profile
    marks = [f'data-react-class="{cb.PROFILE_CLASS}"', f'data-react-props="{props}"']
    if attributes_first:
        marks.reverse()
    body = rating("Side effects", "Mild") + rating("Adherence", "Usually") + rating("Burden", "Not at all hard")
    older = rating("Side effects", "Severe") + rating("Adherence", "Always") + rating("Burden", "Very hard")
    section = f"<h3>Jan 2, 2020</h3><div>{body}{extras}</div><h3>Jan 1, 2019</h3><div>{older}</div>" if evaluation else ""
    return f'<div><div {" ".join(marks)}></div></div><div class="eval-details">{section}</div>'


EXTRAS = (
    "<p>\n<strong>Dosage:</strong>\n50 mg\ndaily\n</p><p>\n<strong>Advice &amp; Tips:</strong>\nTake It Early\n</p>"
    "<p>\n<strong>Cost:</strong>\n$25-50 &amp; more\n</p>"
)


@pytest.fixture(scope="module")
def pages(spark):
    site = "https://reviews.example/browse/{}?sheet=1"
    rows = [
        (1, site.format("gabapentin"), f"<html>{block(PROFILE, extras=EXTRAS)}{block({**PROFILE, 'userName': 'second'}, True)}</html>"),
        (2, site.format("trazodone"), "<html><p>nothing here</p></html>"),
        (3, site.format("trazodone"), f"<html>{block('{&quot;broken')}{block(PROFILE, evaluation=False)}{block(PROFILE)}</html>"),
    ]
    return spark.createDataFrame(rows, pg.PAGE_SCHEMA)


def test_records_have_sixteen_fields_in_order(pages):
    out = pg.parse_reviews(pages, personal=True)
    assert out.columns == ["page_id", "position", *cb.REVIEW_RAW] and len(cb.REVIEW_RAW) == 16
    first = out.where("page_id = 1 and position = 1").first()
    assert first["drug_name"] == "gabapentin" and first["username"] == "u<1>" and first["age"] == "44"
    assert first["secondary_condition"] == ["A & B", "C"] and first["profile_bio"] == 'says "hi"'
    assert (first["side_effects"], first["adherence"], first["burden"]) == ("Mild", "Usually", "Not at all hard")
    assert (first["dosage"], first["advice"], first["cost"]) == ("50 mg daily", "take it early", "$25-50 & more")
    second = out.where("page_id = 1 and position = 2").first()
    assert second["username"] == "second" and (second["dosage"], second["advice"], second["cost"]) == ("NA", "NA", "NA")


def test_personal_fields_are_left_out_by_default(pages):
    assert not {"username", "profile_bio"} & set(pg.parse_reviews(pages).columns)


def test_bad_blocks_are_rejected_and_the_rest_goes_on(pages):
    kept = {(r["page_id"], r["position"]) for r in pg.parse_reviews(pages).collect()}
    assert kept == {(1, 1), (1, 2), (3, 3)}
    assert {(r["page_id"], r["position"]) for r in pg.parse_rejects(pages).collect()} == {(3, 1), (3, 2)}


def test_clean_and_published_columns(spark, pages):
    raw = pg.parse_reviews(pages, personal=True)
    missing = raw.withColumn("sex", F.lit(None).cast("string"))
    clean = pg.clean_reviews(raw.unionByName(missing))
    assert clean.columns == cb.REVIEW_CLEAN and clean.count() == 3
    row = clean.first()
    assert row["adherence"] == "3" and row["first_diagnosis_date"] == 2009
    assert len(pg.published_reviews(clean).columns) == 9
    assert pg.clean_reviews(raw, ["Mexico"]).count() == 0


def test_page_counts(spark):
    link = f'<div role="navigation"><a href="#">1</a> <a class="x" href="#"> 26 </a>\n<a class="{cb.NEXT_PAGE_CLASS}">Next</a></div>'
    df = spark.createDataFrame([("a", link), ("b", "<html></html>")], "drug string, html string")
    got = pg.page_addresses(df, "drug", "https://reviews.example/%s/%s")
    assert got.where("drug = 'a'").count() == 26 and got.where("drug = 'b'").count() == 1
    assert got.where("drug = 'b'").first()["url"] == "https://reviews.example/b/1"


def test_implausible_page_counts_are_rejected(spark):
    link = '<a href="#">{}</a> <a class="' + cb.NEXT_PAGE_CLASS + '">Next</a>'
    df = spark.createDataFrame([(str(n), "x", link.format(n)) for n in (0, 1, 3, 2000000000)], "id string, drug string, html string")
    got = pg.page_addresses(df, "id", "https://reviews.example/%s/%s", "drug")
    assert sorted((r["id"], r["page"]) for r in got.collect()) == [("1", 1), ("3", 1), ("3", 2), ("3", 3)]
    assert {r["url"] for r in got.where("page = 3").collect()} == {"https://reviews.example/x/3"}
    assert sorted(r["id"] for r in pg.count_rejects(df, "id").collect()) == ["0", "2000000000"]


def test_a_listing_has_each_address_once(spark):
    got = pg.listing_addresses(spark.createDataFrame([(4,)], "n_pages int"), "https://reviews.example/l/%s")
    assert [r["url"][-1] for r in got.collect()] == list("1234")


def test_nested_markup_in_a_field(spark):
    page = block(PROFILE).replace("Mild\n</div>", "<div><div>Mild</div> or <b>less</b></div>\n</div>")
    df = spark.createDataFrame([(1, "https://reviews.example/browse/x?b", page)], pg.PAGE_SCHEMA)
    row = pg.parse_reviews(df).first()
    assert (row["side_effects"], row["adherence"]) == ("Mild or less", "Usually")


def test_only_rare_references_leave_the_engine(spark):
    """Nested elements are cut by expressions, and Python is handed one text for each list, not the list."""
    whole = "a<div>b<div class='x'>c</div></div>d</div>e</div><p>f"
    texts = [whole, "<div>never closed", "</div>x", "no tags", "a<divan></divan>b</div>c", "é<div\n>x</div\n>y</div >z", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pg._whole_element(F.col("t")).alias("u"))
    assert {r["t"]: r["u"] for r in df.collect()} == {
        whole: "a<div>b<div class='x'>c</div></div>d",
        "<div>never closed": "<div>never closed",
        "</div>x": "",
        "no tags": "no tags",
        "a<divan></divan>b</div>c": "a<divan></divan>b",
        "é<div\n>x</div\n>y</div >z": "é<div\n>x</div\n>y",
        "": "",
        None: None,
    }
    lists = [['&eacute;"\\', None, "&quot;", "\n&#x1F600;"], ["&lt;", None], None]
    got = spark.createDataFrame([(x,) for x in lists], "t array<string>").select(unescaped_all("t").alias("u"))
    assert [r["u"] for r in got.collect()] == [['é"\\', None, '"', "\n😀"], ["<", None], None]
    page = spark.createDataFrame([(1, "https://reviews.example/browse/x?b", block(PROFILE))], pg.PAGE_SCHEMA)
    plan = pg.parse_reviews(page)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("kind", ["p", "li", "section"])
def test_optional_fields_in_elements_of_any_kind(spark, kind):
    page = block(PROFILE, extras=EXTRAS.replace("<p>", f"<{kind} class='x'>").replace("</p>", f"</{kind}>"))
    row = pg.parse_reviews(spark.createDataFrame([(1, "https://reviews.example/browse/x?b", page)], pg.PAGE_SCHEMA)).first()
    assert (row["dosage"], row["advice"], row["cost"]) == ("50 mg daily", "take it early", "$25-50 & more")


def test_all_character_references(spark):
    texts = ["a&nbsp;b", "&#x27;&apos;&quot;&#39;", "&eacute;&Eacute;", "&lt;p&gt; &amp; &amp;lt; &amp;eacute;", "plain & simple", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescaped("t").alias("u"))
    assert all(r["u"] == (r["t"] and entities.unescape(r["t"])) for r in df.collect())


def test_csv_holds_any_text(spark, tmp_path):
    texts = ['a "quoted" word', "two\nlines", "back\\slash", 'ends with \\"', "a,b;c", "  spaces  ", "'", '"', "é\n\n,\"\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    write_csv(df, str(tmp_path / "t"))
    assert {r["i"]: r["s"] for r in read_csv(spark, str(tmp_path / "t"), df.schema).collect()} == dict(enumerate(texts))


def test_pages_without_records_are_remembered(spark, tmp_path, pages):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    pages.repartition(3, "page_id").write.parquet(source)
    parsed = []

    def parse(rows):
        parsed.extend(r["page_id"] for r in rows.select("page_id").collect())
        return pg.parse_reviews(rows)

    append_parsed(page_stream(spark, source, files=1), parse, out, state)
    pages.write.mode("append").parquet(source)
    append_parsed(page_stream(spark, source, files=1), parse, out, state)
    assert sorted(parsed) == [1, 2, 3] and spark.read.parquet(out).count() == 3


def test_key_words_come_from_linked_cells(spark):
    page = "<table><tr><td><b>x</b><a href='#'>Lyrica Tablets</a></td><td>none</td><td><a>Advil</a></td></tr></table>"
    df = spark.createDataFrame([(1, "u", page)], pg.PAGE_SCHEMA)
    assert [r["word"] for r in pg.key_words(df).orderBy("position").collect()] == ["lyrica", "advil"]


def test_csv_missing_marks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1.0, 1), ("NA", None, 2), ("", 3.0, 3), (None, 4.0, 4)], "s string, x double, i int")
    write_csv(df, path)
    got = {r["i"]: (r["s"], r["x"]) for r in read_csv(spark, path, df.schema).collect()}
    assert got == {1: ("a", 1.0), 2: (None, None), 3: (None, 3.0), 4: (None, 4.0)}


def test_incremental_job_stores_each_page_once(spark, tmp_path, pages):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parse = lambda p: pg.parse_reviews(p, personal=True)
    pages.where("page_id = 1").write.parquet(source)
    append_parsed(page_stream(spark, source), parse, out, state)
    assert spark.read.parquet(out).count() == 2
    # Page 1 comes again together with the others.
    pages.write.mode("append").parquet(source)
    second = append_parsed(page_stream(spark, source), parse, out, state)
    assert sum(n for _, n in progress(second)) == 3
    got = spark.read.parquet(out).drop("batch")
    want = parse(pages)
    assert got.count() == want.count() == 3 and got.exceptAll(want).count() == 0
    append_parsed(page_stream(spark, source), parse, out, state)
    assert spark.read.parquet(out).count() == 3


@pytest.mark.parametrize("single", [True, False])
def test_a_named_table_is_a_file_or_a_folder(spark, tmp_path, pages, single):
    folder = tmp_path / "tables"
    pages.select("page_id").coalesce(1).write.parquet(str(folder / "other.parquet"))
    pages.repartition(2).write.parquet(str(folder / "pages.parquet"))
    if single:
        one = tmp_path / "one"
        pages.coalesce(1).write.parquet(str(one))
        folder = tmp_path / "files"
        folder.mkdir()
        next(one.glob("*.parquet")).rename(folder / "pages.parquet")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    append_parsed(page_stream(spark, str(folder), "pages.parquet"), lambda p: p.select("page_id"), out, state)
    assert spark.read.parquet(out).count() == pages.select("page_id").distinct().count()


def test_rejects_without_markup(spark, pages):
    bare = pg.parse_rejects(pages, block=False)
    assert bare.columns == ["page_id", "position", "drug_name"]
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, pg.parse_rejects(pages).drop("block").collect()))


def test_batches_grow_instead_of_their_number(spark, tmp_path, monkeypatch):
    from panelforge.catalog import page_queries as pq

    made = [(i, "u", f"<ul><li><a href='#'>Word{i % 3} x</a></li></ul>") for i in range(60)]
    spark.createDataFrame(made, pg.PAGE_SCHEMA).repartition(8).write.parquet(str(tmp_path / "pages.parquet"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "256m")  # a task, and so a written file, for each file
    queries = []
    monkeypatch.setattr(pq, "append_parsed", lambda *a: queries.append(append_parsed(*a)))
    try:
        got = pq.key_words_in_batches(spark, str(tmp_path))
        assert sorted((r["page_id"], r["word"], r["n"]) for r in got.collect()) == [(i, f"word{i % 3}", 1) for i in range(60)]
        assert 3 <= len(progress(queries[0])) <= pq.MOST_BATCHES
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
