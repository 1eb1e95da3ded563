import pytest
from pyspark.sql import functions as F

from panelforge.functions import codebook as cb
from panelforge.functions import recode as rc
from panelforge.functions import text as tx
from panelforge.operators import columns as cols
from panelforge.operators import filters as fl
from panelforge.plans import survey as plan


def values(df, column):
    return [r[column] for r in df.collect()]


def test_refusal_filter_keeps_missing_answers(spark):
    df = spark.createDataFrame([(1, 8.0), (2, None), (3, float("nan")), (4, 9.0)], "id int, a double")
    assert values(fl.without_refusals(df, [("a", 8)]), "id") == [2, 3, 4]


def test_bound_drops_missing_answers(spark):
    df = spark.createDataFrame([(1, 72.0), (2, None), (3, float("nan")), (4, 73.0)], "id int, a double")
    assert values(fl.below(df, "a", 73), "id") == [1]


def test_unknown_codes_pass_through(spark):
    df = spark.createDataFrame([(1.0,), (8.0,), (None,)], "sex double")
    assert values(df.select(rc.labelled_code("sex", cb.LABELS["sex"]).alias("x")), "x") == ["M", "8.0", None]


def test_bracket_without_code_is_an_error(spark):
    df = spark.createDataFrame([(77.0,)], "income double")
    with pytest.raises(Exception, match="no bracket for income"):
        df.select(rc.bracketed("income", cb.INCOME_BRACKETS, "income")).collect()


def test_missing_answer_counts_as_no(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 1.0), (2.0, 2.0)], "a double, b double")
    assert values(df.select(rc.either_is("a", "b", 1.0, "y", "n").alias("x")), "x") == ["y", "n", "y", "n"]


def test_merged_labels():
    assert rc.merged_labels({5: "Student", 6: "Unemployed"}, {"Student": "Unemployed"}) == {5: "Unemployed", 6: "Unemployed"}


def test_ranks_accept_numbers_as_text(spark):
    df = spark.createDataFrame([("Poor",), ("9.0",), ("?",)], "general_health string")
    out = df.select(rc.ranked("general_health", cb.ORDINAL_RANKS["general_health"]).alias("x"))
    assert values(out, "x") == [1.0, 9.0, None]


def test_dirty_numbers(spark):
    df = spark.createDataFrame([("2015",), ("2015.0",), ("x",), (None,)], "d string")
    assert values(df.select(rc.whole_number("d").alias("x")), "x") == [2015, 2015, None, None]


def test_root_of_positive_is_not_a_number(spark):
    got = spark.createDataFrame([(4.0,), (-4.0,)], "a double").select(rc.root_of_negated("a").alias("x"))
    first, second = values(got, "x")
    assert first != first and second == 2.0


def test_undefined_becomes_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.5,)], "a double")
    assert values(df.select(rc.zero_if_undefined("a").alias("x")), "x") == [0.0, 0.0, 0.5]


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(rc.correlation("a", "b")).first()[0] is None


def test_text_pieces(spark):
    df = spark.createDataFrame([("a\nb\nc\nd",), ("a",)], "t string")
    assert values(df.select(tx.words_between("t", 2, 4).alias("x")), "x") == ["c d", ""]
    assert values(df.select(tx.word_at("t", 2, "\n").alias("x")), "x") == ["c", None]


def test_dropping_an_unknown_column_is_an_error(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert cols.drop_columns(df, ["a"]).columns == ["b"]
    with pytest.raises(KeyError):
        cols.drop_columns(df, ["z"])
    assert cols.drop_columns(df, ["z"], strict=False).columns == ["a", "b"]


def test_replaced_keeps_or_moves_the_column(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert cols.replaced(df, "b", F.lit(9)).columns == ["a", "b", "c"]
    assert cols.replaced(df, "c", F.lit(9), 0).columns == ["c", "a", "b"]


def test_every_value_comes_from_its_own_row(spark):
    """A removed respondent must not shift the answers of those that follow."""
    base = {c: 1.0 for c in [*cb.SURVEY_NAMES, *cb.SURVEY_KEPT]}
    rows = [
        {**base, "respondent_id": 1, "rxqn2": 8.0, "rxqn11": 5.0},
        {**base, "respondent_id": 2, "rxqn11": 2.0, "rxqn7d": 2.0, "rxqn7a": 2.0, "demh3": None},
        {**base, "respondent_id": 3, "rxqn11": 3.0},
    ]
    schema = "respondent_id long, " + ", ".join(f"{c} double" for c in base)
    raw = spark.createDataFrame([[r["respondent_id"]] + [r[c] for c in base] for r in rows], schema)
    got = {r["respondent_id"]: r for r in plan.clean_survey(raw).collect()}
    assert set(got) == {2, 3}
    assert got[2]["general_health"] == "Very good" and got[3]["general_health"] == "Good"
    assert got[2]["have_medicare"] == "Not eligible"
    assert got[2][cb.TARGET] == "adherence" and got[3][cb.TARGET] == "non-adherence"
    assert len(got[2].asDict()) == 27 and "US_region" in got[2].asDict()


def test_feature_groups():
    columns = ["age", "income", "educ", "sex_M", "has_diabetes_Yes", "emply_Part-time"]
    assert cols.feature_group(columns, cb.DEMOGRAPHIC_FEATURES) == ["age", "income", "educ", "sex_M", "emply_Part-time"]
    assert cols.feature_group(columns, cb.HEALTH_FEATURES) == ["age", "has_diabetes_Yes"]
