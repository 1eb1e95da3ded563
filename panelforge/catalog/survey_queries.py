"""Survey cleaning, filters, recodes and projections."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F, types as T

from panelforge.catalog import views as v
from panelforge.catalog.registry import query
from panelforge.functions import codebook as cb
from panelforge.functions import recode as rc
from panelforge.functions import text as tx
from panelforge.operators import columns as cols
from panelforge.operators import filters as fl
from panelforge.operators.encode import LabelCodes
from panelforge.operators.stages import TableFunction
from panelforge.plans import survey as plan
from panelforge.session import scratch_path
from panelforge.sources.tables import load_keys, read_csv, read_survey, read_table, save_keys, write_csv, write_parquet


def _text(value: str) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _case(column: str, labels: dict, merge: dict) -> str:
    arms = " ".join(f"WHEN {column} = {code} THEN {_text(merge.get(label, label))}" for code, label in labels.items())
    return f"CASE {arms} ELSE CAST({column} AS VARCHAR) END"


def _clean_value(name: str) -> str:
    out = cb.SURVEY_RENAMED.get(name, name)
    if name == "income":
        arms = " ".join(f"WHEN income IN ({', '.join(map(str, codes))}) THEN {_text(label)}" for label, codes in cb.INCOME_BRACKETS.items())
        return f"CASE {arms} END AS income"
    if name in cb.LABELS:
        return f"{_case(name, cb.LABELS[name], cb.MERGED_LABELS.get(name, {}))} AS {out}"
    return f"{name} AS {out}"


CODED = v.SURVEY + ", named AS (SELECT respondent_id, " + ", ".join(
    [f"{'coalesce(demh3, 3)' if c == 'demh3' else c} AS {n}" for c, n in cb.SURVEY_NAMES.items()] + cb.SURVEY_KEPT
) + " FROM survey), coded AS (SELECT respondent_id, CASE WHEN stopped_taking = 1 OR didnt_fill_rx = 1 THEN 'non-adherence' ELSE 'adherence' END AS " + (
    cb.TARGET
) + ", " + ", ".join(cb.SURVEY_CLEAN[1:]) + " FROM named WHERE " + " AND ".join(
    f"{c} IS DISTINCT FROM {code}" for c, code in cb.REFUSED_CODES
) + ")"
CLEAN = CODED + ", clean AS (SELECT respondent_id, " + ", ".join(_clean_value(c) for c in cb.SURVEY_CLEAN) + " FROM coded)"

CATEGORIES = ["general_health", "income", "sex", "emply", "educ", "med_burden"]


@query(
    "S1 P6 F1 N1 C1 C2 C4 A3 R1",
    f"WITH {CLEAN}, long AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS category, {c} AS value, {cb.TARGET} AS target FROM clean" for c in CATEGORIES)
    + """) SELECT category, value, count(*) FILTER (target = 'adherence')::BIGINT AS adherent,
    count(*) FILTER (target = 'non-adherence')::BIGINT AS non_adherent FROM long GROUP BY 1, 2""",
)
def adherence_by_category(spark, folder):
    clean = plan.clean_survey(v.survey(spark, folder))
    long = clean.unpivot([cb.TARGET], CATEGORIES, "category", "value")
    return (
        long.groupBy("category", "value")
        .pivot(cb.TARGET, [cb.ADHERENT, cb.NON_ADHERENT])
        .count()
        .fillna(0)
        .select("category", "value", F.col(cb.ADHERENT).alias("adherent"), F.col(cb.NON_ADHERENT).alias("non_adherent"))
    )


@query("S1 P3 P4 P5 P6 F1 N1 C1 C2 C3 C4 C5", f"WITH {CLEAN} SELECT * FROM clean")
def survey_clean(spark, folder):
    return plan.clean_survey(v.survey(spark, folder))


@query("P6 F1 N1 C4", f"WITH {CODED} SELECT * FROM coded")
def survey_coded(spark, folder):
    return plan.coded_answers(v.survey(spark, folder))


_REFUSALS = list(dict.fromkeys(c for c, _ in cb.REFUSED_CODES))


@query(
    "F1",
    f"WITH {v.SURVEY} SELECT count(*)::BIGINT AS kept, count(*) FILTER (demh3 IS NULL)::BIGINT AS kept_without_answer "
    "FROM survey WHERE demh3 IS DISTINCT FROM 8 AND demh3 IS DISTINCT FROM 9",
)
def refusals_keep_missing(spark, folder):
    kept = fl.without_refusals(v.survey(spark, folder), [("demh3", 8), ("demh3", 9)])
    return kept.agg(
        F.count(F.lit(1)).alias("kept"), F.sum(F.col("demh3").isNull().cast("long")).alias("kept_without_answer")
    )


@query("S1 S2 S4", f"WITH {v.SURVEY} SELECT * FROM survey")
def survey_scan(spark, folder):
    raw = v.survey(spark, folder)
    path = scratch_path(spark, "survey")
    write_parquet(cols.new_header(raw, [c.upper() for c in raw.columns]), path)
    return read_survey(spark, path).select(*raw.columns)


@query("S1 S3 S4", f"WITH {v.SURVEY} SELECT * FROM survey")
def survey_scan_csv(spark, folder):
    raw = v.survey(spark, folder)
    path = scratch_path(spark, "survey-csv")
    write_csv(raw, path)
    return read_survey(spark, path, "csv").select(*raw.columns)


@query("S3 S4", f"WITH {CLEAN} SELECT * FROM clean")
def clean_csv_round_trip(spark, folder):
    clean = plan.clean_survey(v.survey(spark, folder))
    path = scratch_path(spark, "clean")
    write_csv(clean, path)
    return read_csv(spark, path, clean.schema, line_breaks=False)


@query("S7", "SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS drug_name FROM part")
def key_list_round_trip(spark, folder):
    path = scratch_path(spark, "keys")
    named = read_table(spark, folder, "part").select(F.lower(tx.word_at("p_name", 0)).alias("drug_name"))
    save_keys(named, "drug_name", path)
    return load_keys(spark, path)


@query(
    "S2 P1 P2 P3 P4 P5 P8",
    "SELECT c_custkey AS customer, c_mktsegment, c_acctbal * 2 AS c_acctbal FROM customer",
)
def column_choices(spark, folder):
    upper = cols.new_header(
        read_table(spark, folder, "customer"), ["C_CUSTKEY", "C_NAME", "C_NATIONKEY", "C_ACCTBAL", "C_MKTSEGMENT"]
    )
    df = cols.drop_columns(cols.lower_header(upper), ["c_nationkey"])
    df = cols.replaced(df, "c_acctbal", F.col("c_acctbal") * 2, position=3)
    df = cols.reordered(df, ["c_name", "c_custkey", "c_mktsegment", "c_acctbal"])
    return cols.renamed(cols.column_slice(df, 1), {"c_custkey": "customer"})


@query(
    "P7 P9 D2",
    f"WITH {v.SURVEY} SELECT respondent_id, (rxqn7d = 1)::INTEGER AS label, age * 2 AS age, income * 2 AS income, educ * 2 AS educ FROM survey",
)
def target_and_group(spark, folder):
    raw = v.survey(spark, folder).withColumn("label", (F.col("rxqn7d") == 1).cast("int")).drop("rxqn7d")
    label, features = cols.target_and_features(raw, "label", ["respondent_id"])
    group = cols.feature_group(features, ["age", "income", "educ"])
    group = [c for c in group if c != "age2"]
    return cols.on_every_column(raw.select("respondent_id", label, *group), group, lambda c: F.col(c) * 2)


@query(
    "F2 F3 F4 F5",
    f"WITH {v.SURVEY} SELECT respondent_id, rxqn1, demh3, division FROM survey "
    "WHERE demh3 IS NOT NULL AND rxqn1 < 73 AND division IN (1, 2, 3) AND rxqn2 IS DISTINCT FROM 9",
)
def answered_in_range(spark, folder):
    df = fl.below(fl.answered(v.survey(spark, folder), ["demh3", "rxqn1", "division"]), "rxqn1", cb.MAX_PRESCRIPTIONS)
    df = fl.without_value(fl.one_of(df, "division", [1.0, 2.0, 3.0]), "rxqn2", 9.0)
    return df.select("respondent_id", "rxqn1", "demh3", "division")


@query(
    "F6",
    f"WITH {v.SCORED} SELECT {v.sql_r6('avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END)')} AS positive_share FROM scored",
)
def positive_share(spark, folder):
    return v.scored_orders(spark, folder).agg(v.r6(fl.share_of("y", 1)).alias("positive_share"))


@query(
    "N1 N2",
    f"WITH {v.CUSTOMER_ORDERS} SELECT c_custkey, coalesce(urgent98, 3) AS urgent98, "
    "coalesce(nullif(CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END, ''), 'NA') AS segment FROM co",
)
def default_values(spark, folder):
    df = v.customer_orders(spark, folder)
    segment = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("")
    df = df.select("c_custkey", "urgent98", rc.default_text(segment, cb.NOT_GIVEN).alias("segment"))
    return fl.filled(df, {"urgent98": 3})


def _rank_case(name: str) -> str:
    arms = " ".join(f"WHEN {_text(k)} THEN {r}" for k, r in cb.ORDINAL_RANKS[name].items())
    return f"coalesce(CASE {name} {arms} END::DOUBLE, TRY_CAST({name} AS DOUBLE)) AS {name}"


@query(
    "C10",
    f"WITH {CLEAN} SELECT respondent_id, " + ", ".join(_rank_case(c) for c in cb.ORDINAL_FEATURES) + " FROM clean",
)
def ordinal_ranks(spark, folder):
    clean = plan.clean_survey(v.survey(spark, folder))
    return clean.select("respondent_id", *[rc.ranked(c, cb.ORDINAL_RANKS[c]).alias(c) for c in cb.ORDINAL_FEATURES])


@query(
    "D1 C10",
    f"WITH {CLEAN} SELECT respondent_id, income, educ, income * educ AS both FROM (SELECT respondent_id, {_rank_case('income')}, {_rank_case('educ')} FROM clean)",
)
def user_function_stage(spark, folder):
    def ranks(df):
        return df.select("respondent_id", *[rc.ranked(c, cb.ORDINAL_RANKS[c]).alias(c) for c in ("income", "educ")])

    stages = [TableFunction(ranks), SQLTransformer(statement="SELECT *, income * educ AS both FROM __THIS__")]
    return PipelineModel(stages).transform(plan.clean_survey(v.survey(spark, folder)))


@query(
    "C9",
    "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_totalprice) - 1)::DOUBLE AS price_code, "
    "(dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS priority_code, "
    "o_totalprice AS price_again, o_orderpriority AS priority_again FROM orders",
)
def label_codes(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    codes = LabelCodes(orders, ["o_totalprice", "o_orderpriority"])
    df = codes.encode(orders, "_code")
    df = codes.decode(df, "o_totalprice", "o_totalprice_code", "price_again")
    df = codes.decode(df, "o_orderpriority", "o_orderpriority_code", "priority_again")
    return df.select(
        "o_orderkey",
        F.col("o_totalprice_code").alias("price_code"),
        F.col("o_orderpriority_code").alias("priority_code"),
        "price_again",
        "priority_again",
    )


@query(
    "C2 C3 C5",
    f"WITH {v.SURVEY} SELECT " + _clean_value("income") + ", " + _clean_value("emply") + ", "
    + _clean_value("sex") + ", " + _clean_value("metro") + ", count(*)::BIGINT AS n FROM survey GROUP BY 1, 2, 3, 4",
)
def bracket_counts(spark, folder):
    raw = v.survey(spark, folder)
    merged = rc.merged_labels(cb.LABELS["emply"], cb.MERGED_LABELS["emply"])
    return raw.groupBy(
        rc.bracketed("income", cb.INCOME_BRACKETS, "income").alias("income"),
        rc.labelled_code("emply", merged).alias("emply"),
        rc.labelled_code("sex", cb.LABELS["sex"]).alias("sex"),
        rc.labelled_code("metro", cb.LABELS["metro"]).alias("metro"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "C6 C7 C8",
    f"SELECT c_custkey, -c_acctbal AS negated, abs(c_acctbal) AS size, c_acctbal > 0 AS positive, "
    f"CASE WHEN c_acctbal > 0 THEN 'red' ELSE 'blue' END AS colour, c_acctbal::VARCHAR AS as_text, "
    f"trunc(c_acctbal)::INTEGER AS whole, CASE WHEN c_acctbal <= 0 THEN {v.sql_r6('sqrt(abs(least(c_acctbal, 0)))')} END AS root, "
    f"{v.sql_r6('(c_acctbal / 5000 - 1) * 100', 3)} AS percent FROM customer",
)
def scalar_values(spark, folder):
    balance = F.col("c_acctbal")
    return read_table(spark, folder, "customer").select(
        "c_custkey",
        (-balance).alias("negated"),
        F.abs(balance).alias("size"),
        rc.is_positive(balance).alias("positive"),
        rc.sign_colour(balance).alias("colour"),
        balance.cast("string").alias("as_text"),
        rc.whole_number(balance.cast("string")).alias("whole"),
        F.when(balance <= 0, v.r6(rc.root_of_negated(balance))).alias("root"),
        v.r6(rc.percent_over(balance, F.lit(5000.0)), 3).alias("percent"),
    )


@query(
    "C11",
    "SELECT doc_id, lower(split_part(text, ' ', 1)) AS first_word, string_split(text, chr(10))[3] AS third_line, "
    "array_to_string(string_split(text, chr(10))[3:4], ' ') AS third_and_fourth FROM documents",
)
def text_pieces(spark, folder):
    return read_table(spark, folder, "documents").select(
        "doc_id",
        F.lower(tx.word_at("text", 0)).alias("first_word"),
        tx.word_at("text", 2, "\n").alias("third_line"),
        tx.words_between("text", 2, 4).alias("third_and_fourth"),
    )


@query(
    "C12",
    "SELECT p_partkey, printf('https://reviews.example/browse/%s?sheet=%s', lower(split_part(p_name, ' ', 1)), p_size::VARCHAR) AS url FROM part",
)
def address_templates(spark, folder):
    name = F.lower(tx.word_at("p_name", 0))
    return read_table(spark, folder, "part").select(
        "p_partkey",
        tx.address("https://reviews.example/browse/%s?sheet=%s", name, "p_size").alias("url"),
    )


@query(
    "C13",
    "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(*)::BIGINT AS n FROM events GROUP BY 1",
)
def json_fields(spark, folder):
    props = F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))
    return read_table(spark, folder, "events").groupBy("event_type").agg(
        F.sum(props["k"]).alias("total"), F.count(F.lit(1)).alias("n")
    )


@query(
    "C14 A4",
    f"WITH {v.SCORED} SELECT fold, printf('%.3f +/- %.2f', avg(score), stddev_samp(score)) AS summary FROM scored GROUP BY 1",
)
def mean_and_deviation(spark, folder):
    return v.scored_orders(spark, folder).groupBy("fold").agg(
        rc.mean_with_deviation(F.avg("score"), F.stddev_samp("score")).alias("summary")
    )
