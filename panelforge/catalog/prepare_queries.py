"""Splits, scaling, encoding, imputation and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog import views as v
from panelforge.catalog.registry import query
from panelforge.catalog.survey_queries import CLEAN
from panelforge.functions import codebook as cb
from panelforge.functions.keyed import named
from panelforge.operators import split as sp
from panelforge.operators.balance import oversampled
from panelforge.operators.encode import scaled, varied_columns
from panelforge.operators.impute import impute_column, impute_in_order
from panelforge.operators.neighbours import first_per_vector, nearest_join, vector_text
from panelforge.operators.profile import per_column
from panelforge.plans import features as ft
from panelforge.plans import survey as plan
from panelforge.session import cut
from panelforge.sources.tables import read_table

_RANKED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {v.sql_hash('id', 42)}, id) AS position,
  count(*) OVER (PARTITION BY y) AS n FROM scored)"""


@query("T1", f"WITH {v.SCORED}, {_RANKED} SELECT id, y, position <= ceil(n * 0.2::DOUBLE) AS is_test FROM ranked")
def stratified_holdout(spark, folder):
    return sp.stratified_holdout(v.scored_orders(spark, folder).select("id", "y"), "id", "y")


@query("T1", f"SELECT o_orderkey, {v.sql_uniform('o_orderkey', 42)} < 0.2 AS is_test FROM orders")
def threshold_holdout(spark, folder):
    return sp.threshold_holdout(read_table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query("T2", f"WITH {v.SCORED}, {_RANKED} SELECT id, y, ((position - 1) % 10)::INTEGER AS fold FROM ranked")
def stratified_folds(spark, folder):
    return sp.stratified_folds(v.scored_orders(spark, folder).select("id", "y"), "id", "y")


@query(
    "T1 T2",
    "WITH lab AS (SELECT l.doc_id, quality, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {v.sql_hash('doc_id', 42)}, doc_id) AS p FROM lab) "
    "SELECT quality, ((p - 1) % 10)::INTEGER AS fold, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM r GROUP BY 1, 2",
)
def labelled_document_folds(spark, folder):
    lab = read_table(spark, folder, "labels").select("doc_id", "quality").join(
        read_table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    folds = sp.stratified_folds(lab, "doc_id", "quality")
    return folds.groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


_SCALED = ["age", "rxqn1", "rxqn13"]


@query(
    "T4 A5",
    f"WITH {v.SURVEY} SELECT respondent_id, "
    + ", ".join(v.sql_r6(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()") + f" AS {c}" for c in _SCALED)
    + " FROM survey",
)
def scaled_numerics(spark, folder):
    raw = cut(v.survey(spark, folder).select("respondent_id", *_SCALED))
    return scaled(raw, _SCALED).select("respondent_id", *[v.r6(c).alias(c) for c in _SCALED])


_FLAGS = ["rxqn12a", "rxqn12b", "rxqn12c", "rxqn12d", "rxqn12e", "rxqn8a"]


@query(
    "T6 A5",
    f"WITH {v.SURVEY}, s AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", var_pop(({c} = 1)::INTEGER) AS x FROM survey" for c in _FLAGS)
    + f") SELECT \"column\", {v.sql_r6('x')} AS variance FROM s WHERE x > 0.16",
)
def varied_flags(spark, folder):
    flags = v.survey(spark, folder).select(*[(F.col(c) == 1).cast("double").alias(c) for c in _FLAGS])
    flags = cut(flags)
    kept = varied_columns(flags, _FLAGS, cb.MIN_VARIANCE)
    return per_column(flags, kept, variance=F.var_pop).withColumn("variance", v.r6("variance"))


def _text(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _design_sql() -> str:
    """Long form, because the one-hot columns are the levels that occur."""
    head = "SELECT respondent_id, label, "
    parts = [
        head + f"'{c}' AS feature, " + v.sql_r6(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()") + " AS value FROM used"
        for c in cb.NUMERIC_FEATURES
    ]
    for c in cb.ORDINAL_FEATURES:
        arms = " ".join(f"WHEN {_text(k)} THEN {r}" for k, r in cb.ORDINAL_RANKS[c].items())
        parts.append(head + f"'{c}', coalesce(CASE {c} {arms} END::DOUBLE, TRY_CAST({c} AS DOUBLE)) FROM used")
    for c in cb.CATEGORICAL_FOR_LOGISTIC:
        later = f"(SELECT DISTINCT {c} AS level FROM used WHERE {c} > (SELECT min({c}) FROM used))"
        parts.append(head + f"concat('{c}_', level), ({c} = level)::INTEGER::DOUBLE FROM used JOIN {later} ON true")
    return (
        f"WITH {CLEAN}, used AS (SELECT *, ({cb.TARGET} = 'non-adherence')::INTEGER AS label FROM clean "
        f"WHERE n_prescriptions < {cb.MAX_PRESCRIPTIONS}) " + " UNION ALL ".join(parts)
    )


@query("T5 T4 R2 C10 F3 P7 P9 D1", _design_sql())
def design_matrix(spark, folder):
    rows = cut(ft.modelling_rows(plan.clean_survey(v.survey(spark, folder))))
    design = ft.fit_design(rows)
    out = design.apply(rows).withColumns({c: v.r6(c) for c in cb.NUMERIC_FEATURES})
    return out.unpivot(["respondent_id", "label"], [named(c) for c in design.columns], "feature", "value")


# --- imputation -------------------------------------------------------------


def impute_sql(source: str, key: str, columns, target: str, missing: str, mask: str, tag: str) -> str:
    """CTEs that impute one column of `source`; the result is `<tag>_done`."""
    codes = ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in columns)
    blank = f"(SELECT DISTINCT c.{target} FROM {tag}_codes c JOIN {source} s USING ({key}) WHERE s.{target} = {missing})"
    hidden = ", ".join(
        f"CASE WHEN {c} <> {blank} THEN {c} END AS {c}" if mask == "matrix" or c == target else c for c in columns
    )
    others = [c for c in columns if c != target]
    terms = " + ".join(f"coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0)" for c in others)
    shared = " + ".join(f"(q.{c} IS NOT NULL AND d.{c} IS NOT NULL)::INTEGER" for c in others)
    return f"""{tag}_codes AS (SELECT {key}, {codes} FROM {source}),
{tag}_hidden AS MATERIALIZED (SELECT {key}, {hidden} FROM {tag}_codes),
{tag}_pairs AS (SELECT q.{key}, d.{key} AS donor, d.{target}, ({terms})::DOUBLE * ({len(columns)}::DOUBLE / nullif({shared}, 0)) AS distance
  FROM {tag}_hidden q JOIN {tag}_hidden d ON q.{target} IS NULL AND d.{target} IS NOT NULL),
{tag}_near AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY distance, donor) AS place FROM {tag}_pairs WHERE distance IS NOT NULL),
{tag}_mean AS (SELECT {key}, floor(avg({target})) AS code FROM {tag}_near WHERE place <= 4 GROUP BY 1),
{tag}_values AS (SELECT DISTINCT c.{target} AS code, s.{target} AS value FROM {tag}_codes c JOIN {source} s USING ({key})),
{tag}_done AS MATERIALIZED (SELECT s.* REPLACE (CASE WHEN m.code IS NULL THEN s.{target} ELSE w.value END AS {target})
  FROM {source} s LEFT JOIN {tag}_mean m USING ({key}) LEFT JOIN {tag}_values w ON w.code = m.code)"""


_PEOPLE = f"""{v.CUSTOMER_ORDERS}, people AS MATERIALIZED (SELECT c_custkey, c_mktsegment, c_nationkey::DOUBLE AS nation,
  coalesce(last_priority, 'none') AS priority, coalesce(last_status, 'none') AS status, floor(coalesce(last_price, 0) / 20000)::DOUBLE AS price,
  coalesce(n_orders, 0)::DOUBLE AS orders FROM co)"""
_PEOPLE_COLUMNS = ["c_mktsegment", "nation", "priority", "status", "price", "orders"]


def people(spark, folder):
    df = v.customer_orders(spark, folder).select(
        "c_custkey",
        "c_mktsegment",
        F.col("c_nationkey").cast("double").alias("nation"),
        F.coalesce("last_priority", F.lit("none")).alias("priority"),
        F.coalesce("last_status", F.lit("none")).alias("status"),
        F.floor(F.coalesce("last_price", F.lit(0.0)) / 20000).cast("double").alias("price"),
        F.coalesce("n_orders", F.lit(0)).cast("double").alias("orders"),
    )
    return cut(df)


@query(
    "N3 J5 C9",
    "WITH " + _PEOPLE + ", " + impute_sql("people", "c_custkey", _PEOPLE_COLUMNS, "c_mktsegment", "'MACHINERY'", "column", "a") + " SELECT * FROM a_done",
)
def impute_segment(spark, folder):
    return impute_column(people(spark, folder), "c_custkey", "c_mktsegment", "MACHINERY")


@query(
    "N3 J5 C9",
    "WITH " + _PEOPLE + ", " + impute_sql("people", "c_custkey", _PEOPLE_COLUMNS, "c_mktsegment", "'AUTOMOBILE'", "matrix", "a") + " SELECT * FROM a_done",
)
def impute_segment_matrix(spark, folder):
    return impute_column(people(spark, folder), "c_custkey", "c_mktsegment", "AUTOMOBILE", mask="matrix")


_CHAIN = ["age", "n_prescriptions", "n_provider_visits", "first_got_rx", "income", "understand_health_prob", "mstatus", "ownhome", "emply", "has_diabetes"]


def _chain_sql() -> str:
    ctes = [CLEAN, f"narrow AS MATERIALIZED (SELECT respondent_id, {', '.join(_CHAIN)} FROM clean WHERE n_prescriptions < 73)"]
    source = "narrow"
    for i, (column, missing) in enumerate(cb.IMPUTE_STEPS):
        value = _text(missing) if isinstance(missing, str) else str(missing)
        ctes.append(impute_sql(source, "respondent_id", _CHAIN, column, value, "column", f"s{i}"))
        source = f"s{i}_done"
    return "WITH " + ", ".join(ctes) + f" SELECT * FROM {source}"


@query("N4 N3 F3", _chain_sql())
def impute_chain(spark, folder):
    rows = ft.modelling_rows(plan.clean_survey(v.survey(spark, folder))).select("respondent_id", *_CHAIN)
    return impute_in_order(rows, "respondent_id", cb.IMPUTE_STEPS)


# --- neighbours and balancing -----------------------------------------------

_POINTS = f"""{v.CUSTOMER_ORDERS}, points AS MATERIALIZED (SELECT c_custkey, CASE WHEN last_priority = '1-URGENT' THEN 1 ELSE 0 END AS label,
  floor(c_acctbal / 500)::DOUBLE AS balance, floor(coalesce(last_price, 0) / 20000)::DOUBLE AS price, coalesce(n_orders, 0)::DOUBLE AS orders FROM co)"""
_DIMS = ["balance", "price", "orders"]


def points(spark, folder):
    df = v.customer_orders(spark, folder).select(
        "c_custkey",
        F.when(F.col("last_priority") == "1-URGENT", 1).otherwise(0).alias("label"),
        F.floor(F.col("c_acctbal") / 500).cast("double").alias("balance"),
        F.floor(F.coalesce("last_price", F.lit(0.0)) / 20000).cast("double").alias("price"),
        F.coalesce("n_orders", F.lit(0)).cast("double").alias("orders"),
    )
    return cut(df)


def _gap(a: str, b: str) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in _DIMS)


@query(
    "J5",
    f"WITH {_POINTS}, n AS (SELECT q.c_custkey, d.c_custkey AS donor, {_gap('q', 'd')} AS distance, "
    f"row_number() OVER (PARTITION BY q.c_custkey ORDER BY {_gap('q', 'd')}, d.c_custkey) AS place FROM points q JOIN points d ON q.label = 1 AND d.label = 0) "
    "SELECT c_custkey, place::INTEGER AS rank, donor, distance FROM n WHERE place <= 5",
)
def nearest_neighbours(spark, folder):
    df = points(spark, folder).withColumn("vector", vector_text(_DIMS))
    queries, donors = df.where("label = 1"), df.where("label = 0")
    near = nearest_join(
        queries.dropDuplicates(["vector"]), first_per_vector(donors, "vector", "c_custkey", 5), _DIMS, 5, "vector", "c_custkey", []
    )
    return queries.select("c_custkey", F.col("vector").alias("query")).join(near, "query").select(
        "c_custkey", "rank", "donor", "distance"
    )


_WIDE = 24


def _wide_unit(donors: int) -> int:
    """Rows of a work unit: about four cells, of at least 32 rows and of no more than a task holds with ease."""
    return max(32, min(262_144, donors // 4))


_WIDE_VECTOR = "list_transform(range(1, 25), lambda i: floor(embedding[i]::DOUBLE * 50))"


@query(
    "J5",
    f"WITH p AS MATERIALIZED (SELECT vec_id, label, {_WIDE_VECTOR} AS x FROM embeddings), "
    "n AS (SELECT q.vec_id, d.vec_id AS donor, list_sum(list_transform(range(1, 25), lambda i: (q.x[i] - d.x[i]) * (q.x[i] - d.x[i]))) AS distance "
    "FROM p q JOIN p d ON q.label = 1 AND d.label <> 1), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, donor) AS place FROM n) "
    "SELECT vec_id, place::INTEGER AS rank, donor, distance FROM r WHERE place <= 5",
)
def nearest_neighbours_wide(spark, folder):
    """Many dimensions and units so small that donors are cut into cells at any scale.

    In so many dimensions most cells are visited, and a row is sent once to each: the units
    grow with the donors, so that the copies of a query do not.
    """
    dims = [f"x{i}" for i in range(_WIDE)]
    values = [F.floor(F.get("embedding", F.lit(i)).cast("double") * 50).cast("double").alias(d) for i, d in enumerate(dims)]
    df = cut(read_table(spark, folder, "embeddings").select("vec_id", "label", *values).withColumn("vector", vector_text(dims)))
    queries, donors = df.where("label = 1"), df.where("label <> 1")
    near = nearest_join(
        queries.dropDuplicates(["vector"]), first_per_vector(donors, "vector", "vec_id", 5), dims, 5, "vector", "vec_id", [], unit_rows=_wide_unit(donors.count())
    )
    return queries.select("vec_id", F.col("vector").alias("query")).join(near, "query").select("vec_id", "rank", "donor", "distance")


def _smote_sql() -> str:
    mixed = ", ".join(v.sql_r6(f"b.{c} + b.step * (d.{c} - b.{c})") + f" AS {c}" for c in _DIMS)
    draw = "concat(m.c_custkey, '/', copy)"
    return f"""WITH {_POINTS}, sizes AS (SELECT count(*) FILTER (label = 0) - count(*) FILTER (label = 1) AS wanted, count(*) FILTER (label = 1) AS few FROM points),
m AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {v.sql_hash('c_custkey', '33:base')}, c_custkey) AS position FROM points WHERE label = 1),
near AS (SELECT * FROM (SELECT q.c_custkey, d.c_custkey AS donor,
    row_number() OVER (PARTITION BY q.c_custkey ORDER BY {_gap('q', 'd')}, d.c_custkey) AS place FROM m q JOIN m d ON q.c_custkey <> d.c_custkey) WHERE place <= 5),
degree AS (SELECT c_custkey, max(place) AS k FROM near GROUP BY 1),
base AS (SELECT m.*, copy, {v.sql_uniform(draw, '33:step')} AS step, 1 + floor({v.sql_uniform(draw, '33:pick')} * k)::INTEGER AS pick
  FROM m JOIN degree USING (c_custkey), sizes, LATERAL (SELECT unnest(range(1, (wanted // few + (position <= wanted % few)::INTEGER + 1)::BIGINT)) AS copy))
SELECT c_custkey, 0 AS copy, label, balance, price, orders FROM points
UNION ALL SELECT b.c_custkey, b.copy::INTEGER, b.label, {mixed} FROM base b JOIN near n ON n.c_custkey = b.c_custkey AND n.place = b.pick JOIN m d ON d.c_custkey = n.donor"""


@query("T3 J5 U1", _smote_sql())
def oversampled_minority(spark, folder):
    out = oversampled(points(spark, folder), "c_custkey", "label", _DIMS)
    return out.select("c_custkey", "copy", "label", *[v.r6(c).alias(c) for c in _DIMS])


@query(
    "T3",
    f"WITH {_POINTS} SELECT l.label, greatest((SELECT count(*) FROM points WHERE label = 0), (SELECT count(*) FROM points WHERE label = 1))::BIGINT AS n "
    "FROM (SELECT DISTINCT label FROM points) l",
)
def class_parity(spark, folder):
    out = oversampled(points(spark, folder), "c_custkey", "label", _DIMS)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
