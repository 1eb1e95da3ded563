"""Counts, summaries, joins, ordering, reshaping and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog import views as v
from panelforge.catalog.registry import query
from panelforge.catalog.survey_queries import CLEAN
from panelforge.functions import codebook as cb
from panelforge.operators import profile as pf
from panelforge.operators.encode import one_hot, require_levels
from panelforge.plans import survey as plan
from panelforge.sources.tables import read_table

_COUNTED = [cb.SURVEY_RENAMED.get(c, c) for c in cb.SURVEY_CLEAN]


@query(
    "A1",
    f"WITH {CLEAN} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*)::BIGINT AS n FROM clean WHERE {c} IS NOT NULL GROUP BY 2" for c in _COUNTED
    ),
)
def value_counts(spark, folder):
    return pf.value_counts(plan.clean_survey(v.survey(spark, folder)), _COUNTED)


@query(
    "A2 A8",
    f"WITH {v.CUSTOMER_ORDERS} SELECT count(*)::BIGINT AS n, (count(DISTINCT urgent98) + max((urgent98 IS NULL)::INTEGER))::BIGINT AS urgent_values, "
    "(count(DISTINCT c_mktsegment) + max((c_mktsegment IS NULL)::INTEGER))::BIGINT AS segments FROM co",
)
def distinct_counts(spark, folder):
    return v.customer_orders(spark, folder).agg(
        F.count(F.lit(1)).alias("n"),
        pf.distinct_with_null("urgent98").alias("urgent_values"),
        pf.distinct_with_null("c_mktsegment").alias("segments"),
    )


@query(
    "A3",
    "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS \"F\", count(*) FILTER (o_orderstatus = 'O')::BIGINT AS \"O\", "
    "count(*) FILTER (o_orderstatus = 'P')::BIGINT AS \"P\" FROM orders GROUP BY 1",
)
def cross_table(spark, folder):
    return pf.cross_table(read_table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "A5 A6 A7",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {v.sql_r6(f'var_samp({c})', 4)} AS variance, {v.sql_r6(f'avg(abs({c}))', 4)} AS mean_size, "
        f"{v.sql_r6(f'corr({c}, l_quantity)', 4)} AS with_quantity FROM lineitem"
        for c in _MEASURES
    ),
)
def column_summaries(spark, folder):
    table = pf.per_column(
        read_table(spark, folder, "lineitem"),
        _MEASURES,
        variance=F.var_samp,
        mean_size=lambda c: F.avg(F.abs(c)),
        with_quantity=lambda c: F.corr(c, F.col("l_quantity")),
    )
    return table.select("column", *[v.r6(c, 4).alias(c) for c in ("variance", "mean_size", "with_quantity")])


@query(
    "J1",
    "WITH late AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1) "
    "SELECT c_custkey, c_acctbal, n::BIGINT AS orders_1998 FROM customer LEFT JOIN late ON c_custkey = o_custkey",
)
def aligned_columns(spark, folder):
    late = (
        read_table(spark, folder, "orders")
        .where(F.year("o_orderdate") == 1998)
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("orders_1998"))
    )
    return read_table(spark, folder, "customer").select("c_custkey", "c_acctbal").join(late, "c_custkey", "left")


_LINE = "SELECT var_samp(l_quantity) AS q, var_samp(l_tax) AS t, avg(l_quantity) AS mq, avg(l_tax) AS mt FROM lineitem"


@query(
    "J2 J3 J4",
    f"SELECT 'l_quantity' AS variable, {v.sql_r6('q', 4)} AS variance, {v.sql_r6('mq', 4)} AS mean FROM ({_LINE}) "
    f"UNION ALL SELECT 'l_tax', {v.sql_r6('t', 4)}, {v.sql_r6('mt', 4)} FROM ({_LINE})",
)
def joined_summaries(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    wanted = ["l_quantity", "l_tax"]
    variances = pf.per_column(lines, wanted, variance=F.var_samp).withColumnRenamed("column", "variable")
    flat = lines.agg(
        F.array(*[F.lit(c) for c in wanted]).alias("names"), F.array(*[F.avg(c) for c in wanted]).alias("means")
    )
    means = pf.zipped(flat, variable="names", mean="means")
    joined = variances.join(means, "variable")
    return joined.select("variable", v.r6("variance", 4).alias("variance"), v.r6("mean", 4).alias("mean"))


@query(
    "O1 O2",
    "(SELECT 'largest' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL "
    "(SELECT 'smallest', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15)",
)
def largest_and_smallest(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    top = pf.largest(orders, "o_totalprice", 10, "o_orderkey")
    low = pf.ordered(orders, "o_totalprice", tie="o_orderkey").limit(15)
    return top.select(F.lit("largest").alias("side"), "*").unionByName(low.select(F.lit("smallest").alias("side"), "*"))


@query("O3", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {v.sql_hash('o_orderkey', 7)}, o_orderkey LIMIT 100")
def keyed_sample(spark, folder):
    return pf.keyed_sample(read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 7)


@query(
    "R1",
    "WITH m AS (SELECT l_returnflag AS model, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY 1) "
    f"SELECT model, 'discount' AS kind, {v.sql_r6('d')} AS score FROM m UNION ALL SELECT model, 'tax', {v.sql_r6('t')} FROM m",
)
def long_scores(spark, folder):
    wide = read_table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")
    )
    return pf.long_scores(wide, "model", ["discount", "tax"], "kind", "score").withColumn("score", v.r6("score"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "R2",
    "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INTEGER::DOUBLE AS \"c_mktsegment_{s}\"" for s in _SEGMENTS[1:]) + " FROM customer",
)
def one_hot_segments(spark, folder):
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    found = require_levels(customers, ["c_mktsegment"])["c_mktsegment"]
    return customers.select("c_custkey", *[c.alias(n) for n, c in one_hot("c_mktsegment", found).items()])


@query(
    "U1",
    "SELECT fold, count(*)::BIGINT AS n FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS fold FROM orders WHERE o_orderkey % 10 = {i}" for i in range(10)) + ") GROUP BY 1",
)
def appended_folds(spark, folder):
    scored = v.scored_orders(spark, folder).select("id", "fold")
    parts = [scored.where(F.col("fold") == i) for i in range(10)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
