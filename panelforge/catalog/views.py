"""Survey, score and review tables derived from the given star schema.

The queries need coded answers, scored rows and review pages. Each of those is a
projection of the given tables, so its size grows with them, and each has the
same definition in SQL for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelforge.functions.keyed import keyed_uniform
from panelforge.sources.tables import read_table

# --- SQL pieces -------------------------------------------------------------


def sql_uniform(key: str, seed) -> str:
    return f"(('0x' || substr(md5(concat({key}, ':{seed}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def sql_hash(key: str, seed) -> str:
    return f"md5(concat({key}, ':{seed}'))"


def r6(column, digits: int = 6):
    """Rounded for comparison, with a plain zero for tiny negatives."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.abs(column) < 0.5 * 10**-digits, F.lit(0.0)).otherwise(F.round(column, digits))


def sql_r6(expression: str, digits: int = 6) -> str:
    e = f"({expression})::DOUBLE"
    return f"(CASE WHEN abs({e}) < {0.5 * 10**-digits:.{digits + 1}f} THEN 0.0::DOUBLE ELSE round({e}, {digits}) END)"


# --- customer summary -------------------------------------------------------


def customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with order totals and the latest order.

    Line items are counted per order before they meet the orders, and all order
    facts are one aggregate per customer, combined on the map side.
    """
    items = read_table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("items")
    )
    orders = read_table(spark, folder, "orders")
    # Only numbers and dates are aggregated, which fit the rows of a hash table; texts would
    # have all orders sorted, and so the facts of the latest order are picked as a row.
    facts = (
        orders.join(items, "o_orderkey", "left")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"),
            F.sum("o_totalprice").alias("sum_price"),
            F.max("o_orderdate").alias("last_date"),
            F.min("o_orderdate").alias("first_date"),
            F.max(
                F.when(F.year("o_orderdate") == 1998, F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0))
            ).alias("urgent98"),
        )
    )
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    latest = (
        orders.where("o_custkey is not null")
        .select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
        .withColumn("place", F.row_number().over(newest))
        .where("place = 1")
        .select(
            "o_custkey",
            F.col("o_totalprice").alias("last_price"),
            F.col("o_orderstatus").alias("last_status"),
            F.col("o_orderpriority").alias("last_priority"),
        )
    )
    facts = facts.join(latest, "o_custkey").select(
        "o_custkey", "n_orders", "n_items", "sum_price", "last_price", "last_status", "last_priority", "last_date", "first_date", "urgent98"
    )
    customers = read_table(spark, folder, "customer")
    return (
        customers.join(facts, customers.c_custkey == facts.o_custkey, "left")
        .drop("o_custkey")
        .withColumn("cents", F.pmod(F.round(F.abs("c_acctbal") * 100).cast("long"), F.lit(100)).cast("int"))
    )


CUSTOMER_ORDERS = """
items AS (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1),
facts AS (
  SELECT o_custkey, count(*) AS n_orders, coalesce(sum(items), 0)::BIGINT AS n_items, sum(o_totalprice) AS sum_price,
         arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price,
         arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status,
         arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_priority,
         max(o_orderdate) AS last_date, min(o_orderdate) AS first_date,
         max(CASE WHEN year(o_orderdate) = 1998 THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END END) AS urgent98
  FROM orders LEFT JOIN items ON l_orderkey = o_orderkey GROUP BY 1),
co AS (
  SELECT c.*, f.* EXCLUDE (o_custkey), (round(abs(c_acctbal) * 100)::BIGINT % 100)::INTEGER AS cents
  FROM customer c LEFT JOIN facts f ON c_custkey = o_custkey)
"""

# --- coded survey -----------------------------------------------------------


# Answer codes as SQL text that both engines read alike. `cents` is the fraction of
# the account balance and marks the rare codes for refused or unknown answers.
SURVEY_CODES = {
    "rxqn1": "n_items",
    "rxqn2": "CASE WHEN day(last_date) = 30 THEN 8 WHEN day(last_date) = 31 THEN 9 ELSE 1 + month(last_date) % 5 END",
    "sex": "1 + c_nationkey % 2",
    "age": "CASE WHEN day(first_date) = 1 THEN 99 ELSE 18 + floor(last_price / 8000) END",
    "rxqn7d": "CASE WHEN cents = 0 THEN 8 WHEN last_priority = '1-URGENT' THEN 1 ELSE 2 END",
    "rxqn7a": "CASE WHEN cents = 1 THEN 8 WHEN last_status = 'O' AND last_price > 250000 THEN 1 ELSE 2 END",
    "age2": "CASE WHEN last_price < 160000 THEN 1 WHEN last_price < 320000 THEN 2 ELSE 3 END",
    "rxqn8a": "1 + n_orders % 2",
    "rxqn8b": "1 + n_items % 2",
    "rxqn8f": "1 + cents % 2",
    "rxqn8c": "1 + month(first_date) % 2",
    "rxqn9a": "1 + day(first_date) % 2",
    "rxqn11": "CASE WHEN cents = 2 THEN 8 ELSE 1 + n_orders % 5 END",
    "rxqn12a": "CASE WHEN cents = 3 THEN 8 WHEN cents = 4 THEN 9 ELSE 1 + day(last_date) % 2 END",
    "rxqn12b": "CASE WHEN cents = 5 THEN 8 WHEN cents = 6 THEN 9 ELSE 1 + month(first_date) % 2 END",
    "rxqn12c": "CASE WHEN cents = 7 THEN 8 WHEN day(first_date) % 3 = 0 THEN 1 ELSE 2 END",
    "rxqn12d": "CASE WHEN cents = 8 THEN 8 WHEN last_status = 'F' THEN 1 ELSE 2 END",
    "rxqn12e": "CASE WHEN cents = 9 THEN 8 WHEN day(last_date) % 4 = 0 THEN 1 ELSE 2 END",
    "rxqn12h": "CASE WHEN cents = 10 THEN 9 ELSE 1 + n_items % 2 END",
    "rxqn13": "CASE WHEN cents = 11 THEN 998 WHEN cents = 12 THEN 999 ELSE n_orders END",
    "rxqn18a": "CASE WHEN cents = 13 THEN 8 WHEN cents = 14 THEN 9 ELSE 1 + cents % 4 END",
    "rxqn19": "CASE WHEN cents = 15 THEN 8 ELSE 1 + c_nationkey % 4 END",
    "demh1": "CASE WHEN cents = 16 THEN 9 WHEN c_acctbal > 0 THEN 1 ELSE 2 END",
    "demh3": "CASE WHEN cents = 17 THEN 8 WHEN cents = 18 THEN 9 WHEN urgent98 = 1 THEN 1 WHEN urgent98 = 0 THEN 2 END",
    "rxqn27": "CASE WHEN cents = 19 THEN 8 WHEN cents = 20 THEN 9 ELSE 1 + month(first_date) % 4 END",
    "income": "CASE WHEN cents = 21 THEN 98 WHEN cents = 22 THEN 99 ELSE 1 + c_nationkey % 15 END",
    "educ": "CASE WHEN cents = 23 THEN 9 ELSE 1 + month(last_date) % 6 END",
    "metro": "1 + n_items % 5",
    "ownhome": "CASE WHEN cents = 24 THEN 8 WHEN cents = 25 THEN 9 ELSE 1 + n_orders % 2 END",
    "mstatus": "CASE WHEN cents = 26 THEN 9 ELSE 1 + day(first_date) % 6 END",
    "emply": "CASE WHEN cents = 27 THEN 8 WHEN cents = 28 THEN 9 ELSE 1 + n_items % 7 END",
    "division": "1 + c_nationkey % 9",
    "parent": "1 + month(last_date) % 2",
    "race": "1 + day(last_date) % 7",
}


def survey(spark: SparkSession, folder: str) -> DataFrame:
    """Coded answers of one respondent per customer that has orders."""
    base = customer_orders(spark, folder).where("n_orders is not null")
    return base.select(
        F.col("c_custkey").alias("respondent_id"),
        *[F.expr(f"cast({text} as double)").alias(name) for name, text in SURVEY_CODES.items()],
    )


SURVEY = CUSTOMER_ORDERS + ", survey AS (SELECT c_custkey AS respondent_id, " + ", ".join(
    f"CAST({text} AS DOUBLE) AS {name}" for name, text in SURVEY_CODES.items()
) + " FROM co WHERE n_orders IS NOT NULL)"

# --- scored rows ------------------------------------------------------------

SCORED_FOLDS = 10


def scored_orders(spark: SparkSession, folder: str) -> DataFrame:
    """(id, fold, y, score, prediction): a noisy score with many ties per order."""
    orders = read_table(spark, folder, "orders")
    y = F.when(
        (F.col("o_orderpriority") == "1-URGENT") | ((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 250000)), 1
    ).otherwise(0)
    blend = keyed_uniform("o_orderkey", "score") * 0.75 + y * 0.25
    return (
        orders.select(F.col("o_orderkey").alias("id"), y.alias("y"), (F.floor(blend * 100) / 100.0).alias("score"))
        .withColumn("prediction", (F.col("score") >= 0.5).cast("double"))
        .withColumn("fold", F.pmod("id", F.lit(SCORED_FOLDS)).cast("int"))
    )


SCORED = f"""
scored AS (
  SELECT *, CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction, (id % {SCORED_FOLDS})::INTEGER AS fold
  FROM (SELECT o_orderkey AS id, y, floor(({sql_uniform('o_orderkey', 'score')} * 0.75::DOUBLE + y * 0.25::DOUBLE) * 100) / 100.0::DOUBLE AS score
        FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' OR (o_orderstatus = 'O' AND o_totalprice > 250000) THEN 1 ELSE 0 END AS y FROM orders)))
"""

# --- review pages -----------------------------------------------------------

ADDRESS = "https://reviews.example/browse/%s?sheet=%s"

# Each order is one page with two profile blocks: the customer with the latest
# and an older evaluation, and the customer's nation as a second reviewer. Field
# definitions are SQL text that both engines read alike.
_BLOCKS = {
    "customer": {
        "username": "c_name",
        "age": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(18 + c_nationkey AS STRING) END",
        "sex": "CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END",
        "country": "CASE WHEN c_nationkey % 3 = 0 THEN 'United States' WHEN c_nationkey % 3 = 1 THEN 'Canada' ELSE n_name END",
        "state": "concat('state ', c_nationkey)",
        "first_diagnosis_date": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(year(o_orderdate) AS STRING) END",
        "primary_condition": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE lower(c_mktsegment) END",
        "side_effects": "substr(o_orderpriority, 3)",
        "adherence": "CASE o_orderkey % 5 WHEN 0 THEN 'Always' WHEN 1 THEN 'Usually' WHEN 2 THEN 'Sometimes' WHEN 3 THEN 'Never taken as prescribed' ELSE 'Not sure' END",
        "burden": "CASE WHEN o_totalprice > 250000 THEN 'Hard & long' ELSE 'A little \"hard\"' END",
        "dosage": "CASE WHEN o_orderstatus = 'F' THEN concat(o_orderkey % 100, ' mg daily') ELSE 'NA' END",
        "advice": "CASE WHEN o_orderpriority = '1-URGENT' THEN concat('take <early> at ', o_orderkey % 24) ELSE 'NA' END",
        "cost": "CASE WHEN o_totalprice > 100000 THEN concat('$', CAST(floor(o_totalprice / 1000) AS BIGINT)) ELSE 'NA' END",
        "profile_bio": "concat('\"', c_mktsegment, '\" & more')",
    },
    "nation": {
        "username": "n_name",
        "age": "CAST(30 + n_regionkey AS STRING)",
        "sex": "CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE 'female' END",
        "country": "'Mexico'",
        "state": "concat('region ', n_regionkey)",
        "first_diagnosis_date": "'2001'",
        "primary_condition": "'travel'",
        "side_effects": "'None'",
        "adherence": "'Always'",
        "burden": "'Not at all hard'",
        "dosage": "'NA'",
        "advice": "'NA'",
        "cost": "'NA'",
        "profile_bio": "'-'",
    },
}


def _escaped(column):
    for character, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        column = F.replace(column, F.lit(character), F.lit(reference))
    return column


def review_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written out as review pages (page_id, url, html)."""
    orders = read_table(spark, folder, "orders")
    customers = read_table(spark, folder, "customer")
    nations = read_table(spark, folder, "nation")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).join(
        nations, customers.c_nationkey == nations.n_nationkey
    )
    # A page is far wider than its order, so the narrow rows are spread out first. The number
    # given keeps adaptive execution from merging them by their size before they grow.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "o_orderkey")

    def block(fields: dict, older: bool):
        f = {name: F.expr(text) for name, text in fields.items()}
        attributes = F.to_json(
            F.struct(
                f["username"].alias("userName"), f["age"].alias("userAge"), f["sex"].alias("sex"),
                f["country"].alias("country"), f["state"].alias("state"),
                f["first_diagnosis_date"].alias("firstDiagnosisDate"),
                f["primary_condition"].alias("primaryConditionName"),
                F.array(F.col("c_mktsegment"), F.col("n_name")).alias("secondaryConditionNames"),
                f["profile_bio"].alias("briefBio"),
            )
        )
        pieces = [
            F.lit('<div class="summary"><div data-react-class="ProfileSummaryPropsContainer" data-react-props="'),
            _escaped(attributes),
            F.lit('"></div></div><div class="eval-details"><h3>'),
            F.date_format("o_orderdate", "MMM d, yyyy"),
            F.lit("</h3><div>"),
        ]
        for name, label in (("side_effects", "Side effects"), ("adherence", "Adherence"), ("burden", "Burden")):
            pieces += [F.lit(f"<div><span>{label}</span></div><div>\n<b>rating</b>\n"), _escaped(f[name]), F.lit("\n</div>")]
        for name, label in (("dosage", "Dosage:"), ("advice", "Advice &amp; Tips:"), ("cost", "Cost:")):
            value = F.replace(_escaped(f[name]), F.lit(" daily"), F.lit("\ndaily"))
            paragraph = F.concat(F.lit(f"<p>\n<strong>{label}</strong>\n"), value, F.lit("\n</p>"))
            pieces.append(F.when(f[name] == "NA", F.lit("")).otherwise(paragraph))
        pieces.append(F.lit("</div>"))
        if older:
            pieces.append(F.lit("<h3>Jan 1, 1990</h3><div><div><span>Side effects</span></div><div>\n\nOld\n</div></div>"))
        pieces.append(F.lit("</div>"))
        return F.concat(*pieces)

    html = F.concat(
        F.lit("<html><body><table><tr><td><a href='#'>"), F.col("c_mktsegment"), F.lit(" tablets</a></td><td>plain</td></tr></table>"),
        F.when(
            F.col("o_orderkey") % 3 == 0,
            F.concat(
                F.lit('<div role="navigation"><a href="#">1</a> <a href="#">'), (F.col("o_orderkey") % 6 + 2).cast("string"),
                F.lit('</a> <a href="#" class="icon-only is-not-rwd next_page">Next</a></div>'),
            ),
        ).otherwise(F.lit("")),
        block(_BLOCKS["customer"], older=True),
        block(_BLOCKS["nation"], older=False),
        # A third block without its evaluation, which the parser has to reject.
        F.when(
            F.col("o_orderkey") % 10 == 0,
            F.lit('<div><div data-react-class="ProfileSummaryPropsContainer" data-react-props="{broken"></div></div>'),
        ).otherwise(F.lit("")),
        F.lit("</body></html>"),
    )
    drug = F.lower("c_mktsegment")
    return rows.select(
        F.col("o_orderkey").alias("page_id"),
        F.format_string(ADDRESS, drug, F.col("o_orderkey").cast("string")).alias("url"),
        html.alias("html"),
    )


_REVIEW_ROWS = """review_rows AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
REVIEWS = _REVIEW_ROWS + ", reviews AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS page_id, {position} AS position, lower(c_mktsegment) AS drug_name, "
    + ", ".join(f"{text} AS {name}" for name, text in fields.items())
    + ", concat(c_mktsegment, ', ', n_name) AS secondary_condition FROM review_rows"
    for position, fields in enumerate(_BLOCKS.values(), start=1)
) + ")"
