"""What the plans look like, where that decides how a job scales."""

import contextlib
import datetime
import io

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from panelforge.catalog import views as v
from panelforge.functions import codebook as cb
from panelforge.operators import filters as fl
from panelforge.operators import metrics as mt
from panelforge.operators import neighbours as nb
from panelforge.operators import profile as pf
from panelforge.operators.encode import moments
from panelforge.operators.ranks import hashed_rank
from panelforge.sources import pages as pg
from panelforge.sources.tables import read_survey


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def survey_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("survey") / "t")
    names = [*cb.SURVEY_NAMES, *cb.SURVEY_KEPT, "weight"]
    spark.range(10).select(F.col("id").alias("RESPONDENT_ID"), *[F.lit(1.0).alias(n.upper()) for n in names]).write.parquet(path)
    return path


def test_refusals_reach_the_scan(spark, survey_path):
    df = fl.without_refusals(read_survey(spark, survey_path).select("respondent_id", "rxqn2"), [("rxqn2", 8)])
    plan = plan_of(df)
    assert "Not(EqualNullSafe(RXQN2,8.0))" in plan
    assert "ReadSchema: struct<RESPONDENT_ID:bigint,RXQN2:double>" in plan


def test_equal_vectors_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("double").alias("a"))
    plan = plan_of(nb.first_per_vector(df.withColumn("v", nb.vector_text(["a"])), "v", "id", 4))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_sample_keeps_few_rows_per_task(spark):
    assert "TakeOrderedAndProject" in plan_of(pf.keyed_sample(spark.range(100), "id", 5, 1))


def test_rank_has_no_window_over_the_table(spark):
    plan = plan_of(hashed_rank(spark.range(100), "id", 1))
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line and "row_number" in line]
    assert windows and all("__piece" in w for w in windows)
    # The one gathered input is the sizes of the pieces, at most 4096 rows.
    assert plan.count("SinglePartition") == 1


def test_profile_is_parsed_once(spark):
    df = spark.createDataFrame([(1, "u", "h")], pg.PAGE_SCHEMA)
    plan = pg.parse_reviews(df, personal=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_metrics_agree_with_spark_evaluators(spark):
    df = spark.range(400).select(
        (F.col("id") % 3 == 0).cast("double").alias("y"), (F.pmod(F.col("id") * 7, F.lit(10)) / 10.0).alias("score")
    ).withColumn("prediction", (F.col("score") > 0.4).cast("double"))
    s = mt.scores(mt.outcome_counts(df)).first()
    multi = lambda name, **k: MulticlassClassificationEvaluator(labelCol="y", metricName=name, **k).evaluate(df)
    assert s["weighted_f1"] == pytest.approx(multi("f1")) and s["accuracy"] == pytest.approx(multi("accuracy"))
    assert s["recall"] == pytest.approx(multi("recallByLabel", metricLabel=1.0))
    assert s["f_beta_4"] == pytest.approx(multi("fMeasureByLabel", metricLabel=1.0, beta=4.0))
    area = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="score").evaluate(df)
    assert mt.roc_auc(mt.score_steps(df)).first()[0] == pytest.approx(area)


def test_a_cluster_has_to_name_its_checkpoint_folder():
    from panelforge.session import shared_folder

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_facts_of_customers_need_no_sort_based_aggregate(spark, tmp_path):
    day = datetime.date
    spark.createDataFrame([(1, 10.0, 3), (2, 20.0, 4)], "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    orders = [
        (1, 1, day(1998, 1, 2), 5.0, "O", "1-URGENT"), (2, 1, day(1998, 3, 1), 6.0, "F", None),
        (3, 1, day(1998, 3, 1), 7.0, None, "2-HIGH"), (4, 1, None, 8.0, "P", "5-LOW"), (5, None, day(1999, 1, 1), 9.0, "O", "5-LOW"),
    ]
    columns = "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderstatus string, o_orderpriority string"
    spark.createDataFrame(orders, columns).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1,), (1,), (3,)], "l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = v.customer_orders(spark, str(tmp_path))
    assert "SortAggregate" not in plan_of(out)
    found = {r["c_custkey"]: r for r in out.collect()}
    one = found[1]
    assert (one["n_orders"], one["n_items"], one["sum_price"], one["urgent98"]) == (4, 3, 26.0, 1)
    assert (one["last_price"], one["last_status"], one["last_priority"]) == (7.0, None, "2-HIGH")
    assert (one["first_date"], one["last_date"]) == (day(1998, 1, 2), day(1998, 3, 1))
    assert found[2]["n_orders"] is None and found[2]["last_price"] is None


def test_moments_of_many_columns_come_in_their_order(spark):
    df = spark.range(50).selectExpr(*[f"id * {i} AS c{i}" for i in range(40)])
    found = moments(df, df.columns)
    assert list(found) == df.columns and all(m == pytest.approx(24.5 * i) for i, (m, _) in enumerate(found.values()))
