import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from panelforge.functions.keyed import keyed_hash
from panelforge.operators import encode as en
from panelforge.operators import profile as pf
from panelforge.operators import split as sp
from panelforge.operators.ranks import hashed_rank, in_order


def test_hashed_rank_equals_one_window(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("g"))
    got = hashed_rank(df, "id", 5, ["g"])
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(keyed_hash("id", 5), "id")))
    assert got.join(want, ["id", "g"]).where("position <> want").count() == 0
    assert got.count() == 3000


def test_running_sums_over_many_partitions(spark):
    rng = np.random.default_rng(0)
    x = rng.permutation(5000)
    df = spark.createDataFrame([(int(v), int(v % 7)) for v in x], "v int, w int").repartition(16)
    with_conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in with_conf.items():
        spark.conf.set(k, v)
    try:
        rows = in_order(df, "v", running=["w"]).orderBy("v").collect()
    finally:
        for k in with_conf:
            spark.conf.unset(k)
    sums = np.cumsum(np.arange(5000) % 7)
    assert [r["position"] for r in rows] == list(range(5000))
    assert [r["cum_w"] for r in rows] == list(sums)
    assert {r["total_w"] for r in rows} == {int(sums[-1])}


def test_folds_are_even_per_class(spark):
    df = spark.range(1007).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    sizes = sp.stratified_folds(df, "id", "y", 10).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in sizes if r["y"] == y]
        assert len(n) == 10 and max(n) - min(n) <= 1


def test_holdout_takes_the_exact_share(spark):
    df = spark.range(962).select("id", (F.col("id") < 281).cast("int").alias("y"))
    n = {(r["y"], r["is_test"]): r["count"] for r in sp.stratified_holdout(df, "id", "y").groupBy("y", "is_test").count().collect()}
    assert n[(1, True)] == int(np.ceil(0.2 * 281)) and n[(0, True)] == int(np.ceil(0.2 * 681))


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    out = en.scaled(df, ["a", "b"]).agg(F.avg("a"), F.var_pop("a"), F.max(F.abs("b"))).first()
    assert out[0] == pytest.approx(0) and out[1] == pytest.approx(1) and out[2] == 0.0


@pytest.mark.parametrize("limit", [2, 1000])
def test_label_codes_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(en, "MAX_LEVELS", limit)
    df = spark.createDataFrame([(1, "b'c", 10.0), (2, "a", 9.0), (3, "b'c", 100.0), (4, None, 9.0)], "id int, s string, x double")
    codes = en.LabelCodes(df, ["s", "x"])
    got = {r["id"]: (r["s_code"], r["x_code"]) for r in codes.encode(df, "_code").collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (1.0, 2.0), 4: (None, 0.0)}
    again = codes.decode(codes.encode(df, "_code"), "x", "x_code", "again")
    assert again.where("x <> again").count() == 0
    assert codes.code_of("s", "b'c") == 1.0
    with pytest.raises(ValueError):
        codes.code_of("s", "missing")


def test_one_hot_names_and_order():
    assert list(en.one_hot("sex", ["M", "F"])) == ["sex_M"]
    assert list(en.one_hot("h", ["Yes", "No", "8.0"])) == ["h_No", "h_Yes"]


def test_variance_threshold_is_strict(spark):
    df = spark.createDataFrame([(float(i < 1), float(i < 2)) for i in range(4)], "a double, b double")
    assert en.varied_columns(df, ["a", "b"], 0.25) == []
    assert en.varied_columns(df, ["a", "b"], 0.2) == ["b"]


def test_null_is_one_more_value(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "s string")
    assert df.agg(pf.distinct_with_null("s")).first()[0] == 3


def test_value_counts_leave_nulls_out(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 1.0)], "s string, x double")
    got = {(r["column"], r["value"]): r["n"] for r in pf.value_counts(df, ["s", "x"]).collect()}
    assert got == {("s", "a"): 1, ("x", "1.0"): 2}


def test_sample_is_stable(spark):
    df = spark.range(1000)
    first = {r["id"] for r in pf.keyed_sample(df, "id", 10, 1).collect()}
    assert first == {r["id"] for r in pf.keyed_sample(df.repartition(7), "id", 10, 1).collect()} and len(first) == 10


def test_label_codes_of_dates_decimals_and_many_levels(spark):
    df = spark.range(6000).selectExpr(
        "id", "date_add(date'2000-01-01', cast(id % 900 as int)) as day", "cast(id % 7 as decimal(9,2)) / 4 as price", "concat('v', id % 5000) as name"
    )
    codes = en.LabelCodes(df, ["day", "price", "name"])
    coded = codes.encode(df, "_code")
    for c in ("day", "price", "name"):
        found = coded.select(c, f"{c}_code").distinct().collect()
        order = sorted(r[c] for r in found)
        assert {r[c]: r[f"{c}_code"] for r in found} == {v: float(i) for i, v in enumerate(order)}
        assert codes.code_of(c, order[3]) == 3.0
        back = codes.decode(coded, c, f"{c}_code", "back")
        assert back.where(f"back <> {c} or back is null").count() == 0


def test_value_counts_come_most_frequent_first(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "s string")
    assert [(r["value"], r["n"]) for r in pf.value_counts(df, ["s"]).collect()] == [("b", 2), ("a", 1), ("c", 1)]


def test_held_out_rows_give_no_answers(spark):
    from panelforge.operators.impute import impute_in_order

    rows = [(1, 1.0, "?", True), (2, 1.0, "x", False), (3, 1.0, "x", False), (4, 9.0, "y", True), (5, 8.0, "y", True)]
    df = spark.createDataFrame(rows, "id long, a double, s string, gives boolean")
    steps = [("s", "?")]
    every = impute_in_order(df, "id", steps, ["a", "s"], k=2)
    some = impute_in_order(df, "id", steps, ["a", "s"], k=2, donors="gives")
    assert every.where("id = 1").first()["s"] == "x" and some.where("id = 1").first()["s"] == "y"
    assert some.columns == df.columns


def test_cut_tables_have_the_size_of_their_files(spark, capsys):
    from panelforge.session import cut

    df = spark.range(50).withColumn("x", F.col("id") % 7)
    for _ in range(6):
        # estimates of joined checkpoints are products, with twice the digits each time
        df = cut(df.join(df.withColumnRenamed("x", "y"), "id").select("id", "x"))
    df.explain(mode="cost")
    assert "EiB" not in capsys.readouterr().out
    assert df.count() == 50
