import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelforge.operators import sparse as sp
from panelforge.operators.encode import one_hot, scaled


@pytest.mark.parametrize("sent", [100_000, 1])
def test_sparse_equals_dense(spark, monkeypatch, sent):
    monkeypatch.setattr(sp, "SENT_LEVELS", sent)
    rows = spark.createDataFrame([(i, float(i % 7), "abcde"[i % 5], i % 3, "one") for i in range(60)], "id long, x double, kind string, code int, same string")
    made = sp.fit_sparse(rows, ["x"], ["kind", "code", "same"])
    assert made.width() == 1 + 4 + 2
    dense = scaled(rows, ["x"]).withColumns({**one_hot("kind", list("abcde")), **one_hot("code", [0, 1, 2])})
    names = [r["name"] for r in made.names(spark).orderBy("position").collect()]
    assert names == ["x", "kind_b", "kind_c", "kind_d", "kind_e", "code_1", "code_2"]
    want = {r["id"]: [r[n] for n in names] for r in dense.collect()}
    got = {r["id"]: r["v"] for r in made.apply(rows, ["id"]).select("id", vector_to_array("features").alias("v")).collect()}
    assert {i: pytest.approx(v) for i, v in got.items()} == want
    other = spark.createDataFrame([(1, 0.0, "zz", None, None)], rows.schema)
    assert made.apply(other, ["id"]).select(F.size(F.filter(vector_to_array("features"), lambda v: v != 0))).first()[0] == 1


def test_many_levels_fit(spark):
    rows = spark.range(60_000).select("id", F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("kind"), (F.col("id") % 2).cast("double").alias("y"))
    made = sp.fit_sparse(rows, categorical=["kind"])
    table = made.apply(rows, ["id", "y"])
    model = LogisticRegression(labelCol="y", maxIter=2).fit(table)
    assert made.width() > 20_000 and model.numFeatures == made.width()
    assert table.select(F.max(F.size(sp.nonzero()))).first()[0] == 1
    # names of all places would have to fit the driver
    assert not table.schema["features"].metadata
