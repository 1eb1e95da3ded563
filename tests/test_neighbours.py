import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import balance as bl
from panelforge.operators import box_tree as bt
from panelforge.operators import neighbours as nb
from panelforge.operators.balance import oversampled
from panelforge.operators.impute import impute_column, impute_in_order
from panelforge.session import cut

DIMS = ["a", "b", "c"]


def brute(queries, donors, k, total):
    """k nearest by (distance, key), gaps left out of the distance."""
    out = {}
    for q, x in queries.items():
        found = []
        for d, y in donors.items():
            both = ~(np.isnan(x) | np.isnan(y))
            if both.any():
                found.append((float(((x - y)[both] ** 2).sum() * (total / both.sum())), d))
        out[q] = sorted(found)[:k]
    return out


def frame(spark, vectors, name):
    rows = [[k] + [None if np.isnan(v) else float(v) for v in x] for k, x in vectors.items()]
    return spark.createDataFrame(rows, f"{name} long, a double, b double, c double")


def answers(near):
    out = {}
    for r in near.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((pytest.approx(r["distance"]), r["donor"]))
    return out


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("per_unit", [10_000, 37])
def test_nearest_join_is_exact(spark, monkeypatch, gaps, per_unit):
    monkeypatch.setattr(nb, "ROWS_PER_UNIT", per_unit)
    rng = np.random.default_rng(3)
    points = rng.integers(0, 12, (420, 3)).astype(float)
    if gaps:
        points[rng.random(points.shape) < 0.15] = np.nan
    # A third of the donors share one vector.
    points[100:200] = [5.0, 5.0, 5.0]
    queries = {i: points[i] for i in range(60)}
    donors = {i: points[i] for i in range(60, 420)}
    q, d = cut(frame(spark, queries, "q")), cut(frame(spark, donors, "d"))
    got = answers(nb.nearest_join(q, d, DIMS, 4, "q", "d", ["a"], total=5))
    want = brute(queries, donors, 4, 5)
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("fan", [1, 2])
def test_nearest_join_over_several_levels(spark, monkeypatch, fan):
    monkeypatch.setattr(bt, "FAN_BITS", fan)
    monkeypatch.setattr(bt, "SENT_NODES", 2)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(500, 3)).round(2)
    points[rng.random(points.shape) < 0.05] = np.nan
    points[:40] = points[0]
    queries, donors = {i: points[i] for i in range(0, 500, 9)}, {i: points[i] for i in range(500) if i % 9}
    q, d = cut(frame(spark, queries, "q")), cut(frame(spark, donors, "d"))
    got = answers(nb.nearest_join(q, d, DIMS, 3, "q", "d", ["a"], unit_rows=60))
    assert got == {k: v for k, v in brute(queries, donors, 3, 3).items() if v}


def tree_of(spark, points, leaf_rows):
    rows = cut(spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in x]) for i, x in enumerate(points)], "id long, vec array<double>"))
    return bt.build(rows, points.shape[1], "id", leaf_rows)


def test_boxes_hold_their_rows_and_levels_nest(spark, monkeypatch):
    monkeypatch.setattr(bt, "FAN_BITS", 2)
    rng = np.random.default_rng(6)
    points = rng.normal(size=(900, 4))
    points[rng.random(points.shape) < 0.02] = np.nan
    tree = tree_of(spark, points, 50)
    leaf_of = {r["id"]: r["node"] for r in tree.rows.collect()}
    assert len(tree.boxes) == len(tree.splits) > 1
    assert max(np.unique(list(leaf_of.values()), return_counts=True)[1]) <= 110
    for level, boxes in enumerate(tree.boxes):
        below = 2 * (len(tree.boxes) - 1 - level)
        found = {r["node"]: r for r in boxes.collect()}
        assert sum(r["n"] for r in found.values()) == 900
        for i, x in enumerate(points):
            box = found[leaf_of[i] >> below]
            assert box["parent"] == box["node"] >> 2
            assert all(low is None or low <= v <= high for v, low, high in zip(x, box["low"], box["high"], strict=True))


def test_few_leaves_are_visited(spark):
    rng = np.random.default_rng(7)
    points = rng.random((4000, 3))
    tree = tree_of(spark, points, 64)
    asked = tree.rows.where("id < 400").withColumn("group", F.col("node").cast("string")).withColumn("radius", F.lit(0.03**2))
    groups = bt.query_groups(asked, 3)
    pairs, leaves = bt.visited(tree, groups, 3).count(), tree.boxes[-1].count()
    assert leaves >= 60 and pairs < 0.3 * groups.count() * leaves


def test_equal_rows_make_one_leaf(spark):
    points = np.array([[1.0, 2.0]] * 300 + [[np.nan, 2.0]] * 20 + [[np.nan, np.nan]] * 20)
    tree = tree_of(spark, points, 50)
    sizes = sorted(r["n"] for r in tree.boxes[-1].collect())
    assert sizes == [20, 20, 300]


def test_limiting_equal_vectors_changes_nothing(spark):
    rng = np.random.default_rng(4)
    points = rng.integers(0, 3, (300, 3)).astype(float)
    queries, donors = {i: points[i] for i in range(20)}, {i: points[i] for i in range(20, 300)}
    d = frame(spark, donors, "d").withColumn("v", nb.vector_text(DIMS))
    kept = cut(nb.first_per_vector(d, "v", "d", 4))
    assert kept.count() < 280
    got = answers(nb.nearest_join(cut(frame(spark, queries, "q")), kept, DIMS, 4, "q", "d", []))
    assert got == brute(queries, donors, 4, 3)


def test_fewer_donors_than_asked_for(spark):
    q = cut(frame(spark, {1: np.array([0.0, 0, 0])}, "q"))
    d = cut(frame(spark, {7: np.array([1.0, 0, 0]), 8: np.array([2.0, 0, 0])}, "d"))
    assert [r["donor"] for r in nb.nearest_join(q, d, DIMS, 4, "q", "d", []).orderBy("rank").collect()] == [7, 8]


# --- imputation -------------------------------------------------------------


def test_imputed_category_is_the_truncated_mean(spark):
    rows = [(i, float(i), c) for i, c in enumerate(["a", "a", "c", "b", "gap", "a", "a", "a", "a"])]
    df = cut(spark.createDataFrame(rows, "id int, x double, s string"))
    got = {r["id"]: r["s"] for r in impute_column(df, "id", "s", "gap").collect()}
    # Neighbours of 4 are 3, 5, 2, 6 with codes 1, 0, 2, 0: mean 0.75, truncated to 0.
    assert got[4] == "a" and {k: v for k, v in got.items() if k != 4} == {i: c for i, _, c in rows if i != 4}


def test_missing_value_has_to_occur(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "id int, s string, x double")
    with pytest.raises(ValueError):
        impute_column(df, "id", "s", "gap")


def test_matrix_mask_blanks_equal_codes_everywhere(spark):
    # '9' sorts first, so code 0 is blank in every column: x = 0.0 is not compared.
    rows = [(1, "9", 5.0), (2, "a", 5.0), (3, "a", 0.0), (4, "b", 6.0), (5, "b", 7.0), (6, "b", 8.0)]
    df = cut(spark.createDataFrame(rows, "id int, s string, x double"))
    by_column = {r["id"]: r["s"] for r in impute_column(df, "id", "s", "9", k=1).collect()}
    assert by_column[1] == "a"
    # With k=4 the column mode takes rows 2, 3, 4, 5 and the matrix mode 2, 4, 5, 6.
    column = {r["id"]: r["s"] for r in impute_column(df, "id", "s", "9", k=4).collect()}
    matrix = {r["id"]: r["s"] for r in impute_column(df, "id", "s", "9", mask="matrix", k=4).collect()}
    assert column[1] == "a" and matrix[1] == "a"
    matrix_two = {r["id"]: r["s"] for r in impute_column(df, "id", "s", "9", mask="matrix", k=5).collect()}
    assert matrix_two[1] == "a"


def test_no_shared_feature_falls_back_to_the_column_mean(spark):
    rows = [(1, "9", 0.0), (2, "c", 1.0), (3, "a", 2.0), (4, "b", 3.0)]
    df = cut(spark.createDataFrame(rows, "id int, s string, x double"))
    # Row 1 has only x = 0.0, whose code 0 is blank as well. Codes 3, 1, 2: mean 2.
    got = {r["id"]: r["s"] for r in impute_column(df, "id", "s", "9", mask="matrix").collect()}
    assert got[1] == "b"


def test_null_is_neither_gap_nor_donor(spark):
    rows = [(1, "gap", 1.0), (2, None, 1.0), (3, "a", 9.0)]
    df = cut(spark.createDataFrame(rows, "id int, s string, x double"))
    got = {r["id"]: r["s"] for r in impute_column(df, "id", "s", "gap").collect()}
    assert got == {1: "a", 2: None, 3: "a"}


def test_steps_read_the_previous_result(spark):
    rows = [(i, float(i % 5), "gap" if i == 3 else "ab"[i % 2], 99.0 if i in (3, 8) else float(20 + i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, x double, s string, age double")
    out = impute_in_order(df, "id", [("s", "gap"), ("age", 99.0)])
    assert out.where("s = 'gap' or age = 99").count() == 0 and out.count() == 12


# --- balancing --------------------------------------------------------------


def test_balanced_rows_lie_between_two_parents(spark):
    rng = np.random.default_rng(1)
    x = rng.random((120, 3))
    x[:20] = x[0]
    rows = [(i, int(i < 37), *map(float, x[i])) for i in range(120)]
    df = cut(spark.createDataFrame(rows, "id long, y int, a double, b double, c double"))
    out = oversampled(df, "id", "y", DIMS).collect()
    assert sum(r["y"] == 1 for r in out) == sum(r["y"] == 0 for r in out) == 83
    assert {(r["id"], r["copy"]) for r in out if r["copy"] == 0} == {(i, 0) for i in range(120)}
    minority = x[:37]
    for r in out:
        if r["copy"]:
            base, new = x[r["id"]], np.array([r[c] for c in DIMS])
            near = np.argsort(((minority - base) ** 2).sum(axis=1), kind="stable")
            near = [n for n in near if n != r["id"]][:5]
            on_line = False
            for n in near:
                step = minority[n] - base
                t = 0.0 if not step.any() else float((new - base) @ step / (step @ step))
                on_line |= -1e-9 <= t <= 1 + 1e-9 and np.allclose(base + t * step, new, atol=1e-9)
            assert on_line


def test_copies_are_spread_evenly(spark):
    df = cut(spark.range(50).select("id", (F.col("id") < 15).cast("int").alias("y"), F.col("id").cast("double").alias("a")))
    n = [r["count"] for r in oversampled(df, "id", "y", ["a"]).where("copy > 0").groupBy("id").count().collect()]
    assert sum(n) == 20 and set(n) <= {1, 2}


def test_one_minority_row_is_repeated(spark):
    df = cut(spark.createDataFrame([(1, 1, 4.0), (2, 0, 1.0), (3, 0, 2.0)], "id long, y int, a double"))
    assert [r["a"] for r in oversampled(df, "id", "y", ["a"]).where("copy > 0").collect()] == [4.0]


@pytest.mark.parametrize("sent", [10_000, 2])
def test_many_copies_of_few_rows_are_dealt_evenly(spark, monkeypatch, sent):
    monkeypatch.setattr(bl, "SENT_ROWS", sent)
    rows = [(i, int(i < 3), float(i), float(i % 7)) for i in range(5003)]
    df = cut(spark.createDataFrame(rows, "id long, y int, a double, b double").repartition(4))
    made = bl.synthetic_rows(df, "id", "y", ["a", "b"]).cache()
    assert made.count() == 5000 - 3 and made.select("id", "copy").distinct().count() == 4997
    assert sorted(r["count"] for r in made.groupBy("id").count().collect()) == [1665, 1666, 1666]
    if sent > 3:
        per_task = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert max(per_task) < 2 * sum(per_task) / len(per_task)


def test_units_of_many_dimensions_grow_with_the_donors():
    from panelforge.catalog.prepare_queries import _wide_unit

    assert _wide_unit(100) == 32
    # the cells, and with them the copies of a query, stay the same
    assert 1_000_000 / _wide_unit(1_000_000) < 5


@pytest.mark.parametrize("direct", [0, 1 << 30])
@pytest.mark.parametrize("gaps", [False, True])
def test_tree_and_direct_matching_agree(spark, monkeypatch, direct, gaps):
    monkeypatch.setattr(nb, "ROWS_PER_UNIT", 37)
    monkeypatch.setattr(nb, "DIRECT_PAIRS", direct)
    built, build = [], bt.build
    monkeypatch.setattr(bt, "build", lambda *a: built.append(1) or build(*a))
    rng = np.random.default_rng(13)
    points = rng.integers(0, 12, (300, 3)).astype(float)
    if gaps:
        points[rng.random(points.shape) < 0.15] = np.nan
    points[100:150] = [5.0, 5.0, 5.0]
    queries, donors = {i: points[i] for i in range(80)}, {i: points[i] for i in range(80, 300)}
    q, d = cut(frame(spark, queries, "q")), cut(frame(spark, donors, "d"))
    got = answers(nb.nearest_join(q, d, DIMS, 4, "q", "d", ["a"], total=5))
    assert got == {k: v for k, v in brute(queries, donors, 4, 5).items() if v}
    assert len(built) == (0 if direct else 1)


def test_nothing_to_match(spark):
    q, d = cut(frame(spark, {1: np.array([0.0, 0, 0])}, "q")), cut(frame(spark, {2: np.array([1.0, 0, 0])}, "d"))
    assert nb.nearest_join(q.where("q < 0"), d, DIMS, 4, "q", "d", []).count() == 0
    assert nb.nearest_join(q, d.where("d < 0"), DIMS, 4, "q", "d", []).count() == 0


def test_vectors_are_equal_by_value_and_gap(spark):
    rows = [(1, 0.0, None), (2, -0.0, None), (3, None, 0.0), (4, float("nan"), 0.0), (5, float("nan"), -0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("v", nb.vector_key(["a", "b"]))
    assert sorted(r["id"] for r in nb.first_per_vector(df, "v", "id", 1).collect()) == [1, 3, 4]


def test_rough_distances_with_and_without_gaps_agree():
    draw = np.random.default_rng(3)
    a, b = draw.normal(size=(30, 6)), draw.normal(size=(40, 6))
    plain, off = nb._rough_distances(a, b, 6)
    gapped, _ = nb._rough_distances(np.column_stack([a, np.full(30, np.nan)]), np.column_stack([b, np.zeros(40)]), 6)
    exact = ((a[:, None] - b) ** 2).sum(axis=2)
    assert abs(plain - exact).max() <= off and np.allclose(gapped, exact)


def test_candidates_are_matched_as_arrow_and_sorted_by_a_hash(spark, capsys):
    """Values of vectors are not turned into Python objects, and compared only where hashes are equal."""
    points = {i: np.array([i % 7, i % 5, 1.0]) for i in range(60)}
    d = cut(frame(spark, points, "d").withColumn("v", nb.vector_key(DIMS)))
    nb.nearest_join(d.dropDuplicates(["v"]), nb.first_per_vector(d, "v", "d", 3), DIMS, 3, "v", "d", ["a"]).explain()
    plan = capsys.readouterr().out
    assert "FlatMapCoGroupsInArrow" in plan and plan.count("xxhash64(v") >= 1 and "xxhash64(query" in plan
