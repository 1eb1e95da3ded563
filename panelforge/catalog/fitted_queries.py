"""Fitted models on tables and shapes for which SQL can give the same fit.

A stump, a drawn threshold and a penalised fit on one flag have closed forms, so the
engines that grow and solve them are compared number by number.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from panelforge.catalog import views as v
from panelforge.catalog.registry import query
from panelforge.functions import codebook as cb
from panelforge.operators import boosting, linear, sparse, trees
from panelforge.operators import explain as ex
from panelforge.operators import models as md
from panelforge.plans import training as tr
from panelforge.session import cut, scratch_path
from panelforge.sources.tables import load_model, read_table, save_model

_ITEM_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _item_rows(spark, folder, part):
    """Line items with few distinct values, returned ones as class 1."""
    return read_table(spark, folder, "lineitem").select(
        F.expr(part).cast("int").alias("part"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.array(*[F.col(c).cast("double") for c in _ITEM_FEATURES]).alias("x"),
        "l_orderkey",
        "l_linenumber",
    )


def _item_blocks(spark, folder, part):
    rows = _item_rows(spark, folder, part)
    layout = trees.fit_bins(rows, len(_ITEM_FEATURES))
    return layout, trees.tree_blocks(rows, layout, ["l_orderkey", "l_linenumber"])


def _long_items(part: str) -> str:
    """(part, feature, value, n, ones) and running sums below each value."""
    each = " UNION ALL ".join(
        f"SELECT {part} AS part, {j} AS feature, {c}::DOUBLE AS value, (l_returnflag = 'R')::INTEGER AS y FROM lineitem" for j, c in enumerate(_ITEM_FEATURES)
    )
    return f"""
grouped AS (SELECT part, feature, value, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS ones FROM ({each}) GROUP BY 1, 2, 3),
below AS (SELECT *, sum(n) OVER w AS ln, sum(ones) OVER w AS l1, sum(n) OVER whole AS tn, sum(ones) OVER whole AS t1, max(value) OVER whole AS top, min(value) OVER whole AS low
  FROM grouped WINDOW w AS (PARTITION BY part, feature ORDER BY value), whole AS (PARTITION BY part, feature))"""


# --- boosting -----------------------------------------------------------------

_STUMP = boosting.Boost("stump", rounds=1, leaves=2)


@query(
    "M5",
    f"""WITH {_long_items('l_linenumber % 3')},
sums AS (SELECT *, t1 / tn AS p FROM below WHERE value < top),
gains AS (SELECT *, ln * p - l1 AS gl, ln * p * (1 - p) AS hl, (tn - ln) * p - (t1 - l1) AS gr, (tn - ln) * p * (1 - p) AS hr FROM sums),
best AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY round(gl * gl / hl + gr * gr / hr, 7) DESC, feature, value) AS place FROM gains
  WHERE ln >= {_STUMP.rows} AND tn - ln >= {_STUMP.rows})
SELECT part::INTEGER AS part, feature::INTEGER AS feature, value AS cut, ln::BIGINT AS n_left, (tn - ln)::BIGINT AS n_right,
  {v.sql_r6(f'-{_STUMP.rate} * gl / hl')} AS left_value, {v.sql_r6(f'-{_STUMP.rate} * gr / hr')} AS right_value FROM best WHERE place = 1""",
)
def boosted_stumps(spark, folder):
    """The first split of a boosted model for every third of the line items."""
    layout, blocks = _item_blocks(spark, folder, "l_linenumber % 3")
    model = boosting.boost(blocks, _STUMP, layout)
    firsts = [(g, int(t[0].nodes[0][0]), float(layout.values[int(t[0].nodes[0][0])][int(t[0].nodes[0][1])]), float(t[0].nodes[1][4]), float(t[0].nodes[2][4])) for g, t in model.trees.items()]
    split = F.broadcast(spark.createDataFrame(firsts, "part int, feature int, cut double, left_value double, right_value double"))
    below = F.sum((F.get("x", F.col("feature")) <= F.col("cut")).cast("long"))
    rows = _item_rows(spark, folder, "l_linenumber % 3").join(split, "part")
    counted = rows.groupBy("part", "feature", "cut", "left_value", "right_value").agg(below.alias("n_left"), (F.count(F.lit(1)) - below).alias("n_right"))
    return counted.withColumns({c: v.r6(c) for c in ("left_value", "right_value")})


# --- forests ------------------------------------------------------------------

_STUMPS = trees.Forest("stumps", 6, depth=1, bootstrap=False)
_DRAWN = trees.Forest("drawn", 6, depth=1, bootstrap=False, extra=True)


def _root_draws(spec: trees.Forest) -> list[tuple[int, int, float]]:
    """(tree, feature, share) of every root; they do not depend on the rows."""
    out = []
    for tree in range(spec.trees):
        j = int(trees.drawn_features(spec, tree, trees.ROOT, np.ones(len(_ITEM_FEATURES), bool))[0])
        out.append((tree, j, float(trees.uniform(spec.seed, tree, trees.ROOT, j, 3))))
    return out


def _split_sql(spec: trees.Forest, order: str) -> str:
    draws = ", ".join(f"({t}, {j}, {u!r}::DOUBLE)" for t, j, u in _root_draws(spec))
    return f"""WITH {_long_items('0')}, draws(tree, feature, share) AS (VALUES {draws}),
best AS (SELECT tree, ln, l1, tn, t1, row_number() OVER (PARTITION BY tree ORDER BY {order}) AS place FROM below JOIN draws USING (feature) WHERE value < top)
SELECT tree::INTEGER AS tree, side::INTEGER AS side, (CASE side WHEN 0 THEN ln ELSE tn - ln END)::BIGINT AS n, (CASE side WHEN 0 THEN l1 ELSE t1 - l1 END)::BIGINT AS ones
FROM best, (VALUES (0), (1)) s(side) WHERE place = 1"""


def _first_splits(spark, folder, spec):
    layout, blocks = _item_blocks(spark, folder, "0")
    grown = trees.grow_forests(blocks, [spec], {0: [0]}, layout)
    side = F.when(F.col("node") == trees.child(trees.ROOT, True), 1).otherwise(0)
    return trees.leaves(grown).select("tree", side.alias("side"), F.col("weight").cast("long").alias("n"), F.col("ones").cast("long").alias("ones"))


_GINI = "(l1 * l1 + (ln - l1) * (ln - l1)) / ln + ((t1 - l1) * (t1 - l1) + (tn - ln - t1 + l1) * (tn - ln - t1 + l1)) / (tn - ln)"


@query("M3", _split_sql(_STUMPS, f"round({_GINI}, 6) DESC, value"))
def forest_stumps(spark, folder):
    """Both sides of every tree's first split, best of all cuts of its feature."""
    return _first_splits(spark, folder, _STUMPS)


@query("M4", _split_sql(_DRAWN, "CASE WHEN value <= low + share * (top - low) THEN 0 ELSE 1 END, CASE WHEN value <= low + share * (top - low) THEN -value ELSE value END"))
def extra_trees_first_split(spark, folder):
    """Both sides of every tree's first split, at a threshold drawn by hash."""
    return _first_splits(spark, folder, _DRAWN)


# --- logistic -----------------------------------------------------------------

_LASSO = {**cb.LOGISTIC_GRID, "l1_share": [1.0]}


def _lasso_sql() -> str:
    names = {n: i for i, n in enumerate(cb.LOGISTIC_GRID["class_weight"])}
    candidates = ", ".join(
        f"('l1 C={c:g} weights={w}', {1 / c!r}::DOUBLE, " + ("NULL, NULL)" if w == "balanced" else f"{w[0]!r}::DOUBLE, {w[1]!r}::DOUBLE)") for c in _LASSO["C"] for w in names
    )
    logit = lambda s: f"ln({s} / (1 - {s}))"
    return f"""WITH {v.SCORED}, c(candidate, lam, c0, c1) AS (VALUES {candidates}),
folds AS (SELECT unnest(range(0, {v.SCORED_FOLDS}))::INTEGER AS fold),
counts AS (SELECT f.fold, sum(y * prediction) AS a1, sum((1 - y) * prediction) AS b1, sum(y * (1 - prediction)) AS a0, sum((1 - y) * (1 - prediction)) AS b0
  FROM folds f JOIN scored s ON s.fold <> f.fold GROUP BY f.fold),
weighted AS (SELECT candidate, fold, lam, a1 * w1 AS a1, a0 * w1 AS a0, (a1 * w1 + b1 * w0) AS n1, (a0 * w1 + b0 * w0) AS n0 FROM (
  SELECT *, coalesce(c0, (a1 + b1 + a0 + b0) / (2 * (b1 + b0))) AS w0, coalesce(c1, (a1 + b1 + a0 + b0) / (2 * (a1 + a0))) AS w1 FROM counts, c)),
shares AS (SELECT *, sign(a1 / n1 - a0 / n0) AS s FROM weighted),
solved AS (SELECT *, a1 / n1 - s * lam / n1 AS q1, a0 / n0 + s * lam / n0 AS q0, (a1 + a0) / (n1 + n0) AS q FROM shares)
SELECT candidate, fold, {v.sql_r6(f"CASE WHEN s * (q1 - q0) > 0 THEN {logit('q1')} - {logit('q0')} ELSE 0 END", 4)} AS weight,
  {v.sql_r6(f"CASE WHEN s * (q1 - q0) > 0 THEN {logit('q0')} ELSE {logit('q')} END", 4)} AS intercept FROM solved"""


@query("M1 M2 M9", _lasso_sql())
def lasso_closed_form(spark, folder):
    """Every L1 candidate of the grid without every fold, on one flag."""
    rows = v.scored_orders(spark, folder).select("fold", "y", F.array("prediction").alias("x"))
    blocks = linear.row_blocks(rows, "fold", "y", "x")
    folds = range(v.SCORED_FOLDS)
    counts = {f: {} for f in folds}
    for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["fold"]][r["y"]] = r["n"]
    fits = linear.fit_many(blocks, tr.logistic_problems(counts, _LASSO), {f: [g for g in folds if g != f] for f in folds}, 1, tolerance=1e-11)
    found = [(p.name, p.group, float(w), float(b)) for p, (w, b) in zip(fits.problems, fits.coefficients, strict=True)]
    table = spark.createDataFrame(found, "candidate string, fold int, weight double, intercept double")
    return table.withColumns({c: v.r6(c, 4) for c in ("weight", "intercept")})


def _flag_model(spark, folder):
    rows = cut(v.scored_orders(spark, folder).select("id", "y", "prediction"))
    stages = md.feature_stages(rows, ["prediction"], False)
    ready = PipelineModel(stages).transform(rows)
    estimator = md.logistic("y", rows.count(), cb.LOGISTIC_FLAT_C, max_iter=200)
    return rows, PipelineModel([*stages, estimator.setFeaturesCol("features").setPredictionCol("said").fit(ready)])


@query(
    "X1 M1",
    f"""WITH {v.SCORED}, p AS (SELECT avg(y) FILTER (prediction = 1) AS p1, avg(y) FILTER (prediction = 0) AS p0 FROM scored)
SELECT 'prediction' AS feature, {v.sql_r6('ln(p0 / (1 - p0)) - ln(p1 / (1 - p1))', 2)} AS weight, p1 < p0 AS is_positive FROM p""",
)
def flag_contribution(spark, folder):
    """The coefficient report of a fitted model with one flag, whose weight is a difference of log odds."""
    _, model = _flag_model(spark, folder)
    return ex.contribution_table(ex.weight_table(spark, model.stages[-1], ["prediction"])).withColumn("weight", v.r6("weight", 2))


@query("S8 D1 M8", f"WITH {v.SCORED} SELECT count(*)::BIGINT AS n, 0.0::DOUBLE AS largest_gap FROM scored")
def stored_scores(spark, folder):
    """Rows scored by a model and its stored copy, and the largest difference."""
    rows, model = _flag_model(spark, folder)
    path = scratch_path(spark, "model")
    save_model(model, path)
    first, again = (md.predictions(m, rows, "id", "y", "said") for m in (model, load_model(path)))
    both = first.select("id", "score").join(again.select("id", F.col("score").alias("again")), "id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("score") - F.col("again"))).alias("largest_gap"))


@query(
    "R2 T5",
    "SELECT l_orderkey, l_linenumber, nullif(dense_rank() OVER (ORDER BY l_orderkey) - 2, -1)::INTEGER AS position FROM lineitem",
)
def sparse_levels(spark, folder):
    """The place of each item's order among all orders in a sparse one-hot vector; the first order has none."""
    items = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    vectors = sparse.fit_sparse(items, categorical=["l_orderkey"]).apply(items, ["l_orderkey", "l_linenumber"])
    return vectors.select("l_orderkey", "l_linenumber", F.get(sparse.nonzero(), F.lit(0))["position"].alias("position"))
