"""Exact k-nearest-neighbour join over a tree of boxes.

Donors lie in the leaves of a tree that is split over all dimensions. Every query is first
matched inside the leaf it falls into, which gives it a radius. Groups of queries of one
leaf and similar radius then go down the tree, from the coarsest boxes to the leaves, and
only leaves within a group's radius are visited, so the answer is exact and far leaves are
never touched. Work units are (query group, leaf, donor slice) of bounded size; inside a
unit a matrix product finds the pairs that can count, and only these are computed exactly.
Up to DIRECT_PAIRS pairs of a query and a donor are compared without a tree, which would
take more time to build than it saves.

Distance is the mean squared difference over the dimensions present on both rows
times the number of dimensions, in the usual form for data with gaps. Ties go to
the lower key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelforge.operators import box_tree
from panelforge.session import cut

ROWS_PER_UNIT = 4096
MATRIX_VALUES = 4_000_000
#: 64 full work units, a few seconds each.
DIRECT_PAIRS = 1 << 30


def vector_text(dims: Sequence[str]):
    """One text per distinct vector; equal texts mean equal values."""
    values = F.array(*[F.col(d).cast("double") for d in dims])
    return F.array_join(F.transform(values, lambda x: (x + F.lit(0.0)).cast("string")), ",", "_")


def vector_key(dims: Sequence[str]):
    """The values as one array to group and join by, without making texts of them."""
    return F.array(*[F.col(d).cast("double") + F.lit(0.0) for d in dims])


def first_per_vector(df: DataFrame, vector: str, key: str, k: int) -> DataFrame:
    """The k lowest keys of each distinct vector.

    No other row with the same vector can be among k nearest, whatever the query.
    The row limit runs before the shuffle, so a vector shared by many rows sends
    only k of them per task.
    """
    # Rows are sorted by a hash first: values are only compared where it is the same.
    order = Window.partitionBy(F.xxhash64(vector), vector).orderBy(key)
    return df.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).drop("__place")


def _distances(a: np.ndarray, b: np.ndarray, total: int) -> np.ndarray:
    """Squared distances of paired rows; infinite where no dimension is present on both."""
    out, shared = np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        gap = a[:, j] - b[:, j]
        here = ~np.isnan(gap)
        out += np.where(here, gap * gap, 0.0)
        shared += here
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, out * (total / shared), np.inf)


def _rough_distances(queries: np.ndarray, donors: np.ndarray, total: int) -> tuple[np.ndarray, float]:
    """Squared distances of all pairs by matrix products, and how far they may be off."""
    centre = np.nan_to_num(np.nanmean(np.vstack([donors, np.zeros((1, donors.shape[1]))]), axis=0))
    q, d = queries - centre, donors - centre
    has_q, has_d = ~np.isnan(q), ~np.isnan(d)
    if has_q.all() and has_d.all():
        # without gaps one product is enough
        size_q, size_d = (q * q).sum(axis=1), (d * d).sum(axis=1)
        rough = q @ d.T
        rough *= -2
        rough += size_q[:, None]
        rough += size_d
        return np.maximum(rough, 0.0, out=rough) * (total / max(1, q.shape[1])), 1e-10 * total * (size_q.max() + size_d.max())
    q, d = np.where(has_q, q, 0.0), np.where(has_d, d, 0.0)
    shared = has_q.astype(float) @ has_d.T.astype(float)
    sums = (q * q) @ has_d.T - 2 * (q @ d.T) + has_q @ (d * d).T
    with np.errstate(divide="ignore", invalid="ignore"):
        rough = np.where(shared > 0, np.maximum(sums, 0.0) * (total / shared), np.inf)
    return rough, 1e-10 * total * ((q * q).sum(axis=1).max() + (d * d).sum(axis=1).max())


def _reachable(queries: np.ndarray, radius: np.ndarray, donors: np.ndarray, total: int) -> np.ndarray:
    """Queries whose radius meets the box of the donors; a dimension counts if all donors have it."""
    full = ~np.isnan(donors).any(axis=0)
    gap = np.fmax(np.fmax(donors[:, full].min(axis=0) - queries[:, full], queries[:, full] - donors[:, full].max(axis=0)), 0.0)
    bound = np.nansum(gap * gap, axis=1) * (total / np.maximum((~np.isnan(queries)).sum(axis=1), 1))
    return bound * (1 - 1e-9) <= radius


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of lists of doubles; a null is NaN."""
    whole = column.combine_chunks()
    values = whole.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(whole), len(values) // len(whole))


def _nearest(queries: pa.Table, donors: pa.Table, k: int, total: int, form: pa.Schema) -> pa.Table:
    """The k nearest donors of each query within one work unit."""
    parts = []
    if queries.num_rows and donors.num_rows:
        donors = donors.sort_by("donor")
        points, targets = _matrix(donors.column("vec")), _matrix(queries.column("vec"))
        asked = np.flatnonzero(_reachable(targets, queries.column("radius").to_numpy(), points, total))
        step = max(1, MATRIX_VALUES // len(points))
        for start in range(0, len(asked), step):
            some = asked[start : start + step]
            rough, off = _rough_distances(targets[some], points, total)
            bound = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * off if len(points) > k else np.full(len(some), np.inf)
            rows, columns = np.nonzero((rough <= bound[:, None]) & np.isfinite(rough))
            found = _distances(targets[some[rows]], points[columns], total)
            order = np.lexsort((columns, found, rows))
            rows, columns, found = rows[order], columns[order], found[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
            rows, columns, found = rows[keep], columns[keep], found[keep]
            # Lists are taken as they lie, which costs nothing for each of their values.
            picked = donors.select(["donor", "payload"]).take(columns)
            made = {"query": queries.column("query").take(some[rows]), "donor": picked.column("donor"), "distance": pa.array(found), "payload": picked.column("payload")}
            parts.append(pa.table([made[n] for n in form.names], names=form.names).cast(form))
    return pa.concat_tables(parts) if parts else form.empty_table()


def _sliced(df: DataFrame, node_sizes: DataFrame, key: str, unit: int, out: str) -> DataFrame:
    """Add a slice number, so that a leaf's rows of one slice are about `unit` at most."""
    sizes = node_sizes.select("node", F.ceil(F.col("n") / unit).cast("int").alias("__slices"))
    return df.join(sizes, "node").withColumn(out, F.pmod(F.xxhash64(key), F.col("__slices")).cast("int"))


def _match_units(pairs: DataFrame, queries: DataFrame, donors: DataFrame, k: int, total: int, schema) -> DataFrame:
    """Match the queries of a group with the donors of a leaf, for each of the pairs (group, node).

    Queries are copied to every donor slice of a leaf and donors to every group that
    visits their leaf, never row by row.
    """
    form = to_arrow_schema(schema)

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        return _nearest(a, b, k, total, form)

    slices = donors.select("node", "donor_slice").distinct()
    units = pairs.join(slices, "node")
    unit = ["group", "node", "donor_slice"]
    left = units.join(queries.select("group", "query", "vec", "radius"), "group")
    # Columns of its own for the second side, which the join of both would otherwise confuse.
    right = units.toDF(*units.columns).join(donors.select("node", "donor_slice", "donor", "vec", "payload"), ["node", "donor_slice"])
    # Units are small to move and costly to work on. With the number given, adaptive
    # execution does not merge them into few tasks by their size.
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(tasks, *unit), right.repartition(tasks, *unit)
    return left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(match, schema)


def _match_all(queries: DataFrame, donors: DataFrame, sizes: tuple[int, int], k: int, total: int, schema, unit: int) -> DataFrame:
    """Match all queries with all donors, in units of a slice of each; `sizes` are their rows."""
    form = to_arrow_schema(schema)

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        return _nearest(a, b, k, total, form)

    slices = [max(1, -(-n // unit)) for n in sizes]
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("group", place("query", slices[0])).withColumn("donor_slice", each(slices[1]))
    right = donors.withColumn("donor_slice", place("donor", slices[1])).withColumn("group", each(slices[0]))
    unit_key = ["group", "donor_slice"]
    # Twice as many tasks as units, so that few units share one by their hashes.
    tasks = min(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * slices[0] * slices[1])
    left = left.withColumn("radius", F.lit(float("inf"))).repartition(tasks, *unit_key)
    return left.groupBy(*unit_key).cogroup(right.repartition(tasks, *unit_key).groupBy(*unit_key)).applyInArrow(match, schema)


def _keep_nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy(F.xxhash64("query"), "query").orderBy("distance", "donor")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_join(
    queries: DataFrame,
    donors: DataFrame,
    dims: Sequence[str],
    k: int,
    query: str,
    key: str,
    payload: Sequence[str],
    total: int | None = None,
    unit_rows: int | None = None,
) -> DataFrame:
    """(query, rank, donor, distance, payload) of the k nearest donors per query.

    `distance` is squared. `payload` columns arrive as one array of doubles. Both
    inputs are read more than once, so callers pass written or cached tables.
    `unit_rows` bounds the donors and the queries of a work unit and asks for the tree; it
    changes the work and not the result.
    """
    total = total or len(dims)
    unit = unit_rows or ROWS_PER_UNIT
    vec = F.array(*[F.col(d).cast("double") for d in dims])
    schema = T.StructType(
        [
            T.StructField("query", queries.schema[query].dataType),
            T.StructField("donor", donors.schema[key].dataType),
            T.StructField("distance", T.DoubleType()),
            T.StructField("payload", T.ArrayType(T.DoubleType())),
        ]
    )
    paid = F.array(*[F.col(c).cast("double") for c in payload]).alias("payload")
    given = donors.select(F.col(key).alias("donor"), vec.alias("vec"), paid)
    asked = queries.select(F.col(query).alias("query"), vec.alias("vec"))
    if unit_rows is None:
        sizes = asked.count(), given.count()
        if sizes[0] * sizes[1] <= DIRECT_PAIRS:
            return _keep_nearest(_match_all(asked, given, sizes, k, total, schema, unit), k)
    tree = box_tree.build(cut(given), len(dims), "donor", unit)
    d = _sliced(tree.rows, tree.boxes[-1], "donor", unit, "donor_slice")
    placed = cut(tree.place(asked))
    sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    q = _sliced(placed, sizes, "query", unit, "slice").withColumn("group", F.concat_ws("/", "node", "slice"))
    home = q.withColumn("radius", F.lit(float("inf")))
    first = _keep_nearest(_match_units(home.select("group", "node").distinct(), home, d, k, total, schema), k)
    if not tree.splits:
        return first

    first = cut(first)
    reach = first.groupBy("query").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("radius")
    )
    ranged = q.join(reach, "query", "left").fillna({"radius": float("inf")})
    # Queries of one leaf whose radii are within a factor of four go together.
    band = F.floor(F.log2(F.greatest("radius", F.lit(1e-30))) / 2)
    ranged = cut(ranged.withColumn("group", F.concat_ws("/", "group", F.when(F.col("radius") < float("inf"), band))))
    groups = cut(box_tree.query_groups(ranged, len(dims)))
    pairs = box_tree.visited(tree, groups, total)
    pairs = pairs.where(F.col("node") != F.split("group", "/")[0].cast("long"))
    second = _match_units(pairs, ranged, d, k, total, schema)
    return _keep_nearest(first.select(*schema.fieldNames()).unionByName(second), k)
