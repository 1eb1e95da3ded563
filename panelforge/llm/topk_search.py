"""Exact k best inner products by a join over Voronoi cells.

With one more component, which lifts all rows to the same length, the rows of greatest
inner product with a query are its nearest ones. Rows and queries are put into the cells
of sampled pivots. From the cells' radii, the distances between pivots and the rows
nearest to each pivot follows how far the k-th neighbour of any query of a cell can be,
and so which rows of which other cell could be among the k: only these are sent to the
cell's queries. Cells are joined into units of bounded size, cells beyond it are cut, and
each unit is solved by blocks of exact products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.frames import binaries, by_slices, kept, key_runs, rows_of
from panelforge.llm.vectors import exact_kind, finite_vectors, integer_rows


@dataclass(frozen=True)
class Voronoi:
    """Answers of a query, units of a component, most pivots, components of a side of a unit.

    There are about as many pivots as the square root of the rows, up to `most_pivots`,
    drawn by hash; beyond that cells are cut into more units, and results stay exact.
    """

    k: int = 5
    scale: int = 256
    most_pivots: int = 512
    unit_cells: int = 1 << 20


@dataclass(frozen=True)
class Lifted:
    """Pivots as lifted points, and the length that all rows are lifted to."""

    pivots: np.ndarray
    heights: np.ndarray
    length: float

    def distances(self, x: np.ndarray, height: np.ndarray) -> np.ndarray:
        own = (x * x).sum(axis=1) + height * height
        theirs = (self.pivots * self.pivots).sum(axis=1) + self.heights * self.heights
        products = x @ self.pivots.T + height[:, None] * self.heights
        return np.sqrt(np.maximum(0, own[:, None] - 2 * products + theirs))

    def height(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.length * self.length - (x * x).sum(axis=1)))

    def cells(self, raw: np.ndarray, lifted: bool) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row and the distance to it; queries are not lifted."""
        x = raw.astype(np.float64)
        cell, near = np.zeros(len(x), np.int64), np.zeros(len(x))
        for at in range(0, len(x), 1024):
            some = x[at : at + 1024]
            d = self.distances(some, self.height(some) if lifted else np.zeros(len(some)))
            cell[at : at + 1024] = d.argmin(axis=1)
            near[at : at + 1024] = d.min(axis=1)
        return cell, near


@dataclass(frozen=True)
class Plan:
    """Which rows of a cell (from which distance to its pivot on) each set of query cells needs."""

    needed: np.ndarray  # (sets, cells) least distance
    cell_needed: np.ndarray  # (query cells, cells) least distance
    set_of: np.ndarray
    slices: np.ndarray  # of the queries of a set
    chunk_of: np.ndarray
    chunk_slices: np.ndarray  # of the rows of a cell
    farthest: np.ndarray  # row of a cell, -1 without rows


def _chain(apart: np.ndarray) -> np.ndarray:
    """All pivots in an order that goes from each to the nearest one left."""
    order, left = [0], np.ones(len(apart), bool)
    left[0] = False
    while left.any():
        nearest = int(np.where(left, apart[order[-1]], np.inf).argmin())
        order.append(nearest)
        left[nearest] = False
    return np.array(order)


def _joined(order: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each cell, slices of its group, size of each group): neighbours up to `most` rows."""
    group, number, filled = np.zeros(len(sizes), np.int64), 0, 0
    totals = [0]
    for cell in order:
        if filled and filled + sizes[cell] > most:
            number, filled = number + 1, 0
            totals.append(0)
        group[cell] = number
        filled += sizes[cell]
        totals[number] = filled
    return group, -(-np.maximum(1, np.array(totals)) // most), np.array(totals)


def plan(lifted: Lifted, rows: np.ndarray, farthest: np.ndarray, nearest: list[tuple[int, float]], queries: np.ndarray, radius: np.ndarray, k: int, most: int) -> Plan:
    """From the summaries of the cells: row counts and radii, query counts and radii, nearest rows.

    A query lies within `radius` of its pivot, so a row of cell j at distance d from its
    pivot is at most radius + |pivots| + d away; the k + 1 least of these sums bound the
    k-th neighbour, as one may be the query itself. By the triangle inequality the rows of
    cell j below |pivots| - radius - bound are farther away.
    """
    apart = lifted.distances(lifted.pivots, lifted.heights)
    slack = 1e-6 * (lifted.length + 1)
    near = np.array([d for _, d in nearest])
    near_cell = np.array([j for j, _ in nearest], np.int64)
    needed = np.full((len(rows), len(rows)), np.inf)
    for i in np.flatnonzero(queries):
        bound = np.inf
        if len(near) > k:
            bound = np.partition(radius[i] + apart[i, near_cell] + near, k)[k]
        needed[i] = apart[i] - radius[i] - bound - slack
    order = _chain(apart)
    set_of, slices, _ = _joined(order, queries, most)
    chunk, chunk_slices, _ = _joined(order, rows, most)
    by_set = np.full((len(slices), len(rows)), np.inf)
    np.minimum.at(by_set, set_of, needed)
    first = np.cumsum(chunk_slices) - chunk_slices
    return Plan(by_set, needed, set_of, slices, first[chunk], chunk_slices[chunk], farthest)


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, columns) of the k greatest of each row, falling, ties by rising column."""
    k = min(k, scores.shape[1])
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
    above, level = scores > edge, scores == edge
    taken = above | level & (level.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True))
    columns = np.nonzero(taken)[1].reshape(len(scores), k)
    values = np.take_along_axis(scores, columns, axis=1)
    order = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(values, order, axis=1), np.take_along_axis(columns, order, axis=1)


def _lengths(scale: int):
    """The width and the length of each row's vector."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        width = np.asarray(batch.column("vector").value_lengths(), np.int64)
        x = integer_rows(batch.column("vector"), scale, int(width.max(initial=0))).astype(np.float64)
        return pa.RecordBatch.from_arrays([pa.array(width), pa.array(np.sqrt((x * x).sum(axis=1)))], names=["width", "length"])

    return by_slices(work, 1024)


PLACED = "vec_id long, raw binary, cell int, distance double, query_cell int, query_distance double"


def _placed(lifted: Lifted, scale: int):
    """Each row in integers, with its cell as a row and its cell as a query."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = integer_rows(batch.column("vector"), scale, lifted.pivots.shape[1])
        (cell, near), (query_cell, query_near) = lifted.cells(x, True), lifted.cells(x, False)
        columns = [batch.column("vec_id"), binaries(x.astype(np.int32)), pa.array(cell, pa.int32()), pa.array(near), pa.array(query_cell, pa.int32()), pa.array(query_near)]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PLACED.split(", ")])

    return by_slices(work, 1024)


UNIT = "query_set int, query_slice int, chunk int"
SENT = f"{UNIT}, query boolean, row long, vec_id long, cell int, distance double, raw binary"


def _sent(made: Plan, of_rows: bool):
    """Each row as often as a unit needs it: a row to the sets near it, a query to all chunks near it."""
    names = [f.split()[0] for f in SENT.split(", ")]
    chunks = int((made.chunk_of + made.chunk_slices).max())
    held = np.zeros((len(made.slices), chunks), bool)  # chunks that have rows for a set
    for cell, (start, n) in enumerate(zip(made.chunk_of, made.chunk_slices, strict=True)):
        held[(made.needed[:, cell] <= made.farthest[cell]) & (made.farthest[cell] >= 0), start : start + n] = True

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, near, row = (batch.column(c).to_numpy() for c in ("cell", "distance", "row"))
        if of_rows:
            at, sets = np.nonzero(near[:, None] >= made.needed[:, cell].T)
            copies = made.slices[sets]
            at, sets = np.repeat(at, copies), np.repeat(sets, copies)
            part = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            chunk = made.chunk_of[cell[at]] + _mixed(row[at]) % made.chunk_slices[cell[at]]
        else:
            own = made.set_of[cell]
            at, chunk = np.nonzero(held[own])
            sets = own[at]
            part = _mixed(row[at]) % made.slices[sets]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        columns = [pa.array(v, t) for v, t in zip((sets, part, chunk, np.full(len(at), not of_rows)), kinds, strict=True)]
        take = pa.array(at)
        columns += [batch.column("row").take(take), batch.column("vec_id").take(take), pa.array(cell[at], pa.int32()), pa.array(near[at]), batch.column("raw").take(take)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return by_slices(work, 256)


def _mixed(row: np.ndarray) -> np.ndarray:
    return (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def _solved(made: Plan, k: int):
    """(row, query_id, vec_id, other, score): the k best rows of a unit for each of its queries."""

    def unit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        query = batch.column("query").to_numpy(zero_copy_only=False)
        ids = batch.column("vec_id")
        row, cell, near = (batch.column(c).to_numpy() for c in ("row", "cell", "distance"))
        missing = np.asarray(ids.is_null())
        ids = ids.fill_null(0).to_numpy()
        raw = rows_of(batch.column("raw"), np.int32)
        q, x = np.flatnonzero(query), np.flatnonzero(~query)
        if not len(q) or not len(x):
            return
        x = x[np.lexsort((row[x], ids[x], missing[x]))]  # ties of a score go to the lower place
        q = q[np.argsort(cell[q], kind="stable")]
        kind = exact_kind(int(np.abs(raw[q]).max(initial=0)), int(np.abs(raw[x]).max(initial=0)), raw.shape[1])
        out = np.iinfo(np.int64).min + 1 if kind is np.int64 else -np.inf
        for begin in range(0, len(q), 1024):
            some = q[begin : begin + 1024]
            least = made.cell_needed[np.unique(cell[some])].min(axis=0)
            rows = x[near[x] >= least[cell[x]]]
            values, places = np.empty((len(some), 0), kind), np.empty((len(some), 0), np.int64)
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                scores = raw[some].astype(kind) @ raw[part].astype(kind).T
                scores[row[some][:, None] == row[part]] = out
                new, columns = best_of(scores, k)
                values, places = np.concatenate((values, new), axis=1), np.concatenate((places, part[columns]), axis=1)
                values, columns = best_of(values, k)
                places = np.take_along_axis(places, columns, axis=1)
            at, rank = np.nonzero(values > out)
            found = places[at, rank]
            columns = [pa.array(row[some][at]), pa.array(ids[some][at]), pa.array(ids[found], mask=missing[found]), pa.array(row[found]), pa.array(values[at, rank].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "query_id", "vec_id", "other", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches, ("query_set", "query_slice", "chunk")):
            yield from unit(rows)

    return run


def placed_rows(rows: DataFrame, p: Voronoi) -> tuple[DataFrame, Lifted] | None:
    """The rows (vec_id, vector) in cells, as a written table with a row number, and the pivots."""
    total, width, longest = rows.select("vector").mapInArrow(_lengths(p.scale), "width long, length double").agg(F.count("*"), F.max("width"), F.max("length")).first()
    if not total:
        return None
    pivots = min(p.most_pivots, int(np.ceil(np.sqrt(total))))
    # at most most_pivots rows
    drawn = rows.orderBy(F.xxhash64("vector", "vec_id")).limit(pivots).select("vector").collect()
    at = integer_rows(pa.array([r["vector"] for r in drawn], pa.list_(pa.float64())), p.scale, max(1, width))
    at = np.unique(at, axis=0).astype(np.float64)
    lifted = Lifted(at, np.zeros(len(at)), float(longest))
    lifted = Lifted(at, lifted.height(at), float(longest))
    points = rows.select("vec_id", "vector").mapInArrow(_placed(lifted, p.scale), PLACED)
    return kept(points.withColumn("row", F.monotonically_increasing_id()), "points"), lifted


def plan_of(points: DataFrame, asked: DataFrame, lifted: Lifted, p: Voronoi) -> Plan:
    """The plan from one row per cell of rows and of queries, and the k + 1 rows nearest to each pivot."""
    near = Window.partitionBy("cell").orderBy("distance")
    nearest = points.select("cell", "distance", F.row_number().over(near).alias("place")).filter(F.col("place") <= p.k + 1).collect()
    sides = []
    for table in (points, asked.select("query_cell", "query_distance").toDF("cell", "distance")):
        n, far = np.zeros(len(lifted.pivots), np.int64), np.full(len(lifted.pivots), -1.0)
        for r in table.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect():
            n[r["cell"]], far[r["cell"]] = r["n"], r["far"]
        sides += [n, far]
    most = max(1, p.unit_cells // lifted.pivots.shape[1])
    return plan(lifted, sides[0], sides[1], [(r["cell"], r["distance"]) for r in nearest], sides[2], sides[3], p.k, most)


def sent_rows(points: DataFrame, asked: DataFrame, made: Plan) -> DataFrame:
    """Rows and queries, each once for every unit that needs it."""
    queries = asked.select("row", "vec_id", "raw", F.col("query_cell").alias("cell"), F.col("query_distance").alias("distance"))
    rows = points.select("row", "vec_id", "raw", "cell", "distance")
    return rows.mapInArrow(_sent(made, True), SENT).unionByName(queries.mapInArrow(_sent(made, False), SENT))


def top_products(df: DataFrame, queries: Column | None = None, key: str = "vec_id", vector: str = "embedding", p: Voronoi = Voronoi()) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of every query.

    `queries` is a condition on `vec_id`; by default ids divisible by 50. Vectors that are
    null or hold null or non-finite components take no part. A row is never its own answer,
    but another row with the same id or vector can be. Equal scores go to the smaller id,
    rows without an id come last and are never queries. Short vectors end in zeros.
    Components of a size with which a score could not be a long are taken as the limit of
    that size. Fewer than k other rows are all returned; an empty table gives an empty one.
    """
    condition = F.coalesce(F.col("vec_id") % 50 == 0 if queries is None else queries, F.lit(False))
    rows = finite_vectors(df, key, vector)
    placed = placed_rows(rows, p)
    if placed is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    points, lifted = placed
    asked = points.filter(condition)
    made = plan_of(points, asked, lifted, p)
    keys = [f.split()[0] for f in UNIT.split(", ")]
    units = sent_rows(points, asked, made).repartition(*keys).sortWithinPartitions(*keys)
    found = units.mapInArrow(_solved(made, p.k), "row long, query_id long, vec_id long, other long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= p.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
