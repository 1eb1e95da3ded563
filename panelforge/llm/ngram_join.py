"""Jaccard join of documents on word n-grams, as a blocked sparse matrix product.

1. Texts with the same n-gram set are one class. Of each set a prefix is taken, in an
   order that puts n-grams of very many prefixes last. Two sets that link share enough of
   their prefixes (see `enough`), so columns outside prefixes are not needed yet.
2. Classes are grouped into units by their most frequent shared column and by size, and
   units that share a column and may hold linked sizes make blocks. A block multiplies
   the incidence matrices of two bounded slices, a run of columns at a time, and drops
   all pairs whose count stays below the bound that their sizes imply.
3. The members of a block that have a pair left get their whole sets, and a second
   product over all columns gives the exact overlaps. A block sends on no pairs, but for
   each linked member the least one it is connected with.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.components import connected_components, least_labels
from panelforge.llm.frames import kept, key_runs, texts
from panelforge.llm.url_filter import bloom_blocks, bloom_hits, bloom_misses
from panelforge.llm.words import shingle_sets, word_hashes


@dataclass(frozen=True)
class JaccardJoin:
    """Sets link at `part` / `whole` or more.

    `heavy`: prefixes an n-gram must be in to move to the end of the order, and the most
    n-grams that do; both change the work and not the result. `slice_rows`: rows of a side
    of a block; `columns`: columns multiplied at a time.
    """

    width: int = 5
    part: int = 75
    whole: int = 100
    heavy: int = 10
    most_heavy: int = 1_000_000
    slice_rows: int = 512
    columns: int = 4096

    def prefix(self, n):
        """Length of the prefix of a set of n: a linked set shares part/whole of it or more."""
        return n - (n * self.part + self.whole - 1) // self.whole + 1

    def overlap(self, a, b):
        """The least overlap at which sets of a and b link."""
        both = self.part + self.whole
        return (self.part * (a + b) + both - 1) // both

    def enough(self, a, b, last_a, last_b):
        """The least number of shared prefix columns of linked sets.

        Common columns up to the earlier end of the two prefixes are in both; after it the
        set whose prefix ends there can add what it has outside. Where the ends are not
        told apart, the larger rest counts.
        """
        rest_a, rest_b = a - self.prefix(a), b - self.prefix(b)
        rest = np.where(last_a < last_b, rest_a, np.where(last_b < last_a, rest_b, np.maximum(rest_a, rest_b)))
        return np.maximum(1, self.overlap(a, b) - rest)

    def sizes_fit(self, a, b):
        return self.whole * np.minimum(a, b) >= self.part * np.maximum(a, b)


def _sets(batch: pa.RecordBatch, p: JaccardJoin) -> Iterator[tuple[int, np.ndarray]]:
    for first, hashes, offsets in word_hashes(batch.column("text")):
        for k, found in enumerate(shingle_sets(hashes, offsets, p.width)):
            yield first + k, found


def _class(found: np.ndarray) -> int | None:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64)) if len(found) else None


PREFIXES = "doc_id long, n long, cls long, tokens array<long>, last long"


def _prefixes(p: JaccardJoin, heavy: np.ndarray):
    """(doc_id, n, cls, tokens, last) of each row; a class's prefix is sent once by a task.

    `last` is the place of the prefix's end in the order, in steps of four hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = batch.column("doc_id").to_pylist()
                sizes, classes, tokens, lasts = [], [], [], []
                for row, found in _sets(batch, p):
                    cls = _class(found)
                    sizes.append(len(found))
                    classes.append(cls)
                    if cls is None or cls in sent or ids[row] is None:
                        tokens.append(np.empty(0, np.int64))
                        lasts.append(0)
                        continue
                    if len(sent) > 1_000_000:
                        sent.clear()
                    sent.add(cls)
                    length, late_end = p.prefix(len(found)), 0
                    if len(heavy):
                        short = found >> SHORT
                        spot = np.minimum(np.searchsorted(heavy, short), len(heavy) - 1)
                        late = heavy[spot] == short
                        light = found[~late]
                        late_end = int(len(light) < length)
                        found = np.concatenate([light, found[late][: length - len(light)]]) if late_end else light
                    tokens.append(found[:length].view(np.int64))
                    lasts.append((late_end << 62) | (int(found[length - 1]) >> 2))
                ends = np.cumsum([0, *map(len, tokens)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens)))
                columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), lists, pa.array(lasts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "cls", "tokens", "last"])

    return run


def _whole_sets(p: JaccardJoin):
    """(cls, grams) of each row that has a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [(_class(found), found.tobytes()) for _, found in _sets(batch, p) if len(found)]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["cls", "grams"])

    return run


# --- blocks --------------------------------------------------------------------------

BLOCK = ("home_a", "band_a", "home_b", "band_b", "slice_a", "slice_b")


def _product(left: list[np.ndarray], right: list[np.ndarray], columns: int) -> np.ndarray:
    """Counts of common tokens of every row of `left` with every row of `right`."""
    counts = np.zeros((len(left), len(right)), np.float32)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, place, often = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    common = often[place] > 1
    place, row = (np.cumsum(often > 1) - 1)[place[common]], row[common]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    width = int(place[-1]) + 1 if len(place) else 0
    for begin in range(0, width, columns):
        some = slice(*np.searchsorted(place, [begin, begin + columns]))
        matrix = np.zeros((len(left) + len(right), min(columns, width - begin)), np.float32)
        matrix[row[some], place[some] - begin] = 1
        counts += matrix[: len(left)] @ matrix[len(left) :].T
    return counts


def _sides(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The rows of both sides of a block; those of a slice with itself are on both."""
    side = rows.column("side").to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return left, right if len(right) else left


def _candidates(p: JaccardJoin):
    """(block, side, cls) of the members with a pair that may link."""

    def block(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        left, right = _sides(rows)
        if not len(left) or len(rows) < 2:
            return None
        cls, sizes, last = (rows.column(c).to_numpy() for c in ("cls", "n", "last"))
        lists = rows.column("tokens")
        ends = np.cumsum([0, *np.asarray(lists.value_lengths())])
        flat = np.asarray(lists.flatten())
        tokens = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        counts = _product([tokens[k] for k in left], [tokens[k] for k in right], p.columns)
        a, b = sizes[left][:, None], sizes[right][None, :]
        fit = (counts >= p.enough(a, b, last[left][:, None], last[right][None, :])) & p.sizes_fit(a, b) & (cls[left][:, None] != cls[right][None, :])
        hit = np.zeros(len(rows), bool)
        hit[left] |= fit.any(axis=1)
        hit[right] |= fit.any(axis=0)
        return rows.select([*BLOCK, "side", "cls"]).filter(pa.array(hit)) if hit.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches, BLOCK):
            found = block(rows)
            if found is not None:
                yield found

    return run


def _links(p: JaccardJoin):
    """(a, b) of linked members of a block: each with the least one it is connected with."""

    def block(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        left, right = _sides(rows)
        if not len(left) or len(rows) < 2:
            return None
        grams = [np.frombuffer(g, np.uint64) for g in rows.column("grams").to_pylist()]
        sizes = np.array([len(g) for g in grams])
        cls = rows.column("cls").to_numpy()
        counts = _product([grams[k] for k in left], [grams[k] for k in right], p.columns)
        i, j = np.nonzero((counts >= p.overlap(sizes[left][:, None], sizes[right][None, :])) & (cls[left][:, None] != cls[right][None, :]))
        i, j = left[i], right[j]
        label = least_labels(len(rows), i, j)
        hit = np.flatnonzero(label != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array(cls[label[hit]])], names=["a", "b"]) if len(hit) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches, BLOCK):
            found = block(rows)
            if found is not None:
                yield found

    return run


# --- on Spark ------------------------------------------------------------------------


#: Bits of an n-gram's hash left out when prefixes are counted, and its first bits, which name a bucket.
SHORT, BUCKET = np.uint64(24), 10
COUNTED = 1 << 19


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, counts) of the prefixes' n-grams: sorted short hashes, as packed steps, with their counts."""
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held).view(np.uint64) >> SHORT, return_counts=True)
        bucket = (found >> np.uint64(40 - BUCKET)).astype(np.int32)
        names, first = np.unique(bucket, return_index=True)
        blobs = []
        for begin, end in zip(first, [*first[1:], len(found)], strict=True):
            step = np.diff(found[begin:end], prepend=np.uint64(0))
            # bytes of one rank together, as the high ones are mostly zero
            planes = step.view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()
            blobs.append(zlib.compress(planes + counts[begin:end].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], names=["bucket", "counts"])

    for batch in batches:
        held.append(np.asarray(batch.column("tokens").flatten(), np.int64))
        size += len(held[-1])
        if size > COUNTED:
            yield packed()
            held, size = [], 0
    if size:
        yield packed()


def _often(p: JaccardJoin):
    """(token, count) of the short hashes that `heavy` prefixes have, of a partition sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches, ("bucket",)):
            found, counts = [], []
            for blob in map(zlib.decompress, rows.column("counts").to_pylist()):
                n = len(blob) // 9
                step = np.zeros((n, 8), np.uint8)
                step[:, :5] = np.frombuffer(blob, np.uint8, 5 * n).reshape(5, n).T
                found.append(np.cumsum(step.view(np.uint64).ravel()))
                counts.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, offset=5 * n).reshape(4, n).T).view("<u4").ravel())
            names, place = np.unique(np.concatenate(found), return_inverse=True)
            total = np.bincount(place, np.concatenate(counts)).astype(np.int64)
            often = total >= p.heavy
            yield pa.RecordBatch.from_arrays([pa.array(names[often].astype(np.int64)), pa.array(total[often])], names=["token", "count"])

    return run


def prefix_counts(docs: DataFrame, p: JaccardJoin) -> DataFrame:
    """The blobs of `_counted`. Both steps run in one Python worker: of two in a row each keeps its own alive."""
    prefixes = _prefixes(p, np.empty(0, np.uint64))
    return docs.mapInArrow(lambda batches: _counted(prefixes(batches)), "bucket int, counts binary")


def heavy_tokens(docs: DataFrame, p: JaccardJoin) -> np.ndarray:
    """The n-grams of the most prefixes, at most `p.most_heavy`, as sorted short hashes.

    Prefixes are counted by the first 40 bits of a hash, so that few bytes move; n-grams
    that share them move to the end of the order together, which no result depends on.
    """
    blobs = prefix_counts(docs, p).repartition("bucket").sortWithinPartitions("bucket")
    counts = blobs.mapInArrow(_often(p), "token long, count long")
    rows = counts.orderBy(F.desc("count"), "token").limit(p.most_heavy).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().astype(np.uint64))


#: Rows of units or of the grid up to which they are sent to every task instead of shuffled with the sets.
SENT_ROWS = 200_000


UNIT = ("size", "slices", "least_n", "most_n", "first_end", "final_end")


def _shared_enough(p: JaccardJoin):
    """Whether units a and b share enough columns for any of their pairs, by `JaccardJoin.enough`."""

    def ceil_div(x, by: int):
        return F.ceil(x / F.lit(float(by)))

    def rest(n):
        return ceil_div(n * p.part, p.whole) - 1

    overlap = ceil_div((F.col("least_n_a") + F.col("least_n_b")) * p.part, p.part + p.whole)
    rest_a, rest_b = rest(F.col("most_n_a")), rest(F.col("most_n_b"))
    most = F.when(F.col("final_end_a") < F.col("first_end_b"), rest_a).when(F.col("final_end_b") < F.col("first_end_a"), rest_b)
    return F.col("columns") >= overlap - F.coalesce(most, F.greatest(rest_a, rest_b))


def grid_of(lists: DataFrame, p: JaccardJoin) -> tuple[DataFrame, DataFrame]:
    """The blocks to multiply, and the units with their numbers of slices.

    A unit has the classes of a home column and a band of sizes. Two units make blocks if
    they share as many columns as their sizes demand of a linked pair.
    """
    units = lists.groupBy("home", "band").agg(
        F.count("*").alias("size"), F.ceil(F.count("*") / p.slice_rows).cast("int").alias("slices"),
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min("last").alias("first_end"), F.max("last").alias("final_end"),
    )
    units = kept(units, "units")
    columns = lists.select(F.explode("tokens").alias("token"), "home", "band").distinct()
    a = columns.select("token", F.col("home").alias("home_a"), F.col("band").alias("band_a"))
    b = columns.select("token", F.col("home").alias("home_b"), F.col("band").alias("band_b"))
    ordered = (F.col("band_b") == F.col("band_a") + 1) | ((F.col("band_a") == F.col("band_b")) & (F.col("home_a") <= F.col("home_b")))
    pairs = a.join(b, "token").filter(ordered).groupBy("home_a", "band_a", "home_b", "band_b").agg(F.count("*").alias("columns"))
    for side in ("a", "b"):
        pairs = pairs.join(units.select(*(F.col(c).alias(f"{c}_{side}") for c in ("home", "band", *UNIT))), [f"home_{side}", f"band_{side}"])
    same = (F.col("home_a") == F.col("home_b")) & (F.col("band_a") == F.col("band_b"))
    pairs = pairs.filter(F.when(same, F.col("size_a") > 1).otherwise(_shared_enough(p)))
    grid = pairs.withColumn("slice_a", F.explode(F.sequence(F.lit(0), F.col("slices_a") - 1)))
    grid = grid.withColumn("slice_b", F.explode(F.sequence(F.lit(0), F.col("slices_b") - 1)))
    return kept(grid.filter(~same | (F.col("slice_a") <= F.col("slice_b"))).select(*BLOCK), "grid"), units


def blocks_of(lists: DataFrame, grid: DataFrame, units: DataFrame) -> DataFrame:
    """The members of every block, sorted within it."""
    units, grid = (F.broadcast(t) if t.count() <= SENT_ROWS else t for t in (units.select("home", "band", "slices"), grid))
    members = lists.join(units, ["home", "band"])
    members = members.withColumn("slice", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int"))
    columns = ("cls", "n", "tokens", "last")
    members = members.select("home", "band", "slice", *columns)
    same_slice = (F.col("home_a") == F.col("home_b")) & (F.col("band_a") == F.col("band_b")) & (F.col("slice_a") == F.col("slice_b"))
    left = grid.join(members.toDF("home_a", "band_a", "slice_a", *columns), ["home_a", "band_a", "slice_a"])
    right = grid.filter(~same_slice).join(members.toDF("home_b", "band_b", "slice_b", *columns), ["home_b", "band_b", "slice_b"])
    rows = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "side", "cls")


def whole_sets(classes: DataFrame, docs: DataFrame, p: JaccardJoin) -> DataFrame:
    """(cls, grams) of `classes` (cls, doc_id), from the text of a document of each class.

    A Bloom filter of the ids drops other documents before anything is shuffled; what it
    lets through besides has a class that is not asked for, or the same set.
    """
    filled, blocks = bloom_blocks(classes.select(F.col("doc_id").cast("string").alias("key")), classes.count())
    possible = bloom_hits(docs.withColumn("key", F.col("doc_id").cast("string")), filled, blocks).select("doc_id", "text")
    return possible.mapInArrow(_whole_sets(p), "cls long, grams binary").dropDuplicates(["cls"])


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", p: JaccardJoin = JaccardJoin()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Rows without words have no set and are their own component; so are rows without an id
    (their component is null). Rows with equal sets are linked. Repeated ids are rows of
    their own. Sets and classes are compared by 64-bit hashes.
    """
    return _grouped(texts(df, key, text), p).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, p: JaccardJoin) -> DataFrame:
    """(doc_id, n_shingles, cls, component_id, first): `first` is the class of the component's least row."""
    heavy = heavy_tokens(docs, p)
    rows = kept(docs.mapInArrow(_prefixes(p, heavy), PREFIXES), "prefixes")
    named = rows.filter(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())
    classes = kept(named.groupBy("cls").agg(F.min("doc_id").alias("least")), "classes")

    columns = named.select("cls", "n", "last", F.explode("tokens").alias("token"))
    by_token = Window.partitionBy("token")
    shared = columns.select("*", F.min("cls").over(by_token).alias("low"), F.max("cls").over(by_token).alias("high"), F.count("*").over(by_token).alias("count")).filter("low < high")
    lists = shared.groupBy("cls").agg(F.first("n").alias("n"), F.first("last").alias("last"), F.collect_set("token").alias("tokens"), F.max(F.struct("count", "token"))["token"].alias("home"))
    # 1.34 is over 4/3, so linked sizes are in the same or in neighbouring bands
    ratio = 1.005 * p.whole / p.part
    lists = kept(lists.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(ratio))).cast("int")), "lists")

    grid, units = grid_of(lists, p)
    key = ", ".join(f"{c} {'long' if c.startswith('home') else 'int'}" for c in BLOCK)
    members = kept(blocks_of(lists, grid, units).mapInArrow(_candidates(p), f"{key}, side int, cls long"), "members")
    needed = kept(members.select("cls").distinct().join(classes.select("cls", F.col("least").alias("doc_id")), "cls"), "needed")
    verified = members.join(whole_sets(needed, docs, p), "cls")
    verified = verified.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "side", "cls")
    links = verified.mapInArrow(_links(p), "a long, b long")

    reach = connected_components(links).withColumnRenamed("node", "cls")
    joined = classes.join(reach, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = joined.groupBy("component").agg(F.min(F.struct("least", "cls")).alias("name"))
    result = joined.join(names, "component").select("cls", F.col("name.least").alias("component_id"), F.col("name.cls").alias("first"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(result, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "cls", component.alias("component_id"), "first")


def _class_of(p: JaccardJoin):
    """The class of a text as a column function; null without words."""

    @F.arrow_udf("long")
    def classes(column: pa.Array) -> pa.Array:
        found = [None] * len(column)
        for at in range(0, len(column), 256):
            for row, grams in _sets(pa.RecordBatch.from_arrays([column.slice(at, 256)], names=["text"]), p):
                found[at + row] = _class(grams)
        return pa.array(found, pa.int64())

    return classes


def first_of_groups(df: DataFrame, key: str = "doc_id", text: str = "text", p: JaccardJoin = JaccardJoin()) -> DataFrame:
    """The rows of `df` that are the first of their component; its columns stay as they are.

    Rows without an id or without words stay. A repeated id is no link: rows are told apart
    by id and class, and of the first row's exact repetitions one stays. A Bloom filter of
    the ids in question keeps the other rows, with their texts, out of the exact join.
    """
    rows = _grouped(texts(df, key, text), p).filter(F.col("doc_id").isNotNull() & F.col("cls").isNotNull())
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("cls") == F.col("first"))
    found = kept(rows.select("doc_id", "cls", stays.alias("stays")), "components")
    gone = found.filter(~F.col("stays")).select("doc_id", "cls")
    again = found.filter("stays").groupBy("doc_id", "cls").count().filter("count > 1")
    suspects = kept(gone.select("doc_id").unionByName(again.select("doc_id")).distinct(), "suspects")
    n = suspects.count()
    if not n:
        return df
    filled, blocks = bloom_blocks(suspects.select(F.col("doc_id").cast("string").alias("key")), n)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.coalesce(F.col(key).cast("long").cast("string"), F.lit("")).alias("key"))
    clear = bloom_misses(rows, filled, blocks)
    checked = bloom_hits(rows, filled, blocks).withColumn("doc_id", F.col("row").getField(key).cast("long"))
    checked = checked.withColumn("cls", _class_of(p)(F.col("row").getField(text).cast("string")))
    # rows without an id may look held by the filter; like those without words they are never equal to others
    alone = F.when(F.col("doc_id").isNull() | F.col("cls").isNull(), F.monotonically_increasing_id())
    checked = checked.withColumn("alone", alone).join(gone.distinct(), ["doc_id", "cls"], "left_anti").dropDuplicates(["doc_id", "cls", "alone"])
    return clear.select("row.*").unionByName(checked.select("row.*"))
