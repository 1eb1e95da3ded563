"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.session import scratch_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """Only the columns an operator reads, so that others of any name cannot clash."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written to the shared folder and read again, which cuts its lineage, and its place."""
    place = scratch_path(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place), place


def kept(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def discard(spark: SparkSession, place: str) -> None:
    """Remove a table that `written` made and that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened until none of `taken` is the same in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels no model may learn from; a null key counts as learnable."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def by_slices(work: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 256):
    """`work` on slices of each Arrow batch, so that results leave the task in small pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield work(batch.slice(at, rows))

    return run


def key_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, one key at a time, of batches that are sorted by integer keys."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        change = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            change |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(begin, end - begin)
        held = batch.slice(cuts[-1])
    if held is not None:
        yield held


def binaries(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def rows_of(column: pa.Array, kind: type) -> np.ndarray:
    """The matrix of a column of equally long binary values."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class Once:
    """A value made on its first use in a task; only its recipe travels to executors."""

    def __init__(self, make: Callable):
        self.make, self.made = make, {}

    def __call__(self, *args):
        if args not in self.made:
            self.made[args] = self.make(*args)
        return self.made[args]

    def __reduce__(self):
        return Once, (self.make,)
