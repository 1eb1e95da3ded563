"""Incremental parsing of a growing folder of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.sources.pages import PAGE_SCHEMA


def page_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    """Pages as they arrive; `files` bounds the files of one micro-batch.

    A `pattern` without wildcards names one table in the folder, a file or a folder of files.
    """
    stream = spark.readStream.schema(PAGE_SCHEMA)
    if any(c in pattern for c in "*?[{"):
        stream, path = stream.option("pathGlobFilter", pattern), folder
    else:
        # A path with a wildcard may lead to a file as well as to a folder.
        path = f"{folder.rstrip('/')}/{pattern[:-1]}[{pattern[-1]}]"
    return (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_parsed(
    stream: DataFrame, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "page_id"
):
    """Parse what is new, append it to `out`, and return the finished query.

    Each micro-batch owns one folder, overwritten when the batch is repeated after
    a failure, so nothing is stored twice. The keys of all pages seen, also of those that
    gave no record, are a table of their own beside the checkpoint, so a later batch reads
    keys only. Of versions of a page in one batch the least by its columns is parsed.
    """
    spark = stream.sparkSession
    seen = f"{checkpoint.rstrip('/')}-keys"

    def write(pages: DataFrame, batch: int) -> None:
        others = [c for c in pages.columns if c != key]
        fresh = pages.groupBy(key).agg(F.min(F.struct(*others)).alias("page")).select(key, "page.*")
        if path_exists(spark, seen):
            before = spark.read.option("basePath", seen).parquet(seen).where(F.col("batch") < batch).select(key)
            fresh = fresh.join(before, key, "left_anti")
        fresh = fresh.persist()
        parse(fresh).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        fresh.select(key).write.mode("overwrite").parquet(f"{seen}/batch={batch}")
        fresh.unpersist()

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def progress(query) -> list[tuple[int, int]]:
    """(batch, rows read) of the last batches of a finished query; Spark keeps 100."""
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress]
