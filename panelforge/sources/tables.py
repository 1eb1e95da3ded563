"""Declared-schema readers, and writers without an index column."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelforge.functions.codebook import SURVEY_KEPT, SURVEY_NAMES
from panelforge.operators.columns import lower_header


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def survey_schema() -> T.StructType:
    codes = [T.StructField(c, T.DoubleType()) for c in [*SURVEY_NAMES, *SURVEY_KEPT]]
    return T.StructType([T.StructField("respondent_id", T.LongType()), *codes])


def read_survey(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """The coded survey. The input is the exported table with a respondent key.

    Parquet columns are matched by name. A CSV file is read as text and picked by
    its header, because a declared CSV schema goes by position.
    """
    if file_format == "csv":
        raw = lower_header(spark.read.options(**QUOTING).option("header", True).option("nullValue", "NA").csv(path))
        return raw.select(
            *[F.nullif(F.col(f.name), F.lit("")).cast(f.dataType).alias(f.name) for f in survey_schema()]
        )
    wanted = survey_schema().fieldNames()
    return lower_header(spark.read.format(file_format).load(path)).select(*wanted)


#: A quoted field may hold separators, line breaks, backslashes and doubled quotes.
QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = True) -> DataFrame:
    """CSV with a header, where `NA` and empty fields are both missing.

    A file with line breaks inside texts cannot be split, so its size bounds a task's
    input; `write_csv` writes one file for each partition. Without `line_breaks` a file
    is split by lines and read by many tasks.
    """
    df = spark.read.schema(schema).options(**QUOTING).option("header", True).option("nullValue", "NA").option(
        "enforceSchema", False
    ).csv(path, multiLine=line_breaks)
    texts = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**QUOTING).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_keys(df: DataFrame, column: str, path: str) -> None:
    """Write the distinct values of a column as a dimension table."""
    df.select(column).distinct().write.mode("overwrite").parquet(path)


def load_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
