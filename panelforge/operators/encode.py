"""Label, ordinal and one-hot encoding, and scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.functions.keyed import named
from panelforge.operators.ranks import in_order

# Columns with at most this many values are encoded by an in-plan array.
MAX_LEVELS = 1000
# Columns whose moments one job works out.
MOMENT_COLUMNS = 16
# Types whose values have a literal; columns of other types always get an index table.
LITERAL_TYPES = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "double")


def levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted distinct values of the columns that have at most MAX_LEVELS of them.

    The first job counts, the second collects, so what reaches the driver is
    bounded by MAX_LEVELS values per column, give or take the error of the count.
    """
    if not columns:
        return {}
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    plain = {f.name for f in df.schema if f.dataType.simpleString() in LITERAL_TYPES}
    small = [c for c in columns if counts[c] <= MAX_LEVELS and c in plain]
    if not small:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in small]).first()
    return {c: list(row[c]) for c in small}


def sql_literal(value) -> str:
    """A value as SQL text. One parsed text builds faster than a literal per call."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, (bool, int)):
        return str(value)
    raise TypeError(f"no literal for {type(value).__name__}")


class LabelCodes:
    """Position of each value in the sorted distinct values, counted from zero.

    Columns with few values use an array literal inside the plan. The others get
    an index table that is joined on the value.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.columns = list(columns)
        self.small, self.tables = {}, {}
        self.refresh(df, self.columns)

    def refresh(self, df: DataFrame, columns: Sequence[str]) -> None:
        """Look at the values of some columns again, after they have changed."""
        self.small.update(levels(df, columns))
        for c in columns:
            if c not in self.small:
                values = df.select(F.col(c).alias("value")).where("value is not null").distinct()
                self.tables[c] = in_order(values, "value", out="code")

    def _array(self, column: str) -> str:
        return f"array({', '.join(map(sql_literal, self.small[column]))})"

    def encode(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Add `<column><suffix>` as double; null stays null."""
        for c in self.tables:
            table = self.tables[c].select(F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"__c_{c}"))
            df = df.join(table, F.col(c) == F.col(f"__v_{c}"), "left").drop(f"__v_{c}")
        coded = {}
        for c in self.columns:
            if c in self.tables:
                code = F.col(f"__c_{c}")
            elif self.small[c]:
                code = F.expr(f"array_position({self._array(c)}, `{c}`) - 1")
            else:
                code = F.lit(None)
            coded[f"{c}{suffix}"] = code.cast("double")
        return df.withColumns(coded).drop(*[f"__c_{c}" for c in self.tables])

    def code_of(self, column: str, value) -> float:
        """Code of one value; an unknown value is an error."""
        if column in self.small:
            if value not in self.small[column]:
                raise ValueError(f"{value!r} does not occur in {column}")
            return float(self.small[column].index(value))
        found = self.tables[column].where(F.col("value") == F.lit(value)).select("code").first()
        if found is None:
            raise ValueError(f"{value!r} does not occur in {column}")
        return float(found["code"])

    def decode(self, df: DataFrame, column: str, code: str, out: str) -> DataFrame:
        """Add the value that belongs to a code column."""
        if column in self.small:
            return df.withColumn(out, F.expr(f"get({self._array(column)}, int(`{code}`))"))
        table = self.tables[column].select(F.col("value").alias(out), F.col("code").alias("__code"))
        return df.join(table, F.col(code).cast("long") == F.col("__code"), "left").drop("__code")


def one_hot(column: str, values: Sequence, drop_first: bool = True) -> dict[str, Column]:
    """Indicator columns `column_value` in sorted order, the first value left out."""
    kept = sorted(values)[1:] if drop_first else sorted(values)
    return {f"{column}_{v}": (F.col(column).eqNullSafe(F.lit(v))).cast("double") for v in kept}


def require_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted distinct values of every column, however many: each is to become a column."""
    found = levels(df, columns)
    for c in columns:
        if c not in found:
            values = df.select(F.col(c).alias("value")).where("value is not null").distinct()
            found[c] = sorted(r["value"] for r in values.collect())
    return found


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, from one aggregate row for every few columns.

    Spark generates no code for plans of more than 100 fields, and a column has five here.
    """
    found = {}
    for start in range(0, len(columns), MOMENT_COLUMNS):
        some = columns[start : start + MOMENT_COLUMNS]
        aggregates = []
        for i, c in enumerate(some):
            aggregates += [F.avg(named(c)).alias(f"m{i}"), F.stddev_pop(named(c)).alias(f"s{i}")]
        row = df.agg(*aggregates).first()
        found.update({c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(some)})
    return found


def standardised(column: str, mean: float, deviation: float) -> Column:
    """(x - mean) / deviation; a constant column is only centred."""
    return (named(column) - F.lit(float(mean))) / F.lit(float(deviation) or 1.0)


def scaled(df: DataFrame, columns: Sequence[str], fitted: Mapping | None = None) -> DataFrame:
    fitted = fitted or moments(df, columns)
    return df.withColumns({c: standardised(c, *fitted[c]) for c in columns})


def varied_columns(df: DataFrame, columns: Sequence[str], threshold: float) -> list[str]:
    """Columns whose population variance is above the threshold."""
    row = df.agg(*[F.var_pop(named(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > threshold]
