"""A design matrix of sparse vectors, for categories of any number of levels.

A category's levels are a table (value, code) that rows are joined with; neither the driver
nor the plan holds them. The first level in sorted order has no place of its own, as in the
dense design, and values that were not fitted on have none either.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from panelforge.functions.keyed import named
from panelforge.operators.encode import moments, standardised
from panelforge.operators.ranks import in_order
from panelforge.session import cut, scratch_path

#: Level tables up to this size are sent to every task; larger ones are joined by value.
SENT_LEVELS = 100_000


@dataclass(frozen=True)
class SparseDesign:
    """Fitted scaling and level tables. The vector has the numeric features first."""

    numeric: dict[str, tuple[float, float]]
    tables: dict[str, DataFrame]
    sizes: Mapping[str, int]

    @property
    def encoded(self) -> list[str]:
        """Categories with more than one level; the others would be constant."""
        return [c for c in self.tables if self.sizes[c] > 1]

    def width(self) -> int:
        return len(self.numeric) + sum(self.sizes[c] - 1 for c in self.encoded)

    def apply(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns `keep` and the sparse vector `features` of every row, as a written table.

        A vector is written as its parts and read as a vector: encoders and assemblers
        would name every place in the column's metadata, which the driver holds.
        """
        scaled = [standardised(c, *self.numeric[c]).alias(f"__n{i}") for i, c in enumerate(self.numeric)]
        rows = df.select(*[named(c) for c in keep], *scaled, *[named(c).alias(f"__v{i}") for i, c in enumerate(self.encoded)])
        missing = F.raise_error(F.lit("a numeric feature is null or NaN"))
        places = []
        for i in range(len(self.numeric)):
            x = F.col(f"__n{i}")
            places.append(F.struct(F.lit(i).alias("position"), F.when(x.isNull() | F.isnan(x), missing.cast("double")).otherwise(x).alias("value")))
        start = len(self.numeric)
        for i, c in enumerate(self.encoded):
            table = self.tables[c].select(F.col("value").alias(f"__t{i}"), F.col("code").alias(f"__c{i}"))
            table = F.broadcast(table) if self.sizes[c] <= SENT_LEVELS else table
            rows = rows.join(table, F.col(f"__v{i}") == F.col(f"__t{i}"), "left").drop(f"__t{i}")
            # the first level and unknown values have no place
            known = F.when(F.col(f"__c{i}") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
            places.append(F.struct((F.coalesce(F.col(f"__c{i}"), F.lit(0)) - 1 + start).cast("int").alias("position"), known.alias("value")))
            start += self.sizes[c] - 1
        used = F.filter(F.array(*places), lambda p: p["value"] != 0.0) if places else F.expr("cast(array() as array<struct<position int, value double>>)")
        parts = F.struct(
            F.lit(0).cast("byte").alias("type"), F.lit(self.width()).alias("size"),
            F.transform("__used", lambda p: p["position"]).alias("indices"), F.transform("__used", lambda p: p["value"]).alias("values"),
        )
        made = rows.withColumn("__used", used).select(*[named(c) for c in keep], parts.alias("features"))
        path = scratch_path(df.sparkSession, "vectors")
        made.write.parquet(path)
        fields = [*made.schema.fields[:-1], T.StructField("features", VectorUDT())]
        return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)

    def names(self, spark) -> DataFrame:
        """(position, name) of the vector's places."""
        parts = [spark.createDataFrame(list(enumerate(self.numeric)), "position long, name string")]
        start = len(self.numeric)
        for c in self.encoded:
            label = F.concat(F.lit(f"{c}_"), F.col("value").cast("string"))
            parts.append(self.tables[c].where("code > 0").select((F.col("code") - 1 + start).cast("long").alias("position"), label.alias("name")))
            start += self.sizes[c] - 1
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def fit_sparse(rows: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> SparseDesign:
    """Means and deviations of the numeric features, and a written table of each category's levels."""
    tables = {}
    for c in categorical:
        values = rows.select(named(c).alias("value")).where("value is not null").distinct()
        tables[c] = cut(in_order(values, "value", out="code"))
    return SparseDesign(moments(rows, numeric) if numeric else {}, tables, {c: t.count() for c, t in tables.items()})


def nonzero(features: str = "features"):
    """(position, value) of a sparse vector's places, as an array; dense vectors give all places."""
    plain = F.unwrap_udt(F.col(features))
    positions = F.coalesce(plain["indices"], F.transform(plain["values"], lambda _, i: i.cast("int")))
    return F.arrays_zip(positions.alias("position"), plain["values"].alias("value"))
