"""User functions as pipeline stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Transformer
from pyspark.sql import DataFrame


class TableFunction(Transformer):
    """A DataFrame -> DataFrame function as a stage.

    For a stage that has to be stored, use Spark's SQLTransformer instead.
    """

    def __init__(self, function: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.function = function

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.function(dataset)
