"""Table functions for SQL: rows of nested arrays with columns from the array's own type, and the first rows of each partition of a table.

Both take their columns from their arguments when a query is analysed, and exchange rows in pickled batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType


def _plain(value):
    """Rows and dictionaries of a nested value as tuples and lists, as output columns take them."""
    if isinstance(value, Row):
        return tuple(value)
    return value


class NestedRows:
    """``nested_rows(array, most)``: ``position`` from 0 and the fields of each of the first ``most`` structs of an array, all without ``most``; a null array has no rows, a null struct a row of nulls."""

    def __init__(self, analysed: AnalyzeResult | None = None):
        self.fields = [f.name for f in analysed.schema.fields[1:]] if analysed else []

    @staticmethod
    def analyze(array: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        kind = array.dataType
        if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, StructType):
            raise ValueError(f"nested_rows takes an array of structs, not {kind.simpleString()}")
        return AnalyzeResult(StructType([StructField("position", IntegerType()), *kind.elementType.fields]))

    def eval(self, array, most: int | None = None) -> Iterator[tuple]:
        for i, x in enumerate([] if array is None else list(array)[:most]):
            get = (lambda c: None) if x is None else x.get if isinstance(x, dict) else x.__getitem__  # noqa: B023
            yield (i, *(_plain(get(c)) for c in self.fields))


class FirstRows:
    """``first_rows(TABLE(t), n, by, on)``: the first ``n`` rows of each value of column ``by`` in the order of column ``on``, with their ``place`` from 1."""

    def __init__(self, analysed: AnalyzeResult | None = None):
        self.names = [f.name for f in analysed.schema.fields[:-1]] if analysed else []
        self.n = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, n: AnalyzeArgument, by: AnalyzeArgument, on: AnalyzeArgument) -> AnalyzeResult:
        names = table.dataType.names
        for c in (by.value, on.value):
            if c not in names:
                raise ValueError(f"first_rows: no column {c} among {', '.join(names)}")
        return AnalyzeResult(StructType([*table.dataType.fields, StructField("place", IntegerType())]), partitionBy=[PartitioningColumn(f"`{by.value}`")], orderBy=[OrderingColumn(f"`{on.value}`")])

    def eval(self, row: Row, n: int, by: str, on: str) -> Iterator[tuple]:
        self.n += 1
        if self.n <= n:
            yield (*(_plain(row[c]) for c in self.names), self.n)


def register(spark: SparkSession) -> None:
    """``nested_rows`` and ``first_rows`` for the session's SQL."""
    for name, made in (("nested_rows", NestedRows), ("first_rows", FirstRows)):
        spark.udtf.register(name, udtf(made, useArrow=False))  # with Arrow each call's few rows would be a data frame and a batch of their own
