"""Data-quality operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.functions.scalars import ratio


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def count_gap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows per key on both sides, and how many the second lacks."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = count(a, "n_a").join(count(b, "n_b"), key, "full_outer").na.fill(0, ["n_a", "n_b"])
    return both.withColumn("missing", F.greatest(F.col("n_a") - F.col("n_b"), F.lit(0)))


def lacking_ids(a: DataFrame, b: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The first ``k`` keys of a that b lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti").orderBy(key).limit(k)


def differing(actual: DataFrame, expected: DataFrame, key: str, columns: Sequence[str], tolerance: float = 0.001) -> DataFrame:
    """``key, column, actual, expected`` where figures differ by more than the tolerance or one is missing."""
    long = lambda df, name: df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], list(columns), "column", name)
    both = long(actual, "actual").join(long(expected, "expected"), [key, "column"], "full_outer")
    return both.filter(~F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= tolerance, F.col("actual").isNull() & F.col("expected").isNull()))


def declared_gap(declared: DataFrame, rows: DataFrame, key: str, column: str) -> DataFrame:
    """Declared counts against counted rows."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("counted"))
    return declared.select(key, column).join(counted, key, "left").withColumn("counted", F.coalesce("counted", F.lit(0))).withColumn("gap", F.col(column) - F.col("counted"))


def zero_share(df: DataFrame, column: str) -> DataFrame:
    """Percentage of rows where a figure is zero."""
    return df.agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(F.col(column) == 0), F.count(F.lit(1)), 100.0).alias("pct_zero"))
