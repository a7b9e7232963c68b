"""Window operators over year series, and choosing one row per key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def smoothed(df: DataFrame, entity: Sequence[str], columns: Sequence[str], window: int = 3, tau: float = 1.0, order: str = "year") -> DataFrame:
    """Centred exponential moving average: weights exp(-|k| / tau) over the neighbours that have a value."""
    w = W.partitionBy(*entity).orderBy(order)
    half = window // 2

    def one(c: str) -> Column:
        total, weight = F.lit(0.0), F.lit(0.0)
        for k in range(-half, half + 1):
            near = F.col(c) if not k else F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
            share = math.exp(-abs(k) / tau)
            total = total + F.coalesce(near.cast("double") * share, F.lit(0.0))
            weight = weight + F.when(near.isNotNull(), share).otherwise(0.0)
        return F.try_divide(total, weight)

    return df.select(*[one(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def centred_mean(df: DataFrame, entity: Sequence[str], columns: Sequence[str], window: int = 3, order: str = "year") -> DataFrame:
    w = W.partitionBy(*entity).orderBy(order).rowsBetween(-(window // 2), window // 2)
    return df.select(*[F.avg(c).over(w).alias(c) if c in columns else F.col(c) for c in df.columns])


def trailing_mean(df: DataFrame, entity: Sequence[str], columns: Sequence[str], window: int = 3, order: str = "year") -> DataFrame:
    w = W.partitionBy(*entity).orderBy(order).rowsBetween(-(window - 1), 0)
    return df.select(*[F.avg(c).over(w).alias(c) if c in columns else F.col(c) for c in df.columns])


def max_normalised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each figure over its column's largest, 0 where that isn't positive.

    The maxima are one row, so the join to them is a broadcast of fixed size and
    no global window gathers the table in one task.
    """
    top = df.agg(*[F.max(c).alias(f"_{c}") for c in columns])
    scaled = lambda c: F.when(F.col(f"_{c}") > 0, F.col(c) / F.col(f"_{c}")).otherwise(0.0).alias(c)
    return df.join(F.broadcast(top)).select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order; the rank limit cuts rows before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest(df: DataFrame, keys: Sequence[str], order: str = "year") -> DataFrame:
    """The row with the largest ``order`` of each key, a null one only where there is no other, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    # a struct is never null, and its nulls come first
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_writer(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last writer wins: as a merge tree keeps one row per key."""
    return latest(df, [key], order)
