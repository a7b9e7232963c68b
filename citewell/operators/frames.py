"""Joins, filters, set operations, reshaping and top-k with the engine's null rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewell.operators.ranks import numbered


def any_nonzero(columns: Sequence[str]) -> Column:
    """Whether any of the columns is neither null nor zero."""
    return reduce(Column.__or__, [F.coalesce(F.col(c), F.lit(0)) != 0 for c in columns])


def contains_text(text: Column, part: str) -> Column:
    """Case-insensitive literal search; null never matches."""
    return F.coalesce(F.contains(F.lower(text), F.lit(part.lower())), F.lit(False))


def last_years(df: DataFrame, span: int, column: str = "year") -> DataFrame:
    """Rows of the last ``span`` years up to the latest one; the bound is a scalar subquery."""
    return df.filter(F.col(column) >= df.agg((F.max(column) - span).alias("y")).scalar())


def latest_year(df: DataFrame, column: str = "year") -> DataFrame:
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())


def at_source(works: DataFrame, source_id: str) -> DataFrame:
    """Works whose primary location, or without one any location, is the source."""
    primary = F.col("primary_location.source.id")
    return works.filter(F.coalesce(primary == source_id, F.exists("locations", lambda x: x["source"]["id"] == source_id), F.lit(False)))


def without(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done``."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Outer schema: a column that one side lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def in_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``: what lacks is null, what is more goes."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Adds the columns that lack, and fills nulls of those there are."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def without_suffix(df: DataFrame, suffix: str = "_count") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def with_suffix(df: DataFrame, columns: Sequence[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in columns})


def with_total_row(df: DataFrame, label: str, columns: Sequence[str], text: str = "Total") -> DataFrame:
    """A last row with the sums, labelled ``text``."""
    return df.unionByName(df.agg(*[F.sum(c).alias(c) for c in columns]).select(F.lit(text).alias(label), *columns))


def pivot_sum(df: DataFrame, rows: str, columns: str, values: Sequence, amount: str, total: str | None = "Total") -> DataFrame:
    """A matrix of sums, nulls as 0.  ``values`` names the columns, so no job looks for them."""
    made = df.groupBy(rows).pivot(columns, list(values)).agg(F.sum(amount)).na.fill(0)
    return made.withColumn(total, reduce(Column.__add__, [F.col(f"`{v}`") for v in values])) if total else made


def top_members(df: DataFrame, member: str, amount: str, k: int) -> DataFrame:
    """The ``k`` members with the largest totals, ties by name."""
    return df.groupBy(member).agg(F.sum(amount).alias(amount)).orderBy(F.desc(amount), member).limit(k)


def pivot_top(df: DataFrame, rows: str, member: str, amount: str, k: int) -> DataFrame:
    """A matrix over the ``k`` largest members only; their names are the one thing the driver learns."""
    names = [r[0] for r in top_members(df, member, amount, k).collect()]
    return pivot_sum(df.filter(F.col(member).isin(names)), rows, member, names, amount, total=None)


def sample_rows(df: DataFrame, n: int, by: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, the same on every run and partitioning where ``by`` is a key: those with the smallest seeded MD5."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by])), *by).limit(n)


def pinned_last(df: DataFrame, column: str, value) -> DataFrame:
    return df.orderBy(F.when(F.col(column) == value, 1).otherwise(0), column)


def melted(df: DataFrame, ids: Sequence[str], prefix: str, name: str = "label", value: str = "pct") -> DataFrame:
    """Columns with a prefix as rows, the prefix off and capitalised, zero rows left out."""
    wide = [c for c in df.columns if c.startswith(prefix)]
    long = df.unpivot(list(ids), wide, name, value)
    return long.withColumn(name, F.initcap(F.regexp_replace(name, f"^{prefix}", ""))).filter(F.coalesce(F.col(value), F.lit(0)) != 0)


def nested(df: DataFrame, key: str, columns: Sequence[str], out: str = "items") -> DataFrame:
    """The rows of each key as one JSON array, ordered by the columns.

    A key's array is one task's: for keys of more rows than a task can hold take ``nested_parts``.
    """
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias(out))


def nested_parts(df: DataFrame, key: str, columns: Sequence[str], each: int = 10_000, out: str = "items") -> DataFrame:
    """The rows of each key as JSON arrays of at most ``each`` items: ``key, part, out``, parts numbered from 0 in the order of the columns.

    Places come from a sort by range, so a key with most of the rows makes many parts, not a long task.
    """
    rows = numbered(df.select(F.col(key).alias("_key"), *columns), ["_key", *columns], "_at")
    firsts = rows.groupBy(F.col("_key").alias("_of")).agg(F.min("_at").alias("_first"))
    placed = rows.join(firsts, rows["_key"].eqNullSafe(firsts["_of"])).withColumn("part", F.floor((F.col("_at") - F.col("_first")) / each).cast("int"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.struct(*columns).alias("x")))), lambda i: i["x"])
    return placed.groupBy(F.col("_key").alias(key), "part").agg(F.to_json(items).alias(out))


def updated(df: DataFrame, news: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with the columns' new values where ``news`` has any; one row of ``news`` a key."""
    fresh = news.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(fresh, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def flagged(df: DataFrame, dim: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """``df`` with boolean flags by key, false where the key or the flag is missing."""
    return df.drop(*flags).join(dim.select(key, *flags), key, "left").withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
