"""Topic hierarchy: dual-period fine grain, level re-aggregation, rollup, fractional counts, evolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citewell.functions.scalars import ratio

PATH = ("domain", "field", "subfield", "topic")


def fine_grain(works: DataFrame, keys: Sequence[str], recent_from: int, recent_to: int | None = None, path: Sequence[str] = PATH) -> DataFrame:
    """Documents and impact by full topic path, over all years and the recent ones, in one pass."""
    recent = F.col("year") >= recent_from
    recent = recent if recent_to is None else recent & (F.col("year") <= recent_to)
    named = works.filter(F.col(path[0]).isNotNull() & (F.col(path[0]) != ""))
    fwci = F.coalesce("fwci", F.lit(0.0))
    return named.groupBy(*keys, *path).agg(
        F.count(F.lit(1)).alias("documents_full"),
        F.coalesce(F.avg(fwci), F.lit(0.0)).alias("fwci_full"),
        F.count_if(recent).alias("documents_recent"),
        F.coalesce(F.avg(F.when(recent, fwci)), F.lit(0.0)).alias("fwci_recent"),
    )


def levels(fine: DataFrame, keys: Sequence[str], path: Sequence[str] = PATH) -> DataFrame:
    """Document-weighted figures for every prefix of the path; deeper members are ``ALL``; ``level`` names the last real one.

    The input is already one row a path, so the expansion to levels multiplies a
    small table; works are read once.
    """
    sums = {s: (F.sum(f"documents_{s}"), F.sum(F.coalesce(F.col(f"fwci_{s}"), F.lit(0.0)) * F.col(f"documents_{s}"))) for s in ("full", "recent")}
    sets = [[F.col(c) for c in (*keys, *path[: i + 1])] for i in range(len(path))]
    out = fine.groupingSets(sets, *keys, *path).agg(
        F.grouping_id(*keys, *path).alias("g"),
        *[x.alias(f"{name}_{s}") for s, pair in sums.items() for x, name in zip(pair, ("documents", "weight"), strict=True)],
    )
    hidden = lambda i: F.col("g").bitwiseAND((1 << (len(path) - 1 - i))) != 0
    level = F.coalesce(*[F.when(hidden(i), F.lit(path[i - 1])) for i in range(1, len(path))], F.lit(path[-1]))
    return out.select(
        *keys,
        *[F.when(hidden(i), F.lit("ALL")).otherwise(F.col(c)).alias(c) for i, c in enumerate(path)],
        level.alias("level"),
        *[c for s in sums for c in (F.col(f"documents_{s}"), ratio(F.col(f"weight_{s}"), F.col(f"documents_{s}")).alias(f"fwci_{s}"))],
    )


def rollup_levels(works: DataFrame, keys: Sequence[str], path: Sequence[str] = PATH[:3]) -> DataFrame:
    """ROLLUP over the path inside ``keys`` with grand totals: level ``total`` and ``ALL`` members; named members only."""
    named = works
    for c in path:
        named = named.filter(F.col(c).isNotNull() & (F.col(c) != ""))
    sets = [[*keys, *path[:i]] for i in range(len(path) + 1)]
    out = named.groupingSets([[F.col(c) for c in s] for s in sets], *keys, *path).agg(F.grouping_id(*keys, *path).alias("g"), F.count(F.lit(1)).alias("num_documents"))
    hidden = lambda i: F.col("g").bitwiseAND(1 << (len(path) - 1 - i)) != 0
    level = F.coalesce(F.when(hidden(0), F.lit("total")), *[F.when(hidden(i), F.lit(path[i - 1])) for i in range(1, len(path))], F.lit(path[-1]))
    return out.select(*keys, *[F.when(hidden(i), F.lit("ALL")).otherwise(F.col(c)).alias(c) for i, c in enumerate(path)], level.alias("level"), "num_documents")


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """Each row's share of its group's total."""
    return df.withColumn(out, ratio(F.col(value), F.sum(value).over(W.partitionBy(*keys))))


def normalised_shares(df: DataFrame, keys: Sequence[str], share: str = "share", out: str = "share") -> DataFrame:
    """Shares that sum to 1 in each group; where they sum to nothing, equal parts."""
    w = W.partitionBy(*keys)
    x = F.coalesce(F.col(share), F.lit(0.0))
    total = F.sum(x).over(w)
    return df.withColumn(out, F.when(total <= 0, 1.0 / F.count(F.lit(1)).over(w)).otherwise(F.try_divide(x, total)))


def fractional(counts: DataFrame, shared: DataFrame, on: str, keys: Sequence[str], value: str = "num_documents") -> DataFrame:
    """Counts of entities spread over their topics by share."""
    return counts.join(shared, on).groupBy(*keys).agg(F.sum(F.col(value) * F.col("share")).alias("count"))


def evolution(works: DataFrame, keys: Sequence[str], first: int, last: int, path: Sequence[str] = PATH) -> DataFrame:
    """Documents by entity, year and topic path within an inclusive range of years."""
    used = works.filter(F.col("year").between(first, last) & F.col(path[0]).isNotNull())
    return used.groupBy(*keys, "year", *path).agg(F.count(F.lit(1)).alias("num_documents"))


def full_and_recent(works: DataFrame, keys: Sequence[str], recent_from: int) -> DataFrame:
    """The two-scan form: a full outer join of both periods' counts, zeros where one side lacks the key."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = count(works, "documents_full").join(count(works.filter(F.col("year") >= recent_from), "documents_recent"), list(keys), "full_outer")
    return both.na.fill(0, ["documents_full", "documents_recent"])
