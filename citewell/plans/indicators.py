"""The indicator suite: one list of aggregate columns for every level and grain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.functions.scalars import ratio
from citewell.schemas import require

#: Open-access states and the languages told apart.
STATUSES = ("gold", "green", "hybrid", "bronze", "diamond", "closed")
LANGUAGES = ("en", "es", "pt", "fr", "de", "it", "ru", "zh", "ja")


def _mean(x: Column, nulls: str) -> Column:
    return F.avg(F.coalesce(x, F.lit(0.0)) if nulls == "zero" else x)


def count_exprs(nulls: str = "zero", statuses: Sequence[str] = STATUSES, languages: Sequence[str] = LANGUAGES, only: Column | None = None) -> list[Column]:
    """Counts and means of works: all combine before the shuffle.

    ``nulls`` is ``zero`` (a missing impact counts as 0) or ``skip``; ``only``
    restricts every aggregate to the works it holds for.
    """
    when = (lambda p: p & only) if only is not None else (lambda p: p)
    value = (lambda x: F.when(only, x)) if only is not None else (lambda x: x)
    fwci = F.coalesce(F.col("fwci"), F.lit(0.0)) if nulls == "zero" else F.col("fwci")
    made = [
        F.count_if(when(F.lit(True))).alias("num_documents"),
        F.coalesce(F.sum(value(F.col("cited_by_count"))), F.lit(0)).alias("total_citations"),
        F.coalesce(F.avg(value(fwci)), F.lit(0.0)).alias("fwci_avg"),
        (100 * F.coalesce(F.avg(value(F.coalesce("percentile", F.lit(0.0)) if nulls == "zero" else F.col("percentile"))), F.lit(0.0))).alias("avg_percentile"),
        F.count_if(when(F.col("percentile") >= 0.90)).alias("top_10_count"),
        F.count_if(when(F.col("percentile") >= 0.99)).alias("top_1_count"),
        F.count_if(when(F.coalesce("is_oa", F.lit(False)))).alias("oa_total_count"),
    ]
    made += [F.count_if(when(F.coalesce(F.col("oa_status") == s, F.lit(False)))).alias(f"oa_{s}_count") for s in statuses]
    made += [F.count_if(when(F.coalesce(F.col("language") == x, F.lit(False)))).alias(f"lang_{x}_count") for x in languages]
    made.append(F.count_if(when(~F.coalesce(F.col("language").isin(*languages), F.lit(False)))).alias("lang_other_count"))
    return made


def shares(counts: DataFrame) -> DataFrame:
    """Each ``x_count`` column as ``pct_x``, a percentage of ``num_documents``, 0 where there are none."""
    keep = [F.col(c) for c in counts.columns if not c.endswith("_count")]
    made = [ratio(F.col(c), F.col("num_documents"), 100.0).alias(f"pct_{c.removesuffix('_count')}") for c in counts.columns if c.endswith("_count")]
    return counts.select(*keep, *made)


def indicator_cube(works: DataFrame, keys: Sequence[str], nulls: str = "zero", statuses: Sequence[str] = STATUSES, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """The suite for each combination of ``keys``; rows with a null key are left out.  One shuffle, of partial sums."""
    require(works, *keys, "cited_by_count", "fwci", "percentile", "is_oa", "oa_status", "language")
    used = works.dropna(subset=list(keys)) if keys else works
    return shares(used.groupBy(*keys).agg(*count_exprs(nulls, statuses, languages)))


def grouped_cubes(works: DataFrame, sets: Sequence[Sequence[str]], nulls: str = "zero", statuses: Sequence[str] = STATUSES, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """The suite for several sets of keys in one pass over the works."""
    require(works, "cited_by_count", "fwci", "percentile", "is_oa", "oa_status", "language")
    return shares(grouped_sets(works, sets, count_exprs(nulls, statuses, languages)))


def grouped_sets(works: DataFrame, sets: Sequence[Sequence[str]], counts: Sequence[Column]) -> DataFrame:
    """Aggregates for several sets of keys: ``grouping`` is the number of the set, keys outside it are null.

    Rows with a null key of their set are left out of that set only; rows are read, and partial sums shuffled, once.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    require(works, *keys)
    if not keys:
        return works.agg(*counts).filter("num_documents > 0").withColumn("grouping", F.lit(0))
    # a key outside a set has its bit in the grouping id, the first key the highest
    bits = [sum(1 << i for i, k in enumerate(reversed(keys)) if k not in s) for s in sets]
    made = works.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id(*keys).alias("_g"), *counts)
    number = F.coalesce(*[F.when(F.col("_g") == b, i) for i, b in enumerate(bits)])
    whole = F.coalesce(*[F.when(F.col("_g") == b, reduce(Column.__and__, [F.col(k).isNotNull() for k in s], F.lit(True))) for b, s in zip(bits, sets, strict=True)])
    return made.filter(whole).withColumn("grouping", number).drop("_g")


def mean_of_ratios(cube: DataFrame, keys: Sequence[str], skip: Sequence[str] = (), distinct: str | None = None) -> DataFrame:
    """Unweighted means of a finer cube's figures, with summed documents; ``distinct`` counts an entity exactly."""
    summed = [c for c in ("num_documents", "total_citations") if c in cube.columns]
    means = [c for c in cube.columns if c not in {*keys, *skip, *summed, distinct}]
    more = [F.count_distinct(distinct).alias(f"num_{distinct.removesuffix('_id')}s")] if distinct else []
    return cube.dropna(subset=list(keys)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in summed], *[F.avg(c).alias(c) for c in means], *more)


def weighted(cube: DataFrame, keys: Sequence[str], columns: Sequence[str], weight: str = "num_documents", digits: int | None = None) -> DataFrame:
    """Document-weighted means: sum(x * n) / sum(n), nulls as 0, 0 where n sums to none."""
    total = F.sum(weight)
    made = [ratio(F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col(weight)), total) for c in columns]
    return cube.groupBy(*keys).agg(total.alias(weight), *[(F.round(x, digits) if digits is not None else x).alias(c) for x, c in zip(made, columns, strict=True)])


def coverage(journals: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Percentage of journals with each flag; a missing flag is false."""
    return journals.groupBy(*keys).agg(*[(100 * F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double"))).alias(f"pct_{f.removeprefix('is_')}") for f in flags])


def percentile_scale(df: DataFrame, column: str = "percentile", keys: Sequence[str] = ()) -> DataFrame:
    """Shares at the 90 % mark on the scale the values show: above 1 anywhere in the group means 0 to 100."""
    x = F.col(column)
    both = df.groupBy(*keys).agg(F.max(x).alias("top"), F.count_if(x >= 0.9).alias("low"), F.count_if(x >= 90).alias("high"), F.count(F.lit(1)).alias("n"))
    big = F.coalesce(F.col("top") > 1.0, F.lit(False))
    return both.select(*keys, F.when(big, 100).otherwise(1).alias("scale"), ratio(F.when(big, F.col("high")).otherwise(F.col("low")), F.col("n"), 100.0).alias("pct_top_10"))
