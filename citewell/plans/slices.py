"""What dashboards ask of the cubes: key figures, statistics, tables and searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.functions.scalars import ratio
from citewell.operators.frames import contains_text
from citewell.operators.quantiles import exact_quantiles


def key_figures(journals: DataFrame) -> DataFrame:
    """Journals, articles, citations, open-access percentage and mean impact, as one row."""
    return journals.agg(
        F.count(F.lit(1)).alias("total_journals"),
        F.coalesce(F.sum("works_count"), F.lit(0)).alias("total_articles"),
        F.coalesce(F.sum("cited_by_count"), F.lit(0)).alias("total_citations"),
        ratio(F.count_if("is_oa"), F.count(F.lit(1)), 100.0).alias("percent_oa"),
        F.avg("citedness").alias("avg_impact"),
    )


def country_figures(journals: DataFrame) -> DataFrame:
    return journals.dropna(subset=["country_code"]).groupBy("country_code").agg(
        F.count(F.lit(1)).alias("num_journals"),
        F.coalesce(F.sum("works_count"), F.lit(0)).alias("works_count"),
        F.coalesce(F.sum("cited_by_count"), F.lit(0)).alias("cited_by_count"),
        F.avg("citedness").alias("avg_impact_factor"),
        ratio(F.count_if("is_oa"), F.count(F.lit(1)), 100.0).alias("percent_oa"),
    )


def statistics(df: DataFrame, column: str) -> DataFrame:
    """Mean, exact median, sample deviation and range."""
    x, half = F.col(column), exact_quantiles(df, column, [0.5])
    made = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return made.join(F.broadcast(half)).select("n", "mean", F.col("quantiles")[0].alias("median"), "std", "min", "max")


def summary(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, quartiles with interpolation, and range."""
    x, quartiles = F.col(column), exact_quantiles(df, column, [0.25, 0.5, 0.75])
    made = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return made.join(F.broadcast(quartiles)).select("n", "mean", "std", "min", *[F.col("quantiles")[i].alias(f"q{i + 1}") for i in range(3)], "max")


def summary_by(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """The summary of each group that has values."""
    x, quartiles = F.col(column), exact_quantiles(df, column, [0.25, 0.5, 0.75], by)
    made = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    same = [made[c].eqNullSafe(quartiles[c]) for c in by]
    return made.join(quartiles, same).select(*[made[c] for c in by], "n", "mean", "std", "min", *[F.col("quantiles")[i].alias(f"q{i + 1}") for i in range(3)], "max")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"))


def find_source(sources: DataFrame, name: str | None = None, issn: str | None = None, source_id: str | None = None) -> DataFrame:
    """Sources by part of the name, ISSN or id; any that is given may match."""
    tests = [contains_text(F.col("display_name"), name)] if name else []
    tests += [F.coalesce(F.col("issn_l") == issn, F.lit(False))] if issn else []
    tests += [F.col("id") == source_id] if source_id else []
    any_of = F.lit(False)
    for t in tests:
        any_of = any_of | t
    return sources.filter(any_of)


def open_access_and_impact(journals: DataFrame) -> DataFrame:
    return journals.select("id", "citedness", "works_count", F.when(F.col("is_oa"), "Open Access").otherwise("Closed").alias("access"))
