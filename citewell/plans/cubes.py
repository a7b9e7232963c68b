"""Annual, period and recent cubes at every level, dense or sparse, full or incremental."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.functions.scalars import period_label
from citewell.plans.indicators import grouped_cubes, indicator_cube

#: The key of each level's entities; the world is one entity, ``ALL``.
LEVELS = {"world": None, "country": "country_code", "journal": "journal_id"}


def annual(works: DataFrame, entity: Sequence[str], since: int | None = None, **suite) -> DataFrame:
    """Entity by year, only years with works."""
    used = works if since is None else works.filter(F.col("year") >= since)
    return indicator_cube(used, [*entity, "year"], **suite)


def dense(cube: DataFrame, entity: Sequence[str], first: int, last: int) -> DataFrame:
    """Every entity in every year of the range: zeros where it has no works, language shares null there."""
    grid = cube.select(*entity).distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    figures = [c for c in cube.columns if c not in {*entity, "year"}]
    filled = [F.col(c) if c.startswith("pct_lang_") else F.coalesce(F.col(c), F.lit(0).cast(cube.schema[c].dataType)).alias(c) for c in figures]
    return grid.join(cube, [*entity, "year"], "left").select(*entity, "year", *filled)


def period(works: DataFrame, entity: Sequence[str], first: int, last: int, **suite) -> DataFrame:
    """One row an entity over an inclusive range of years, labelled with it."""
    used = works.filter(F.col("year").between(first, last))
    return indicator_cube(used, entity, **suite).withColumn("period", period_label(first, last))


def year_range(works: DataFrame, low: int | None = None, high: int | None = None) -> tuple[int, int]:
    """Exact first and last year, cut to the bounds given."""
    got = works.agg(F.min("year").alias("a"), F.max("year").alias("b")).first()
    return max(got.a, low) if low is not None else got.a, min(got.b, high) if high is not None else got.b


def pending(works: DataFrame, done: DataFrame, entity: str) -> DataFrame:
    """Works of entities that a cube has no row for yet."""
    return works.join(done.select(entity).distinct(), entity, "left_anti")


def refreshed(cube: DataFrame, works: DataFrame, entity: str, build, force: bool = False) -> DataFrame:
    """``cube`` with the rows of entities it lacks, or built anew."""
    if force:
        return build(works)
    return cube.unionByName(build(pending(works, cube, entity)))


def level_cubes(works: DataFrame, levels: Sequence[str], years: tuple[int, int], recent: tuple[int, int], grouped=grouped_cubes, **suite) -> DataFrame:
    """Annual, period and recent figures of every entity of the levels: ``level, kind, entity, year, period`` and the suite.

    Two passes over the works, one for annual and period figures of all levels and one for the recent period;
    ``grouped`` makes the figures of several sets of keys.
    """
    keys = {x: [LEVELS[x]] if LEVELS[x] else [] for x in levels}

    def one_pass(span: tuple[int, int], kinds: dict[str, list[str]]) -> DataFrame:
        sets = [(x, kind, [*keys[x], *more]) for x in levels for kind, more in kinds.items()]
        cube = grouped(works.filter(F.col("year").between(*span)), [s for _, _, s in sets], **suite)
        named = lambda at: F.element_at(F.array(*[F.lit(s[at]) for s in sets]), F.col("grouping") + 1)
        there = [k for x in levels for k in keys[x]]
        year = F.col("year").cast("int") if "year" in cube.columns else F.lit(None).cast("int")
        return cube.select(
            named(0).alias("level"), named(1).alias("kind"), F.coalesce(*[F.col(k).cast("string") for k in there], F.lit("ALL")).alias("entity"), year.alias("year"),
            F.when(named(1) != "annual", period_label(*span)).alias("period"), *[c for c in cube.columns if c not in {*there, "year", "grouping"}],
        )

    return one_pass(years, {"annual": ["year"], "period": []}).unionByName(one_pass(recent, {"recent": []}))


def build_cubes(works: DataFrame, path: str, recent: tuple[int, int], levels: Sequence[str] = tuple(LEVELS), years: tuple[int, int] | None = None, incremental: bool = False, **suite) -> DataFrame:
    """All cubes of the levels as one table at ``path``, partitioned by level and kind; gives the table.

    ``incremental`` appends the entities that the table has no row for and leaves
    the others as they are, changed or not; a missing table is built in full.
    ``years`` is the whole range of the works by default.
    """
    spark = works.sparkSession
    years = years or year_range(works)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if incremental and folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        done = spark.read.parquet(path).select("level", "entity").distinct()
        parts = []
        for level in levels:
            entity = F.col(LEVELS[level]).cast("string") if LEVELS[level] else F.lit("ALL")
            left = works.withColumn("_entity", entity).join(done.filter(F.col("level") == level).select(F.col("entity").alias("_entity")), "_entity", "left_anti").drop("_entity")
            parts.append(level_cubes(left, [level], years, recent, **suite))
        made, mode = reduce(DataFrame.unionByName, parts), "append"
    else:
        made, mode = level_cubes(works, levels, years, recent, **suite), "overwrite"
    made.write.mode(mode).partitionBy("level", "kind").parquet(path)
    return spark.read.parquet(path)


def save_cube(cube: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, sorted by the keys that slices filter on, so that row groups can be skipped."""
    (cube.sortWithinPartitions(*by) if by else cube).write.mode(mode).parquet(path)


def load_cube(spark, path: str) -> DataFrame:
    """A saved cube; a missing one is an error."""
    return spark.read.parquet(path)
