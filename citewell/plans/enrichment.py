"""What a REST catalogue adds to the tables: topics of sources, sources by name, and their recent works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.functions.scalars import last_segment
from citewell.plans.normalise import parsed, source_topics
from citewell.schemas import SOURCE_JSON
from citewell.sources.rest import fetch_each, read_rest


def topics_of(sources: DataFrame, url: str, done: DataFrame | None = None, id_col: str = "id", **options) -> DataFrame:
    """Topic rows of the sources, by one request each to ``url/<last segment of the id>``; those in ``done`` (``journal_id``) are not asked for again.

    ``journal_id`` is the id as the table has it.  A source without topics gives no
    row and is asked for again next time.  Write the result before using it
    twice: each reading asks the server.
    """
    ids = sources.select(F.col(id_col).alias("journal_id")).filter("journal_id IS NOT NULL").distinct()
    if done is not None:
        ids = ids.join(done.select("journal_id").distinct(), "journal_id", "left_anti")
    ids = ids.withColumn("key", last_segment(F.col("journal_id")))
    # the document may name the source otherwise, so rows go back to their ids by what was asked for
    got = fetch_each(ids, "key", url.rstrip("/") + "/{key}", **options)
    documents = got.select("key", F.from_json("raw_data", SOURCE_JSON).alias("d")).select(F.col("key").alias("id"), "d.display_name", "d.topics")
    return ids.join(source_topics(documents).withColumnRenamed("journal_id", "key"), "key").drop("key")


def first_hits(spark: SparkSession, url: str, names: list[str], **options) -> DataFrame:
    """``key, raw_data``: the first source that a search for each name or ISSN finds; none gives no row."""
    return read_rest(spark, url, names, search="{key}", most_rows=1, per_page=1, **options)


def works_of(spark: SparkSession, url: str, source_ids: list[str], first: int = 2021, last: int = 2025, most: int = 300, **options) -> DataFrame:
    """Parsed works of each source from the years, at most ``most`` of each as the catalogue orders them."""
    at = f"primary_location.source.id:{{key}},publication_year:{first}-{last}"
    return parsed(read_rest(spark, url, source_ids, at, most_rows=most, per_page=min(most, 100), **options))
