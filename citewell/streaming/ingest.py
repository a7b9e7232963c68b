"""Incremental ingest as a stream: new snapshot files are merged once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citewell.sources.snapshot import with_ids


def document_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """``id, raw_data, loaded_at`` of files as they appear; the checkpoint is the ledger."""
    lines = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).text(path)
    return with_ids(lines.withColumnRenamed("value", "raw_data")).withColumn("loaded_at", F.current_timestamp())


def run_available(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends all files there are, then stops; files done before are not read again."""
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def yearly_counts(works: DataFrame, watermark: str | None = None) -> DataFrame:
    """Running documents by journal and year, for a stream or a table of cube works."""
    source = works.withWatermark("loaded_at", watermark) if watermark else works
    return source.groupBy("journal_id", "year").agg(F.count(F.lit(1)).alias("num_documents"))


def windowed_counts(events: DataFrame, time: str, length: str, key: str, lateness: str | None = None) -> DataFrame:
    """Counts and sums in tumbling windows; with ``lateness`` a stream drops state once late rows can't arrive."""
    source = events.withWatermark(time, lateness) if lateness else events
    made = source.groupBy(F.window(time, length).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("start"), key, "n", "total")
