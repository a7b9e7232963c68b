"""Reading snapshots: gzip JSON lines by entity, ledgered ingest, tables from files and databases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewell.functions.scalars import parsed_once
from citewell.operators.series import last_writer
from citewell.schemas import require


def entities(spark: SparkSession, root: str) -> list[str]:
    """Names of sub-folders with at least one ``.gz`` file below, hidden ones left out; listed by Hadoop, so any store will do."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in system.listStatus(path):
        name = status.getPath().getName()
        if not status.isDirectory() or name.startswith((".", "_")):
            continue
        files = system.listFiles(status.getPath(), True)
        while files.hasNext():
            if files.next().getPath().getName().endswith(".gz"):
                found.append(name)
                break
    return sorted(found)


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """``id, raw_data, file`` from JSON lines, one file a task; blank and malformed lines are left out, a missing id is empty."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(path)
    return with_ids(lines.select(F.col("value").alias("raw_data"), F.col("_metadata.file_path").alias("file")))


def with_ids(lines: DataFrame) -> DataFrame:
    """``id`` before ``raw_data`` and the other columns, of lines that hold a JSON object; each line is parsed once."""
    parsed = lines.select(parsed_once(F.from_json("raw_data", "id STRING, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})).alias("_d"), *lines.columns)
    good = parsed.filter((F.trim("raw_data") != "") & F.col("_d").isNotNull() & F.col("_d._bad").isNull())
    return good.select(F.coalesce("_d.id", F.lit("")).alias("id"), *lines.columns)


def typed_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of ``schema`` from JSON lines in one parse, without raw text; blank and malformed lines are left out.

    A field of another type than the schema's is null and doesn't cost the line its other fields.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(path)
    parsed = lines.select("value", parsed_once(F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})).alias("_d"))
    fields = [f for f in parsed.schema["_d"].dataType.names if f != "_bad"]
    some = reduce(Column.__or__, [F.col(f"_d.`{f}`").isNotNull() for f in fields])
    return parsed.filter((F.trim("value") != "") & F.col("_d").isNotNull() & (F.col("_d._bad").isNull() | some)).select("_d.*").drop("_bad")


def inferred_json(spark: SparkSession, path: str) -> DataFrame:
    """Schema from the data, malformed lines dropped."""
    return spark.read.option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)


def described(df: DataFrame) -> DataFrame:
    """``column, type`` of a table."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "column string, type string")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of Parquet files, from their footers."""
    before = spark.conf.get("spark.sql.parquet.aggregatePushdown")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        return spark.read.parquet(path).count()
    finally:
        spark.conf.set("spark.sql.parquet.aggregatePushdown", before)


def files(spark: SparkSession, path: str, suffix: str = ".gz") -> DataFrame:
    """``file`` of everything below a path, without reading it."""
    glob = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    return glob.select(F.col("path").alias("file"))


def ingest(spark: SparkSession, root: str, table: str, ledger: str, entity: str) -> int:
    """Appends the documents of files that the ledger doesn't have, then their names; gives the number of new files.

    A crash between the two writes loads files again, so readers take ``latest_documents``.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(ledger)
    there = files(spark, f"{root.rstrip('/')}/{entity}").select("file", F.lit(entity).alias("entity"))
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        there = there.join(spark.read.parquet(ledger).filter(F.col("entity") == entity).select("file"), "file", "left_anti")
    names = [r.file for r in there.collect()]  # file names of one batch
    if names:
        raw = spark.read.option("recursiveFileLookup", "true").text(names)
        documents = with_ids(raw.withColumnRenamed("value", "raw_data")).withColumns({"entity": F.lit(entity), "loaded_at": F.current_timestamp()})
        documents.write.mode("append").partitionBy("entity").parquet(table)
        spark.createDataFrame([(n, entity) for n in names], "file string, entity string").withColumn("processed_at", F.current_timestamp()).write.mode("append").parquet(ledger)
    return len(names)


def latest_documents(documents: DataFrame) -> DataFrame:
    """The last loaded document of each id; within a batch the later ``updated_date`` wins, then the greater text, so no order of rows matters."""
    order = F.struct("loaded_at", F.coalesce(F.get_json_object("raw_data", "$.updated_date"), F.lit("")).alias("updated"), "raw_data")
    return last_writer(documents.withColumn("_order", order), "id", "_order").drop("_order")


#: White space at the ends of a value is part of it, and a quote within one is doubled.
_CSV = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, separator: str = ",") -> DataFrame:
    return spark.read.schema(schema).options(**_CSV).option("sep", separator).csv(path)


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.mode("overwrite").options(**_CSV).option("sep", separator).csv(path)


def with_columns(df: DataFrame, wanted: Sequence[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Exactly the wanted columns: those that the table lacks get their default, or null as text."""
    lacking = lambda c: F.lit((defaults or {}).get(c)) if c in (defaults or {}) else F.lit(None).cast("string")
    there = {c.lower() for c in df.columns}
    return df.select(*[F.col(c) if c.lower() in there else lacking(c).alias(c) for c in wanted])


def read_database(
    spark: SparkSession, url: str, query: str, wanted: list[str], key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16,
    defaults: dict[str, object] | None = None, **options: str,
) -> DataFrame:
    """A query's rows over JDBC, in parallel over a numeric key; wanted columns that it lacks get their default, or null.

    The database is asked for its columns once, so an older schema is no error.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return with_columns(reader.load(), wanted, defaults)


def read_by_key(spark: SparkSession, url: str, name: str, key: str, values: Sequence[str], wanted: list[str], defaults: dict[str, object] | None = None, per_task: int = 20, **options: str) -> DataFrame:
    """Rows of a database's table whose key is one of ``values``, ``per_task`` of them a task and statement.

    The values are a list of the caller's, such as the journals of a report; for
    very many read the whole table by a numeric key and join.
    """
    quoted = ["'" + str(v).replace("'", "''") + "'" for v in values]
    predicates = [f"{key} IN ({', '.join(quoted[i : i + per_task])})" for i in range(0, len(quoted), per_task)] or ["1 = 0"]
    return with_columns(spark.read.jdbc(url, name, predicates=predicates, properties=options), wanted, defaults)


def write_database(df: DataFrame, url: str, name: str, **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode("append").save()


def declare_table(spark: SparkSession, name: str, ddl: str) -> None:
    """Creates an empty table where there is none."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")


def catalogue(spark: SparkSession) -> DataFrame:
    """``table, column, type`` of every table of the current database."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def consolidated(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """Files of differing schemas as one table, the last row of each key by ``order``, over all files and not just a batch."""
    from citewell.operators.frames import union_by_name

    return last_writer(require(union_by_name(*frames), key, order), key, order)
