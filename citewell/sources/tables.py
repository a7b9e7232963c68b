"""Tables by name: creating, filling, emptying, dropping and measuring them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create_as(df: DataFrame, name: str, path: str, codec: str = "snappy", row_group_bytes: int | None = None) -> DataFrame:
    """A Parquet table of a query's rows at ``path``, replaced where it exists."""
    writer = df.write.mode("overwrite").format("parquet").option("path", path).option("compression", codec)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def truncate(spark: SparkSession, name: str) -> None:
    """Empties a table: its rows are replaced by none, for managed tables and files elsewhere alike."""
    table = spark.table(name)
    spark.createDataFrame([], table.schema).write.mode("overwrite").insertInto(name, overwrite=True)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def measure(spark: SparkSession, name: str, columns: bool = True) -> None:
    """Statistics for the optimiser; the place of indexes and their upkeep."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS" + (" FOR ALL COLUMNS" if columns else ""))


def keyed(spark: SparkSession, name: str, *key: str) -> bool:
    """Marks the columns as the table's key, after a test that no row lacks one and no two rows agree in all; otherwise leaves the table alone.

    Spark enforces no keys: the mark is a table property that tells later runs
    that the test was passed, and statistics go with it.
    """
    marked = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if marked.get("citewell.key") == ",".join(key):
        return True
    rows = spark.table(name)
    lacking = F.lit(False)
    for c in key:
        lacking = lacking | F.col(c).isNull()
    broken = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | lacking)
    if not broken.isEmpty():
        return False
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('citewell.key' = '{','.join(key)}')")
    measure(spark, name)
    return True


def write_parts(df: DataFrame, path: str, key: str, batches: int, tasks_each: int = 4, mode: str = "overwrite") -> None:
    """Part files by batches of a key's values, as folders ``batch=n``; a batch goes to a few tasks by row, so no value that has most of the rows meets one of them."""
    batch = df.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))
    spread = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t]), F.lit(tasks_each))
    batch.repartition(batches * tasks_each, "batch", spread).write.mode(mode).partitionBy("batch").parquet(path)


def presence(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``name, present, n``: whether each file is there, and its rows from the footers."""
    from citewell.sources.snapshot import row_count

    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    rows = []
    for name, path in sorted(paths.items()):
        p = jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(conf).exists(p)
        rows.append((name, there, row_count(spark, path) if there else 0))
    return spark.createDataFrame(rows, "name string, present boolean, n long")


def matrix_rows(spark: SparkSession, matrix) -> DataFrame:
    """A small dense matrix in long form: ``row, col, value``."""
    return spark.createDataFrame([(i, j, float(v)) for i, line in enumerate(matrix) for j, v in enumerate(line)], "row int, col int, value double").orderBy(F.col("row"), F.col("col"))


def write_matrix(cells: DataFrame, path: str) -> None:
    """A matrix as a table of ``row, col, value`` cells, sorted by range so that a reader of some rows skips the rest; absent cells are 0."""
    cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value")).repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row int, col int, value double").parquet(path)
