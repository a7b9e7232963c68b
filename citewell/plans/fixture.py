"""The test tables in their bibliometric roles: journal = supplier, work = line item, country = nation, topic path = part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECENT = (1999, 2001)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str, more: Sequence[Column] = ()) -> DataFrame:
    """One row a work, with further columns of line items.  Suppliers, parts, nations and regions join by size: Spark broadcasts those under its threshold."""
    t = lambda name: table(spark, sf_dir, name)
    line, n = t("lineitem"), F.col("l_linenumber")
    status = F.concat("l_returnflag", "l_linestatus")
    joined = (
        line.join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
        .join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
        .join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    )
    state = F.when(status == "AF", "gold").when(status == "AO", "diamond").when(status == "NF", "green").when(status == "NO", "hybrid").when(status == "RF", "bronze")
    language = F.when(n == 1, "en").when(n == 2, "es").when(n == 3, "pt").when(n == 4, "fr").when(n == 5, "de").when(n == 6, "it")
    made = joined.select(
        F.col("l_suppkey").alias("journal_id"), F.year("l_shipdate").alias("year"), n.cast("long").alias("cited_by_count"),
        F.when(n != 7, F.col("l_extendedprice") / 50000.0).alias("fwci"), (F.col("l_quantity") / 50.0).alias("percentile"),
        state.otherwise("closed").alias("oa_status"), language.alias("language"),
        F.col("p_type").alias("domain"), F.col("p_brand").alias("field"), F.col("p_size").cast("string").alias("subfield"), F.col("p_name").alias("topic"),
        F.col("n_name").alias("country_code"), F.col("r_name").alias("region"), *more,
    )
    return made.withColumn("is_oa", F.col("oa_status") != "closed")


WORKS_SQL = """works AS (
  SELECT CAST(l_suppkey AS BIGINT) AS journal_id, CAST(year(l_shipdate) AS INT) AS year, CAST(l_linenumber AS BIGINT) AS cited_by_count,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 50000.0 END AS fwci, l_quantity / 50.0 AS percentile,
         CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'gold' WHEN 'AO' THEN 'diamond' WHEN 'NF' THEN 'green'
              WHEN 'NO' THEN 'hybrid' WHEN 'RF' THEN 'bronze' ELSE 'closed' END AS oa_status,
         CASE l_linenumber WHEN 1 THEN 'en' WHEN 2 THEN 'es' WHEN 3 THEN 'pt' WHEN 4 THEN 'fr' WHEN 5 THEN 'de' WHEN 6 THEN 'it' END AS language,
         p_type AS domain, p_brand AS field, CAST(p_size AS VARCHAR) AS subfield, p_name AS topic, n_name AS country_code, r_name AS region,
         concat(l_returnflag, l_linestatus) IN ('AF', 'AO', 'NF', 'NO', 'RF') AS is_oa
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as journals with their works' counts."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    counts = works(spark, sf_dir).groupBy("journal_id").agg(F.count(F.lit(1)).alias("works_count"), F.sum("cited_by_count").alias("cited_by_count"))
    made = s.select(F.col("s_suppkey").alias("journal_id"), F.col("s_name").alias("display_name"), F.col("n_name").alias("country_code"), (F.col("s_acctbal") > 0).alias("is_oa"), (F.col("s_acctbal") / 1000.0).alias("citedness"))
    return made.join(counts, "journal_id", "left").na.fill(0, ["works_count", "cited_by_count"])


JOURNALS_SQL = f"""{WORKS_SQL},
journals AS (
  SELECT CAST(s_suppkey AS BIGINT) AS journal_id, s_name AS display_name, n_name AS country_code, s_acctbal > 0 AS is_oa, s_acctbal / 1000.0 AS citedness,
         coalesce(c.works_count, 0) AS works_count, coalesce(c.cited_by_count, 0) AS cited_by_count
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
  LEFT JOIN (SELECT journal_id, count(*) AS works_count, CAST(sum(cited_by_count) AS BIGINT) AS cited_by_count FROM works GROUP BY 1) c ON c.journal_id = s_suppkey)"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Figures in double precision rounded, as the order of summation differs between engines; a hair is added so that exact ties go one way."""
    return df.select(*[F.round(F.col(c) + 1e-12, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
