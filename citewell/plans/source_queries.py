"""Sources and sinks: files are written and read again in the shared folder, so results equal the tables they began as."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.plans import normalise, slices
from citewell.plans.catalogue import query
from citewell.plans.fixture import WORKS_SQL, rounded, table, works
from citewell.plans.indicators import indicator_cube
from citewell.schemas import WORK_JSON
from citewell.sources import snapshot


def folder(spark, label: str) -> str:
    """A new path in the folder that executors share; where none is configured, a local session gets one of its own and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="citewell-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def raw_works(spark, d):
    """The test works as snapshot JSON lines."""
    w = works(spark, d).withColumn("id", F.concat(F.lit("W"), F.monotonically_increasing_id().cast("string")))
    name = lambda c: F.struct(F.col(c).alias("display_name"))
    return w.select(F.to_json(F.struct(
        "id", F.col("year").alias("publication_year"), "cited_by_count", "fwci", "language",
        F.struct(F.col("percentile").alias("value")).alias("citation_normalized_percentile"),
        F.struct("is_oa", "oa_status").alias("open_access"),
        F.struct(F.struct(F.col("journal_id").cast("string").alias("id")).alias("source")).alias("primary_location"),
        F.struct(F.col("topic").alias("display_name"), name("subfield").alias("subfield"), name("field").alias("field"), name("domain").alias("domain")).alias("primary_topic"),
    )).alias("value"))


_SUITE_SMALL = "journal_id, year, count(*) AS num_documents, CAST(sum(cited_by_count) AS BIGINT) AS total_citations, round(avg(coalesce(fwci, 0)), 9) AS fwci_avg, round(100.0 * count(*) FILTER (WHERE percentile >= 0.9) / count(*), 9) AS pct_top_10"


@query("src02_snapshot_cube", f"WITH {WORKS_SQL} SELECT CAST(journal_id AS VARCHAR) AS {_SUITE_SMALL} FROM works GROUP BY journal_id, year")
def src02(spark, d):
    path = folder(spark, "snapshot")
    raw_works(spark, d).write.option("compression", "gzip").text(f"{path}/works")
    parsed = snapshot.typed_documents(spark, f"{path}/works", WORK_JSON)
    cube = indicator_cube(normalise.cube_works(parsed), ["journal_id", "year"])
    return rounded(cube.select("journal_id", "year", "num_documents", "total_citations", "fwci_avg", "pct_top_10"))


@query("src01_entities", "SELECT * FROM (VALUES ('sources'), ('works')) t(entity)")
def src01(spark, d):
    path = folder(spark, "snapshot")
    for name in ("works", "sources"):
        table(spark, d, "nation").select("n_name").write.option("compression", "gzip").text(f"{path}/{name}/updated_date=2024-01-01")
    table(spark, d, "nation").select("n_name").write.text(f"{path}/plain")
    return spark.createDataFrame([(e,) for e in snapshot.entities(spark, path)], "entity string")


@query("src03_inferred_json", "SELECT n_nationkey, n_name FROM nation")
def src03(spark, d):
    path = folder(spark, "json")
    table(spark, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value")).union(spark.createDataFrame([("{broken",)], "value string")).write.text(path)
    return snapshot.inferred_json(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("src04_described", "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(\"column\", type)")
def src04(spark, d):
    return snapshot.described(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("src05_full_scan", "SELECT * FROM supplier")
def src05(spark, d):
    return table(spark, d, "supplier")


@query("src06_column_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def src06(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity")


@query("src07_pushed_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 5")
def src07(spark, d):
    return table(spark, d, "lineitem").filter(F.col("l_suppkey") == 5).select("l_orderkey", "l_linenumber")


@query("src09_row_count", "SELECT count(*) AS n FROM orders")
def src09(spark, d):
    return spark.createDataFrame([(snapshot.row_count(spark, f"{d}/orders.parquet"),)], "n long")


@query("src16_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def src16(spark, d):
    path = folder(spark, "csv")
    snapshot.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, ";")
    return snapshot.read_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double", ";")


@query("src17_find_source", "SELECT s_suppkey AS id FROM supplier WHERE contains(lower(s_name), '00003') OR s_nationkey = 7")
def src17(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("display_name"), F.col("s_nationkey").cast("string").alias("issn_l"))
    return slices.find_source(s, name="00003", issn="7").select(F.col("id").cast("long").alias("id"))


@query("src18_catalogue", "SELECT 'citewell_nation' AS \"table\", 'n_name' AS \"column\", 'string' AS type")
def src18(spark, d):
    table(spark, d, "nation").select("n_name").createOrReplaceTempView("citewell_nation")
    return snapshot.catalogue(spark).filter(F.col("table") == "citewell_nation")


@query("snk01_ledger_ingest", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 0 AS again FROM nation")
def snk01(spark, d):
    path = folder(spark, "ingest")
    nation = table(spark, d, "nation").withColumn("id", F.col("n_nationkey").cast("string"))
    older = nation.select("id", F.lit("an older version").alias("n_name"), F.lit("2024-01-01").alias("updated_date"))
    both = nation.select("id", "n_name", F.lit("2024-02-01").alias("updated_date")).union(older)
    both.select(F.to_json(F.struct("id", "n_name", "updated_date")).alias("value")).write.option("compression", "gzip").text(f"{path}/in/works")
    snapshot.ingest(spark, f"{path}/in", f"{path}/raw", f"{path}/ledger", "works")
    again = snapshot.ingest(spark, f"{path}/in", f"{path}/raw", f"{path}/ledger", "works")
    last = snapshot.latest_documents(spark.read.parquet(f"{path}/raw"))
    return last.select("id", F.get_json_object("raw_data", "$.n_name").alias("name"), F.lit(again).alias("again"))


@query("snk02_cube_file", f"WITH {WORKS_SQL} SELECT journal_id, count(*) AS num_documents FROM works GROUP BY 1")
def snk02(spark, d):
    from citewell.plans import cubes

    path = folder(spark, "cube")
    cubes.save_cube(indicator_cube(works(spark, d), ["journal_id"]).select("journal_id", "num_documents"), path, ["journal_id"])
    return cubes.load_cube(spark, path)


@query("snk07_copy_text", "SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, '\\N') AS t FROM nation")
def snk07(spark, d):
    from citewell.functions.scalars import copy_text

    return table(spark, d, "nation").select("n_nationkey", copy_text(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))).alias("t"))


@query("snk11_add_columns", "SELECT n_nationkey, n_name, CAST(0.5 AS DOUBLE) AS fwci FROM nation")
def snk11(spark, d):
    from citewell.operators.frames import with_defaults

    return with_defaults(table(spark, d, "nation").select("n_nationkey", "n_name"), {"fwci": 0.5, "n_name": "already there"})


def _source_json(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    odd = k % 2 == 1
    topic = F.struct(
        F.lit("T1").alias("id"), F.lit("t").alias("display_name"), F.when(odd, k + 1).otherwise(0).alias("count"), k.alias("works_count"),
        F.when(odd, 0.5).otherwise(0.0).alias("share"), (k * 1.0).alias("percentage"), F.when(k % 3 == 0, F.struct(F.lit("D").alias("display_name"))).alias("domain"),
    )
    return s.select(F.to_json(F.struct(
        k.cast("string").alias("id"), F.when(k % 3 == 0, F.concat(F.lit("SciELO "), F.col("s_name"))).otherwise(F.col("s_name")).alias("display_name"),
        F.struct(k.alias("h_index"), (k / 10).alias("2yr_mean_citedness")).alias("summary_stats"),
        F.struct(F.when(k % 2 == 0, "x").alias("scopus")).alias("ids"), (k % 5 == 0).alias("is_oa"), F.array(topic).alias("topics"),
    )).alias("raw_data"))


@query("xf02_source_metadata", "SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_suppkey AS INT) AS h_index, round(s_suppkey / 10, 9) AS citedness_2yr, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS in_scopus, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS in_scielo, 0 AS in_core, s_suppkey % 5 = 0 AS is_oa FROM supplier")
def xf02(spark, d):
    made = normalise.source_metadata(normalise.parsed(_source_json(spark, d), "source"))
    return rounded(made.select("id", "h_index", "citedness_2yr", "in_scopus", "in_scielo", "in_core", "is_oa"))


@query("xf07_topic_fallbacks", "SELECT CAST(s_suppkey AS VARCHAR) AS journal_id, CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey + 1 ELSE s_suppkey END AS count, round(CASE WHEN s_suppkey % 2 = 1 THEN 0.5 ELSE s_suppkey / 100.0 END, 9) AS share, CASE WHEN s_suppkey % 3 = 0 THEN 'D' ELSE 'Unknown' END AS domain FROM supplier")
def xf07(spark, d):
    return rounded(normalise.source_topics(normalise.parsed(_source_json(spark, d), "source")).select("journal_id", "count", "share", "domain"))


_WORK_ROWS = """SELECT 'works' AS name, CAST(year AS VARCHAR) AS a, coalesce(language, '-') AS b, count(*) AS n, CAST(sum(cited_by_count) AS BIGINT) AS total FROM works GROUP BY ALL
  UNION ALL SELECT 'works_open_access', oa_status, CAST(is_oa AS VARCHAR), count(*), 0 FROM works GROUP BY ALL
  UNION ALL SELECT 'works_primary_location', CAST(journal_id AS VARCHAR), '-', count(*), 0 FROM works GROUP BY ALL
  UNION ALL SELECT 'works_topics', topic, field, count(*), 0 FROM works GROUP BY ALL
  UNION ALL SELECT 'works_authorships', country_code, region, count(*), 0 FROM works GROUP BY ALL"""


@query("xf01_work_tables", f"WITH {WORKS_SQL} {_WORK_ROWS}")
def xf01(spark, d):
    path = folder(spark, "nested")
    w = works(spark, d).withColumn("id", F.concat(F.lit("W"), F.monotonically_increasing_id().cast("string")))
    named = lambda c: F.struct(F.col(c).alias("display_name"))
    w.select(F.to_json(F.struct(
        "id", F.col("year").alias("publication_year"), "cited_by_count", "language", F.struct("is_oa", "oa_status").alias("open_access"),
        F.struct(F.struct(F.col("journal_id").cast("string").alias("id")).alias("source")).alias("primary_location"),
        F.array(F.struct(F.col("topic").alias("id"), F.col("topic").alias("display_name"), F.lit(0.5).alias("score"), named("field").alias("field"), named("domain").alias("domain"))).alias("topics"),
        F.array(F.struct(F.struct(F.col("region").alias("id")).alias("author"), F.array(F.struct(F.col("country_code").alias("id"))).alias("institutions"))).alias("authorships"),
    )).alias("raw_data")).write.parquet(path)
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    made = normalise.work_tables(normalise.parsed(spark.read.parquet(path)), ids)
    none = F.lit(0).cast("long")
    keys = {
        "works": (F.col("publication_year").cast("string"), F.coalesce("language", F.lit("-")), F.col("cited_by_count").cast("long")), "works_open_access": (F.col("oa_status"), F.col("is_oa").cast("string"), none),
        "works_primary_location": (F.col("source_id"), F.lit("-"), none), "works_topics": (F.col("topic_display_name"), F.col("field_display_name"), none), "works_authorships": (F.col("institution_id"), F.col("author_id"), none),
    }
    parts = [made[t].groupBy(F.lit(t).alias("name"), a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total")) for t, (a, b, x) in keys.items()]
    return reduce(DataFrame.unionByName, parts)


@query("ext01_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def ext01(spark, d):
    from citewell.streaming.ingest import windowed_counts

    return rounded(windowed_counts(table(spark, d, "events"), "ts", "1 hour", "event_type"), 6)


@query("snk09_create_as", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def snk09(spark, d):
    from citewell.sources import tables

    path = folder(spark, "table")
    name = f"citewell_{path.rpartition('-')[2]}"
    made = tables.create_as(table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"), name, path, row_group_bytes=1 << 20)
    tables.measure(spark, name)
    rows = made.select("*")
    tables.drop(spark, name)
    return spark.read.parquet(path).select(*rows.columns)


@query("snk10_truncate", "SELECT 0 AS n")
def snk10(spark, d):
    from citewell.sources import tables

    path = folder(spark, "table")
    name = f"citewell_{path.rpartition('-')[2]}"
    tables.create_as(table(spark, d, "nation"), name, path)
    tables.truncate(spark, name)
    left = spark.table(name).count()
    tables.drop(spark, name)
    return spark.createDataFrame([(left,)], "n int")


@query("snk06_matrix", "SELECT CAST(c_nationkey AS INT) AS row, CAST(m AS INT) AS col, round(avg(c_acctbal), 9) AS value FROM (SELECT *, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS m FROM customer) GROUP BY ALL")
def snk06(spark, d):
    from citewell.sources import tables

    c = table(spark, d, "customer")
    segments = c.groupBy("c_mktsegment").count().orderBy("c_mktsegment")
    named = F.array(*[F.lit(r["c_mktsegment"]) for r in segments.collect()])
    cells = c.groupBy(F.col("c_nationkey").alias("row"), (F.array_position(named, F.col("c_mktsegment")) - 1).cast("int").alias("col")).agg(F.avg("c_acctbal").alias("value"))
    path = folder(spark, "matrix")
    tables.write_matrix(cells, path)
    return rounded(tables.read_matrix(spark, path))


@query("dq07_presence", "SELECT 'nation' AS name, true AS present, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'nothing', false, 0")
def dq07(spark, d):
    from citewell.sources import tables

    return tables.presence(spark, {"nation": f"{d}/nation.parquet", "nothing": f"{d}/nothing.parquet"})


@query("js08_stats_default", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS INT) ELSE 0 END AS h_index FROM supplier")
def js08(spark, d):
    stats = F.when(F.col("s_suppkey") % 2 == 0, F.to_json(F.struct(F.col("s_suppkey").alias("h_index")))).otherwise("broken")
    return table(spark, d, "supplier").select("s_suppkey", F.coalesce(F.from_json(stats, "h_index int")["h_index"], F.lit(0)).alias("h_index"))


@query("snk03_codec_row_groups", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def snk03(spark, d):
    from citewell.sources import tables

    path = folder(spark, "table")
    name = f"citewell_{path.rpartition('-')[2]}"
    tables.create_as(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), name, path, codec="zstd", row_group_bytes=1 << 18)
    tables.drop(spark, name)
    return spark.read.parquet(path)


@query("snk04_part_files", "SELECT l_suppkey, 1 AS n_batches, count(*) AS n FROM lineitem GROUP BY 1")
def snk04(spark, d):
    from citewell.sources import tables

    path = folder(spark, "parts")
    tables.write_parts(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), path, "l_suppkey", 8)
    return spark.read.parquet(path).groupBy("l_suppkey").agg(F.count_distinct("batch").alias("n_batches"), F.count(F.lit(1)).alias("n"))


@query("snk05_csv_export", "SELECT c_custkey, c_name || ', \"' || c_mktsegment || '\"; ' AS label FROM customer")
def snk05(spark, d):
    path = folder(spark, "csv")
    label = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"; ')).alias("label")
    snapshot.write_csv(table(spark, d, "customer").select("c_custkey", label), path)
    return snapshot.read_csv(spark, path, "c_custkey long, label string")


@query("snk08_declared_table", "SELECT n_nationkey, n_name FROM nation")
def snk08(spark, d):
    from citewell.sources import tables

    name = f"citewell_{uuid.uuid4().hex}"
    ddl = "n_nationkey INT, n_name STRING"
    snapshot.declare_table(spark, name, ddl)
    table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name").write.insertInto(name)
    snapshot.declare_table(spark, name, ddl)
    rows, path = spark.table(name), folder(spark, "declared")
    rows.write.parquet(path)
    tables.drop(spark, name)
    return spark.read.parquet(path)


_KEYED = "count(*) = count(DISTINCT {0}) AND count(*) = count({0})"


@query("snk14_guarded_keys", f"SELECT 'o_orderkey' AS key, {_KEYED.format('o_orderkey')} AS keyed FROM orders UNION ALL SELECT 'o_custkey', {_KEYED.format('o_custkey')} FROM orders")
def snk14(spark, d):
    from citewell.sources import tables

    path = folder(spark, "table")
    name = f"citewell_{path.rpartition('-')[2]}"
    tables.create_as(table(spark, d, "orders").select("o_orderkey", "o_custkey"), name, path)
    rows = [(c, tables.keyed(spark, name, c)) for c in ("o_custkey", "o_orderkey")]
    tables.drop(spark, name)
    return spark.createDataFrame(rows, "key string, keyed boolean")


@query("st05_append", f"WITH {WORKS_SQL} SELECT journal_id, count(*) AS num_documents FROM works GROUP BY 1")
def st05(spark, d):
    from citewell.plans import cubes

    path, w = folder(spark, "cube"), works(spark, d)
    counts = lambda rows: indicator_cube(rows, ["journal_id"]).select("journal_id", "num_documents")
    cubes.save_cube(counts(w.filter("region = 'ASIA'")), path)
    cubes.save_cube(counts(cubes.pending(w, cubes.load_cube(spark, path), "journal_id")), path, mode="append")
    return cubes.load_cube(spark, path)


@query("rs08_location_access", f"WITH {WORKS_SQL} SELECT CAST(journal_id AS VARCHAR) AS source_id, oa_status, is_oa, count(*) AS n FROM works GROUP BY ALL")
def rs08(spark, d):
    path = folder(spark, "works")
    raw_works(spark, d).withColumnRenamed("value", "raw_data").write.parquet(path)
    tables = normalise.work_tables(normalise.parsed(spark.read.parquet(path)))
    access = tables["works_open_access"].select("work_id", "is_oa", "oa_status")
    both = tables["works_primary_location"].select("work_id", "source_id").join(access, "work_id")
    return both.groupBy("source_id", "oa_status", "is_oa").agg(F.count(F.lit(1)).alias("n"))


@query("rs10_topic_paths", "SELECT CAST(s_suppkey AS VARCHAR) AS journal_id, 't' AS topic_name, 'Unknown' AS subfield, 'Unknown' AS field, CASE WHEN s_suppkey % 3 = 0 THEN 'D' ELSE 'Unknown' END AS domain FROM supplier")
def rs10(spark, d):
    return normalise.source_topics(normalise.parsed(_source_json(spark, d), "source")).select("journal_id", "topic_name", "subfield", "field", "domain")


def _entity_json(spark, d, *more):
    """Suppliers with a country's code, as JSON lines; every third lacks its counts."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    k = F.col("s_suppkey")
    fields = [k.cast("string").alias("id"), F.col("s_name").alias("display_name"), F.concat(F.lit("N"), F.col("n_regionkey").cast("string")).alias("country_code"), F.when(k % 3 != 0, k).alias("works_count"), F.lit("2024-02-01").alias("updated_date")]
    return s.select(F.to_json(F.struct(*fields, *more)).alias("raw_data"))


_ENTITY_SQL = "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS display_name, 'N' || n_regionkey AS country_code, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey END AS INT) AS works_count, 0 AS cited_by_count, '2024-02-01' AS updated"
_IN_COUNTRIES = "FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE 'N' || n_regionkey IN ('N1', 'N2')"


@query("xf01_source_table", f"{_ENTITY_SQL}, s_suppkey % 2 = 0 AS is_scopus, '[\"' || s_name || '\"]' AS issn {_IN_COUNTRIES}")
def xf01_sources(spark, d):
    more = [F.struct(F.when(F.col("s_suppkey") % 2 == 0, "x").alias("scopus")).alias("ids"), F.array("s_name").alias("issn")]
    made = normalise.source_table(normalise.parsed(_entity_json(spark, d, *more), "source"), ["N1", "N2"])
    return made.select("id", "display_name", "country_code", "works_count", "cited_by_count", F.date_format("updated_date", "yyyy-MM-dd").alias("updated"), "is_scopus", "issn")


@query("xf01_institution_table", f"{_ENTITY_SQL}, '[\"' || s_name || '\"]' AS display_name_acronyms {_IN_COUNTRIES}")
def xf01_institutions(spark, d):
    made = normalise.institution_table(normalise.parsed(_entity_json(spark, d, F.array("s_name").alias("display_name_acronyms")), "institution"), ["N1", "N2"])
    return made.select("id", "display_name", "country_code", "works_count", "cited_by_count", F.date_format("updated_date", "yyyy-MM-dd").alias("updated"), "display_name_acronyms")
