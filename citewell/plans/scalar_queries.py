"""Scalar functions, JSON, reshaped documents, layouts and maps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from citewell.functions import scalars as S
from citewell.operators import layout, umap
from citewell.plans import indicators
from citewell.plans.catalogue import query
from citewell.plans.fixture import WORKS_SQL, rounded, table, works


@query("js01_json_string", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.none'), '') AS none FROM events")
def js01(spark, d):
    p = F.col("props")
    return table(spark, d, "events").select("event_id", S.json_string(p, "$.k").alias("k"), S.json_string(p, "$.none").alias("none"))


@query("js02_json_int", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, CAST(0 AS BIGINT) AS none FROM events")
def js02(spark, d):
    p = F.col("props")
    return table(spark, d, "events").select("event_id", S.json_int(p, "$.k").alias("k"), S.json_int(p, "$.none").alias("none"))


@query("js03_json_bool", "SELECT n_nationkey, n_nationkey % 2 = 0 AS flag FROM nation")
def js03(spark, d):
    raw = F.to_json(F.struct((F.col("n_nationkey") % 2 == 0).alias("is_oa")))
    return table(spark, d, "nation").select("n_nationkey", S.json_bool(raw, "$.is_oa").alias("flag"))


@query("js06_parse_json", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def js06(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("js07_to_json", "SELECT n_nationkey, '{\"name\":\"' || n_name || '\"}' AS j FROM nation")
def js07(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"))).alias("j"))


@query("js09_status_default", f"WITH {WORKS_SQL} SELECT coalesce(CASE WHEN oa_status = 'gold' THEN NULL ELSE oa_status END, 'closed') AS s, count(*) AS n FROM works GROUP BY 1")
def js09(spark, d):
    s = F.coalesce(F.when(F.col("oa_status") != "gold", F.col("oa_status")), F.lit("closed"))
    return works(spark, d).groupBy(s.alias("s")).agg(F.count(F.lit(1)).alias("n"))


@query("js10_percentile", "SELECT p_partkey, p_size / 50.0 AS p FROM part")
def js10(spark, d):
    p = F.col("p_size") / 50.0
    raw = F.when(F.col("p_partkey") % 2 == 0, p.cast("string")).otherwise(F.to_json(F.struct(p.alias("value"))))
    return table(spark, d, "part").select("p_partkey", S.percentile_value(raw).alias("p"))


@query("nm01_or_zero", "SELECT event_id, coalesce(TRY_CAST(props AS DOUBLE), 0.0) AS a, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS b FROM events")
def nm01(spark, d):
    return table(spark, d, "events").select("event_id", S.or_zero(F.col("props")).alias("a"), S.or_zero(F.get_json_object("props", "$.k")).alias("b"))


@query("nm03_rounding", "SELECT p_partkey, round(p_retailprice / 7, 1) AS r FROM part", nudge=False)
def nm03(spark, d):
    return table(spark, d, "part").select("p_partkey", S.rounded(F.col("p_retailprice") / 7, 1).alias("r"))


@query("nm04_safe_division", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_retailprice / (p_size % 5) END AS r FROM part")
def nm04(spark, d):
    return table(spark, d, "part").select("p_partkey", S.ratio(F.col("p_retailprice"), F.col("p_size") % 5).alias("r"))


@query("nm05_clamp", "SELECT s_suppkey, greatest(least(s_acctbal / 5000, 1.0), 0.0) AS c FROM supplier")
def nm05(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.clamp(F.col("s_acctbal") / 5000).alias("c"))


@query("nm06_scale_position", f"WITH {WORKS_SQL}, c AS (SELECT journal_id, avg(coalesce(fwci, 0)) AS f FROM works GROUP BY 1), m AS (SELECT min(f) AS lo, max(f) AS hi FROM c) SELECT journal_id, round(greatest(least((f - lo) / (hi - lo), 1.0), 0.0), 9) AS position FROM c, m")
def nm06(spark, d):
    cube = indicators.indicator_cube(works(spark, d), ["journal_id"]).select("journal_id", F.col("fwci_avg").alias("f"))
    ends = cube.agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    return rounded(cube.join(F.broadcast(ends)).select("journal_id", S.clamp(S.ratio(F.col("f") - F.col("lo"), F.col("hi") - F.col("lo"))).alias("position")))


@query("nm07_hex_centre", f"SELECT n_nationkey AS id, round({math.sqrt(3)!r} * (n_nationkey % 5 + 0.5 * ((n_nationkey // 5) % 2)), 9) AS x, round(1.5 * (n_nationkey // 5), 9) AS y FROM nation")
def nm07(spark, d):
    x, y = S.hex_center((F.col("n_nationkey") / 5).cast("int"), F.col("n_nationkey") % 5)
    return rounded(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), x.alias("x"), y.alias("y")))


@query("nm08_sum_of_columns", f"WITH {WORKS_SQL} SELECT journal_id, round(100.0 * count(*) FILTER (WHERE oa_status IN ('gold', 'green', 'hybrid', 'bronze')) / count(*), 9) AS pct_oa_total_sum4 FROM works GROUP BY 1")
def nm08(spark, d):
    cube = indicators.indicator_cube(works(spark, d), ["journal_id"])
    four = sum((F.coalesce(F.col(f"pct_oa_{s}"), F.lit(0.0)) for s in ("gold", "green", "hybrid", "bronze")), F.lit(0.0))
    return rounded(cube.select("journal_id", four.alias("pct_oa_total_sum4")))


@query("nm09_estimated_oa", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_nationkey ELSE 0 END AS oa_works_count FROM supplier")
def nm09(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).otherwise(0).alias("oa_works_count"))


@query("str01_contains_flag", "SELECT p_partkey, CASE WHEN contains(p_name, 'r') THEN 1 ELSE 0 END AS f FROM part")
def str01(spark, d):
    return table(spark, d, "part").select("p_partkey", S.contains_flag(F.col("p_name"), "r").alias("f"))


@query("str02_filled_flag", "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END AS f FROM customer")
def str02(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.filled(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("")).cast("int").alias("f"))


@query("str03_last_segment", "SELECT page_id, list_extract(string_split(url, '/'), -1) AS seg FROM pages")
def str03(spark, d):
    return table(spark, d, "pages").select("page_id", S.last_segment(F.col("url")).alias("seg"))


@query("str04_label", "SELECT n_nationkey, upper(n_name[8:8]) || lower(n_name[9:]) AS label FROM nation WHERE n_name LIKE 'NATION_%'")
def str04(spark, d):
    return table(spark, d, "nation").filter(F.col("n_name").startswith("NATION_")).select("n_nationkey", S.label_of(F.col("n_name"), "NATION_").alias("label"))


@query("str05_scrub", "SELECT doc_id, md5(replace(replace(replace(text, chr(9), ' '), chr(10), ' '), chr(13), ' ')) AS m FROM documents")
def str05(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.scrubbed(F.col("text"))).alias("m"))


@query("str06_lower", "SELECT s_suppkey, lower(s_name) AS n FROM supplier")
def str06(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.lower("s_name").alias("n"))


@query("str07_truncate", "SELECT doc_id, text[1:80] AS head FROM documents")
def str07(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 80).alias("head"))


@query("str08_or_all", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_mktsegment END, ''), 'ALL') AS s FROM customer")
def str08(spark, d):
    k = F.col("c_custkey") % 3
    return table(spark, d, "customer").select("c_custkey", S.or_all(F.when(k == 0, "").when(k == 2, F.col("c_mktsegment"))).alias("s"))


@query("ar01_slice", "SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), '|') AS s FROM documents")
def ar01(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 3), "|").alias("s"))


@query("ar02_abstract", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def ar02(spark, d):
    """Each text from its own inverted index."""
    index = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", S.inverted_index(F.col("text")).alias("i"))
    return index.select("doc_id", S.abstract_text(F.col("i")).alias("text"))


@query("ar03_country_codes", "SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS INT) AS at, n_name AS code FROM (SELECT DISTINCT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey)")
def ar03(spark, d):
    """The countries of all regions' suppliers, from one array a region to one array without repeats."""
    n = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    lists = n.groupBy("n_regionkey").agg(F.collect_set("n_name").alias("codes"))
    flat = lists.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))
    return flat.select(F.posexplode("codes").alias("at", "code"))


@query("dt02_parse_time", "SELECT count(t) AS n, CAST(min(t) AS VARCHAR) AS first, CAST(max(t) AS VARCHAR) AS last FROM (SELECT CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS t FROM orders)")
def dt02(spark, d):
    t = F.try_to_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "yyyy-MM-dd")
    return table(spark, d, "orders").select(t.alias("t")).agg(F.count("t").alias("n"), F.min("t").cast("string").alias("first"), F.max("t").cast("string").alias("last"))


@query("dt01_timestamp_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS download_date FROM events")
def dt01(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("download_date"))


@query("dt03_period_label", "SELECT o_custkey, CAST(min(year(o_orderdate)) AS VARCHAR) || '-' || CAST(max(year(o_orderdate)) AS VARCHAR) AS period FROM orders GROUP BY 1")
def dt03(spark, d):
    y = F.year("o_orderdate")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min(y).alias("a"), F.max(y).alias("b")).select("o_custkey", S.period_label(F.col("a"), F.col("b")).alias("period"))


@query("cn01_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c FROM part")
def cn01(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("c"))


@query("cn02_null_fill", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def cn02(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n"])


@query("cn03_true_text", "SELECT n_nationkey, n_nationkey % 3 < 2 AS t FROM nation")
def cn03(spark, d):
    k = F.col("n_nationkey") % 3
    return table(spark, d, "nation").select("n_nationkey", S.true_text(F.when(k == 0, "true").when(k == 1, "1").otherwise("no")).alias("t"))


@query("ml01_zscore", f"WITH {WORKS_SQL}, c AS (SELECT journal_id, avg(coalesce(fwci, 0)) AS f, 1.0 AS same FROM works GROUP BY 1) SELECT journal_id, round((f - avg(f) OVER ()) / stddev_pop(f) OVER (), 6) AS f, 0.0 AS same FROM c")
def ml01(spark, d):
    c = indicators.indicator_cube(works(spark, d), ["journal_id"]).select("journal_id", F.col("fwci_avg").alias("f"), F.lit(1.0).alias("same"))
    return rounded(layout.standardised(c, ["f", "same"]), 6)


_DIMENSIONS = [f"e{i}" for i in range(64)]


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_DIMENSIONS)])


@query("ml02_layout_pca")
def ml02(spark, d):
    return layout.layout_2d(_vectors(spark, d), ["vec_id"], _DIMENSIONS)


@query("ml02_umap")
def ml02_umap(spark, d):
    """All vectors laid out over their graph of nearest neighbours."""
    return umap.umap_2d(_vectors(spark, d), ["vec_id"], _DIMENSIONS)


@query("xf05_umap_by_context")
def xf05_umap(spark, d):
    """The same for each label's vectors by themselves."""
    return umap.umap_by_context(_vectors(spark, d), "label", ["vec_id"], _DIMENSIONS)


@query("xf05_context_layouts")
def xf05(spark, d):
    return layout.layout_by_context(_vectors(spark, d), "label", ["vec_id"], _DIMENSIONS)


def _trained(spark, d):
    """Standardised vectors and a map of 10 by 15 neurons trained on them."""
    z = layout.standardised(_vectors(spark, d), _DIMENSIONS)
    return z, layout.train_map(z, _DIMENSIONS)


@query("ml03_som_umatrix")
def ml03(spark, d):
    return layout.u_matrix(spark, _trained(spark, d)[1], 10, 15)


@query("ml03_trajectory_map")
def ml03_large(spark, d):
    """The map of trajectories: 30 by 50 neurons over the standardised figures of journals and years, with each one's place."""
    columns = ["num_documents", "total_citations", "fwci_avg", "avg_percentile", "pct_top_10", "pct_oa_gold", "pct_oa_closed"]
    z = layout.standardised(indicators.indicator_cube(works(spark, d), ["journal_id", "year"]).select("journal_id", "year", *columns), columns)
    return layout.with_bmu(z, columns, layout.train_map(z, columns, rows=30, cols=50), 50).select("journal_id", "year", "bmu_row", "bmu_col")


@query("ml04_bmu")
def ml04(spark, d):
    z, book = _trained(spark, d)
    return layout.with_bmu(z, _DIMENSIONS, book, 15).select("vec_id", "bmu_row", "bmu_col")


@query("ml06_map_usage")
def ml06(spark, d):
    return layout.map_usage(ml04(spark, d), 10, 15)
