"""Joins, filters, sets, sorting, updates and data quality over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.dims import mapped
from citewell.operators import frames, series
from citewell.plans import checks
from citewell.plans.catalogue import query
from citewell.plans.fixture import table


@query("jn01_inner", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'")
def jn01(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, d, "lineitem").join(urgent, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("jn02_broadcast_dim", "SELECT n_name AS country_code, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def jn02(spark, d):
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("country_code"), "n")


@query("jn03_left", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def jn03(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("jn04_left_metadata", "SELECT s_suppkey AS journal_id, s_name AS name, n_name AS country_code FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def jn04(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("s_suppkey").alias("journal_id"), F.col("s_name").alias("name"), F.col("n_name").alias("country_code"))


@query("jn05_composite_left", "WITH a AS (SELECT o_custkey AS id, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1, 2) SELECT a.id AS id, a.year AS year, a.n AS n, coalesce(b.n, 0) AS n_orig FROM a LEFT JOIN (SELECT * FROM a WHERE n > 1) b ON b.id = a.id AND b.year = a.year")
def jn05(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(a.filter("n > 1").select("id", "year", F.col("n").alias("n_orig")), ["id", "year"], "left").na.fill(0, ["n_orig"])


@query("jn08_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def jn08(spark, d):
    some = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(some, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("o_orderkey")


_RARE = "o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1997 AND month(o_orderdate) < 4"


@query("jn09_anti", f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_RARE})")
def jn09(spark, d):
    return frames.without(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter(_RARE).select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("jn10_three_way", "SELECT DISTINCT l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3")
def jn10(spark, d):
    c = table(spark, d, "customer").filter("c_nationkey = 3")
    o = table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return table(spark, d, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("l_suppkey").distinct()


@query("jn11_intersection_size", "SELECT count(*) AS n FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer)")
def jn11(spark, d):
    return table(spark, d, "supplier").select("s_nationkey").intersect(table(spark, d, "customer").select("c_nationkey")).agg(F.count(F.lit(1)).alias("n"))


_CODES = "('BR', 'HK', 'GB', 'ES', 'HT', 'RU', 'JP', 'ZA', 'EG', 'IN')"


@query("jn12_region", """SELECT n_nationkey AS id, CASE n_nationkey % 6 WHEN 0 THEN 'Latinoamérica y Caribe' WHEN 1 THEN 'China' WHEN 2 THEN 'Norteamérica Anglosajona' WHEN 3 THEN 'Europa Central/Occidental' ELSE 'Other' END AS region FROM nation""")
def jn12(spark, d):
    from citewell.dims import with_region

    k = F.col("n_nationkey") % 6
    code = F.when(k == 0, "BR").when(k == 1, "HK").when(k == 2, "GB").when(k == 3, "ES").when(k == 4, "HT")
    return with_region(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), code.alias("country_code"))).select("id", "region")


@query("jn13_year_diff", "WITH a AS (SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1) SELECT coalesce(a.year, b.year) AS year, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS missing FROM a FULL OUTER JOIN b ON a.year = b.year")
def jn13(spark, d):
    return checks.count_gap(table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year")), table(spark, d, "orders").select(F.year("o_orderdate").alias("year")), "year")


_LINE = "l_orderkey l_linenumber l_shipdate l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()


@query("wn08_keep_last", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(f'{c} DESC' for c in _LINE[2:])}) AS rn FROM lineitem) WHERE rn = 1")
def wn08(spark, d):
    return series.one_per_key(table(spark, d, "lineitem"), _LINE[:2], [F.desc(c) for c in _LINE[2:]]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("wn09_last_writer", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def wn09(spark, d):
    return series.last_writer(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("st01_union_by_name", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def st01(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return frames.union_by_name(s, c)


@query("st02_master_schema", "SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def st02(spark, d):
    from citewell.schemas import struct

    master = struct("id long, name string, segment string")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return frames.in_schema(s, master).union(frames.in_schema(c, master))


@query("st04_priority_union", "SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS rn FROM (SELECT s_suppkey AS id, s_name AS name, 0 AS p FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, 1 FROM customer)) WHERE rn = 1")
def st04(spark, d):
    a = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(0).alias("p"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("p"))
    return series.one_per_key(a.union(b), ["id"], [F.col("p")]).drop("p")


@query("st06_totals_row", "SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 UNION ALL SELECT 'Total', count(*) FROM customer")
def st06(spark, d):
    return frames.with_total_row(jn02(spark, d).withColumnRenamed("country_code", "name"), "name", ["n"])


@query("st07_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20")
def st07(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").filter("s_suppkey < 20").select("s_nationkey"))


@query("flt01_equality", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def flt01(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query("flt02_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def flt02(spark, d):
    return table(spark, d, "part").filter(F.col("p_size").between(10, 20)).select("p_partkey")


@query("flt03_since", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1999")
def flt03(spark, d):
    return table(spark, d, "orders").filter(F.year("o_orderdate") >= 1999).select("o_orderkey")


@query("flt04_isin", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def flt04(spark, d):
    return table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("flt05_any_array", "SELECT s_suppkey FROM supplier WHERE s_nationkey = ANY([1, 3, 5, 7])")
def flt05(spark, d):
    return table(spark, d, "supplier").filter(F.array_contains(F.array(*map(F.lit, (1, 3, 5, 7))), F.col("s_nationkey"))).select("s_suppkey")


@query("flt06_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def flt06(spark, d):
    return frames.without(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("flt07_filled", "SELECT doc_id FROM documents WHERE coalesce(text, '') <> ''")
def flt07(spark, d):
    from citewell.functions.scalars import filled

    return table(spark, d, "documents").filter(filled(F.col("text"))).select("doc_id")


@query("flt08_null_drop", "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n IS NOT NULL")
def flt08(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").na.drop(subset=["n"]).select("c_custkey", "n")


@query("flt11_positive", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def flt11(spark, d):
    return table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey")


@query("flt14_search", "SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'licensed under')")
def flt14(spark, d):
    return table(spark, d, "documents").filter(frames.contains_text(F.col("text"), "Licensed under")).select("doc_id")


@query("flt15_ilike", "SELECT p_partkey FROM part WHERE p_name ILIKE '%A%e%'")
def flt15(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").ilike("%A%e%")).select("p_partkey")


@query("flt16_latam", "SELECT n_nationkey, n_nationkey % 3 = 0 AS latam FROM nation")
def flt16(spark, d):
    from citewell.dims import LATAM_CODES

    code = F.when(F.col("n_nationkey") % 3 == 0, "MX").otherwise("XX")
    return table(spark, d, "nation").select("n_nationkey", code.isin(*LATAM_CODES).alias("latam"))


@query("flt17_exists_nested", "SELECT l_orderkey AS id FROM lineitem GROUP BY 1 HAVING bool_or(l_suppkey = 7)")
def flt17(spark, d):
    source = F.struct(F.struct(F.col("l_suppkey").cast("string").alias("id")).alias("source"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(source).alias("locations"))
    works = rows.withColumn("primary_location", F.struct(F.struct(F.lit(None).cast("string").alias("id")).alias("source")))
    return frames.at_source(works, "7").select("id")


@query("flt18_duplicate_groups", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def flt18(spark, d):
    return checks.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("flt19_mask_count", "SELECT count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n FROM customer")
def flt19(spark, d):
    return table(spark, d, "customer").agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("n"))


@query("prj01_subset", "SELECT c_custkey, c_name FROM customer")
def prj01(spark, d):
    t = table(spark, d, "customer")
    return t.select(*[c for c in ("c_custkey", "c_name", "not_there") if c in t.columns])


@query("prj02_rename", "SELECT c_custkey AS \"Code\", c_name AS \"Name\" FROM customer")
def prj02(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").withColumnsRenamed({"c_custkey": "Code", "c_name": "Name"})


@query("prj04_defaults", "SELECT s_suppkey, s_name, false AS is_core, 0 AS h_index FROM supplier")
def prj04(spark, d):
    return frames.with_defaults(table(spark, d, "supplier").select("s_suppkey", "s_name"), {"is_core": False, "h_index": 0})


@query("prj06_drop_suffix", "SELECT n_regionkey, count(*) AS total FROM nation GROUP BY 1")
def prj06(spark, d):
    t = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_nationkey") > 3).alias("late_count"))
    return frames.without_suffix(t)


@query("prj07_suffix", "SELECT n_regionkey, count(*) AS n_full FROM nation GROUP BY 1")
def prj07(spark, d):
    return frames.with_suffix(table(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")), ["n"], "_full")


@query("prj08_mapping", "SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'One' WHEN 'FRANCE' THEN 'Francia' WHEN 'BRAZIL' THEN 'Brasil' ELSE n_name END AS name FROM nation")
def prj08(spark, d):
    return table(spark, d, "nation").select("n_nationkey", mapped(F.col("n_name"), {"NATION_1": "One", "FRANCE": "Francia", "BRAZIL": "Brasil"}).alias("name"))


@query("prj10_search_label", "SELECT s_name || ' (' || CAST(s_suppkey AS VARCHAR) || ')' AS label FROM supplier")
def prj10(spark, d):
    return table(spark, d, "supplier").select(F.concat("s_name", F.lit(" ("), F.col("s_suppkey").cast("string"), F.lit(")")).alias("label"))


@query("prj11_id_year", "SELECT DISTINCT concat_ws('_', CAST(o_custkey AS VARCHAR), CAST(year(o_orderdate) AS VARCHAR)) AS id_year FROM orders")
def prj11(spark, d):
    return table(spark, d, "orders").select(F.concat_ws("_", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias("id_year")).distinct()


@query("sl01_order_by", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey")
def sl01(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size").orderBy(F.desc("p_size"), "p_partkey")


@query("sl02_mixed_sort", "SELECT n_nationkey % 3 AS code, n_nationkey AS year FROM nation ORDER BY 1, 2 DESC")
def sl02(spark, d):
    return table(spark, d, "nation").select((F.col("n_nationkey") % 3).alias("code"), F.col("n_nationkey").alias("year")).orderBy(F.asc("code"), F.desc("year"))


@query("sl06_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def sl06(spark, d):
    return frames.sample_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 100, ["o_orderkey"])


@query("sl07_pinned_last", "SELECT n_nationkey, n_name FROM nation")
def sl07(spark, d):
    return frames.pinned_last(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 3)


@query("sl08_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def sl08(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(25)


@query("ag26_collect_json", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def ag26(spark, d):
    made = frames.nested(table(spark, d, "conversations"), "conv_id", ["turn", "role", "text"])
    return made.select("conv_id", F.size(F.from_json("items", "array<struct<turn: bigint, role: string>>")).cast("long").alias("n"))


@query("ag26_nested_parts", """SELECT l_suppkey, CAST(pos // 100 AS INT) AS part, count(*) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS pos FROM lineitem) GROUP BY ALL""")
def ag26_parts(spark, d):
    made = frames.nested_parts(table(spark, d, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber"], each=100)
    items = F.from_json("items", "array<struct<l_orderkey: bigint, l_linenumber: int>>")
    orders = F.transform(items, lambda i: i["l_orderkey"])
    return made.select("l_suppkey", "part", F.size(items).cast("long").alias("n"), F.element_at(orders, 1).alias("first"), F.element_at(orders, -1).alias("last"))


@query("rs06_explode_outer", "SELECT conv_id, turn, role FROM conversations UNION ALL SELECT -conv_id - 1, -1, NULL FROM (SELECT DISTINCT conv_id FROM conversations)")
def rs06(spark, d):
    c = table(spark, d, "conversations")
    full = c.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("a"))
    empty = full.select((-F.col("conv_id") - 1).alias("conv_id"), F.slice("a", 1, 0).alias("a"))
    return full.union(empty).select("conv_id", F.explode_outer("a").alias("x")).select("conv_id", F.coalesce("x.turn", F.lit(-1)).alias("turn"), "x.role")


@query("rs07_slice", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations) WHERE rn <= 3")
def rs07(spark, d):
    full = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("a"))
    return full.select("conv_id", F.inline(F.slice("a", 1, 3))).select("conv_id", "turn", "role")


@query("rs09_year_series", "SELECT o_custkey AS id, CAST(year(o_orderdate) AS INT) AS year, count(*) AS works_count FROM orders GROUP BY 1, 2")
def rs09(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("works_count"))
    packed = per.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("year", "works_count"))).alias("counts_by_year"))
    return packed.select("id", F.inline("counts_by_year"))


@query("snk12_update", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def snk12(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return frames.updated(s, s.filter("s_suppkey % 4 = 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal")), "s_suppkey", ["s_acctbal"])


@query("snk13_flags", "SELECT s_suppkey, s_suppkey % 4 = 0 AS is_core FROM supplier")
def snk13(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey")
    return frames.flagged(s, s.filter("s_suppkey % 4 = 0").withColumn("is_core", F.lit(True)), "s_suppkey", ["is_core"])


@query("dq01_duplicates", "SELECT count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def dq01(spark, d):
    return flt18(spark, d).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))


@query("dq03_lacking_ids", f"SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_RARE}) ORDER BY 1 LIMIT 10")
def dq03(spark, d):
    return checks.lacking_ids(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").filter(_RARE).select(F.col("o_custkey").alias("k")), "k")


@query("dq04_tolerance", "SELECT s_suppkey, 's_acctbal' AS \"column\", s_acctbal + 1 AS actual, s_acctbal AS expected FROM supplier WHERE s_suppkey % 5 = 0")
def dq04(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    off = s.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal") + 0.0001))
    return checks.differing(off, s, "s_suppkey", ["s_acctbal"])


@query("dq05_declared", "SELECT o_orderkey, 3 AS declared, coalesce(n, 0) AS counted, 3 - coalesce(n, 0) AS gap FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def dq05(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lit(3).alias("declared"))
    return checks.declared_gap(o, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "declared")


@query("dq06_zero_share", "SELECT count(*) AS n, round(100.0 * count(*) FILTER (WHERE n_orders = 0) / count(*), 9) AS pct_zero FROM (SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)")
def dq06(spark, d):
    from citewell.plans.fixture import rounded

    return rounded(checks.zero_share(jn03(spark, d), "n_orders"))


@query("flt09_both_axes", "SELECT c_custkey, a, b FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS b FROM customer) WHERE a IS NOT NULL AND b IS NOT NULL")
def flt09(spark, d):
    k = F.col("c_custkey")
    axes = table(spark, d, "customer").select("c_custkey", F.when(k % 2 == 0, F.col("c_acctbal")).alias("a"), F.when(k % 3 == 0, F.col("c_nationkey")).alias("b"))
    return axes.filter(F.col("a").isNotNull() & F.col("b").isNotNull())


@query("prj03_labels", "SELECT n_nationkey, 'country' AS type, '1995-2001' AS period FROM nation")
def prj03(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.lit("country").alias("type"), F.lit("1995-2001").alias("period"))


@query("prj05_no_double_names", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def prj05(spark, d):
    s = table(spark, d, "supplier").withColumn("n_name", F.lit("clash"))
    n = table(spark, d, "nation")
    return s.drop("n_name").join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", "s_name", "n_name")


@query("nm02_to_numeric", "SELECT c_custkey, coalesce(TRY_CAST(CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'x1' END AS DOUBLE), 0.0) AS v FROM customer")
def nm02(spark, d):
    from citewell.functions.scalars import or_zero

    text = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("x1")
    return table(spark, d, "customer").select("c_custkey", or_zero(text).alias("v"))


@query("js04_json_operator", "SELECT event_id, props ->> '$.k' AS k FROM events")
def js04(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("cast(try_variant_get(try_parse_json(props), '$.k', 'string') as string)").alias("k"))


@query("js05_safe_nested", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Unknown' END AS name FROM supplier")
def js05(spark, d):
    host = F.when(F.col("s_suppkey") % 2 == 0, F.struct(F.struct(F.col("s_name").alias("name")).alias("host")))
    return table(spark, d, "supplier").withColumn("o", host).select("s_suppkey", F.coalesce("o.host.name", F.lit("Unknown")).alias("name"))


@query("dq02_missing_columns", "SELECT * FROM (VALUES ('fwci'), ('percentile')) t(\"column\")")
def dq02(spark, d):
    lacking = checks.missing_columns(table(spark, d, "supplier"), ["s_suppkey", "fwci", "percentile"])
    return spark.createDataFrame([(c,) for c in lacking], "column string")
