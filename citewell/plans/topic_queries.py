"""Topic hierarchy, shares, pivots and tables over topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.operators import frames
from citewell.plans import indicators, topics
from citewell.plans.catalogue import query
from citewell.plans.fixture import RECENT, WORKS_SQL, rounded, table, works

FIRST, LAST = RECENT
YEARS = list(range(1995, 2002))

_FINE = f"fine AS (SELECT country_code, domain, field, subfield, topic, count(*) AS n, avg(coalesce(fwci, 0)) AS f, count(*) FILTER (WHERE year >= {FIRST}) AS nr, coalesce(avg(coalesce(fwci, 0)) FILTER (WHERE year >= {FIRST}), 0) AS fr FROM works GROUP BY country_code, domain, field, subfield, topic)"


@query("ag19_weighted", f"WITH {WORKS_SQL}, {_FINE} SELECT domain, CAST(sum(n) AS BIGINT) AS documents_full, round(sum(f * n) / sum(n), 3) AS fwci_full FROM fine GROUP BY domain", nudge=False)
def ag19(spark, d):
    fine = topics.fine_grain(works(spark, d), ["country_code"], FIRST)
    return indicators.weighted(fine, ["domain"], ["fwci_full"], weight="documents_full", digits=3)


@query(
    "ag20_topic_levels",
    f"""WITH {WORKS_SQL}, {_FINE}
SELECT country_code, coalesce(domain, 'ALL') AS domain, CASE WHEN grouping(field) = 1 THEN 'ALL' ELSE field END AS field, CASE WHEN grouping(subfield) = 1 THEN 'ALL' ELSE subfield END AS subfield,
  CASE WHEN grouping(topic) = 1 THEN 'ALL' ELSE topic END AS topic,
  CASE WHEN grouping(field) = 1 THEN 'domain' WHEN grouping(subfield) = 1 THEN 'field' WHEN grouping(topic) = 1 THEN 'subfield' ELSE 'topic' END AS level,
  CAST(sum(n) AS BIGINT) AS documents_full, round(sum(f * n) / sum(n), 9) AS fwci_full, CAST(sum(nr) AS BIGINT) AS documents_recent, round(CASE WHEN sum(nr) = 0 THEN 0 ELSE sum(fr * nr) / sum(nr) END, 9) AS fwci_recent
FROM fine GROUP BY GROUPING SETS ((country_code, domain), (country_code, domain, field), (country_code, domain, field, subfield), (country_code, domain, field, subfield, topic))""",
)
def ag20(spark, d):
    return rounded(topics.levels(topics.fine_grain(works(spark, d), ["country_code"], FIRST), ["country_code"]))


_PATH_SQL = ("domain", "field", "subfield", "topic")
_UNION_SQL = " UNION ALL ".join(
    f"SELECT country_code, {', '.join(c if i <= n else f"'ALL' AS {c}" for i, c in enumerate(_PATH_SQL))}, '{_PATH_SQL[n]}' AS level, count(*) AS documents_full FROM works GROUP BY country_code, {', '.join(_PATH_SQL[: n + 1])}"
    for n in range(4)
)


@query("st03_level_union", f"WITH {WORKS_SQL} {_UNION_SQL}")
def st03(spark, d):
    """Each level by itself from the fine cube, put together by name."""
    fine = works(spark, d).groupBy("country_code", *topics.PATH).agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for n, level in enumerate(topics.PATH):
        part = fine.groupBy("country_code", *topics.PATH[: n + 1]).agg(F.sum("n").alias("documents_full"))
        parts.append(part.withColumns({c: F.lit("ALL") for c in topics.PATH[n + 1 :]} | {"level": F.lit(level)}))
    return reduce(DataFrame.unionByName, parts)


@query(
    "ag21_rollup",
    f"""WITH {WORKS_SQL} SELECT country_code, CASE WHEN grouping(domain) = 1 THEN 'ALL' ELSE domain END AS domain, CASE WHEN grouping(field) = 1 THEN 'ALL' ELSE field END AS field,
  CASE WHEN grouping(subfield) = 1 THEN 'ALL' ELSE subfield END AS subfield,
  CASE WHEN grouping(domain) = 1 THEN 'total' WHEN grouping(field) = 1 THEN 'domain' WHEN grouping(subfield) = 1 THEN 'field' ELSE 'subfield' END AS level, count(*) AS num_documents
FROM works GROUP BY GROUPING SETS ((country_code), (country_code, domain), (country_code, domain, field), (country_code, domain, field, subfield))""",
)
def ag21(spark, d):
    return topics.rollup_levels(works(spark, d), ["country_code"])


@query("ag22_evolution", f"WITH {WORKS_SQL} SELECT journal_id, year, domain, field, subfield, topic, count(*) AS num_documents FROM works WHERE year BETWEEN 1996 AND 2000 GROUP BY ALL")
def ag22(spark, d):
    return topics.evolution(works(spark, d), ["journal_id"], 1996, 2000)


_CD = "cd AS (SELECT country_code, domain, count(*) AS num_documents FROM works GROUP BY country_code, domain)"


@query("ag23_country_share", f"WITH {WORKS_SQL}, {_CD} SELECT country_code, domain, num_documents, round(num_documents / sum(num_documents) OVER (PARTITION BY country_code), 9) AS share FROM cd")
def ag23(spark, d):
    counts = works(spark, d).groupBy("country_code", "domain").agg(F.count(F.lit(1)).alias("num_documents"))
    return rounded(topics.share_of_total(counts, ["country_code"], "num_documents"))


@query(
    "ag24_topic_suite_skip",
    f"WITH {WORKS_SQL} SELECT domain, count(*) AS num_documents, round(coalesce(avg(fwci), 0), 9) AS fwci_avg, round(100 * avg(percentile), 9) AS avg_percentile FROM works GROUP BY ALL",
)
def ag24(spark, d):
    return rounded(indicators.indicator_cube(works(spark, d), ["domain"], nulls="skip").select("domain", "num_documents", "fwci_avg", "avg_percentile"))


_SHARES = "raw AS (SELECT l_suppkey AS id, p_type AS domain, count(*) AS k FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), shares AS (SELECT id, domain, CASE WHEN id % 5 = 0 THEN 0.0 ELSE k / 1000.0 END AS share FROM raw), "
_NORM = "norm AS (SELECT id, domain, CASE WHEN sum(share) OVER (PARTITION BY id) <= 0 THEN 1.0 / count(*) OVER (PARTITION BY id) ELSE share / sum(share) OVER (PARTITION BY id) END AS share FROM shares)"


def _shares(spark, d):
    raw = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_suppkey").alias("id"), F.col("p_type").alias("domain")).agg(F.count(F.lit(1)).alias("k"))
    return raw.select("id", "domain", F.when(F.col("id") % 5 == 0, 0.0).otherwise(F.col("k") / 1000.0).alias("share"))


@query("wn06_share_norm", f"WITH {_SHARES}{_NORM} SELECT id, domain, round(share, 9) AS share FROM norm")
def wn06(spark, d):
    return rounded(topics.normalised_shares(_shares(spark, d), ["id"]))


@query("ag25_fractional", f"WITH {WORKS_SQL}, {_SHARES}{_NORM} SELECT year, domain, round(sum(n * share), 9) AS count FROM (SELECT journal_id AS id, year, count(*) AS n FROM works GROUP BY ALL) JOIN norm USING (id) GROUP BY year, domain")
def ag25(spark, d):
    counts = works(spark, d).groupBy(F.col("journal_id").alias("id"), "year").agg(F.count(F.lit(1)).alias("num_documents"))
    return rounded(topics.fractional(counts, topics.normalised_shares(_shares(spark, d), ["id"]), "id", ["year", "domain"]))


@query("wn05_share", f"WITH {WORKS_SQL} SELECT region, oa_status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY region), 9) AS share FROM works GROUP BY region, oa_status")
def wn05(spark, d):
    return rounded(topics.share_of_total(works(spark, d).groupBy("region", "oa_status").agg(F.count(F.lit(1)).alias("n")), ["region"], "n"))


@query(
    "jn06_full_outer",
    f"WITH {WORKS_SQL}, a AS (SELECT journal_id, topic, count(*) AS n FROM works GROUP BY ALL), b AS (SELECT journal_id, topic, count(*) AS n FROM works WHERE year >= {FIRST} GROUP BY ALL) SELECT coalesce(a.journal_id, b.journal_id) AS journal_id, coalesce(a.topic, b.topic) AS topic, coalesce(a.n, 0) AS documents_full, coalesce(b.n, 0) AS documents_recent FROM a FULL OUTER JOIN b ON a.journal_id = b.journal_id AND a.topic = b.topic",
)
def jn06(spark, d):
    return topics.full_and_recent(works(spark, d), ["journal_id", "topic"], FIRST)


@query("jn07_fan_out", f"WITH {WORKS_SQL}, {_SHARES}x AS (SELECT 1) SELECT c.id AS id, c.year AS year, s.domain AS domain, c.n AS num_documents FROM (SELECT journal_id AS id, year, count(*) AS n FROM works GROUP BY ALL) c JOIN shares s ON s.id = c.id")
def jn07(spark, d):
    counts = works(spark, d).groupBy(F.col("journal_id").alias("id"), "year").agg(F.count(F.lit(1)).alias("num_documents"))
    return counts.join(_shares(spark, d).select("id", "domain"), "id")


def _pivot_sql(rows: str, where: str = "TRUE") -> str:
    columns = ", ".join(f'CAST(count(*) FILTER (WHERE year = {y}) AS BIGINT) AS "{y}"' for y in YEARS)
    return f'WITH {WORKS_SQL} SELECT {rows}, {columns}, CAST(count(*) AS BIGINT) AS "Total" FROM works WHERE {where} GROUP BY {rows}'


def _counts(spark, d, *keys):
    return works(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("rs01_pivot_year", _pivot_sql("domain"))
def rs01(spark, d):
    return frames.pivot_sum(_counts(spark, d, "domain", "year"), "domain", "year", YEARS, "n")


@query("rs02_profile", f"SELECT * FROM ({_pivot_sql('country_code')}) UNION ALL SELECT 'Total', * EXCLUDE (country_code) FROM (SELECT 'x' AS country_code, {', '.join(f'CAST(sum("{y}") AS BIGINT)' for y in YEARS)}, CAST(sum(\"Total\") AS BIGINT) FROM ({_pivot_sql('country_code')}))")
def rs02(spark, d):
    made = frames.pivot_sum(_counts(spark, d, "country_code", "year"), "country_code", "year", YEARS, "n")
    return frames.with_total_row(made, "country_code", [*map(str, YEARS), "Total"])


_STATES = ("gold", "green", "hybrid", "bronze", "diamond", "closed")


@query("rs03_pivot_table", f"WITH {WORKS_SQL} SELECT journal_id, {', '.join(f'CAST(count(*) FILTER (WHERE oa_status = {chr(39)}{s}{chr(39)}) AS BIGINT) AS {s}' for s in _STATES)} FROM works GROUP BY journal_id")
def rs03(spark, d):
    return frames.pivot_sum(_counts(spark, d, "journal_id", "oa_status"), "journal_id", "oa_status", _STATES, "n", total=None)


_OA = ", ".join(f"100.0 * count(*) FILTER (WHERE oa_status = '{s}') / count(*) AS pct_oa_{s}" for s in _STATES)


@query("rs04_unpivot_oa", " UNION ALL ".join(f"SELECT journal_id, '{s.capitalize()}' AS label, round(pct_oa_{s}, 9) AS pct FROM (WITH {WORKS_SQL} SELECT journal_id, {_OA} FROM works GROUP BY journal_id) WHERE pct_oa_{s} <> 0" for s in _STATES))
def rs04(spark, d):
    cube = indicators.indicator_cube(works(spark, d), ["journal_id"]).select("journal_id", *[f"pct_oa_{s}" for s in _STATES])
    return rounded(frames.melted(cube, ["journal_id"], "pct_oa_"))


@query("rs05_share_list", " UNION ALL ".join(f"SELECT '{s}' AS label, round(pct_oa_{s}, 9) AS pct FROM (WITH {WORKS_SQL} SELECT {_OA} FROM works)" for s in _STATES))
def rs05(spark, d):
    cube = indicators.indicator_cube(works(spark, d), []).select(*[F.col(f"pct_oa_{s}").alias(s) for s in _STATES])
    return rounded(cube.unpivot([], list(_STATES), "label", "pct"))


@query("sl03_top_k", f"WITH {WORKS_SQL} SELECT topic, count(*) AS n FROM works GROUP BY topic ORDER BY n DESC, topic LIMIT 30")
def sl03(spark, d):
    return frames.top_members(_counts(spark, d, "topic", "year"), "topic", "n", 30)


@query("sl04_top_columns", f"WITH {WORKS_SQL}, top AS (SELECT field, count(*) AS n FROM works GROUP BY field ORDER BY n DESC, field LIMIT 5) SELECT country_code, field, count(*) AS n FROM works WHERE field IN (SELECT field FROM top) GROUP BY country_code, field")
def sl04(spark, d):
    counts = _counts(spark, d, "country_code", "field")
    return counts.join(F.broadcast(frames.top_members(counts, "field", "n", 5).select("field")), "field", "left_semi").select("country_code", "field", "n")


@query("sl04b_pivot_top", f"WITH {WORKS_SQL}, top AS (SELECT field, count(*) AS n FROM works GROUP BY field ORDER BY n DESC, field LIMIT 5), chosen AS (SELECT country_code, field, count(*) AS n FROM works WHERE field IN (SELECT field FROM top) GROUP BY country_code, field) SELECT c.country_code AS country_code, t.field AS field, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT country_code FROM chosen) c CROSS JOIN (SELECT field FROM top) t LEFT JOIN chosen s ON s.country_code = c.country_code AND s.field = t.field")
def sl04b(spark, d):
    """The matrix, told cell by cell as its columns depend on the data."""
    made = frames.pivot_top(_counts(spark, d, "country_code", "field"), "country_code", "field", "n", 5)
    return made.unpivot(["country_code"], [f"`{c}`" for c in made.columns if c != "country_code"], "field", "n")


@query("sl05_distinct_values", f"WITH {WORKS_SQL} SELECT DISTINCT domain, field FROM works ORDER BY 1, 2")
def sl05(spark, d):
    return works(spark, d).select("domain", "field").distinct().orderBy("domain", "field")


@query("prj09_level_path", f"WITH {WORKS_SQL} SELECT DISTINCT concat_ws('||', domain, field, subfield) AS id, concat_ws('||', domain, field) AS parent, subfield AS label FROM works")
def prj09(spark, d):
    return works(spark, d).select(F.concat_ws("||", "domain", "field", "subfield").alias("id"), F.concat_ws("||", "domain", "field").alias("parent"), F.col("subfield").alias("label")).distinct()


@query("flt10_any_nonzero", f"WITH {WORKS_SQL}, c AS (SELECT journal_id, year, count(*) FILTER (WHERE language = 'it' AND percentile > 0.99) AS a, count(*) FILTER (WHERE oa_status = 'gold' AND percentile > 0.99) AS b FROM works GROUP BY ALL) SELECT * FROM c WHERE a <> 0 OR b <> 0")
def flt10(spark, d):
    high = F.col("percentile") > 0.99
    c = works(spark, d).groupBy("journal_id", "year").agg(F.count_if(F.coalesce((F.col("language") == "it") & high, F.lit(False))).alias("a"), F.count_if((F.col("oa_status") == "gold") & high).alias("b"))
    return c.filter(frames.any_nonzero(["a", "b"]))


@query("flt12_last_years", f"WITH {WORKS_SQL} SELECT year, count(*) AS n FROM works WHERE year >= (SELECT max(year) - 2 FROM works) GROUP BY year")
def flt12(spark, d):
    return frames.last_years(_counts(spark, d, "year"), 2)


@query("flt13_latest_year", f"WITH {WORKS_SQL} SELECT country_code, year, count(*) AS n FROM works WHERE year = (SELECT max(year) FROM works) GROUP BY ALL")
def flt13(spark, d):
    return frames.latest_year(_counts(spark, d, "country_code", "year"))


@query("ag29_label_lists", f"WITH {WORKS_SQL} SELECT region, string_agg(c, ', ' ORDER BY c) AS countries FROM (SELECT DISTINCT region, country_code AS c FROM works) GROUP BY region")
def ag29(spark, d):
    return works(spark, d).groupBy("region").agg(F.array_join(F.array_sort(F.collect_set("country_code")), ", ").alias("countries"))
