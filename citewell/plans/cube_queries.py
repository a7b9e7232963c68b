"""Indicator cubes: aggregates, periods, regions, coverage, statistics, and series over them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from citewell.operators import series
from citewell.plans import cubes, indicators, normalise, slices
from citewell.plans.catalogue import query
from citewell.plans.fixture import JOURNALS_SQL, RECENT, WORKS_SQL, journals, rounded, table, works
from citewell.plans.indicators import LANGUAGES, STATUSES

FIRST, LAST = RECENT


def suite_sql(nulls: str = "zero", languages=LANGUAGES, statuses=STATUSES, digits: int | None = 9) -> str:
    """The indicator suite as SQL select items over the rows of a group."""
    r = (lambda x: f"round({x}, {digits})") if digits is not None else (lambda x: x)
    pct = lambda p: r(f"CASE WHEN count(*) = 0 THEN 0.0 ELSE 100.0 * count(*) FILTER (WHERE {p}) / count(*) END")
    value = (lambda c: f"coalesce({c}, 0)") if nulls == "zero" else (lambda c: c)
    items = [
        "count(*) AS num_documents", "CAST(coalesce(sum(cited_by_count), 0) AS BIGINT) AS total_citations",
        f"{r(f'coalesce(avg({value('fwci')}), 0)')} AS fwci_avg", f"{r(f'100 * coalesce(avg({value('percentile')}), 0)')} AS avg_percentile",
        f"{pct('percentile >= 0.90')} AS pct_top_10", f"{pct('percentile >= 0.99')} AS pct_top_1", f"{pct('is_oa')} AS pct_oa_total",
    ]
    items += [f"{pct(f"oa_status = '{s}'")} AS pct_oa_{s}" for s in statuses]
    items += [f"{pct(f"language = '{x}'")} AS pct_lang_{x}" for x in languages]
    listed = ", ".join(f"'{x}'" for x in languages)
    return ", ".join([*items, f"{pct(f'language IS NULL OR language NOT IN ({listed})')} AS pct_lang_other"])


SUITE = suite_sql()
RAW = suite_sql(digits=None)
FIGURES = [x.rpartition(" AS ")[2] for x in SUITE.replace(" AS BIGINT", "").split(", ") if " AS " in x]


@query("ag01_journal_year", f"WITH {WORKS_SQL} SELECT journal_id, year, {SUITE} FROM works GROUP BY ALL")
def ag01(spark, d):
    return rounded(cubes.annual(works(spark, d), ["journal_id"]))


@query("ag02_counts_to_shares", f"WITH {WORKS_SQL} SELECT region, count(*) AS num_documents, round(100.0 * count(*) FILTER (WHERE oa_status = 'gold') / count(*), 9) AS pct_gold FROM works GROUP BY ALL")
def ag02(spark, d):
    counted = works(spark, d).groupBy("region").agg(F.count(F.lit(1)).alias("num_documents"), F.count_if(F.col("oa_status") == "gold").alias("gold_count"))
    return rounded(indicators.shares(counted))


@query("ag03_indicator_suite", f"WITH {WORKS_SQL} SELECT country_code, year, {SUITE} FROM works GROUP BY ALL")
def ag03(spark, d):
    return rounded(indicators.indicator_cube(works(spark, d), ["country_code", "year"]))


@query("ag04_partial_sums", f"WITH {WORKS_SQL} SELECT region, {SUITE} FROM works GROUP BY ALL")
def ag04(spark, d):
    return rounded(indicators.indicator_cube(works(spark, d), ["region"]))


@query(
    "ag05_top_share_fallback",
    f"WITH {WORKS_SQL} SELECT region, round(100.0 * avg(CAST(coalesce(CASE WHEN language IS NULL THEN NULL ELSE percentile >= 0.9 END, oa_status = 'gold') AS INT)), 9) AS pct_top_10 FROM works GROUP BY ALL",
)
def ag05(spark, d):
    known = F.when(F.col("language").isNotNull(), F.col("percentile") >= 0.9)
    top = F.coalesce(known, F.col("oa_status") == "gold", F.lit(False))
    return rounded(works(spark, d).groupBy("region").agg((100 * F.avg(top.cast("int"))).alias("pct_top_10")))


@query("ag06_conditional_counts", f"WITH {WORKS_SQL} SELECT year, sum(CASE WHEN language = 'es' THEN 1 ELSE 0 END)::BIGINT AS n_es, sum(CASE WHEN percentile >= 0.9 THEN 1 ELSE 0 END)::BIGINT AS n_top FROM works GROUP BY ALL")
def ag06(spark, d):
    return works(spark, d).groupBy("year").agg(F.count_if(F.coalesce(F.col("language") == "es", F.lit(False))).alias("n_es"), F.count_if(F.col("percentile") >= 0.9).alias("n_top"))


@query("ag07_conditional_avg", f"WITH {WORKS_SQL} SELECT journal_id, round(coalesce(avg(fwci) FILTER (WHERE year >= {FIRST} AND language = 'it'), 0), 9) AS fwci_recent_it FROM works GROUP BY ALL")
def ag07(spark, d):
    p = (F.col("year") >= FIRST) & F.coalesce(F.col("language") == "it", F.lit(False))
    return rounded(works(spark, d).groupBy("journal_id").agg(F.coalesce(F.avg(F.when(p, F.col("fwci"))), F.lit(0.0)).alias("fwci_recent_it")))


@query(
    "ag08_dual_period",
    f"WITH {WORKS_SQL} SELECT journal_id, count(*) AS documents_full, round(avg(coalesce(fwci, 0)), 9) AS fwci_full, count(*) FILTER (WHERE year BETWEEN {FIRST} AND {LAST}) AS documents_recent, "
    f"round(coalesce(avg(coalesce(fwci, 0)) FILTER (WHERE year BETWEEN {FIRST} AND {LAST}), 0), 9) AS fwci_recent FROM works GROUP BY ALL",
)
def ag08(spark, d):
    recent = F.col("year").between(FIRST, LAST)
    fwci = F.coalesce("fwci", F.lit(0.0))
    return rounded(works(spark, d).groupBy("journal_id").agg(
        F.count(F.lit(1)).alias("documents_full"), F.avg(fwci).alias("fwci_full"), F.count_if(recent).alias("documents_recent"), F.coalesce(F.avg(F.when(recent, fwci)), F.lit(0.0)).alias("fwci_recent"),
    ))


_ANNUAL = f"cube AS (SELECT journal_id, year, {RAW} FROM works GROUP BY ALL)"
_DENSE = ", ".join(
    f"round(c.{x}, 9) AS {x}" if x.startswith("pct_lang_") else f"coalesce(c.{x}, 0) AS {x}" if x in ("num_documents", "total_citations") else f"round(coalesce(c.{x}, 0), 9) AS {x}" for x in FIGURES
)


@query(
    "ag09_dense_years",
    f"WITH {WORKS_SQL}, {_ANNUAL} SELECT e.journal_id, CAST(y.year AS INT) AS year, {_DENSE} FROM (SELECT DISTINCT journal_id FROM cube) e CROSS JOIN (SELECT unnest(range(1993, 2003)) AS year) y LEFT JOIN cube c ON c.journal_id = e.journal_id AND c.year = y.year",
)
def ag09(spark, d):
    return rounded(cubes.dense(cubes.annual(works(spark, d), ["journal_id"]), ["journal_id"], 1993, 2002))


@query("ag10_period", f"WITH {WORKS_SQL} SELECT country_code, {SUITE}, '1995-2001' AS period FROM works WHERE year BETWEEN 1995 AND 2001 GROUP BY country_code")
def ag10(spark, d):
    return rounded(cubes.period(works(spark, d), ["country_code"], 1995, 2001))


@query("ag11_recent", f"WITH {WORKS_SQL} SELECT country_code, {SUITE}, '{FIRST}-{LAST}' AS period FROM works WHERE year BETWEEN {FIRST} AND {LAST} GROUP BY country_code")
def ag11(spark, d):
    return rounded(cubes.period(works(spark, d), ["country_code"], FIRST, LAST))


@query(
    "ag12_three_levels",
    f"WITH {WORKS_SQL} SELECT 'world' AS level, 'ALL' AS id, {SUITE} FROM works UNION ALL SELECT 'country', country_code, {SUITE} FROM works GROUP BY country_code UNION ALL SELECT 'journal', CAST(journal_id AS VARCHAR), {SUITE} FROM works GROUP BY journal_id",
)
def ag12(spark, d):
    cube = indicators.grouped_cubes(works(spark, d), [[], ["country_code"], ["journal_id"]])
    level = F.element_at(F.array(*map(F.lit, cubes.LEVELS)), F.col("grouping") + 1)
    entity = F.coalesce(F.col("country_code"), F.col("journal_id").cast("string"), F.lit("ALL"))
    return rounded(cube.select(level.alias("level"), entity.alias("id"), *FIGURES))


_CUBE = f"cube AS (SELECT journal_id, country_code, region, year, {RAW} FROM works GROUP BY ALL)"
_MEANS = ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" if x in ("num_documents", "total_citations") else f"round(avg({x}), 9) AS {x}" for x in FIGURES)


@query("ag13_mean_of_ratios", f"WITH {WORKS_SQL}, {_CUBE} SELECT region, year, {_MEANS}, count(DISTINCT journal_id) AS num_journals FROM cube GROUP BY region, year")
def ag13(spark, d):
    cube = cubes.annual(works(spark, d), ["journal_id", "country_code", "region"])
    return rounded(indicators.mean_of_ratios(cube, ["region", "year"], skip=["country_code"], distinct="journal_id"))


@query("ag14_count_distinct", f"WITH {WORKS_SQL} SELECT country_code, year, count(DISTINCT journal_id) AS num_journals FROM works GROUP BY ALL")
def ag14(spark, d):
    return works(spark, d).groupBy("country_code", "year").agg(F.count_distinct("journal_id").alias("num_journals"))


@query("ag15_coverage", f"WITH {JOURNALS_SQL} SELECT country_code, round(100 * avg(CASE WHEN is_oa THEN 1.0 ELSE 0.0 END), 9) AS pct_oa FROM journals GROUP BY ALL")
def ag15(spark, d):
    return rounded(indicators.coverage(journals(spark, d), ["country_code"], ["is_oa"]))


@query(
    "ag16_journal_flags",
    f"WITH {WORKS_SQL} SELECT w.journal_id, count(*) AS num_documents, coalesce(any_value(s.f), false) AS is_core FROM works w LEFT JOIN (SELECT s_suppkey, s_acctbal > 5000 AS f FROM supplier WHERE s_suppkey % 3 <> 0) s ON s.s_suppkey = w.journal_id GROUP BY w.journal_id",
)
def ag16(spark, d):
    from citewell.operators.frames import flagged

    cube = works(spark, d).groupBy("journal_id").agg(F.count(F.lit(1)).alias("num_documents"))
    dim = table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("journal_id"), (F.col("s_acctbal") > 5000).alias("is_core"))
    return flagged(cube, dim, "journal_id", ["is_core"])


@query(
    "ag17_kpis",
    f"WITH {JOURNALS_SQL} SELECT count(*) AS total_journals, CAST(sum(works_count) AS BIGINT) AS total_articles, CAST(sum(cited_by_count) AS BIGINT) AS total_citations, round(100.0 * count(*) FILTER (WHERE is_oa) / count(*), 9) AS percent_oa, round(avg(citedness), 9) AS avg_impact FROM journals",
)
def ag17(spark, d):
    return rounded(slices.key_figures(journals(spark, d)))


@query(
    "ag18_country_stats",
    f"WITH {JOURNALS_SQL} SELECT country_code, count(*) AS num_journals, CAST(sum(works_count) AS BIGINT) AS works_count, CAST(sum(cited_by_count) AS BIGINT) AS cited_by_count, round(avg(citedness), 9) AS avg_impact_factor, round(100.0 * count(*) FILTER (WHERE is_oa) / count(*), 9) AS percent_oa FROM journals GROUP BY country_code",
)
def ag18(spark, d):
    return rounded(slices.country_figures(journals(spark, d)))


@query("ag27_value_counts", f"WITH {WORKS_SQL} SELECT oa_status, count(*) AS n FROM works GROUP BY ALL")
def ag27(spark, d):
    return works(spark, d).groupBy("oa_status").agg(F.count(F.lit(1)).alias("n"))


@query("ag28_year_range", f"WITH {WORKS_SQL} SELECT min(year) AS first_year, max(year) AS last_year FROM works")
def ag28(spark, d):
    return works(spark, d).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


_JC = f"jc AS (SELECT journal_id, {RAW} FROM works GROUP BY journal_id)"


@query("ag30_summary", f"WITH {WORKS_SQL}, {_JC} SELECT count(fwci_avg) AS n, round(avg(fwci_avg), 9) AS mean, round(stddev_samp(fwci_avg), 9) AS std, round(min(fwci_avg), 9) AS min, round(quantile_cont(fwci_avg, 0.25), 9) AS q1, round(quantile_cont(fwci_avg, 0.5), 9) AS q2, round(quantile_cont(fwci_avg, 0.75), 9) AS q3, round(max(fwci_avg), 9) AS max FROM jc")
def ag30(spark, d):
    return rounded(slices.summary(indicators.indicator_cube(works(spark, d), ["journal_id"]), "fwci_avg"))


@query("ag31_stats", f"WITH {WORKS_SQL}, {_JC} SELECT count(pct_oa_gold) AS n, round(avg(pct_oa_gold), 9) AS mean, round(median(pct_oa_gold), 9) AS median, round(stddev_samp(pct_oa_gold), 9) AS std, round(min(pct_oa_gold), 9) AS min, round(max(pct_oa_gold), 9) AS max FROM jc")
def ag31(spark, d):
    return rounded(slices.statistics(indicators.indicator_cube(works(spark, d), ["journal_id"]), "pct_oa_gold"))


@query("ag32_corr", f"WITH {WORKS_SQL}, {_JC} SELECT count(*) AS n, round(corr(fwci_avg, avg_percentile), 9) AS r FROM jc")
def ag32(spark, d):
    return rounded(slices.correlation(indicators.indicator_cube(works(spark, d), ["journal_id"]), "fwci_avg", "avg_percentile"))


@query("ag33_boolean_share", f"WITH {JOURNALS_SQL} SELECT count(*) FILTER (WHERE is_oa) AS n_oa, round(100.0 * count(*) FILTER (WHERE is_oa) / count(*), 9) AS pct_oa FROM journals")
def ag33(spark, d):
    return rounded(journals(spark, d).agg(F.count_if("is_oa").alias("n_oa"), (100.0 * F.count_if("is_oa") / F.count(F.lit(1))).alias("pct_oa")))


@query("ag34_weighted_kpi", f"WITH {WORKS_SQL}, {_JC} SELECT round(sum(num_documents * pct_oa_diamond / 100), 4) AS diamond_documents FROM jc")
def ag34(spark, d):
    return rounded(indicators.indicator_cube(works(spark, d), ["journal_id"]).agg(F.sum(F.col("num_documents") * F.col("pct_oa_diamond") / 100).alias("diamond_documents")), 4)


@query("ag35_top_keys", f"WITH {WORKS_SQL} SELECT journal_id, count(*) AS n FROM works GROUP BY ALL ORDER BY n DESC, journal_id LIMIT 10")
def ag35(spark, d):
    return works(spark, d).groupBy("journal_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "journal_id").limit(10)


@query("ag36_entity_counts", "SELECT 'orders' AS entity, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part")
def ag36(spark, d):
    made = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("entity"), "n") for t in ("orders", "customer", "part")]
    return made[0].union(made[1]).union(made[2])


@query(
    "ag37_detect_scale",
    f"WITH {WORKS_SQL}, m AS (SELECT journal_id, CASE WHEN journal_id % 2 = 0 THEN percentile * 100 ELSE percentile END AS p FROM works) SELECT journal_id, CASE WHEN max(p) > 1 THEN 100 ELSE 1 END AS scale, "
    "round(100.0 * count(*) FILTER (WHERE p >= CASE WHEN m2 > 1 THEN 90 ELSE 0.9 END) / count(*), 9) AS pct_top_10 FROM (SELECT *, max(p) OVER (PARTITION BY journal_id) AS m2 FROM m) GROUP BY journal_id",
)
def ag37(spark, d):
    mixed = works(spark, d).withColumn("percentile", F.when(F.col("journal_id") % 2 == 0, F.col("percentile") * 100).otherwise(F.col("percentile")))
    return rounded(indicators.percentile_scale(mixed, keys=["journal_id"]))


@query("xf10_journal_profile", f"WITH {WORKS_SQL} SELECT journal_id, year, count(*) AS num_documents, round(avg(fwci), 9) AS fwci_avg, round(100.0 * count(*) FILTER (WHERE percentile >= 0.9) / count(*), 9) AS pct_top_10, round(avg(percentile), 9) AS avg_percentile FROM works GROUP BY ALL")
def xf10(spark, d):
    return rounded(normalise.journal_profile(works(spark, d).withColumn("is_top_10", F.col("percentile") >= 0.9)))


@query("xf08_oa_impact", f"WITH {JOURNALS_SQL} SELECT journal_id AS id, citedness, works_count, CASE WHEN is_oa THEN 'Open Access' ELSE 'Closed' END AS access FROM journals")
def xf08(spark, d):
    return slices.open_access_and_impact(journals(spark, d).withColumnRenamed("journal_id", "id"))


_CY = f"cy AS (SELECT country_code, year, CASE WHEN (year + length(country_code)) % 4 = 0 THEN NULL ELSE avg(coalesce(fwci, 0)) END AS fwci_avg, count(*) AS num_documents FROM works GROUP BY country_code, year)"


def country_years(spark, d):
    """A country by year series with gaps in one figure."""
    gap = (F.col("year") + F.length("country_code")) % 4 == 0
    cube = works(spark, d).groupBy("country_code", "year").agg(F.avg(F.coalesce("fwci", F.lit(0.0))).alias("fwci_avg"), F.count(F.lit(1)).alias("num_documents"))
    return cube.withColumn("fwci_avg", F.when(~gap, F.col("fwci_avg")))


def _ema_sql(window: int) -> str:
    half = window // 2
    term = lambda k: f"{'lag' if k < 0 else 'lead'}(fwci_avg, {abs(k)}) OVER w" if k else "fwci_avg"
    top = " + ".join(f"coalesce({term(k)} * {math.exp(-abs(k))!r}, 0)" for k in range(-half, half + 1))
    low = " + ".join(f"CASE WHEN {term(k)} IS NULL THEN 0 ELSE {math.exp(-abs(k))!r} END" for k in range(-half, half + 1))
    return f"WITH {WORKS_SQL}, {_CY} SELECT country_code, year, round(({top}) / nullif({low}, 0), 9) AS fwci_avg, num_documents FROM cy WINDOW w AS (PARTITION BY country_code ORDER BY year)"


@query("wn01_ema3", _ema_sql(3))
def wn01_3(spark, d):
    return rounded(series.smoothed(country_years(spark, d), ["country_code"], ["fwci_avg"], 3))


@query("wn01_ema5", _ema_sql(5))
def wn01_5(spark, d):
    return rounded(series.smoothed(country_years(spark, d), ["country_code"], ["fwci_avg"], 5))


@query("wn02_centered", f"WITH {WORKS_SQL}, {_CY} SELECT country_code, year, round(avg(fwci_avg) OVER (PARTITION BY country_code ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS fwci_avg, num_documents FROM cy")
def wn02(spark, d):
    return rounded(series.centred_mean(country_years(spark, d), ["country_code"], ["fwci_avg"], 3))


@query("wn03_trailing", f"WITH {WORKS_SQL}, {_CY} SELECT country_code, year, round(avg(fwci_avg) OVER (PARTITION BY country_code ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS fwci_avg, num_documents FROM cy")
def wn03(spark, d):
    return rounded(series.trailing_mean(country_years(spark, d), ["country_code"], ["fwci_avg"], 3))


@query("wn04_group_totals", f"WITH {WORKS_SQL}, {_CY} SELECT country_code, year, num_documents, CAST(sum(num_documents) OVER (PARTITION BY country_code) AS BIGINT) AS total, count(*) OVER (PARTITION BY country_code) AS years FROM cy")
def wn04(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("country_code")
    return country_years(spark, d).select("country_code", "year", "num_documents", F.sum("num_documents").over(w).alias("total"), F.count(F.lit(1)).over(w).alias("years"))


@query("wn07_max_norm", f"WITH {WORKS_SQL}, {_JC} SELECT journal_id, round(fwci_avg / max(fwci_avg) OVER (), 9) AS fwci_avg, round(CASE WHEN max(pct_lang_zh) OVER () > 0 THEN pct_lang_zh / max(pct_lang_zh) OVER () ELSE 0 END, 9) AS pct_lang_zh FROM jc")
def wn07(spark, d):
    cube = indicators.indicator_cube(works(spark, d), ["journal_id"]).select("journal_id", "fwci_avg", "pct_lang_zh")
    return rounded(series.max_normalised(cube, ["fwci_avg", "pct_lang_zh"]))


@query("wn10_latest", f"WITH {WORKS_SQL}, {_CY} SELECT country_code, max(year) AS year, arg_max(num_documents, year) AS num_documents FROM cy GROUP BY country_code")
def wn10(spark, d):
    return series.latest(country_years(spark, d).select("country_code", "year", "num_documents"), ["country_code"])


@query("xf03_entity_years", f"""WITH {JOURNALS_SQL} SELECT CAST(w.journal_id AS VARCHAR) AS id, any_value(j.display_name) AS name, 'journal' AS type, w.year AS year, any_value(j.country_code) AS country_code, count(*) AS num_documents FROM works w JOIN journals j USING (journal_id) GROUP BY w.journal_id, w.year
UNION ALL SELECT country_code, country_code, 'country', year, country_code, count(*) FROM works GROUP BY country_code, year UNION ALL SELECT 'WORLD', 'World', 'world', year, NULL, count(*) FROM works GROUP BY year""")
def xf03(spark, d):
    w = works(spark, d)
    count = lambda *keys: w.groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("num_documents"))
    return normalise.entity_years(count("journal_id"), count("country_code"), count(), journals(spark, d), ["num_documents"])


def _trajectories_sql() -> str:
    parts = [(1, f"WITH {WORKS_SQL}, {_CY} SELECT country_code, year, round(fwci_avg, 9) AS fwci_avg, num_documents FROM cy"), (3, _ema_sql(3)), (5, _ema_sql(5))]
    return " UNION ALL ".join(f'SELECT country_code, year, fwci_avg, num_documents, {n} AS "window" FROM ({sql})' for n, sql in parts)


@query("xf04_trajectories", _trajectories_sql())
def xf04(spark, d):
    base = country_years(spark, d)
    both = [series.smoothed(base, ["country_code"], ["fwci_avg"], n).withColumn("window", F.lit(n)) for n in (3, 5)]
    return rounded(base.withColumn("window", F.lit(1)).unionByName(both[0]).unionByName(both[1]))


@query("xf06_incremental", f"WITH {WORKS_SQL} SELECT journal_id, {SUITE} FROM works GROUP BY journal_id")
def xf06(spark, d):
    from citewell.plans.source_queries import folder

    w, path = works(spark, d), folder(spark, "cubes")
    cubes.build_cubes(w.filter("journal_id % 2 = 0"), path, RECENT, years=cubes.year_range(w))
    made = cubes.build_cubes(w, path, RECENT, incremental=True)
    return rounded(made.filter("level = 'journal' and kind = 'period'").select(F.col("entity").cast("long").alias("journal_id"), *FIGURES))


def _levels_sql(suite: str) -> str:
    """All levels and kinds over ``works``."""
    made = []
    for level, key in (("world", "'ALL'"), ("country", "country_code"), ("journal", "CAST(journal_id AS VARCHAR)")):
        by = "" if level == "world" else f", {key}"
        made.append(f"SELECT '{level}' AS level, 'annual' AS kind, {key} AS entity, year, NULL AS period, {suite} FROM works GROUP BY year{by}")
        made.append(f"SELECT '{level}', 'period', {key}, NULL, min(lo) || '-' || min(hi), {suite} FROM works, span GROUP BY ALL")
        made.append(f"SELECT '{level}', 'recent', {key}, NULL, '{FIRST}-{LAST}', {suite} FROM works WHERE year BETWEEN {FIRST} AND {LAST} GROUP BY ALL")
    return " UNION ALL ".join(made)


def _dated(spark, d):
    """Works with a number and a date of their last update."""
    line = table(spark, d, "lineitem")
    keys = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return works(spark, d, more=[F.xxhash64(*keys.columns).alias("work_id"), F.col("l_shipdate").alias("updated")])


@query("xf06_state_refresh", f"WITH {WORKS_SQL}, span AS (SELECT min(year) AS lo, max(year) AS hi FROM works) {_levels_sql(SUITE)}")
def xf06_state(spark, d):
    """A state of an earlier day, with works missing, other and since removed, brought up to date."""
    from citewell.plans.cube_state import CubeState
    from citewell.shared import shared_path

    now = _dated(spark, d)
    k = F.pmod(F.col("work_id"), F.lit(11))
    early = F.col("updated") - F.expr("INTERVAL 1 DAY")
    other = now.filter((k != 0) | (F.col("journal_id") % 3 == 0))
    other = other.withColumns({c: F.when((k == 1) & (F.col("journal_id") % 3 == 1), x).otherwise(F.col(c)) for c, x in (("cited_by_count", F.lit(0).cast("long")), ("updated", early))})
    removed = now.filter("journal_id % 5 = 4").withColumns({"work_id": F.col("work_id") + 1, "journal_id": F.col("journal_id") + 1_000_000})
    state = CubeState(shared_path(spark, "state"))
    state.build(other.unionByName(removed))
    state.refresh(now)
    return rounded(state.cubes(spark, RECENT).select("level", "kind", "entity", "year", "period", *FIGURES))


@query("s14_sketches")
def s14_sketches(spark, d):
    """Distinct topics and quartiles of impact of all levels, merged up from one pass over the works."""
    from citewell.plans.cube_state import CubeState
    from citewell.shared import shared_path

    state = CubeState(shared_path(spark, "state"), distinct=["topic"], quantiles=["fwci"])
    state.build(_dated(spark, d))
    made = state.cubes(spark, RECENT).filter("kind != 'annual'")
    return made.select("level", "kind", "entity", "num_documents", "distinct_topic", *[F.col("fwci_quantiles")[i].alias(f"fwci_q{i + 1}") for i in range(3)])


@query("xf09_with_originals", f"WITH {WORKS_SQL}, {_CY} SELECT country_code, year, round(avg(fwci_avg) OVER (PARTITION BY country_code ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS fwci_avg, round(fwci_avg, 9) AS fwci_avg_orig FROM cy")
def xf09(spark, d):
    base = country_years(spark, d)
    smooth = series.trailing_mean(base, ["country_code"], ["fwci_avg"], 3).select("country_code", "year", "fwci_avg")
    return rounded(smooth.join(base.select("country_code", "year", F.col("fwci_avg").alias("fwci_avg_orig")), ["country_code", "year"], "left"))
