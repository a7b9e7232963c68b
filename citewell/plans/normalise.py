"""Snapshot JSON to relational tables, and what a cube reads of a work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.functions.scalars import contains_flag, filled, parsed_once, ratio, scrubbed
from citewell.schemas import INSTITUTION_JSON, SOURCE_JSON, WORK_JSON
from citewell.shared import stored

_JSON = {"work": WORK_JSON, "source": SOURCE_JSON, "institution": INSTITUTION_JSON}


def parsed(raw: DataFrame, kind: str = "work") -> DataFrame:
    """Typed columns of ``id, raw_data`` rows: each document is parsed once, whatever filters follow."""
    return raw.select(parsed_once(F.from_json("raw_data", _JSON[kind])).alias("d")).select("d.*")


def cube_works(works: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """One row a work with the cube's columns and ``more`` of its own; percentiles on a scale of 0 to 1."""
    top = lambda c: F.col(f"primary_topic.{c}display_name")
    p = F.col("citation_normalized_percentile.value")
    return works.select(
        F.col("id").alias("work_id"),
        F.col("primary_location.source.id").alias("journal_id"),
        F.col("publication_year").alias("year"),
        F.col("cited_by_count").cast("long").alias("cited_by_count"),
        F.col("fwci"),
        F.when(p > 1.0, p / 100).otherwise(p).alias("percentile"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_oa"),
        F.coalesce("open_access.oa_status", F.lit("closed")).alias("oa_status"),
        F.col("language"),
        top("domain.").alias("domain"), top("field.").alias("field"), top("subfield.").alias("subfield"), top("").alias("topic"), *more,
    )


def work_tables(works: DataFrame, source_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """The work table and its four child tables, of works at the given sources (``id``) or of all.

    The works are stored once, and each table reads its own columns of them.
    """
    if source_ids is not None:
        ids = source_ids.select(F.col("id").alias("_s")).distinct()
        works = works.join(ids, works["primary_location.source.id"] == ids["_s"], "left_semi")
    works = stored(works, "works")
    plain = "id doi title display_name publication_year publication_date type cited_by_count is_retracted is_paratext cited_by_api_url language fwci".split()
    location, access = F.col("primary_location"), F.col("open_access")
    return {
        "works": works.select(
            *[scrubbed(F.col(c)).alias(c) if c in ("title", "display_name") else c for c in plain],
            F.to_json("abstract_inverted_index").alias("abstract_inverted_index"),
            F.col("citation_normalized_percentile.value").alias("citation_normalized_percentile"),
        ),
        "works_primary_location": works.filter(location.isNotNull()).select(
            F.col("id").alias("work_id"), location["source"]["id"].alias("source_id"), *[location[c].alias(c) for c in ("is_oa", "landing_page_url", "pdf_url", "license", "version")]
        ),
        "works_open_access": works.filter(access.isNotNull()).select(F.col("id").alias("work_id"), *[access[c].alias(c) for c in ("is_oa", "oa_status", "oa_url", "any_repository_has_fulltext")]),
        "works_authorships": authorship_rows(works),
        "works_topics": topic_rows(works),
    }


def authorship_rows(works: DataFrame) -> DataFrame:
    """A row for each authorship and institution; an authorship without institutions keeps one row with null."""
    a = works.select(F.col("id").alias("work_id"), F.explode("authorships").alias("a"))
    return a.select("work_id", F.col("a.author_position").alias("author_position"), F.col("a.author.id").alias("author_id"), F.col("a.raw_affiliation_string").alias("raw_affiliation_string"), F.explode_outer("a.institutions").alias("i")).select(
        "work_id", "author_position", "author_id", F.col("i.id").alias("institution_id"), "raw_affiliation_string"
    )


def topic_rows(works: DataFrame, most: int = 3) -> DataFrame:
    """The first topics of each work; a work without topics has no row."""
    t = works.select(F.col("id").alias("work_id"), F.explode(F.slice("topics", 1, most)).alias("t"))
    return t.select(
        "work_id", F.col("t.id").alias("topic_id"), F.col("t.score").alias("score"), F.col("t.display_name").alias("topic_display_name"),
        F.col("t.field.display_name").alias("field_display_name"), F.col("t.domain.display_name").alias("domain_display_name"),
    )


def source_topics(sources: DataFrame) -> DataFrame:
    """A source's topics with path, count and share; share falls back to percentage, count to works_count, names to Unknown."""
    t = sources.select(F.col("id").alias("journal_id"), F.col("display_name").alias("journal_name"), F.explode("topics").alias("t"))
    name = lambda c: F.coalesce(F.col(f"t.{c}display_name"), F.lit("Unknown"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    return t.select(
        "journal_id", "journal_name", name("").alias("topic_name"), F.col("t.id").alias("topic_id"),
        name("subfield.").alias("subfield"), name("field.").alias("field"), name("domain.").alias("domain"),
        F.when(zero("t.count"), F.coalesce("t.works_count", F.lit(0))).otherwise(F.col("t.count")).alias("count"),
        F.when(zero("t.share"), F.coalesce(F.col("t.percentage") / 100, F.lit(0.0))).otherwise(F.col("t.share")).alias("share"),
    )


def source_metadata(sources: DataFrame) -> DataFrame:
    """Name, ISSN, country and index flags of each source."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    flag = lambda c: filled(F.col(c)).cast("int")
    return sources.select(
        text("id"), text("display_name"), text("issn_l"), text("country_code"), text("type"),
        F.coalesce("is_oa", F.lit(False)).alias("is_oa"), F.coalesce("is_in_doaj", F.lit(False)).alias("is_in_doaj"),
        F.coalesce("summary_stats.h_index", F.lit(0)).alias("h_index"), F.coalesce("summary_stats.i10_index", F.lit(0)).alias("i10_index"),
        F.coalesce("summary_stats.2yr_mean_citedness", F.lit(0.0)).alias("citedness_2yr"),
        flag("ids.scopus").alias("in_scopus"), flag("ids.mag").alias("in_mag"),
        F.greatest(contains_flag(F.col("display_name"), "SciELO"), contains_flag(F.col("host_organization_name"), "SciELO")).alias("in_scielo"),
        F.greatest(contains_flag(F.col("display_name"), "CORE"), flag("ids.fatcat")).alias("in_core"),
    )


def _loaded(rows: DataFrame, countries: Sequence[str] | None, plain: Sequence[str], as_json: Sequence[str], **more: Column) -> DataFrame:
    """Rows of the countries, or all: text scrubbed, nested columns as JSON, counts zero where there are none, the date as a timestamp."""
    if countries is not None:
        rows = rows.filter(F.col("country_code").isin(list(countries)))
    kept = [scrubbed(F.col(c)).alias(c) if dict(rows.dtypes)[c] == "string" else F.col(c) for c in plain]
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("works_count", "cited_by_count")]
    nested = [F.to_json(c).alias(c) for c in as_json]
    return rows.select(*kept, *nested, *counts, F.try_to_timestamp("updated_date").alias("updated_date"), *[v.alias(k) for k, v in more.items()])


def source_table(sources: DataFrame, countries: Sequence[str] | None = None) -> DataFrame:
    """The relational table of sources in the countries given (all by default); a source without a country is in none."""
    no = lambda c: F.coalesce(c, F.lit(False))
    plain = "id issn_l display_name publisher homepage_url works_api_url country_code".split()
    return _loaded(sources, countries, plain, ["issn", "summary_stats"], is_oa=no("is_oa"), is_in_doaj=no("is_in_doaj"), is_scopus=filled(F.col("ids.scopus")))


def institution_table(institutions: DataFrame, countries: Sequence[str] | None = None) -> DataFrame:
    """The relational table of institutions, by the same rules."""
    plain = "id ror display_name country_code type homepage_url image_url image_thumbnail_url works_api_url".split()
    return _loaded(institutions, countries, plain, ["display_name_acronyms", "display_name_alternatives"])


def counts_by_year(sources: DataFrame) -> DataFrame:
    return sources.select("id", F.inline("counts_by_year"))


def entity_years(journal: DataFrame, country: DataFrame, world: DataFrame, names: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Journals, countries and the world in one table: ``id, name, type, year, country_code`` and the figures."""
    j = journal.join(names.select("journal_id", "display_name", "country_code"), "journal_id", "left").select(
        F.col("journal_id").cast("string").alias("id"), F.col("display_name").alias("name"), F.lit("journal").alias("type"), "year", "country_code", *columns
    )
    c = country.select(F.col("country_code").alias("id"), F.col("country_code").alias("name"), F.lit("country").alias("type"), "year", "country_code", *columns)
    w = world.select(F.lit("WORLD").alias("id"), F.lit("World").alias("name"), F.lit("world").alias("type"), "year", F.lit(None).cast("string").alias("country_code"), *columns)
    return j.unionByName(c).unionByName(w)


def journal_profile(works: DataFrame) -> DataFrame:
    """A journal's years by a boolean top-10 mark: documents, mean impact, percentage in the top 10, mean percentile."""
    return works.groupBy("journal_id", "year").agg(
        F.count(F.lit(1)).alias("num_documents"), F.avg("fwci").alias("fwci_avg"),
        ratio(F.count_if(F.coalesce("is_top_10", F.lit(False))), F.count(F.lit(1)), 100.0).alias("pct_top_10"), F.avg("percentile").alias("avg_percentile"),
    )
