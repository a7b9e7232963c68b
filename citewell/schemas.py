"""Canonical column names and types of works, sources and their child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class MissingColumns(ValueError):
    """A table lacks columns that a cube needs; silent zeros would be the alternative."""


def struct(ddl: str) -> T.StructType:
    """A schema from its text; needs a running session, so texts are what modules keep."""
    return T.StructType.fromDDL(ddl)


#: A work as it stands in a snapshot's JSON, as schema text.
WORK_JSON = """id string, doi string, title string, display_name string, publication_year int, publication_date string, type string, language string,
    cited_by_count int, fwci double, is_retracted boolean, is_paratext boolean, cited_by_api_url string,
    citation_normalized_percentile struct<value: double, is_in_top_1_percent: boolean, is_in_top_10_percent: boolean>,
    open_access struct<is_oa: boolean, oa_status: string, oa_url: string, any_repository_has_fulltext: boolean>,
    primary_location struct<is_oa: boolean, landing_page_url: string, pdf_url: string, license: string, version: string, source: struct<id: string>>,
    locations array<struct<source: struct<id: string>>>,
    primary_topic struct<display_name: string, subfield: struct<display_name: string>, field: struct<display_name: string>, domain: struct<display_name: string>>,
    topics array<struct<id: string, display_name: string, score: double, field: struct<display_name: string>, domain: struct<display_name: string>>>,
    authorships array<struct<author: struct<id: string>, author_position: string, raw_affiliation_string: string, institutions: array<struct<id: string>>>>,
    abstract_inverted_index map<string, array<int>>"""

#: A source (journal) as it stands in a snapshot's JSON, as schema text.
SOURCE_JSON = """id string, display_name string, issn_l string, issn array<string>, publisher string, host_organization_name string, country_code string, type string,
    is_oa boolean, is_in_doaj boolean, is_core boolean, is_ojs boolean, is_in_scielo boolean, works_count int, cited_by_count int, homepage_url string, works_api_url string, updated_date string,
    summary_stats struct<h_index: int, i10_index: int, `2yr_mean_citedness`: double>, ids struct<scopus: string, mag: string, fatcat: string>,
    topics array<struct<id: string, display_name: string, count: bigint, works_count: bigint, share: double, percentage: double,
      subfield: struct<display_name: string>, field: struct<display_name: string>, domain: struct<display_name: string>>>,
    counts_by_year array<struct<year: int, works_count: bigint, cited_by_count: bigint>>"""

#: An institution as it stands in a snapshot's JSON, as schema text.
INSTITUTION_JSON = """id string, ror string, display_name string, country_code string, type string, homepage_url string, image_url string, image_thumbnail_url string,
    display_name_acronyms array<string>, display_name_alternatives array<string>, works_count int, cited_by_count int, works_api_url string, updated_date string"""

#: What the indicator cubes read of a work, one row each.
WORK_COLUMNS = (
    "journal_id year cited_by_count fwci percentile is_oa oa_status language domain field subfield topic".split()
)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise MissingColumns(f"missing columns: {', '.join(lacking)}; there are {', '.join(df.columns)}")
    return df
