"""The catalogue: names, SQL twins and results against DuckDB for a sample of queries."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
SAMPLE = "ag01_journal_year ag09_dense_years ag13_mean_of_ratios ag20_topic_levels ag21_rollup wn01_ema3 wn08_keep_last rs01_pivot_year rs04_unpivot_oa jn13_year_diff ar02_abstract src02_snapshot_cube".split()
SAMPLE += "snk03_codec_row_groups snk04_part_files snk05_csv_export snk08_declared_table snk14_guarded_keys st05_append rs08_location_access rs10_topic_paths xf01_source_table xf01_institution_table sl02_mixed_sort".split()

SAMPLE += "s14_sessions s14_asof_nearest s14_interval_join s14_global_ranks s14_quantiles_by_group s14_nested_rows s14_first_rows snk06_matrix ar03_country_codes xf01_work_tables xf06_state_refresh ag30_summary".split()


def plain(rows):
    value = lambda v: "-" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.7f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(value, r)) for r in rows)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_smoke(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())
