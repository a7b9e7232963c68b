"""Snapshot files, the ledger and the stream."""

import gzip
import json

from citewell.sources import snapshot, tables
from citewell.streaming import ingest


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write("\n".join(rows))


def test_snapshot_ledger_and_stream(spark, tmp_path):
    root = tmp_path / "snap"
    lines = [json.dumps({"id": str(i), "v": i}) for i in range(3)]
    write(root / "works/updated_date=2024-01-01/a.gz", [*lines, "", "  ", "{broken", '{"v": 9}'])
    (root / ".hidden").mkdir()
    (root / "empty").mkdir()
    assert snapshot.entities(spark, str(root)) == ["works"]
    assert sorted(r.id for r in snapshot.raw_documents(spark, str(root / "works")).collect()) == ["", "0", "1", "2"]

    table, ledger = str(tmp_path / "raw"), str(tmp_path / "ledger")
    assert snapshot.ingest(spark, str(root), table, ledger, "works") == 1
    assert snapshot.ingest(spark, str(root), table, ledger, "works") == 0
    write(root / "works/updated_date=2024-01-02/b.gz", [json.dumps({"id": "1", "v": 100})])
    assert snapshot.ingest(spark, str(root), table, ledger, "works") == 1
    latest = {r.id: json.loads(r.raw_data)["v"] for r in snapshot.latest_documents(spark.read.parquet(table)).collect()}
    assert latest == {"": 9, "0": 0, "1": 100, "2": 2}

    out, check = str(tmp_path / "stream"), str(tmp_path / "check")
    for _ in range(2):
        ingest.run_available(ingest.document_stream(spark, str(root / "works")), out, check)
    assert spark.read.parquet(out).count() == 5


def test_database_tables(spark):
    """An embedded database in memory: written, read in parallel by key, with a column that it lacks."""
    url = "jdbc:derby:memory:citewell;create=true"
    snapshot.write_database(spark.createDataFrame([(i, i % 3, f"t{i}") for i in range(40)], "K int, YEAR_ int, TITLE string"), url, "WORKS")
    got = snapshot.read_database(spark, url, "SELECT * FROM WORKS WHERE YEAR_ = 1", ["K", "TITLE", "FWCI"], key="K", bounds=(0, 40), parts=4)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect())) == [(i, f"t{i}", None) for i in range(1, 40, 3)]


def test_database_without_some_columns(spark):
    """Columns that the database lacks get the defaults given; rows of a list of keys come by a statement for each few of them."""
    url = "jdbc:derby:memory:citewell2;create=true"
    snapshot.write_database(spark.createDataFrame([(f"S{i}", f"it's {i}") for i in range(9)] * 2, "ID string, TITLE string"), url, "SOURCES", createTableColumnTypes="ID VARCHAR(64), TITLE VARCHAR(64)")
    got = snapshot.read_database(spark, url, "SELECT * FROM SOURCES", ["ID", "COUNTRY_CODE", "IS_SCOPUS"], defaults={"COUNTRY_CODE": "UNKNOWN", "IS_SCOPUS": False})
    assert {tuple(r) for r in got.collect()} == {(f"S{i}", "UNKNOWN", False) for i in range(9)} and got.count() == 18
    some = snapshot.read_by_key(spark, url, "SOURCES", "TITLE", ["it's 1", "it's 4", "it's 8", "none"], ["ID"], per_task=2)
    assert some.rdd.getNumPartitions() == 2
    assert sorted(r.ID for r in some.collect()) == ["S1", "S1", "S4", "S4", "S8", "S8"]
    assert snapshot.read_by_key(spark, url, "SOURCES", "ID", [], ["ID"]).count() == 0


def test_guarded_keys(spark):
    spark.sql("DROP TABLE IF EXISTS citewell_keyed")
    spark.sql("CREATE TABLE citewell_keyed (a INT, b STRING) USING parquet")
    spark.sql("INSERT INTO citewell_keyed VALUES (1, 'x'), (2, 'x'), (3, NULL)")
    assert not tables.keyed(spark, "citewell_keyed", "b")
    assert tables.keyed(spark, "citewell_keyed", "a", "b") is False
    assert tables.keyed(spark, "citewell_keyed", "a") and tables.keyed(spark, "citewell_keyed", "a")
    spark.sql("DROP TABLE citewell_keyed")


def test_part_files(spark, tmp_path):
    """Every row once, a key in one batch, maps and a key with most rows included."""
    rows = [("hot", i, {"a": i}) for i in range(500)] + [(f"k{i}", i, None) for i in range(50)] + [(None, 1, None)]
    tables.write_parts(spark.createDataFrame(rows, "k string, n int, m map<string, int>"), str(tmp_path / "p"), "k", 4)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 551 and back.filter("k = 'hot'").count() == 500
    assert back.groupBy("k").agg({"batch": "min"}).join(back.groupBy("k").agg({"batch": "max"}), "k").filter("`min(batch)` != `max(batch)`").count() == 0
    assert len(list((tmp_path / "p").glob("batch=*/*.parquet"))) > 4


def test_declared_tables_stay(spark):
    spark.sql("DROP TABLE IF EXISTS citewell_declared")
    snapshot.declare_table(spark, "citewell_declared", "id STRING, n INT")
    spark.sql("INSERT INTO citewell_declared VALUES ('a', 1)")
    snapshot.declare_table(spark, "citewell_declared", "id STRING, n INT")
    assert [tuple(r) for r in spark.table("citewell_declared").collect()] == [("a", 1)]
    spark.sql("DROP TABLE citewell_declared")


def test_csv_round_trip_and_catalogue(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b"), (2, None)], "k long, t string")
    snapshot.write_csv(df, str(tmp_path / "c"), ";")
    assert sorted(map(tuple, snapshot.read_csv(spark, str(tmp_path / "c"), df.schema, ";").collect())) == [(1, "a;b"), (2, None)]


def test_runner_from_snapshot_to_cubes(spark, tmp_path):
    """A first run, one with a new file of works, and one with force give the same as all works at once."""
    from citewell.run import run

    def work(i, source, date, cited=1):
        return json.dumps({"id": f"W{i}", "updated_date": date, "publication_year": 2020 + i % 3, "cited_by_count": cited, "primary_location": {"source": {"id": source}}, "language": "en", "open_access": {"is_oa": True, "oa_status": "gold"}})

    root, out = tmp_path / "snap", str(tmp_path / "out")
    write(root / "sources/updated_date=2024-01-01/a.gz", [json.dumps({"id": s, "country_code": c}) for s, c in (("S1", "MX"), ("S2", "BR"))])
    write(root / "works/updated_date=2024-01-01/a.gz", [work(i, f"S{i % 2 + 1}", "2024-01-01") for i in range(12)])
    first = {(r.level, r.entity): r.num_documents for r in run(spark, str(root), out, (2021, 2022)).filter("kind = 'period'").collect()}
    assert first == {("world", "ALL"): 12, ("country", "MX"): 6, ("country", "BR"): 6, ("journal", "S1"): 6, ("journal", "S2"): 6}
    write(root / "works/updated_date=2024-02-01/b.gz", [work(0, "S2", "2024-02-01", 50), work(40, "S2", "2024-02-01")])
    plain = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    made = plain(run(spark, str(root), out, (2021, 2022)))
    assert made == plain(run(spark, str(root), out, (2021, 2022), force=True))
    world = [r for r in run(spark, str(root), out, (2021, 2022), levels=["world"]).filter("kind = 'period'").collect()]
    assert [(r.num_documents, r.total_citations) for r in world] == [(13, 62)]


def test_documents_are_parsed_once(spark, tmp_path):
    from citewell.plans import normalise
    from citewell.schemas import WORK_JSON
    from citewell.sources import snapshot

    optimised = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    lines = ['{"id": "W1", "open_access": {"is_oa": true, "oa_status": "gold"}, "cited_by_count": "many"}', "{broken", " ", '{"id": "W2", "primary_location": {"source": {"id": "S"}}}']
    rows = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    rows.write.option("compression", "gzip").text(f"{tmp_path}/works")
    typed = snapshot.typed_documents(spark, f"{tmp_path}/works", WORK_JSON)
    assert optimised(normalise.cube_works(typed).filter("work_id > 'W0'")).count("from_json(") == 1
    assert sorted((r.id, r.cited_by_count) for r in typed.collect()) == [("W1", None), ("W2", None)]
    assert optimised(snapshot.raw_documents(spark, f"{tmp_path}/works")).count("from_json(") == 1
    made = normalise.work_tables(normalise.parsed(rows.withColumnRenamed("value", "raw_data")))
    assert not any("from_json(" in optimised(t) for t in made.values())
    assert [tuple(r)[:3] for r in made["works_open_access"].collect()] == [("W1", True, "gold")]
    assert [tuple(r)[:2] for r in made["works_primary_location"].collect()] == [("W2", "S")]
