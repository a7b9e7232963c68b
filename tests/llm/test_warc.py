"""Archives written and read back, push-down, and members by other writers."""

import base64
import gzip
import hashlib

from citewell.llm import warc

PAGES = [(3, "http://u/3", "same é"), (1, "http://u/1 x\r\ny", "same é"), (2, None, None), (5, "u5", ""), (7, "u7", "z" * 200_000), (1, "http://u/1 x\r\ny", "same é")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def pages(spark, rows=PAGES):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))


def test_round_trip(spark, tmp_path):
    got = warc.round_trip(pages(spark), str(tmp_path)).collect()
    first = {}
    for i, _, t in sorted(PAGES, key=lambda r: r[0]):
        first.setdefault(t or "", i)
    assert len(got) == len(PAGES) and all(r.verified for r in got)
    texts = {i: t or "" for i, _, t in PAGES}
    for r in got:
        text = texts[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), digest(text))
        again = first[text] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[text]) if again else ("response", None))
    assert warc.round_trip(pages(spark, []), str(tmp_path)).count() == 0


def test_query_pushes_its_predicates(spark, tmp_path):
    """Neither half of the query filters after its scan: the record type is tested on headers, before a payload is decoded."""
    plan = warc.round_trip(pages(spark), str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 2 and "Filter" not in plan.replace("RuntimeFilters", "")


def test_frequent_and_rare_payloads(spark):
    rows = [(i, "u", "often" if i % 2 else f"p{i // 4}") for i in range(200)]
    for share in (2, 10_000):
        made = warc.with_revisits(pages(spark, rows), hot_share=share).collect()
        assert len(made) == 200 and sum(r.record_type == "response" for r in made) == 51
        assert all((r.payload is None) == (r.record_type == "revisit") and (r.refers_to is None) == (r.record_type == "response") for r in made)


def test_appended_foreign_and_unfinished_files(spark, tmp_path):
    path = str(tmp_path / "w")
    for rows in (PAGES[:1], PAGES[1:3]):
        warc.write_warc(warc.with_revisits(pages(spark, rows)), path)
    record = warc.member(warc.record_bytes("urn:x-page:9", "response", "u", "d", None, b"x"))
    (tmp_path / "w" / f"own-{'0' * 32}-{'1' * 32}.warc.gz").write_bytes(record)  # as a failed attempt leaves it
    (tmp_path / "w" / "other.warc.gz").write_bytes(record)
    assert sorted(r.record_id for r in warc.read_warc(spark, path).collect()) == [f"urn:x-page:{i}" for i in (1, 2, 3, 9)]


def test_least_bytes(spark):
    kinds = {(r.record_id, r.record_type) for r in warc.with_revisits(pages(spark), least_bytes=100).collect()}
    assert {k for _, k in kinds} == {"response"}


def test_predicates_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(warc.with_revisits(pages(spark)), path)
    some = warc.read_warc(spark, path, payload="none", span=1).filter("record_type = 'revisit' AND target_uri LIKE 'http://%'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert [r.record_id for r in some.collect()] == ["urn:x-page:3"]
    full = warc.read_warc(spark, path).filter("record_id = 'urn:x-page:7'").first()
    assert bytes(full.payload) == b"z" * 200_000 and full.target_uri == "u7"
    assert warc.read_warc(spark, path).filter("content_length > 1000").count() == 1


def test_skipped_blocks_are_not_decoded(tmp_path):
    record = warc.record_bytes("urn:a", "response", "u", "d", None, b"payload" * 99_999)
    data = warc.member(record) + warc.member(warc.record_bytes("urn:b", "response", "u", "d", None, b"x"))
    broken = bytearray(data)
    broken[4000:4010] = b"\0" * 10  # inside the first payload
    (tmp_path / "a.warc.gz").write_bytes(bytes(broken))
    with open(tmp_path / "a.warc.gz", "rb") as f:
        got = list(warc.records(f, 0, len(data)))
    assert [r.value("record_id") for r in got] == ["urn:a", "urn:b"]


def test_members_of_other_writers_and_plain_files(spark, tmp_path):
    one = warc.record_bytes("urn:x-page:1", "response", "u", "d", None, b"first")
    two = warc.record_bytes("urn:x-page:2", "response", "u", "d", None, b"second\r\n\r\nWARC/1.1 inside")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "b.warc").write_bytes(one + two)
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.payload) for r in got) == sorted([b"first", b"second\r\n\r\nWARC/1.1 inside"] * 2)
    assert all(r.header_digest == r.payload_digest for r in got)
