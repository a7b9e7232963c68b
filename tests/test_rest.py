"""The REST source against a server on this machine."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

from citewell.plans import enrichment
from citewell.sources.rest import fetch, read_rest


class Pages(BaseHTTPRequestHandler):
    refused = 0

    def do_GET(self):
        q = parse_qs(urlparse(self.path).query)
        if Pages.refused < 1:
            Pages.refused += 1
            self.send_response(429)
            self.end_headers()
            return
        at = 0 if q["cursor"][0] == "*" else int(q["cursor"][0])
        rows = [{"id": f"{q['filter'][0]}-{i}"} for i in range(at, min(5, at + int(q["per-page"][0])))]
        body = json.dumps({"results": rows, "meta": {"next_cursor": str(at + 2) if at + 2 < 5 else None}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_pages_keys_and_retries(spark):
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/works"
    try:
        rows = read_rest(spark, url, ["MX", "BR"], "country:{key}", per_page=2, pace=0, retry_wait=0.01).collect()
        assert sorted((r.key, json.loads(r.raw_data)["id"]) for r in rows) == sorted((k, f"country:{k}-{i}") for k in ("MX", "BR") for i in range(5))
        assert read_rest(spark, url, ["MX"], "country:{key}", most_rows=3, per_page=2, pace=0).count() == 3
    finally:
        server.shutdown()


class Catalogue(BaseHTTPRequestHandler):
    """Sources by id and by search, and their works."""

    asked: list = []
    topics = {"S1": [{"id": "T1", "display_name": "t1", "works_count": 7, "percentage": 25.0, "field": {"display_name": "f"}}], "S2": []}

    def do_GET(self):
        at, q = urlparse(self.path), parse_qs(urlparse(self.path).query)
        Catalogue.asked.append(at.path)
        name = at.path.rpartition("/")[2]
        if at.path.startswith("/sources/") and name not in self.topics:
            self.send_response(404)
            self.end_headers()
            return
        if at.path.startswith("/sources/"):
            answer = {"id": f"https://x/{name}", "display_name": name.lower(), "topics": self.topics[name]}
        elif at.path == "/sources":
            answer = {"results": [{"id": f"{q['search'][0]}-{i}"} for i in range(3)] if q["search"][0] != "none" else [], "meta": {"next_cursor": "more"}}
        else:
            answer = {"results": [{"id": f"W{i}", "doi": q["filter"][0]} for i in range(int(q["per-page"][0]))], "meta": {"next_cursor": "more"}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *args):
        pass


def test_topics_search_and_works(spark):
    server = HTTPServer(("127.0.0.1", 0), Catalogue)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        sources = spark.createDataFrame([("https://x/S1",), ("https://x/S1",), ("https://x/S2",), ("https://x/S3",), ("https://x/S4",), (None,)], "id string")
        done = spark.createDataFrame([("https://x/S4",), (None,)], "journal_id string")
        got = enrichment.topics_of(sources, f"{url}/sources", done, tasks=2, pace=0).collect()
        assert [(r.journal_id, r.journal_name, r.topic_name, r.field, r.domain, r["count"], r.share) for r in got] == [("https://x/S1", "s1", "t1", "f", "Unknown", 7, 0.25)]
        assert sorted(Catalogue.asked) == ["/sources/S1", "/sources/S2", "/sources/S3"]
        hits = enrichment.first_hits(spark, f"{url}/sources", ["a b", "none"], pace=0).collect()
        assert [(r.key, json.loads(r.raw_data)["id"]) for r in hits] == [("a b", "a b-0")]
        works = enrichment.works_of(spark, f"{url}/works", ["S1"], most=250, pace=0).collect()
        assert len(works) == 250 and {r.doi for r in works} == {"primary_location.source.id:S1,publication_year:2021-2025"}
    finally:
        server.shutdown()


class Broken(BaseHTTPRequestHandler):
    asked: list[float] = []

    def do_GET(self):
        Broken.asked.append(time.monotonic())
        turn = len(Broken.asked)
        self.send_response(503 if turn == 1 else 200)
        if turn == 1:
            self.send_header("Retry-After", "1")
        body = b'{"results": [{"id": "a"}]}'
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body[:9] if turn == 2 else body)

    def log_message(self, *args):
        pass


def test_answers_that_break_off_and_servers_that_ask_for_time():
    server = HTTPServer(("127.0.0.1", 0), Broken)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert fetch(f"http://127.0.0.1:{server.server_port}/x", wait=0.01) == {"results": [{"id": "a"}]}
    finally:
        server.shutdown()
    assert len(Broken.asked) == 3 and Broken.asked[1] - Broken.asked[0] >= 1


def test_no_keys_ask_for_nothing(spark):
    """No server listens there, so any request would fail."""
    assert read_rest(spark, "http://127.0.0.1:9/works", []).collect() == []
    assert enrichment.first_hits(spark, "http://127.0.0.1:9/sources", []).collect() == []
    assert enrichment.works_of(spark, "http://127.0.0.1:9/works", []).collect() == []
