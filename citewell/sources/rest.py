"""Paged REST collections as a Spark data source, ``paged_rest``: one partition a key, pages followed by cursor."""

from __future__ import annotations

import http.client
import json
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import quote, urlencode

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fetch(url: str, tries: int = 5, wait: float = 1.0, longest: float = 300.0) -> dict:
    """JSON of a URL; waits longer each time the server fails for a moment, or as long as it asks for, up to ``longest`` seconds.

    A connection that breaks or stalls while an answer is read, or an answer cut short, is tried again too.
    """
    for n in range(tries):
        pause = wait * 2**n
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code not in (429, 500, 502, 503, 504) or n == tries - 1:
                raise
            asked = e.headers.get("Retry-After", "") if e.headers else ""
            pause = max(pause, float(asked)) if asked.isdigit() else pause
        except (OSError, http.client.HTTPException, json.JSONDecodeError):
            if n == tries - 1:
                raise
        time.sleep(min(pause, longest))
    raise RuntimeError(url)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.filter = options["url"], options.get("filter", "")
        self.keys = json.loads(options.get("keys", "[null]"))
        self.per_page, self.most = int(options.get("perpage", 200)), int(options.get("mostrows", 0))
        self.pace, self.wait = float(options.get("pace", 0.15)), float(options.get("retrywait", 1.0))
        self.mail, self.search = options.get("mail", ""), options.get("search", "")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in self.keys]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """``key, raw_data`` rows of one key, until the last page or ``mostRows``."""
        if partition is None:  # what Spark reads where there are no partitions
            return
        key, cursor, given = partition.value, "*", 0
        while cursor:
            query = {"per-page": self.per_page, "cursor": cursor}
            if self.filter:
                query["filter"] = self.filter.replace("{key}", str(key))
            if self.search:
                query["search"] = self.search.replace("{key}", str(key))
            if self.mail:
                query["mailto"] = self.mail
            page = fetch(f"{self.url}?{urlencode(query)}", wait=self.wait)
            rows = page.get("results") or []
            for row in rows:
                yield (None if key is None else str(key), json.dumps(row, ensure_ascii=False))
                given += 1
                if self.most and given >= self.most:
                    return
            cursor = (page.get("meta") or {}).get("next_cursor") if rows else None
            if cursor:
                time.sleep(self.pace)


class PagedRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "key string, raw_data string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def read_rest(spark: SparkSession, url: str, keys: list[str] | None = None, filter: str = "", most_rows: int = 0, per_page: int = 200, pace: float = 0.15, mail: str = "", retry_wait: float = 1.0, search: str = "") -> DataFrame:
    """``key, raw_data`` of a collection, for each key (a country code, a source id) in a task of its own.

    Without ``keys`` the whole collection is asked for; an empty list asks for nothing.
    Parse ``raw_data`` with the JSON schemas; ``filter`` and ``search`` may name ``{key}``.
    """
    spark.dataSource.register(PagedRest)
    options = {"url": url, "filter": filter, "keys": json.dumps([None] if keys is None else keys), "mostRows": most_rows, "perPage": per_page, "pace": pace, "mail": mail, "retryWait": retry_wait, "search": search}
    return spark.read.format("paged_rest").options(**{k: str(v) for k, v in options.items()}).load()


def fetch_each(ids: DataFrame, id_col: str, url: str, tasks: int = 4, pace: float = 0.15, mail: str = "", retry_wait: float = 1.0) -> DataFrame:
    """``key, raw_data``: the object at ``url``, which names ``{key}``, for every different id; ids that the server doesn't know give no row.

    Ids are a table of any size; ``tasks`` fetch side by side and each waits
    ``pace`` seconds between two requests, which bounds the rate.
    """

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = "?" + urlencode({"mailto": mail}) if mail else ""
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                keys, found = [], []
                for key in batch.column(0).slice(start, 100).to_pylist():
                    try:
                        found.append(json.dumps(fetch(url.replace("{key}", quote(key, safe="")) + query, wait=retry_wait), ensure_ascii=False))
                        keys.append(key)
                    except urllib.error.HTTPError as e:
                        if e.code not in (404, 410):
                            raise
                    time.sleep(pace)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], ["key", "raw_data"])

    keys = ids.select(F.col(id_col).cast("string").alias("key")).filter("key IS NOT NULL").distinct()
    return keys.repartition(tasks).mapInArrow(get, "key string, raw_data string")
