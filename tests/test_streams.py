"""Streams against the batch operators, with late rows, shuffled files, restarts and state that falls."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citewell.operators.timejoins import sessions
from citewell.streaming import stateful

GAP, LATE = timedelta(minutes=30), timedelta(hours=3)
SCHEMA = "user long, at timestamp, value double"


def events(seed, n=150):
    r, t = random.Random(seed), datetime(2024, 1, 1)
    return [(r.choice([1, 1, 1, 2, 3]), t + timedelta(minutes=r.randrange(0, 3000), seconds=r.choice([0, 0, 7])), float(r.randrange(9))) for _ in range(n)]


def plain(df):
    return sorted((r.user, r.start, r.end, r.n, round(r.total, 6)) for r in df.collect())


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(stateful.STATE_STORE[0], None)
    spark.conf.set(*stateful.STATE_STORE)
    yield spark
    spark.conf.set(stateful.STATE_STORE[0], before) if before else spark.conf.unset(stateful.STATE_STORE[0])


def fed(spark, rows, folder, parts):
    """Files of slices of time in order, shuffled within: rows come up to two hours late."""
    rows = sorted(rows, key=lambda r: r[1])
    blocks = [rows[i : i + len(rows) // parts + 1] for i in range(0, len(rows), len(rows) // parts + 1)]
    for i, block in enumerate(blocks):
        random.Random(i).shuffle(block)
        spark.createDataFrame(block, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03}")
        yield i


def last_day(spark, folder):
    """One event a year on moves the watermark past all others."""
    spark.createDataFrame([(99, datetime(2025, 1, 1), 0.0)], SCHEMA).coalesce(1).write.parquet(f"{folder}/999")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("make", [stateful.timed_sessions, stateful.window_sessions], ids=["timers", "windows"])
def test_sessions_of_a_stream_equal_the_batch(rocks, tmp_path, make):
    spark, rows = rocks, events(1)
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    held = []
    for i in fed(spark, rows, folder, 3):  # a new run from the checkpoint for each
        query = stateful.run_to_table(make(stream(spark, folder), "user", "at", GAP, "value", lateness=LATE), table, checkpoint)
        held += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert i >= 0
    last_day(spark, folder)
    query = stateful.run_to_table(make(stream(spark, folder), "user", "at", GAP, "value", lateness=LATE), table, checkpoint)
    held += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    batch = spark.createDataFrame(rows, SCHEMA)
    want = plain(sessions(batch, "user", "at", GAP, "value"))
    got = [x for x in plain(spark.read.parquet(table)) if x[0] != 99]
    assert got == want and len(want) > 20
    assert held[-1] < max(held)  # what has expired is dropped
    assert plain(stateful.window_sessions(batch, "user", "at", GAP, "value")) == want


def test_two_streams(spark, tmp_path):
    """Pairs within the bound, once each over a restart, and left rows without a partner after it."""
    a, b = events(2, 60), events(3, 60)
    within = timedelta(minutes=20)
    folders = [str(tmp_path / x) for x in ("a", "b")]
    table, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in zip(fed(spark, a, folders[0], 2), fed(spark, b, folders[1], 2), strict=True):
        joined = stateful.joined_streams(stream(spark, folders[0]), stream(spark, folders[1]), "user", "at", "at", within, LATE, "left_outer")
        stateful.run_to_table(joined, table, checkpoint)
    for f in folders:
        last_day(spark, f)
    joined = stateful.joined_streams(stream(spark, folders[0]), stream(spark, folders[1]), "user", "at", "at", within, LATE, "left_outer")
    stateful.run_to_table(joined, table, checkpoint)
    pairs = [(*x, *y) for x in a for y in b if x[0] == y[0] and abs(x[1] - y[1]) <= within]
    alone = [(*x, None, None, None) for x in a if not any(x[0] == y[0] and abs(x[1] - y[1]) <= within for y in b)]
    got = [tuple(r) for r in spark.read.parquet(table).filter(F.col("user") != 99).collect()]
    assert sorted(got, key=str) == sorted(pairs + alone, key=str) and pairs and alone
