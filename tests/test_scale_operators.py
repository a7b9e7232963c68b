"""Ranks, quantiles, sessions, as-of and interval joins against plain Python."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from citewell.operators import timejoins
from citewell.operators.quantiles import exact_quantiles
from citewell.operators.ranks import numbered, ranked
from citewell.operators.timejoins import asof_join, interval_join, sessions

T0 = datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_and_tiles(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, 1.0, 1.0, 1.0, 2.0, float(r.randrange(40))]), r.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, x double, w long").repartition(5)
    p = pd.DataFrame(rows, columns=["i", "x", "w"])
    key = p.x.map(lambda v: (1, 0.0) if v is None or math.isnan(v) else (0, -v))  # descending, nulls last
    order = sorted(set(key))
    got = ranked(df, ["-x"], weight="w", parts=7)
    for row in got.collect():
        k = key[row.i]
        before = p[key.map(lambda v, k=k: v < k)]
        assert row["rank"] == len(before) + 1 and row.dense_rank == order.index(k) + 1
        assert row.running == p.w[key.map(lambda v, k=k: v <= k)].sum() and row.share == pytest.approx(row.running / p.w.sum())
    assert "SinglePartition" not in plan_of(got)
    tiles = {n: numbered(df, ["-x", "i"], "n", tiles=n, parts=4).orderBy("n").collect() for n in (7, 500)}
    assert [x.n for x in tiles[7]] == list(range(1, 301))
    assert [x.ntile for x in tiles[7]] == sorted(x.ntile for x in tiles[7]) and [sum(x.ntile == t for x in tiles[7]) for t in range(1, 8)] == [43] * 6 + [42]
    assert [x.ntile for x in tiles[500]] == list(range(1, 301))
    assert ranked(df.limit(0), ["x"], weight="w").collect() == [] and numbered(df.limit(0), ["x"], tiles=3).collect() == []


@pytest.mark.parametrize("bins", [2, 16])
def test_quantiles(spark, bins):
    r = random.Random(bins)
    odd = [1e308, -1e308, 5e-324, 0.0, -0.0, 1 / 3, math.nan, None]
    rows = [("a", r.gauss(0, 1)) for _ in range(120)] + [("hot", float(r.randrange(3))) for _ in range(200)] + [("odd", x) for x in odd] + [(None, 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    ps = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = {x.g: x.quantiles for x in exact_quantiles(df, "x", ps, ["g"], bins).collect()}
    values = {g: [x for h, x in rows if h == g and x is not None and not math.isnan(x)] for g in {g for g, _ in rows}}
    assert set(got) == {g for g, v in values.items() if v}
    for g, q in got.items():
        assert q == pytest.approx([float(np.quantile(values[g], p)) for p in ps], rel=1e-12), g
    whole = exact_quantiles(df.filter("g in ('a', 'hot')"), "x", ps, bins=bins).first().quantiles
    assert whole == pytest.approx(np.quantile(values["a"] + values["hot"], ps).tolist())
    assert exact_quantiles(df.filter("g = 'none'"), "x", ps).first().quantiles is None
    with pytest.raises(ValueError):
        exact_quantiles(df, "x", [1.5])


def test_sessions_over_slices(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 6 + ["b", None]), T0 + timedelta(minutes=r.choice([0, 30, r.randrange(6000)])), r.choice([1.0, None])) for _ in range(400)] + [("c", None, 1.0)]
    gap = timedelta(minutes=25)
    got = sessions(spark.createDataFrame(rows, "k string, t timestamp, v double"), "k", "t", gap, "v", timedelta(hours=1))
    want = []
    for k in ("hot", "b"):
        for t, v in sorted((t, v or 0.0) for x, t, v in rows if x == k):
            if want and want[-1][0] == k and t - want[-1][2] <= gap:
                want[-1] = (k, want[-1][1], t, want[-1][3] + 1, want[-1][4] + v)
            else:
                want.append((k, t, t, 1, v))
    assert sorted((x.k, x.start, x.end, x.n, x.total or 0.0) for x in got.collect()) == sorted(want)
    with pytest.raises(ValueError):
        sessions(got, "k", "start", gap, "n", gap)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, timedelta(minutes=40)])
def test_asof(spark, direction, tolerance):
    r = random.Random(4)
    at = lambda: r.choice([None, T0 + timedelta(minutes=r.randrange(9000)), T0 + timedelta(minutes=5 * r.randrange(90))])
    left = [(i, r.choice(["hot", "hot", "b", None]), at()) for i in range(120)]
    right = [(r.choice(["hot", "hot", "b", None]), at(), r.randrange(99)) for _ in range(90)]
    got = asof_join(
        spark.createDataFrame(left, "i long, k string, t timestamp"), spark.createDataFrame(right, "k string, u timestamp, v long"), ["k"], "t", ["v"],
        direction, tolerance, right_time="u", slice_length=timedelta(hours=2),
    )
    for x in got.collect():
        hits = [(u, v) for k, u, v in right if k == x.k and k is not None and u is not None and x.t is not None]
        hits = [(u, v) for u, v in hits if direction == "nearest" or (u <= x.t if direction == "backward" else u >= x.t)]
        best = min(hits, key=lambda h: (abs(x.t - h[0]), h[0], -h[1]), default=None)
        best = best if best and (tolerance is None or abs(x.t - best[0]) <= tolerance) else (None, None)
        assert (x.matched_time, x.v) == best, x
    assert got.count() == len(left)
    with pytest.raises(ValueError):
        asof_join(got, got, ["k"], "t", ["v"], "sideways")


def test_intervals(spark):
    r = random.Random(5)

    def some(n):
        rows = []
        for i in range(n):
            a = T0 + timedelta(seconds=r.randrange(100_000))
            rows.append((i, r.choice(["a", "b", None]), a, a + timedelta(seconds=r.choice([0, 1, 59, 60, 61, 5000, r.randrange(90_000)]))))
        return [*rows, (n, "a", T0 - timedelta(days=900), T0 + timedelta(days=900)), (n + 1, "a", None, T0), (n + 2, "a", T0, T0 - timedelta(days=1))]

    a, b = some(70), some(50)
    frames = [spark.createDataFrame(x, "i long, k string, a timestamp, b timestamp") for x in (a, b)]
    meet = lambda x, y: x[2] and y[2] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
    for on in ([], ["k"]):
        got = interval_join(*frames, "a", "b", on)
        want = sorted((x[0], y[0]) for x in a for y in b if meet(x, y) and (not on or x[1] == y[1] and x[1]))
        assert sorted((p.left.i, p.right.i) for p in got.collect()) == want and want
        assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    # an interval over everything is copied a few times, not once a minute
    assert frames[0].filter("i = 70").count() == 1 and F is not None


def test_totals_of_intervals(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rng = random.Random(5)
    left = [(rng.randrange(4), a, a + rng.randrange(40)) for a in (rng.randrange(200) for _ in range(60))]
    points = [(rng.randrange(220), rng.choice([None, 1, 1 << 62])) for _ in range(150)]
    intervals = spark.createDataFrame([(u, at(a), at(b)) for u, a, b in left], "u int, a timestamp, b timestamp")
    known = spark.createDataFrame([(at(t), v) for t, v in points] + [(None, 3)], "t timestamp, v long")
    small = known.withColumn("v", F.when(F.col("v") > 1, 2).otherwise(F.col("v")))
    got = {(r.u, r.a): (r.n, r.total) for r in timejoins.interval_totals(intervals, small, "a", "b", ["u", "a"], "t", "v").collect()}
    want = {}
    for u, a, b in left:
        for t, v in points:
            if a <= t < b:
                n, vs = want.setdefault((u, at(a)), (0, []))
                want[u, at(a)] = (n + 1, [*vs, *([] if v is None else [min(v, 2)])])
    assert got == {k: (n, sum(vs) if vs else None) for k, (n, vs) in want.items()}
    # totals before an interval may pass 64 bits where its own do not
    one = spark.createDataFrame([(1, at(300), at(301))], "u int, a timestamp, b timestamp")
    more = known.union(spark.createDataFrame([(at(300), 7)], "t timestamp, v long"))
    assert [tuple(r) for r in timejoins.interval_totals(one, more, "a", "b", ["u"], "t", "v").collect()] == [(1, 1, 7)]


def test_interval_query_makes_no_pairs(spark, monkeypatch):
    from citewell.plans import catalogue

    def pairs(*_, **__):
        raise AssertionError("every session would meet every error of its time")

    queries = catalogue.queries()
    monkeypatch.setattr(timejoins, "interval_join", pairs)
    assert queries["s14_interval_join"](spark, "/root/testdata/sf0.001").count() > 0
