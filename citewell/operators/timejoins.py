"""Sessions, as-of joins, interval joins and totals of intervals over event times.

Each is keyed by time slices or buckets beside the key, so a key with most of
the rows has as many tasks as slices; what crosses a slice's edge is carried as
a row or two a slice.  Times are whole microseconds inside.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewell.operators import ranks

_LEVELS = 12  # of bucket sizes, each eight times the one before


def _micros(length: timedelta) -> int:
    return length // timedelta(microseconds=1)


def _at(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def sessions(events: DataFrame, key: str, time: str, gap: timedelta, value: str, slice_length: timedelta = timedelta(days=1)) -> DataFrame:
    """``key, start, end, n, total``: events of a key that follow each other within ``gap``, the bound included.

    Sessions are made within slices first; of a slice only the first and the
    last may go on in another, and only these meet by key.  Events without key
    or time are left out; equal times are one session.
    """
    if slice_length <= gap:
        raise ValueError(f"slices of {slice_length} are too short for gaps of {gap}")
    t = _at(time)
    rows = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("k"), t.alias("t"), F.floor(t / _micros(slice_length)).alias("slice"), F.col(value).alias("v"))
    here = Window.partitionBy("k", "slice").orderBy("t")
    begins = F.coalesce((F.col("t") - F.lag("t").over(here) > _micros(gap)).cast("int"), F.lit(1))
    local = rows.withColumn("new", begins).withColumn("s", F.sum("new").over(here)).groupBy("k", "slice", "s")
    local = local.agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    local = local.withColumn("last", F.max("s").over(Window.partitionBy("k", "slice")))
    edge = (F.col("s") == 1) | (F.col("s") == F.col("last"))
    over = Window.partitionBy("k").orderBy("a")
    edges = local.filter(edge).withColumn("new", F.coalesce((F.col("a") - F.lag("b").over(over) > _micros(gap)).cast("int"), F.lit(1)))
    edges = edges.withColumn("g", F.sum("new").over(over)).groupBy("k", "g").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    columns = ["k", "a", "b", "n", "total"]
    both = local.filter(~edge).select(*columns).unionByName(edges.select(*columns))
    return both.select(F.col("k").alias(key), F.timestamp_micros("a").alias("start"), F.timestamp_micros("b").alias("end"), "n", "total")


def asof_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], time: str, columns: Sequence[str], direction: str = "backward",
    tolerance: timedelta | None = None, right_time: str | None = None, slice_length: timedelta = timedelta(days=1),
) -> DataFrame:
    """Each row of ``left`` with ``columns`` and ``matched_time`` of the row of ``right`` of its key that is nearest in time.

    ``direction`` is ``backward`` (the last not after it), ``forward`` (the first
    not before it) or ``nearest`` (of equal distances the earlier).  Among rows of
    ``right`` at one time the greatest ``columns`` count.  Beyond ``tolerance``, and
    where a key or time is null, columns are null; no row of ``left`` is lost.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"direction {direction}: backward, forward or nearest")
    keys = [f"_k{i}" for i in range(len(on))]
    keyed = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    sliced = F.floor(F.col("_t") / _micros(slice_length)).alias("_slice")
    rows = left.select(*keyed, _at(time).alias("_t"), F.struct(*left.columns).alias("_row")).select("*", sliced)
    hits = right.select(*keyed, _at(right_time or time).alias("_t"), F.struct(*columns).alias("_hit")).filter(F.col("_t").isNotNull()).select("*", sliced)
    hits = hits.groupBy(*keys, "_slice", "_t").agg(F.max("_hit").alias("_hit"))  # of one time the greatest
    hit = F.struct("_t", "_hit")
    ends = hits.groupBy(*keys, "_slice").agg(F.max_by(hit, "_t").alias("_last"), F.min_by(hit, "_t").alias("_first"))
    # what each slice with rows gets from slices before and after it: as many rows as slices meet by key
    order = Window.partitionBy(*keys).orderBy("_slice")
    sides = rows.select(*keys, "_slice").distinct().join(ends, [*keys, "_slice"], "full")
    before = F.last("_last", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    carried = sides.select(*keys, "_slice", before.alias("_before"), after.alias("_after")).select(*keys, "_slice", F.explode(F.array("_before", "_after")).alias("_c"))
    carried = carried.filter("_c IS NOT NULL").select(*keys, "_slice", "_c._t", "_c._hit")
    everything = rows.unionByName(hits.unionByName(carried), allowMissingColumns=True).withColumn("_kind", F.col("_row").isNotNull())
    found = F.when(~F.col("_kind"), hit)
    back = F.last(found, True).over(Window.partitionBy(*keys, "_slice").orderBy("_t", "_kind"))
    ahead = F.last(found, True).over(Window.partitionBy(*keys, "_slice").orderBy(F.desc("_t"), "_kind"))
    both = everything.select("*", *([back.alias("_b")] if direction != "forward" else []), *([ahead.alias("_a")] if direction != "backward" else [])).filter("_kind")
    if direction == "nearest":
        nearer = (F.col("_b").isNotNull()) & (F.col("_a").isNull() | (F.col("_t") - F.col("_b._t") <= F.col("_a._t") - F.col("_t")))
        chosen = F.when(nearer, F.col("_b")).otherwise(F.col("_a"))
    else:
        chosen = F.col("_b" if direction == "backward" else "_a")
    ok = F.col("_t").isNotNull()
    for k in keys:
        ok &= F.col(k).isNotNull()
    if tolerance is not None:
        ok &= F.abs(F.col("_t") - chosen["_t"]) <= _micros(tolerance)
    out = both.select("_row", F.when(ok, chosen).alias("_m"))
    return out.select("_row.*", F.timestamp_micros("_m._t").alias("matched_time"), *[F.col(f"_m._hit.{c}").alias(c if c not in left.columns else f"{c}_right") for c in columns])


def interval_join(left: DataFrame, right: DataFrame, start: str, end: str, on: Sequence[str] = (), base: timedelta = timedelta(minutes=1)) -> DataFrame:
    """Pairs of rows whose intervals, from ``start`` up to but without ``end``, overlap: structs ``left`` and ``right``.

    An interval belongs to the level whose buckets are at least as long as it, so
    it lies in two of them at most, and meets longer ones in the buckets of
    their levels: a row is copied twice a level, however long it or any other is.
    A pair is reported only in the bucket where the later of the two begins.
    Empty intervals and those without a bound or key meet nothing.
    """
    sizes = [_micros(base) * 8**i for i in range(_LEVELS)]

    def dealt(df: DataFrame, name: str) -> DataFrame:
        length = F.col("e") - F.col("s")
        level = F.lit(_LEVELS - 1)
        for i in reversed(range(_LEVELS - 1)):
            level = F.when(length <= sizes[i], i).otherwise(level)
        keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(on)]
        rows = df.select(*keys, _at(start).alias("s"), _at(end).alias("e"), F.struct(*df.columns).alias(name)).filter("s < e").withColumn("own", level)
        size = F.element_at(F.array(*[F.lit(x).cast("long") for x in sizes]), F.col("level") + 1)
        rows = rows.select("*", F.explode(F.sequence("own", F.lit(_LEVELS - 1))).alias("level")).withColumn("size", size)
        first, last = F.floor(F.col("s") / F.col("size")), F.floor((F.col("e") - 1) / F.col("size"))
        rows = rows.select("*", F.explode(F.sequence(first, last)).alias("bucket"))
        return rows.select(*[f"k{i}" for i in range(len(on))], "level", "bucket", "size", F.col("s").alias(f"{name}_s"), F.col("e").alias(f"{name}_e"), (F.col("own") == F.col("level")).alias(f"{name}_own"), name)

    a, b = dealt(left, "left"), dealt(right, "right").drop("size")
    # levels that no interval of the other side belongs to need no copies
    there = a.filter("left_own").select("level").union(b.filter("right_own").select("level")).distinct()
    a = a.join(F.broadcast(there), "level")  # a row a level
    pairs = a.join(b, [*[f"k{i}" for i in range(len(on))], "level", "bucket"])
    later = F.floor(F.greatest("left_s", "right_s") / F.col("size"))
    hit = (F.col("left_own") | F.col("right_own")) & (F.col("left_s") < F.col("right_e")) & (F.col("right_s") < F.col("left_e")) & (later == F.col("bucket"))
    return pairs.filter(hit).select("left", "right")


def interval_totals(left: DataFrame, points: DataFrame, start: str, end: str, by: Sequence[str], time: str, value: str) -> DataFrame:
    """``by, n, total``: how many ``points`` lie from ``start`` up to but without ``end``, and the sum of their whole-number ``value``.

    Rows of ``left`` that agree in ``by`` are added up; those that no point lies
    in are left out.  No pairs are made: bounds and points are sorted by time
    once, and an interval has the running totals at its end less those at its
    start, so work grows with the rows however many intervals a point lies in.
    """
    names = [f"_k{i}" for i in range(len(by))]
    whole = F.col(value).cast("decimal(38,0)")  # running totals of many great values pass 64 bits where an interval's don't
    at = points.select(_at(time).alias("_t"), whole.alias("_v")).filter("_t IS NOT NULL").groupBy("_t").agg(F.count(F.lit(1)).alias("_n"), F.count("_v").alias("_known"), F.sum("_v").alias("_v"))
    rows = left.select(*[F.col(c).alias(k) for c, k in zip(by, names, strict=True)], _at(start).alias("s"), _at(end).alias("e")).filter("s < e")
    bound = lambda c, sign: F.struct(F.col(c).alias("_t"), F.lit(sign).alias("_sign"))
    bounds = rows.select(*names, F.explode(F.array(bound("s", -1), bound("e", 1))).alias("b")).select(*names, "b.*")
    both = bounds.unionByName(at, allowMissingColumns=True).withColumn("_point", F.col("_sign").isNull())  # a bound comes before a point at its time
    sums = ranks.running(both, ["_t", "_point", *names], ["_n", "_known", "_v"]).filter(~F.col("_point"))
    made = sums.groupBy(*names).agg(*[F.sum(F.col(c) * F.col("_sign")).alias(c) for c in ("_n", "_known", "_v")]).filter("_n > 0")
    return made.select(*[F.col(k).alias(c) for k, c in zip(names, by, strict=True)], F.col("_n").alias("n"), F.when(F.col("_known") > 0, F.col("_v").cast("long")).alias("total"))
