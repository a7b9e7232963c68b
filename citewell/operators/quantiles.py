"""Exact quantiles by selection: counts in ranges that narrow, so no task ever holds the values.

A quantile asks for one or two values by their place in sorted order.  Each
place has a range known to hold it.  A pass counts values by bins of the range,
combined before the shuffle, and the bin with the place becomes its range, from
the bin's smallest to its largest value; at the latest a range of one value
ends it.  With ``bins`` bins, n values of a smooth distribution take about
log(n) / log(bins) passes over the one column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewell.shared import stored

_BY = "_by_{}"


def _bin(x: Column, bins: int) -> Column:
    """Number of the bin of the range from ``low`` to ``high``; halves, so that no difference overflows."""
    width = (F.col("high") / 2 - F.col("low") / 2) / bins
    at = F.floor((x / 2 - F.col("low") / 2) / F.when(width > 0, width))
    return F.when(x == F.col("low"), 0).otherwise(F.coalesce(F.least(F.lit(bins - 1), at), F.lit(bins - 1))).cast("int")


def _places(n: Column, p: float) -> tuple[Column, Column]:
    """First place, from 0, and share of the next."""
    at = (n - 1) * F.lit(p)
    return F.floor(at).cast("long"), at - F.floor(at)


def _selected(values: DataFrame, by: Sequence[str], probabilities: Sequence[float], bins: int) -> DataFrame:
    """``by``, ``p``, ``first``, ``part`` and the values at that place and the next, one row a group and probability."""
    groups = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    asked = [(i, *_places(F.col("n"), p)) for i, p in enumerate(probabilities)]
    targets = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(j).alias("j"), F.least(first + j, F.col("n") - 1).alias("k"), part.alias("part")) for i, first, part in asked for j in (0, 1)])
    state = stored(groups.select(*by, "low", "high", F.explode(targets).alias("t")).select(*by, "low", "high", "t.p", "t.j", "t.k", "t.part"), "ranges")
    done = None
    while True:
        ended = state.filter("low = high").select(*by, "p", "j", "part", F.col("low").alias("value"))
        done = ended if done is None else done.unionByName(ended)
        state = state.filter("low < high")
        if not state.head(1):
            return done
        # places of a group that are still in one range are counted together
        ranges = state.select(*by, "low", "high").distinct()
        ranges = F.broadcast(ranges) if by == ["_all"] else ranges  # one group: a range or two a probability
        near = values.join(ranges, list(by)).filter(F.col("x").between(F.col("low"), F.col("high")))
        counts = near.groupBy(*by, "low", "high", _bin(F.col("x"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*by, "low", "high").orderBy("bin"))
        counts = counts.withColumn("upto", upto)
        hit = state.join(counts, [*by, "low", "high"]).filter((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n")))
        state = stored(hit.select(*by, F.col("least").alias("low"), F.col("most").alias("high"), "p", "j", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "part"), "ranges")


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str] = (), bins: int = 4096) -> DataFrame:
    """``by`` and ``quantiles``, an array in the order of ``probabilities``, with interpolation between neighbours.

    Nulls and NaN don't count; a group without values has no row, and without
    ``by`` an empty column gives one null array.  Null groups are groups.
    """
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError(f"probabilities {probabilities}: each lies between 0 and 1")
    keys = [_BY.format(i) for i in range(len(by))] or ["_all"]
    # a null group is told from all others by the second key, as joins match no nulls
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in zip(keys, by, strict=False)] if by else [F.lit(0).alias("_all")]
    nulls = [F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in by]).alias("_nulls")] if by else []
    x = F.col(column).cast("double")
    values = df.filter(x.isNotNull() & ~F.isnan(x)).select(*named, *nulls, x.alias("x"))
    keys = keys + ["_nulls"] if by else keys
    found = _selected(values, keys, probabilities, bins)
    pair = found.groupBy(*keys, "p").agg(F.max("part").alias("part"), F.max(F.when(F.col("j") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("j") == 1, F.col("value"))).alias("b"))
    value = F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    out = pair.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", value.alias("v")))), lambda q: q["v"]).alias("quantiles"))
    if not by:
        one = df.sparkSession.range(1).select(F.lit(0).alias("_all"))
        return one.join(out, "_all", "left").select("quantiles")
    back = [F.when(F.substring("_nulls", i + 1, 1) == "0", F.col(k)).cast(df.schema[c].dataType).alias(c) for i, (k, c) in enumerate(zip(keys, by, strict=False))]
    return out.select(*back, "quantiles")
