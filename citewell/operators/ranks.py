"""Ranks and running totals over a whole table, without a window that gathers it in one task.

Rows are sorted by range; each range counts its rows, and the counts of the
ranges before it, one row a range, are added to places within it.  Ties are one
row before they are ranked, so a value that most rows share is one entry.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewell.shared import stored

_ROWS = (1 << 33) - 1  # of monotonically increasing ids, the bits below the partition's number


def _sorting(order: Sequence[str]) -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def _names(order: Sequence[str]) -> list[str]:
    return [c.removeprefix("-") for c in order]


def _ranged(df: DataFrame, order: Sequence[str], parts: int | None) -> DataFrame:
    """``df`` sorted by range and stored, with ``_range`` and ``_at``, the place in it."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = _sorting(order)
    rows = stored(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "ranged")
    return rows.select("*", F.shiftright("_id", 33).cast("int").alias("_range"), F.col("_id").bitwiseAND(F.lit(_ROWS)).alias("_at")).drop("_id")


def _before(rows: DataFrame, sums: dict[str, Column]) -> tuple[DataFrame, dict[str, float]]:
    """``_range`` and each sum over the ranges before it, as many rows as ranges, and the sums over all."""
    found = sorted(rows.groupBy("_range").agg(*[x.alias(c) for c, x in sums.items()]).collect())
    kind = {c: next((k for k in (float, Decimal) if any(isinstance(r[c], k) for r in found)), int) for c in sums}
    running = {c: list(accumulate((kind[c](r[c] or 0) for r in found), initial=kind[c](0))) for c in sums}
    named = {float: "double", Decimal: "decimal(38,0)", int: "long"}
    kinds = ", ".join(f"{c} {named[kind[c]]}" for c in sums)
    made = [(r["_range"], *(running[c][i] for c in sums)) for i, r in enumerate(found)]
    return rows.sparkSession.createDataFrame(made, f"_range int, {kinds}"), {c: running[c][-1] for c in sums}


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_number", tiles: int | None = None, parts: int | None = None) -> DataFrame:
    """Adds each row's number in a total order from 1, and with ``tiles`` its ``ntile``.

    ``order`` has column names, those with a minus descending; nulls come first
    ascending and last descending.
    """
    rows = _ranged(df, order, parts)
    offsets, total = _before(rows, {"_n": F.count(F.lit(1))})
    number = F.col("_at") + F.col("_n") + 1
    made = rows.join(F.broadcast(offsets), "_range").select(*df.columns, number.cast("long").alias(name))
    if not tiles:
        return made
    each, more = divmod(int(total["_n"]), tiles)
    n, wide = F.col(name) - 1, more * (each + 1)
    tile = F.when(n < wide, F.floor(n / (each + 1))).otherwise(more + F.floor((n - wide) / max(each, 1)))
    return made.withColumn("ntile", (tile + 1).cast("int"))


def ranked(df: DataFrame, order: Sequence[str], weight: str | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``rank``, ``dense_rank`` and, with ``weight``, its ``running`` total and ``share`` up to and with a row's ties."""
    keys = _names(order)
    w = F.sum(weight) if weight else F.lit(0)
    groups = _ranged(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), w.alias("_weight")), order, parts)
    offsets, total = _before(groups, {"_n": F.sum("_rows"), "_k": F.count(F.lit(1)), "_w": F.sum("_weight")})
    here = Window.partitionBy("_range").orderBy("_at")
    upto = groups.withColumns({"_rows_upto": F.sum("_rows").over(here), "_weight_upto": F.coalesce(F.sum("_weight").over(here), F.lit(0))})
    made = upto.join(F.broadcast(offsets), "_range").select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], (F.col("_n") + F.col("_rows_upto") - F.col("_rows") + 1).alias("rank"),
        (F.col("_k") + F.col("_at") + 1).alias("dense_rank"), (F.col("_w") + F.col("_weight_upto")).alias("running"),
    )
    same = [df[k].eqNullSafe(made[f"_key_{k}"]) for k in keys]
    whole = float(total["_w"] or 0)
    more = [F.col("running"), (F.col("running") / whole if whole else F.lit(None).cast("double")).alias("share")] if weight else []
    return df.join(made, same).select(*[df[c] for c in df.columns], F.col("rank").cast("long").alias("rank"), F.col("dense_rank").cast("long").alias("dense_rank"), *more)


def running(df: DataFrame, order: Sequence[str], columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` with each of ``columns`` (whole numbers or doubles) as its total over the rows up to and with this one, in a total order."""
    rows = _ranged(df, order, parts)
    offsets, _ = _before(rows, {f"_before_{c}": F.sum(c) for c in columns})
    here = Window.partitionBy("_range").orderBy("_at")
    made = rows.withColumns({c: F.coalesce(F.sum(c).over(here), F.lit(0)) for c in columns})
    return made.join(F.broadcast(offsets), "_range").select(*[(F.col(c) + F.col(f"_before_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])
