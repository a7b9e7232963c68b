"""The graph of nearest neighbours, within contexts: random projections give blocks, and neighbours of neighbours mend what blocks cut.

Points are numbered rows ``i, ctx, first, n, x``: a number over all contexts, the
context, the first number in it, its number of points, and the coordinates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewell.operators.ranks import numbered
from citewell.shared import stored

_GROUPS = 256  # of members that give one batch of neighbours, however many rows came in one
_NEAR = "i long, near array<struct<d: double, j: long>>"
_NEAR_TYPE = pa.list_(pa.struct([("d", pa.float64()), ("j", pa.int64())]))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pair by pair, so that two points are as far apart in whatever block they meet."""
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(-1))


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points by number, and a row each of the distances and numbers of its ``k`` nearest others; of equal distances the smaller number."""
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    d = _distances(x, x)
    np.fill_diagonal(d, np.inf)
    at = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(ids) - 1)]
    return ids, np.take_along_axis(d, at, 1), ids[at]


def _found(groups: Iterable[tuple[np.ndarray, np.ndarray]], k: int) -> pa.RecordBatch:
    """``i, near`` of all points of the groups, built from arrays: a Python object for each pair would take twenty times the memory."""
    ids, sizes, ds, js = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]
    for numbers, x in groups:
        i, d, j = _nearest(numbers, x, k)
        ids.append(i)
        sizes.append(np.full(len(i), d.shape[1], np.int64))
        ds.append(d.ravel())
        js.append(j.ravel())
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(ds)), pa.array(np.concatenate(js))], fields=list(_NEAR_TYPE.value_type))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.ListArray.from_arrays(pa.array(ends), pairs, type=_NEAR_TYPE)], names=["i", "near"])


def _projected(points: DataFrame, width: int, rounds: int, block: int, seed: int) -> DataFrame:
    """``points`` once a round, with the signs of random projections as ``code``, as many as the context needs, and one more projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = np.random.Generator(np.random.PCG64(seed)).normal(size=(rounds, width, 32))
        for batch in batches:
            x, n = _matrix(batch.column("x"), width), batch.column("n").to_numpy()
            bits = np.clip(np.ceil(np.log2(np.maximum(n, 1) / (block / 2))), 0, 31).astype(np.int64)
            for r in range(rounds):
                p = x @ turns[r]
                signs = (p[:, :31] > 0) @ (1 << np.arange(31, dtype=np.int64)[::-1])
                code = signs >> (31 - bits)
                columns = [*batch.columns, pa.array(np.full(len(n), r), pa.int32()), pa.array(code), pa.array(p[:, 31])]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "round", "code", "along"])

    kinds = "i long, ctx long, first long, n long, x array<double>, round int, code long, along double"
    return points.select("i", "ctx", "first", "n", "x").mapInArrow(run, kinds)


def _merged(near: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of all that was found for a point."""
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))))
    return near.groupBy("i").agg(F.slice(found, 1, k).alias("near"))


def nearest_neighbours(points: DataFrame, width: int, k: int, block: int = 256, rounds: int = 6, descents: int = 3, seed: int = 42) -> DataFrame:
    """``i, near``: about the ``k`` nearest other points of a point's context, with their distances, nearest first.

    In each round points are sorted by context, signs of random projections and
    one more projection, and runs of ``block`` points compare all their pairs: no
    block grows with a context or with a point that recurs.  Where a context is
    larger than a block, ``descents`` times each point's neighbours, and the
    points nearest to it that have it as theirs, 2 ``k`` at most, meet.  Results
    depend on the points and ``seed``, not on partitions.
    """
    def of_block(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_found([(table.column("i").to_numpy(), _matrix(table.column("x"), width))], k)])

    large = points.filter(F.col("n") > block).select("i").head(1)
    rounds = rounds if large else 1
    sorted_ = numbered(_projected(points, width, rounds, block, seed), ["round", "ctx", "code", "along", "i"], "at")
    total = points.count()
    place = F.col("at") - 1 - F.col("round") * F.lit(total) - F.col("first")
    shift = (F.col("round") % 2) * (block // 2)
    blocks = sorted_.select("round", "ctx", F.floor((place + shift) / block).alias("b"), "i", "x")
    graph = stored(_merged(blocks.groupBy("round", "ctx", "b").applyInArrow(of_block, _NEAR), k), "near")
    if not large:
        return graph

    def of_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            for begin in range(0, len(members), _GROUPS):
                parts = (m.values for m in members.slice(begin, _GROUPS))
                yield _found(((m.field("j").to_numpy(), _matrix(m.field("x"), width)) for m in parts), k)

    vectors = points.select(F.col("i").alias("j"), "x")
    for _ in range(descents):
        out = graph.select("i", F.explode("near").alias("e")).select("i", "e.j", "e.d")
        back = F.row_number().over(Window.partitionBy("j").orderBy("d", "i"))
        into = out.withColumn("r", back).filter(F.col("r") <= k).select(F.col("j").alias("i"), F.col("i").alias("j"))
        members = out.select("i", "j").union(into).union(graph.select("i", F.col("i").alias("j"))).distinct()
        groups = members.join(vectors, "j").groupBy("i").agg(F.collect_list(F.struct("j", "x")).alias("members"))
        graph = stored(_merged(graph.unionByName(groups.select("members").mapInArrow(of_members, _NEAR)), k), "near")
    return graph
