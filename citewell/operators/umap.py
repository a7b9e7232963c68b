"""Two-dimensional layouts by uniform manifold approximation: a fuzzy graph of nearest neighbours, laid out by gradient steps.

Columns are standardised in each context, neighbours found by
``neighbours.nearest_neighbours``, distances turned into weights whose sum is the
logarithm of the number of neighbours, and both directions of an edge joined as
a probabilistic sum.  The layout begins at the two principal components and
follows edges by weight, with negative samples.  A context of at most
``nodes_per_block`` points is one block, laid out in one task; a larger one is
cut into blocks by place, which move by turns beside the last places of the others.

Coordinates are a stochastic optimum, so they equal no other library's number
for number; they are the same for every partitioning of the input.

Cases: null figures count as 0; contexts of fewer than ``least`` points have no
layout; a null context is one of its own; points that are equal keep places of their own; rows
that agree in all columns are told apart by an arbitrary number; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.operators.layout import axes_of, moments
from citewell.operators.neighbours import nearest_neighbours
from citewell.operators.ranks import numbered
from citewell.shared import stored


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """``a`` and ``b`` of 1 / (1 + a x^2b), closest to 1 up to ``min_dist`` and an exponential fall behind it."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p = np.array([1.0, 1.0])
    damp = 1e-3

    def residual(p: np.ndarray) -> np.ndarray:
        return 1 / (1 + p[0] * x ** (2 * p[1])) - want

    for _ in range(200):
        power = x ** (2 * p[1])
        slope = -1 / (1 + p[0] * power) ** 2
        jacobian = np.stack([slope * power, slope * p[0] * power * 2 * np.log(x)], 1)
        r = residual(p)
        step = np.linalg.solve(jacobian.T @ jacobian + damp * np.eye(2), -jacobian.T @ r)
        if (residual(p + step) ** 2).sum() < (r**2).sum():
            p, damp = p + step, damp / 3
        else:
            damp *= 4
    return float(p[0]), float(p[1])


def memberships(distances: np.ndarray, neighbours: int) -> np.ndarray:
    """Weights of a point's edges: 1 up to the nearest point apart from it, then falling so that they sum to log2 of ``neighbours``."""
    apart = distances[distances > 0]
    nearest = apart.min() if len(apart) else 0.0
    beyond = np.maximum(distances - nearest, 0)
    low, high, scale, want = 0.0, np.inf, 1.0, np.log2(neighbours)
    for _ in range(64):
        total = np.where(beyond > 0, np.exp(-beyond / scale), 1.0).sum()
        if abs(total - want) < 1e-5:
            break
        low, high = (low, scale) if total > want else (scale, high)
        scale = (low + high) / 2 if np.isfinite(high) else scale * 2
    scale = max(scale, 1e-3 * distances.mean()) if len(distances) else scale
    return np.where(beyond > 0, np.exp(-beyond / scale), 1.0) if scale > 0 else np.ones(len(distances))


def fuzzy_edges(graph: DataFrame, neighbours: int) -> DataFrame:
    """``i, j, w``: each edge once, its two directions joined as w + v - w v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            size = np.array([len(x) for x in near], np.int64)
            flat = near.flatten()
            i = np.repeat(batch.column("i").to_numpy(), size)
            d, j = flat.field("d").to_numpy(), flat.field("j").to_numpy()
            w = [memberships(x, min(neighbours, len(x) + 1)) for x in np.split(d, np.cumsum(size)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(np.concatenate(w) if w else np.empty(0))], names=["i", "j", "w"])

    ways = graph.mapInArrow(run, "i long, j long, w double")
    return ways.groupBy("i", "j").agg(F.when(F.count(F.lit(1)) == 2, F.sum("w") - F.min("w") * F.max("w")).otherwise(F.max("w")).alias("w"))


def _steps(nodes: np.ndarray, places: np.ndarray, heads: np.ndarray, tails: np.ndarray, weights: np.ndarray, epochs: tuple[int, int, int], ab: tuple[float, float], own: int, seed: int) -> np.ndarray:
    """Places after the epochs from the first to the second of all; only the first ``own`` nodes move."""
    a, b = ab
    first, last, of = epochs
    rng = np.random.Generator(np.random.PCG64([seed, first, int(nodes[0]) if len(nodes) else 0]))
    keep = weights >= weights.max(initial=0) / of
    heads, tails, weights = heads[keep], tails[keep], weights[keep]
    if not len(heads):
        return places
    rate = weights / weights.max()
    places = places.copy()

    def move(at: np.ndarray, by: np.ndarray) -> None:
        fit = at < own
        for axis in (0, 1):
            places[:, axis] += np.bincount(at[fit], by[fit, axis], len(places))

    for epoch in range(first, last):
        alpha = 1.0 - epoch / of
        active = np.flatnonzero(np.floor((epoch + 1) * rate) > np.floor(epoch * rate))
        for part in np.array_split(rng.permutation(active), min(8, max(1, len(active)))):
            h, t = heads[part], tails[part]
            gap = places[h] - places[t]
            d2 = (gap**2).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull = np.where(d2 > 0, -2 * a * b * d2 ** (b - 1) / (1 + a * d2**b), 0.0)
            step = np.clip(pull[:, None] * gap, -4, 4) * alpha
            move(h, step)
            move(t, -step)
            h = np.repeat(h, 5)
            others = rng.integers(0, len(places), len(h))
            gap = places[h] - places[others]
            d2 = (gap**2).sum(1)
            push = np.where(h != others, 2 * b / ((0.001 + d2) * (1 + a * d2**b)), 0.0)
            move(h, np.where((d2 > 0)[:, None], np.clip(push[:, None] * gap, -4, 4), 4.0 * (h != others)[:, None]) * alpha)
    return places


def _laid_out(points: DataFrame, edges: DataFrame, ab: tuple[float, float], epochs: int | None, nodes_per_block: int, turns: int, seed: int) -> DataFrame:
    """``i, x, y`` from ``i, ctx, first, n, x, y`` and the edges."""
    def of_block(nodes: pa.Table, ways: pa.Table, first: float, last: float) -> pa.Table:
        nodes = nodes.sort_by("i")
        own = nodes.column("i").to_numpy()
        of = epochs or (500 if len(own) and nodes.column("n")[0].as_py() <= 10_000 else 200)
        ways = ways.sort_by([("i", "ascending"), ("j", "ascending")])
        i, j = ways.column("i").to_numpy(), ways.column("j").to_numpy()
        strange, where = np.unique(j[~np.isin(j, own)], return_index=True)
        far = np.stack([ways.column(c).to_numpy()[~np.isin(j, own)][where] for c in ("jx", "jy")], 1)
        names = np.concatenate([own, strange])
        order = np.argsort(names)
        at = lambda k: order[np.searchsorted(names, k, sorter=order)]
        places = np.concatenate([np.stack([nodes.column(c).to_numpy() for c in ("x", "y")], 1), far])
        once = np.isin(j, strange) | (i < j)  # an edge within the block has come from both its ends
        moved = _steps(names, places, at(i[once]), at(j[once]), ways.column("w").to_numpy()[once], (round(first * of), round(last * of), of), ab, len(own), seed)
        return pa.table({"i": own, "x": moved[: len(own), 0], "y": moved[: len(own), 1]})

    def moved_between(first: float, last: float):
        return lambda nodes, ways: of_block(nodes, ways, first, last)

    rest = points.drop("x", "y")
    both = stored(edges.select("i", "j", "w").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")), "ways")
    single = not points.filter(F.col("n") > nodes_per_block).select("i").head(1)
    turns = 1 if single else turns
    for turn in range(turns):
        places = points.select("i", "x", "y")
        if single:
            blocks = points.withColumn("b", F.lit(0).cast("long"))
        else:  # by turns along either axis, so that borders move
            ranked = numbered(points, ["ctx", "xy"[turn % 2], "i"], "_at")
            shift = (turn // 2 % 2) * (nodes_per_block // 2)
            blocks = ranked.withColumn("b", F.floor((F.col("_at") - 1 - F.col("first") + shift) / nodes_per_block))
        blocks = blocks.select("i", "ctx", "b", "n", "x", "y")
        of = blocks.select("i", F.col("ctx").alias("wctx"), F.col("b").alias("wb"))
        ways = both.join(of, "i").join(places.select(F.col("i").alias("j"), F.col("x").alias("jx"), F.col("y").alias("jy")), "j")
        run = moved_between(turn / turns, (turn + 1) / turns)
        moved = blocks.groupBy("ctx", "b").cogroup(ways.select("wctx", "wb", "i", "j", "w", "jx", "jy").groupBy("wctx", "wb")).applyInArrow(run, "i long, x double, y double")
        points = stored(rest.join(moved, "i"), "places")
    return points.select("i", "x", "y")


def umap_by_context(
    df: DataFrame, context: str, ids: Sequence[str], columns: Sequence[str], neighbours: int = 15, min_dist: float = 0.1, least: int = 3,
    epochs: int | None = None, nodes_per_block: int = 20_000, turns: int = 10, seed: int = 42,
) -> DataFrame:
    """``context, ids, umap_x, umap_y`` for each context with at least ``least`` rows; a small one has fewer neighbours."""
    if neighbours < 2:
        raise ValueError(f"neighbours {neighbours}: a point and one other at least")
    k = len(columns)
    kind = df.schema[context].dataType.simpleString()

    def steady(x: np.ndarray) -> np.ndarray:
        return np.array([float(f"{v:.8g}") for v in x.ravel()]).reshape(x.shape)

    def frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for by, m in zip(part["by"], part["m"], strict=True):
                weights, shift = axes_of(m, k)
                n, mean = m[0], np.array(m[1 : k + 1]) / m[0]
                scale = np.sqrt(np.maximum(np.diag(np.array(m[k + 1 :]).reshape(k, k)) / n - mean**2, 0))
                scale[scale < 1e-12 * (1 + np.abs(mean))] = 1.0
                # sums differ in their last digits by partitioning, and gradient steps would carry that on
                mean, scale, weights, shift = map(steady, (mean, scale, weights, shift))
                rows.append((by, int(n), mean, scale, weights[0], weights[1], shift[0], shift[1]))
            yield pd.DataFrame(rows, columns=["by", "n", "mean", "scale", "u", "v", "a", "b"])

    figures = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    rows = df.select(F.col(context).alias("_ctx"), *[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], figures.alias("_p"))
    contexts = moments(df, columns, context).filter(F.col("m")[0] >= least)
    contexts = contexts.mapInPandas(frames, f"by {kind}, n long, mean array<double>, scale array<double>, u array<double>, v array<double>, a double, b double")
    contexts = numbered(contexts, ["by"], "ctx")
    dot = lambda w, c: F.aggregate(F.zip_with("_p", w, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) - F.col(c)
    joined = rows.join(contexts, rows["_ctx"].eqNullSafe(contexts["by"]))
    z = F.transform(F.arrays_zip(F.col("_p").alias("p"), F.col("mean").alias("m"), F.col("scale").alias("s")), lambda t: (t["p"] - t["m"]) / t["s"])
    named = [f"_id{i}" for i in range(len(ids))]
    points = joined.select("_ctx", *named, "ctx", "n", z.alias("z"), dot("u", "a").alias("px"), dot("v", "b").alias("py"))
    points = numbered(points, ["ctx", *named, "z"], "i").withColumn("i", F.col("i") - 1)
    starts = points.groupBy("ctx").agg(F.min("i").alias("first"), F.max(F.abs("px")).alias("wide"))
    # ten units either way, as the steps are made for; a hair by number parts equal points
    spread = lambda c, s: (F.col(c) * 10 / F.when(F.col("wide") > 0, F.col("wide")).otherwise(1.0) + 1e-4 * F.sin(F.col("i") * F.lit(s))).alias(c[1])
    points = stored(points.join(starts, "ctx").select("i", "ctx", "first", "n", "_ctx", *named, "z", spread("px", 12.9898), spread("py", 78.233)), "points")
    near = nearest_neighbours(points.select("i", "ctx", "first", "n", F.col("z").alias("x")), k, neighbours - 1, seed=seed)
    edges = stored(fuzzy_edges(near, neighbours), "edges")
    placed = _laid_out(points.select("i", "ctx", "first", "n", "x", "y"), edges, curve(min_dist), epochs, nodes_per_block, turns, seed)
    out = points.select("i", "_ctx", *named).join(placed, "i")
    return out.select(F.col("_ctx").alias(context), *[F.col(a).alias(b) for a, b in zip(named, ids, strict=True)], F.col("x").alias("umap_x"), F.col("y").alias("umap_y"))


def umap_2d(df: DataFrame, ids: Sequence[str], columns: Sequence[str], **how) -> DataFrame:
    """``ids, umap_x, umap_y`` of all rows as one context."""
    return umap_by_context(df.withColumn("_all", F.lit(0)), "_all", ids, columns, **how).drop("_all")
