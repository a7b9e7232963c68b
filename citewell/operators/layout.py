"""Standardisation, two-dimensional layouts and self-organising maps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.shared import stored


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0.  Means and deviations are one broadcast row."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    one = lambda c: ((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))).alias(c)
    return df.join(F.broadcast(stats)).select(*[one(c) if c in columns else F.col(c) for c in df.columns])


def _point(columns: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def moments(df: DataFrame, columns: Sequence[str], by: str, held: int = 1000) -> DataFrame:
    """``by, m``: number of rows, sums and sums of products of the columns for each value of ``by``; missing figures count as 0.

    A task gives a row for each value it meets, at most ``held`` at a time, and
    these are summed, so a value that most rows have is spread like any other.
    """
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(found), kind), pa.array([m.tolist() for m in found.values()], pa.list_(pa.float64()))], ["by", "m"])
            found.clear()
            return made

        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            rows: dict = {}
            for i, key in enumerate(keys):
                rows.setdefault(key, []).append(i)
            for key, at in rows.items():
                part = x[at]
                found[key] = found.get(key, 0) + np.concatenate([[len(at)], part.sum(0), (part.T @ part).ravel()])
                if len(found) >= held:
                    yield out()
        if found:
            yield out()

    kind = df.schema[by].dataType.simpleString()
    parts = df.select(F.col(by).alias("by"), _point(columns).alias("x")).mapInArrow(run, f"by {kind}, m array<double>")
    sums = parts.select("by", F.posexplode("m").alias("at", "v")).groupBy("by", "at").agg(F.sum("v").alias("v"))
    return sums.groupBy("by").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("m"))


def axes_of(m: Sequence[float], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights ``[2, k]`` and shifts ``[2]`` that place a row on the two leading axes of the standardised columns, from their moments."""
    n, s, p = m[0], np.array(m[1 : k + 1]), np.array(m[k + 1 :]).reshape(k, k)
    mean = s / n
    cov = p / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale < 1e-12 * (1 + np.abs(mean))] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    axes = vectors[:, np.argsort(-values)[:2]]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)
    weights = np.zeros((2, k))
    weights[: axes.shape[1]] = (axes / scale[:, None]).T
    return weights, weights @ mean


def layout_by_context(df: DataFrame, context: str, ids: Sequence[str], columns: Sequence[str], least: int = 10) -> DataFrame:
    """``x, y`` by principal components of the standardised columns, for each context (the entities of a country) with enough rows.

    Only moments are gathered by context; rows meet their context's axes by a join on a table of one row a context.
    """
    k = len(columns)

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [axes_of(m, k) for m in frame["m"]]
            yield pd.DataFrame({"by": frame["by"], "u": [w[0] for w, _ in made], "v": [w[1] for w, _ in made], "a": [c[0] for _, c in made], "b": [c[1] for _, c in made]})

    kind = df.schema[context].dataType.simpleString()
    axes = moments(df, columns, context).filter(F.col("m")[0] >= least).mapInPandas(turn, f"by {kind}, u array<double>, v array<double>, a double, b double")
    at = lambda w, c: F.aggregate(F.zip_with(_point(columns), w, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) - F.col(c)
    return df.join(axes, df[context].eqNullSafe(axes["by"])).select(context, *ids, at("u", "a").alias("x"), at("v", "b").alias("y"))


def layout_2d(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``x, y`` by principal components of the standardised columns: the deterministic layout of the engine."""
    return layout_by_context(df.withColumn("_all", F.lit(0)), "_all", ids, columns, least=1).drop("_all")


def train_map(df: DataFrame, columns: Sequence[str], rows: int = 10, cols: int = 15, epochs: int = 20, seed: int = 42) -> np.ndarray:
    """A batch self-organising map: a codebook of ``rows * cols`` neurons.

    Each epoch sums, per neuron, the rows it wins: neurons are at most some
    thousands, so an epoch's result is small whatever the table.  The columns are
    written once, so a lost executor costs an epoch its own tasks alone.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    book = rng.normal(size=(rows * cols, len(columns)))
    grid = np.array([(np.sqrt(3) * (c + 0.5 * (r % 2)), 1.5 * r) for r in range(rows) for c in range(cols)])
    apart = ((grid[:, None] - grid[None]) ** 2).sum(2)
    df = stored(df.select(*columns), "standardised")
    for epoch in range(epochs):
        won = with_bmu(df, columns, book, cols).groupBy("neuron").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns]).collect()
        sums, n = np.zeros_like(book), np.zeros(len(book))
        for r in won:
            n[r["neuron"]] = r["n"]
            sums[r["neuron"]] = [r[c] or 0.0 for c in columns]
        radius = max(rows, cols) / 2 * (1 / max(rows, cols)) ** (epoch / max(1, epochs - 1))
        pull = np.exp(-apart / (2 * radius**2))
        weight = pull @ n
        book = np.where(weight[:, None] > 1e-12, (pull @ sums) / np.maximum(weight, 1e-12)[:, None], book)
    return book


def with_bmu(df: DataFrame, columns: Sequence[str], book: np.ndarray, cols: int) -> DataFrame:
    """Adds the nearest neuron and its place; ties go to the first."""

    @F.pandas_udf("int")
    def nearest(points: pd.Series) -> pd.Series:
        x = np.stack(points.to_numpy()) if len(points) else np.zeros((0, book.shape[1]))
        return pd.Series(((book**2).sum(1) - 2 * x @ book.T).argmin(1))

    return df.withColumn("neuron", nearest(_point(columns))).withColumn("bmu_row", (F.col("neuron") / cols).cast("int")).withColumn("bmu_col", F.col("neuron") % cols)


def map_error(df: DataFrame, columns: Sequence[str], book: np.ndarray) -> float:
    """The mean distance of a row to its nearest neuron."""
    bound = df.sparkSession.sparkContext.broadcast(book)

    @F.pandas_udf("double")
    def apart(points: pd.Series) -> pd.Series:
        x, b = np.stack(points.to_numpy()), bound.value
        return pd.Series(np.sqrt(np.maximum(((x**2).sum(1)[:, None] - 2 * x @ b.T + (b**2).sum(1)).min(1), 0)))

    return df.agg(F.avg(apart(_point(columns))).alias("e")).first()["e"] or 0.0


def u_matrix(spark, book: np.ndarray, rows: int, cols: int) -> DataFrame:
    """``row, col, u``: the mean distance of each neuron to its neighbours on the grid."""
    made = []
    for r in range(rows):
        for c in range(cols):
            shift = r % 2
            near = [(r, c - 1), (r, c + 1), (r - 1, c - 1 + shift), (r - 1, c + shift), (r + 1, c - 1 + shift), (r + 1, c + shift)]
            far = [float(np.linalg.norm(book[r * cols + c] - book[a * cols + b])) for a, b in near if 0 <= a < rows and 0 <= b < cols]
            made.append((r, c, float(np.mean(far)) if far else 0.0))
    return spark.createDataFrame(made, "row int, col int, u double")


def map_usage(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """Neurons used, their share, and rows placed outside the grid, as one row."""
    inside = F.col("bmu_row").between(0, rows - 1) & F.col("bmu_col").between(0, cols - 1)
    used = F.count_distinct("bmu_row", "bmu_col")
    return df.agg(F.count(F.lit(1)).alias("n"), used.alias("neurons"), (100.0 * used / (rows * cols)).alias("pct_used"), F.count_if(~inside).alias("outside"))
