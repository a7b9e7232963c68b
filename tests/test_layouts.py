"""Layouts and maps against numpy and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citewell.operators import layout, neighbours, umap
from citewell.operators.neighbours import nearest_neighbours

COLUMNS = [f"c{i}" for i in range(6)]


def cloud(n=180, groups=6, seed=1):
    """Points around centres on a curve, which two axes can't part, some of them equal and some figures missing."""
    r = np.random.default_rng(seed)
    t = r.integers(0, groups, n) / groups * 4 * np.pi
    x = np.stack([np.cos(t), np.sin(t), np.cos(2 * t), np.sin(2 * t), np.cos(3 * t), np.sin(3 * t)], 1) * 3 + r.normal(0, 0.25, (n, 6))
    x[5:9] = x[5]
    return x


def frame(spark, x, **more):
    rows = [(i, *map(float, p), *(v[i] for v in more.values())) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in COLUMNS) + "".join(f", {c} string" for c in more))


def scaled(x):
    return (x - x.mean(0)) / x.std(0)


def true_neighbours(z, k):
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, 1, kind="stable")[:, :k], np.sort(d, 1)[:, :k]


def trustworthiness(z, y, k=10):
    n = len(z)
    d, e = (((a[:, None] - a[None]) ** 2).sum(-1) for a in (z, y))
    np.fill_diagonal(d, np.inf)
    np.fill_diagonal(e, np.inf)
    rank, near = np.argsort(np.argsort(d, 1), 1) + 1, np.argsort(e, 1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()


def test_principal_components(spark):
    x = cloud()
    got = np.array([(r.x, r.y) for r in layout.layout_2d(frame(spark, x), ["id"], COLUMNS).orderBy("id").collect()])
    values, vectors = np.linalg.eigh(np.cov(scaled(x).T, bias=True))
    want = scaled(x) @ vectors[:, np.argsort(-values)[:2]]
    for axis in (0, 1):
        assert np.allclose(got[:, axis], want[:, axis] * np.sign(got[0, axis] * want[0, axis]), atol=1e-8)


def test_map_places_and_distances(spark):
    x = scaled(cloud())
    df = frame(spark, x)
    book = np.random.default_rng(3).normal(size=(12, 6))
    got = {r.id: (r.bmu_row, r.bmu_col) for r in layout.with_bmu(df, COLUMNS, book, 4).collect()}
    for i, p in enumerate(x):
        best = min(range(12), key=lambda n: ((book[n] - p) ** 2).sum())
        assert got[i] == (best // 4, best % 4)
    height = {(r.row, r.col): r.u for r in layout.u_matrix(spark, book, 3, 4).collect()}
    for r in range(3):
        for c in range(4):
            # odd rows stand half a place to the right
            at = lambda r, c: (np.sqrt(3) * (c + 0.5 * (r % 2)), 1.5 * r)
            near = [(a, b) for a in range(3) for b in range(4) if (a, b) != (r, c) and np.hypot(*np.subtract(at(a, b), at(r, c))) < 1.8]
            assert height[r, c] == pytest.approx(np.mean([np.linalg.norm(book[r * 4 + c] - book[a * 4 + b]) for a, b in near]))
    usage = layout.map_usage(layout.with_bmu(df, COLUMNS, book, 4), 3, 4).first()
    assert (usage.n, usage.neurons, usage.outside) == (len(x), len(set(got.values())), 0)


def test_map_error_falls(spark):
    df = frame(spark, scaled(cloud()))
    errors = [layout.map_error(df, COLUMNS, layout.train_map(df, COLUMNS, 5, 6, epochs)) for epochs in (0, 2, 8)]
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.5 * errors[0]


def test_map_of_trajectories(spark):
    """30 by 50 neurons, as the reports have."""
    book = layout.train_map(frame(spark, scaled(cloud(60))), COLUMNS, 30, 50, epochs=3)
    assert book.shape == (1500, 6) and np.isfinite(book).all()
    assert layout.u_matrix(spark, book, 30, 50).count() == 1500


@pytest.mark.parametrize("block", [32, 4096])
def test_neighbours(spark, block):
    z = scaled(cloud(300))
    points = spark.createDataFrame([(i, 1, 0, len(z), p.tolist()) for i, p in enumerate(z)], "i long, ctx long, first long, n long, x array<double>")
    got = {r.i: [e.j for e in r.near] for r in nearest_neighbours(points, 6, 8, block=block).collect()}
    near, far = true_neighbours(z, 8)
    # equal distances may go either way
    found = [sum(np.sqrt(((z[i] - z[j]) ** 2).sum()) <= far[i, -1] + 1e-9 for j in got[i]) / 8 for i in range(len(z))]
    assert len(near) == len(got) and np.mean(found) >= (1.0 if block > 300 else 0.95)
    assert all(i not in js and len(set(js)) == 8 for i, js in got.items())


def test_weights_and_curve():
    a, b = umap.curve(0.1)
    assert (a, b) == (pytest.approx(1.577, abs=2e-3), pytest.approx(0.8951, abs=2e-3))
    d = np.array([0.0, 0.5, 0.7, 1.1, 1.5, 2.0, 3.0])
    w = umap.memberships(d, 8)
    assert w.sum() == pytest.approx(3.0, abs=1e-3) and w[0] == w[1] == 1.0 and (np.diff(w) <= 0).all()
    assert umap.memberships(np.zeros(3), 4).tolist() == [1.0] * 3


def test_umap(spark):
    """Better than two axes at keeping neighbours; the same for another partitioning; small and null contexts by themselves."""
    x = cloud(150)
    label = ["a"] * 120 + ["b"] * 20 + [None] * 8 + ["few"] * 2
    df = frame(spark, x, label=label)
    got = umap.umap_by_context(df, "label", ["id"], COLUMNS, epochs=120).collect()
    again = umap.umap_by_context(df.repartition(7, "c1"), "label", ["id"], COLUMNS, epochs=120).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert {r.label for r in got} == {"a", "b", None} and len(got) == 148
    y = np.array([(r.umap_x, r.umap_y) for r in sorted(got, key=lambda r: r.id) if r.label == "a"])
    plain = np.array([(r.x, r.y) for r in layout.layout_2d(df.filter("label = 'a'"), ["id"], COLUMNS).orderBy("id").collect()])
    z = scaled(x[:120])
    assert np.isfinite(y).all() and trustworthiness(z, y) > trustworthiness(z, plain)


def test_umap_in_blocks(spark):
    """A context larger than a block, laid out by turns."""
    x = cloud(150)
    got = umap.umap_2d(frame(spark, x), ["id"], COLUMNS, epochs=60, nodes_per_block=60, turns=3).orderBy("id").collect()
    y = np.array([(r.umap_x, r.umap_y) for r in got])
    assert len(y) == 150 and trustworthiness(scaled(x), y) > 0.85
    assert umap.umap_2d(frame(spark, x).limit(0), ["id"], COLUMNS).collect() == []
    assert F is not None


def test_neighbour_lists_are_arrays():
    import tracemalloc

    r = np.random.default_rng(3)
    groups = [(r.permutation(1000)[:29], r.normal(size=(29, 8))) for _ in range(256)]
    tracemalloc.start()
    got = neighbours._found(groups, 14)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * got.num_rows * 14 + (1 << 20)  # an object a pair takes some 300 bytes
    ids, x = groups[7]
    rows = got.slice(7 * 29, 29).to_pylist()
    assert [p["i"] for p in rows] == sorted(ids.tolist())
    one = int(np.argmin(ids))
    d = np.sqrt(((x - x[one]) ** 2).sum(1))
    assert [e["j"] for e in rows[0]["near"]] == ids[np.argsort(d)[1:15]].tolist()
    assert neighbours._found([], 14).num_rows == 0
