"""The n-gram join against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from citewell.llm import ngram_join
from citewell.llm.components import connected_components
from citewell.llm.ngram_join import bands_and_rows, near_duplicates


def grams(text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    sets = [(i, grams(t)) for i, t in rows]
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[i] += 1
                links[j] += 1
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    return {i: (top(i), links[i]) for i, _ in rows}


def corpus(seed, groups=12, size=9):
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(3, 120))]
        for _ in range(r.randrange(1, size)):
            own = list(base)
            for _ in range(r.randrange(0, 3)):
                own[r.randrange(len(own))] = f"x{r.randrange(1000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, " \n\t"), (len(rows) + 3, "one two"), (len(rows) + 4, "one two")]
    return rows


@pytest.mark.parametrize("block_docs", [3, 512])
def test_equals_brute_force(spark, block_docs):
    rows = corpus(block_docs)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep": F.lit("x"), "bands": F.lit(1)})
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs, block_docs=block_docs).collect()}
    assert got == brute(rows)


def test_chains_go_by_buckets(spark):
    """A chain of near copies, each like its neighbours alone, is one component that is cheaper by its buckets."""
    words = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bands, per = bands_and_rows(0.8, 0.9999, 128)
    signed = ngram_join.signatures(docs, "doc_id", "text", 5, bands, per).withColumns({"rep": F.col("doc_id"), "root": F.lit(0), "copies": F.lit(1)})
    dealt = ngram_join.dealt_out(signed.drop("doc_id"), 3, 1 << 20)
    assert dealt.filter("band >= 0").count() and not dealt.filter("band < 0").count()
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs, block_docs=3).collect()}
    assert got == brute(rows)


def test_many_different_near_copies(spark):
    """One component of 1,500 texts: what is shuffled for each text grows with the number of chunks it is cut into, and all links count."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[: i % 290] + [f"x{i}"] + base[i % 290 + 1 :])) for i in range(1500)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1500 and {r.class_id for r in got} == {0} and all(r.n_links == 1499 for r in got)


def test_null_and_repeated_ids(spark):
    same, near = " ".join(map(str, range(40))), " ".join(map(str, range(41)))
    rows = [(None, same), (3, same), (3, same), (5, near), (7, None), (None, None), (9, "x"), (9, "a text of its own and then some")]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert [r for r in got if r[0] is None] == [(None, None, 0, None, 1)] * 2
    assert [r[:3] for r in got if r[0] in (3, 5, 7)] == [(3, 3, 2), (3, 3, 2), (5, 3, 2), (7, 7, 0)]
    assert [r[:3] for r in got if r[0] == 9] == [(9, 9, 0)] * 2


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_of_the_chosen_bands():
    bands, rows = bands_and_rows(0.8, 0.9999, 128)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


def brute_sets(rows, threshold=0.8):
    """Class, links and whether the row stays, where ids repeat: by sets, each under its smallest id."""
    sets = {}
    for i, t in rows:
        g = frozenset(grams(t))
        if g and i is not None:
            sets.setdefault(g, []).append(i)
    names = sorted(sets, key=lambda g: min(sets[g]))
    root = {g: g for g in names}

    def top(g):
        while root[g] != g:
            g = root[g]
        return g

    links = {g: len(sets[g]) - 1 for g in names}
    for a, x in enumerate(names):
        for y in names[:a]:
            if len(x & y) >= threshold * len(x | y) - 1e-9:
                links[x] += len(sets[y])
                links[y] += len(sets[x])
                root[top(x)] = top(y)
    class_of = {g: min(min(sets[h]) for h in names if top(h) == top(g)) for g in names}
    return [(i, class_of[frozenset(grams(t))], links[frozenset(grams(t))]) if grams(t) and i is not None else (i, i, 0) for i, t in rows]


def test_ids_that_repeat_with_other_texts(spark):
    """Every text has the class and links of its own set, and unlike texts stay whatever their ids."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = lambda t, x: t + f" {x}"
    keep = lambda rows: sorted((r.doc_id, r.text) for r in ngram_join.keep_one_per_class(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert keep([(9, a), (9, b), (5, near(a, "x"))]) == [(5, near(a, "x")), (9, b)]
    rows = [(9, a), (9, b), (5, near(a, "x")), (6, near(b, "y"))]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 5, 1), (6, 6, 1), (9, 5, 1), (9, 6, 1)]
    r = random.Random(7)
    rows = [(r.randrange(25), t) for _, t in corpus(11, groups=8, size=6)] + [(None, a), (None, near(a, "z")), (3, "long " * 40_000 + "end of it all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(docs, block_docs=4).collect()
    assert sorted(((x.doc_id, x.class_id, x.n_links) for x in found), key=str) == sorted(brute_sets(rows), key=str)
    # each class keeps something under its smallest id, and no text without a link goes unless a copy of it stays
    kept = [(x.doc_id, x.text) for x in ngram_join.keep_one_per_class(docs).collect()]
    assert {c for i, c, _ in brute_sets(rows) if i is not None} <= {i for i, _ in kept}
    stay = {frozenset(grams(t)) for _, t in kept}
    assert all(frozenset(grams(t)) in stay for (_, t), (_, _, n) in zip(rows, brute_sets(rows), strict=True) if n == 0)
