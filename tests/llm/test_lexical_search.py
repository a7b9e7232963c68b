"""Ranked search against scoring every document in plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from citewell.llm.lexical_search import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    cut = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, t in cut if t), sum(len(t) for _, t in cut)
    out = []
    for item, text in items:
        found = []
        for i, own in cut:
            score = 0
            for term in terms(text):
                tf, df = own.count(term), sum(1 for _, t in cut if term in t)
                if tf:
                    m = 100 - 25 + (25 * len(own) * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Été", "été", "STRASSE", "straße", "x_y", "日本語", "a1"]
    docs = [(r.choice([i, i, -i]), " ".join(r.choices(words, k=r.randrange(1, 40)))) for i in range(150)]
    docs += [(3, "w1 w2 w3")] * 30 + [(None, "w1 w2 w3"), (900, None), (901, ""), (902, "--- \x00\t"), (903, "W1;W1\nw2\x7fw3"), (904, "w1 " * 50_000)]
    r.shuffle(docs)
    items = [(i, " ".join(r.choices(words, k=r.randrange(1, 12)))) for i in range(12)]
    return docs, [*items, (5, "w1 w1 w2"), (None, "w3"), (90, None), (91, "..."), (92, "nowhere")]


@pytest.mark.parametrize(("window", "block_items", "block_terms"), [(16, 4096, 1 << 17), (1 << 14, 5, 1 << 17), (7, 4096, 9)])
def test_equals_brute_force(spark, window, block_items, block_terms):
    docs, items = corpus(window)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"id": F.lit(1), "number": F.lit("x"), "score": F.lit(2)})
    asked = spark.createDataFrame(items, "item_id int, text string").withColumn("rank", F.lit(1))
    got = lexical_search(frame, asked, 7, window=window, block_items=block_items, block_terms=block_terms).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute(docs, items, 7)


def test_slices_of_long_texts(spark, monkeypatch):
    from citewell.llm import lexical_search as module

    text = " ".join(f"w{i % 7}" for i in range(400)) + " " + "z" * 90 + " w1 "
    whole = [t for some in module.terms_of(text.encode()) for t in some]
    for size in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(module, "_SLICE", size)
        assert [t for some in module.terms_of(text.encode()) for t in some] == whole


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search(docs, items).collect() == [] and lexical_search(docs, some).collect() == []
    assert lexical_search(some.withColumnRenamed("item_id", "doc_id"), items).collect() == []
    with pytest.raises(ValueError):
        lexical_search(docs, items, window=1 << 17)
