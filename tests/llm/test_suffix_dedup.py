"""Repeated strings against a table of all strings, suffix arrays against sorting."""

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from citewell.llm.suffix_dedup import op12_suffix_array_dedup, remove_repeated
from citewell.llm.suffixes import permuted_common_prefixes, suffix_array
from citewell.llm.window_runs import WindowRuns


def brute(texts, span):
    """``removed, kept`` of each text."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - span + 1):
            seen[d[i : i + span]] = seen.get(d[i : i + span], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int8)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = 1
        edges = np.flatnonzero(np.diff(gone, prepend=0)).tolist()
        out.append((list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(d, gone, strict=False) if not g)))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["ab", "cde", "f", "ghij", "é", "日本", "  ", "kl\n"]
    text = lambda n: "".join(r.choice(words) + r.choice("xyz ") for _ in range(n))
    shared = [text(30) for _ in range(3)]
    texts = [text(r.randrange(1, 60)) + (r.choice(shared) + text(4)) * r.randrange(0, 3) for _ in range(60)]
    texts += [None, "", "short", "a" * 3000, "a" * 39, "a" * 40, "a" * 41, "abc" * 200, "abcde\n" * 300, shared[0], shared[0], *[texts[0]] * 5]
    texts += [text(9) + shared[1][:38] + text(9) for _ in range(40)]  # just too short a passage in many surroundings
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("pieces", "most", "block"), [((12,), 8192, 1 << 22), ((6, 20), 3, 100), ((40,), 1, 1000)])
def test_equals_brute_force(spark, pieces, most, block):
    texts = corpus(most)
    rows = [(r % 50 if r % 9 else None, t) for r, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a": F.lit(1), "key": F.lit("x"), "n": F.lit(2), "id": F.lit(3)})
    got = remove_repeated(docs, span=40, pieces=pieces, most=most, block_bytes=block).collect()
    want = [(i, len((t or "").encode()), removed, kept) for (i, t), (removed, kept) in zip(rows, brute(texts, 40), strict=True)]
    assert sorted(((r.doc_id, r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept)) for r in got), key=str) == sorted(want, key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(rows, brute([r.text for r in rows], 200), strict=True)}
    got = op12_suffix_array_dedup(spark, sf).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got)
    for r in got:
        removed, kept = want[r.doc_id]
        assert (r.n_bytes - len(kept), r.n_spans, r.kept_sha256) == (r.n_removed, len(removed), sha256(kept).hexdigest())


def test_empty_table(spark):
    assert remove_repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(300))
def test_suffix_array(seed):
    r = random.Random(seed)
    k = r.choice([1, 2, 3, 30])
    s = [r.randrange(k) for _ in range(r.randrange(1, 80))]
    s = s[: len(s) // 3 + 1] * 4 if seed % 3 == 0 else s
    want = sorted(range(len(s)), key=lambda i: s[i:])
    symbols = np.array(s, np.uint16)
    sa = suffix_array(symbols, k)
    assert sa.tolist() == want
    cut = r.randrange(len(s) + 1)
    left = np.array([*range(cut, 0, -1), *range(len(s) - cut, 0, -1)])
    shared = [0] * len(s)
    for x, y in zip(want, want[1:], strict=False):
        n = 0
        while n < min(len(s) - max(x, y), left[y]) and s[x + n] == s[y + n]:
            n += 1
        shared[y] = n
    assert permuted_common_prefixes(symbols, sa, left).tolist() == shared


@pytest.mark.parametrize(("span", "piece"), [(40, 12), (40, 40), (9, 1), (200, 64)])
def test_equal_windows_have_equal_keys(span, piece):
    r = random.Random(span + piece)
    texts = [t.encode() for t in corpus(span) if t]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    keys, at = {}, {i: 0 for i in range(len(texts))}
    for text, start, windows, key, _, within in zip(*(x.tolist() for x in WindowRuns(span, piece).of(data, starts, ends)), strict=True):
        assert at[text] == start and windows > 0
        at[text] += windows
        for i in range(start, start + windows):
            assert keys.setdefault(texts[text][i : i + span], key) == key
        own = [texts[text][i : i + span] for i in range(start, start + windows)]
        assert within or len(set(own)) == windows
    assert all(n == max(0, len(texts[i]) - span + 1) for i, n in at.items()) and r
