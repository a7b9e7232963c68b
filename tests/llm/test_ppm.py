"""PPM scores against a dictionary model that follows the definition byte by byte."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from citewell.llm.ppm import DEPTH, ppm_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*(w.encode() for w in WORD.findall(low)), b"\n"]


def stream(text):
    *words, end = tokens(text)
    return b"\n" + b" ".join(words) + end


def brute(rows, learns, depth=DEPTH):
    """Counts and scores byte by byte, over the positions of whole texts."""
    count = Counter(t for i, x in rows if learns(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    model = defaultdict(Counter)
    for i, x in rows:
        if learns(i):
            s = stream(x)
            for j in range(1, len(s)):
                for k in range(min(j, depth) + 1):
                    model[s[j - k : j]][s[j]] += 1

    def byte(context, b):
        gone, lp = set(), 0.0
        for k in range(len(context), -1, -1):
            seen = model.get(context[len(context) - k :])
            if seen is None:
                continue
            rest = {s: c for s, c in seen.items() if s not in gone}
            total = sum(rest.values()) + len(rest)
            if b in rest:
                return lp + math.log10(rest[b] / total)
            if rest:
                lp += math.log10(len(rest) / total)
            gone |= set(seen)
        return lp - math.log10(256 - len(gone))

    made = {}
    for i, x in rows:
        ts, s = tokens(x), stream(x)
        made[i] = (
            len(ts),
            sum(count[t] > 0 for t in ts),
            n,
            sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts),
            sum(byte(s[max(0, j - depth) : j], s[j]) for j in range(1, len(s))),
        )
    return made


ROWS = [
    (1, "The cat sat on the mat\nand the Dog"), (2, None), (3, ""), (4, "a cat, a dog; été ÉTÉ ☃"), (5, "zebra quokka mat-cat \x01"),
    (6, "the the the cat"), (7, "doggy catty sattings"), (8, " \t the  cat\x0b"), (9, "antidisestablishmentarianism the"), (10, "The cat sat on the mat\nand the Dog"),
]


@pytest.mark.parametrize(("block_bytes", "hot"), [(1, 0), (20, 40), (1 << 20, 1 << 20)])
def test_equals_the_definition(spark, block_bytes, hot):
    """Texts in parts of a word, of some words and whole; no, some and all n-grams and tokens by broadcast."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"token": F.lit("x"), "block": F.lit(1), "learn": F.lit(True)})
    learns = lambda i: i % 3 != 1
    got = ppm_scores(docs, F.col("doc_id") % 3 != 1, block_bytes=block_bytes, hot_grams=hot, hot_tokens=hot, held_grams=5, held_tokens=3).collect()
    want = brute(ROWS, learns)
    assert {r.doc_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert r.learn == learns(r.doc_id)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:], rel=1e-9)


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    (r,) = ppm_scores(docs, F.lit(False)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and r.score == pytest.approx(-3 * math.log10(256)) and r.base_score == 0
    assert ppm_scores(docs.limit(0), F.lit(True)).count() == 0


def test_order_of_words_counts(spark):
    rows = [(1, "the quick brown fox jumps"), (2, "jumps fox the brown quick"), (3, "the quick brown fox sleeps")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in ppm_scores(docs, F.col("doc_id") == 3).collect()}
    assert got[1] > got[2] + 1


def test_long_text_and_repeated_rows(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(60_000)) + "x" * 50_000
    docs = spark.createDataFrame([(1, long), (2, long), (2, long), (None, "w1 w4")], "doc_id long, text string")
    got = ppm_scores(docs, F.col("doc_id").isNull() | (F.col("doc_id") == 1), block_bytes=10_000).collect()
    scores = {r.score for r in got if r.doc_id}
    assert len(got) == 4 and max(scores) - min(scores) < 1e-6 and {r.n_tokens for r in got} == {60_001, 3}
    whole = ppm_scores(docs, F.col("doc_id").isNull() | (F.col("doc_id") == 1)).filter("doc_id = 1").first()
    assert whole.score == pytest.approx(max(scores), rel=1e-9)


def test_depth_must_fit_the_key(spark):
    with pytest.raises(ValueError):
        ppm_scores(spark.createDataFrame([(1, "a")], "doc_id long, text string"), F.lit(True), depth=7)


def test_held_out_text_is_far_shorter_than_its_bytes(spark):
    from citewell.llm.ppm import op1_ppm

    rows = op1_ppm(spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    size = {r.doc_id: len(stream(r.text)) - 1 for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > -0.45 * math.log10(256) * sum(size[r.doc_id] for r in held)


def test_sixth_byte_of_context_counts(spark):
    rows = [(1, "xbcdefg ybcdefh"), (2, "xbcdefg ybcdefh"), (3, "xbcdefg")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in ppm_scores(docs, F.col("doc_id") < 3).collect()}
    want = brute(rows, lambda i: i < 3, depth=6)
    assert got == pytest.approx({i: w[4] for i, w in want.items()}, rel=1e-9)
    assert want[3][4] > brute(rows, lambda i: i < 3, depth=5)[3][4] + 0.1
