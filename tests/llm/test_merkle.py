"""The manifest against a plain tree over all rows."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from citewell.llm import merkle
from citewell.llm.merkle import digest_of, folded, manifest, proof_digest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*digests):
    return sha256("".join(digests).encode()).hexdigest()


def leaf(row):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode()).hexdigest()


def paths(digests, arity):
    """Each one's path, and the root, by levels over the whole list."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, a in enumerate(at):
            low = a // arity * arity
            ways[i].append(("".join(level[low:a]), "".join(level[a + 1 : low + arity])))
        at = [a // arity for a in at]
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return ways, level[0] if level else None


def brute(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: paths([x[2] for x in sorted(groups[g])], arity) for g in names}
    tops, root = paths([made[g][1] for g in names], arity)
    out = []
    for g, top in zip(names, tops, strict=True):
        for (known, i, digest), way in zip(sorted(groups[g]), made[g][0], strict=True):
            out.append((i if known else None, digest, made[g][1], root, tuple(way + top)))
    return sorted(out, key=str)


def rows_of(seed, n):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", None]), r.choice(["en"] * 6 + ["de", "fr", None, "é", ""]), r.choice([i, None]), r.choice(["", None, "x" * i, "é" * 3])) for i in range(n)]
    rows += [(n, "a", "en", 3, "same")] * 40 + [(None, None, None, None, None)] * 3 + [(7, "b", "en", 1, "another text of this id"), (n + 1, "a", "lone", 3, "y" * 300_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("arity", "each", "n"), [(2, 30, 200), (2, 1 << 16, 60), (3, 40, 230)])
def test_equals_a_plain_tree(spark, arity, each, n):
    rows = rows_of(each, n)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit(1), "grp": F.lit("x"), "path": F.lit(2), "row": F.lit(0)})
    got = manifest(docs, digest_of(*map(F.col, COLUMNS)), {"doc_id": F.col("doc_id")}, arity=arity, each=each).collect()
    plain = sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in got), key=str)
    assert plain == brute(rows, arity)


def test_rounds_of_upper_levels(spark, monkeypatch):
    """Many small partitions: upper levels take several rounds."""
    monkeypatch.setattr(merkle, "_ROUND", 1)
    rows = [(i, "s", "en" if i % 50 else "de", i, str(i)) for i in range(160)]
    got = manifest(spark.createDataFrame(rows, SCHEMA), digest_of(*map(F.col, COLUMNS)), {"doc_id": F.col("doc_id")}, each=16).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in got), key=str) == brute(rows, 2)


def test_proofs_tell_tampered_rows(spark):
    rows = rows_of(1, 90)
    forged = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, digest_of(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS)))
    out = manifest(spark.createDataFrame(rows, SCHEMA), digest_of(*map(F.col, COLUMNS)), {"doc_id": F.col("doc_id"), "n_chars": F.col("n_chars"), "given": forged}, each=16)
    out = out.withColumns({"folded": folded(F.coalesce("given", "leaf"), F.col("path")), "proof": proof_digest(F.col("path"))})
    for r in out.collect():
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
        assert (r.folded == r.root) is not tampered
        assert r.proof == sha256("".join(x.left + x.right for x in r.path).encode()).hexdigest()


def test_empty_and_single(spark):
    whole = lambda rows: manifest(spark.createDataFrame(rows, SCHEMA), digest_of(*map(F.col, COLUMNS)), {"doc_id": F.col("doc_id")}).collect()
    assert whole([]) == []
    (r,) = whole([(None, None, None, None, None)])
    assert r.leaf == r.subroot == r.root == leaf([None] * 5) and r.path == []
    with pytest.raises(ValueError):
        manifest(spark.createDataFrame([], SCHEMA), F.lit(""), {}, arity=1)
