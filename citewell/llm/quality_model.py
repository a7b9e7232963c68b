"""Quality classifier from weak labels.

1. Heuristic labellers vote good, bad or nothing on every document, as built-in
   column expressions over the whole text.
2. The votes of all documents are counted by pattern; there are at most three
   to the number of labellers, whatever the input.  Expectation-maximisation
   over these counts estimates the share of good documents and of each kind of
   fault and, for each labeller and class, how it votes; the posterior of a pattern is the weak
   label of its documents.
3. A linear scorer over hashed features (word shapes, words, words that repeat
   their neighbour, and shares in steps) is fitted by SGD to the posteriors of
   a bounded sample, and scores every document by whole text in one pass.

Cases: null and empty texts have no evidence, get the prior's score and are
kept or dropped by it; a very long text is scored whole; a word's features are its first 24 characters and the shape of its
first 12, so longer words that agree in these are one; a score at the bound is kept; null ids are like any other; repeated rows get equal scores; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import free_name, lean, table, written
from citewell.llm.hashed import WordRows, bucket, content_hash, hash_sample, sampled_texts
from citewell.llm.quality_rules import measures

#: Measure, bound for good, bound for bad, and the smallest number of words it votes on.
#: Good where the value is on the first bound's side, bad beyond the second, no vote between.
LABELLERS = (
    ("symbol_ratio", 0.01, 0.05, 1),
    ("capital_ratio", 0.15, 0.5, 3),
    ("echo_ratio", 0.25, 0.5, 10),
    ("dup_line_ratio", 0.3, 0.6, 20),
    ("mark_ratio", 0.02, 0.08, 10),
    ("rare_ratio", 0.93, 0.97, 20),
)
GOOD, BAD, NONE = 1, 0, 2


def votes(docs: DataFrame, id_col: str, text_col: str, most_chars: int) -> DataFrame:
    """``h, by, chars, usable``: the row's hash, a digit for each labeller's vote, the length, and whether the text may serve as a training row."""
    source = docs.select(content_hash(F.col(id_col), F.col(text_col)).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, signs = F.length("text"), F.length(F.regexp_replace("text", r"[^|!#$%&*]+", ""))
    source = source.select("h", "text", size.alias("chars"), signs.alias("signs"))
    n = F.col("n_words")
    m = measures(source, "text", ("h", "chars", "signs")).withColumns(
        {"mark_ratio": F.coalesce(F.try_divide(F.col("signs").cast("double"), n * 6), F.lit(0.0)), "rare_ratio": 1.0 - F.col("stop_word_ratio")}
    )
    cast = [F.when(n < least, NONE).when(F.col(c) <= good, GOOD).when(F.col(c) >= bad, BAD).otherwise(NONE).cast("string") for c, good, bad, least in LABELLERS]
    return m.select("h", F.concat(*cast).alias("by"), "chars", ((F.col("chars") <= most_chars) & (n > 0)).alias("usable"))


def estimate(counts: dict[str, int], rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Class shares, vote probabilities ``[labeller, class, vote]`` and each pattern's posterior of good, by EM.

    Class 0 is good; class k holds the faults that labeller k is the first to
    see, so two kinds of fault that never meet stay apart.  A labeller that
    says nothing is missing evidence, not a vote of its own: its factor is 1.
    """
    labellers = len(LABELLERS)
    patterns = sorted(counts)
    if not patterns:
        return np.array([0.5, *[0.5 / labellers] * labellers]), np.full((labellers, labellers + 1, 3), 0.5), {}
    seen = np.array([[int(x) for x in p] for p in patterns])
    weight = np.array([counts[p] for p in patterns], float)
    faults = (seen == BAD).astype(float)
    share = np.hstack([np.where(faults.any(1), 0.05, 0.95)[:, None], faults + 0.01])
    share[:, 1:] *= ((1 - share[:, 0]) / share[:, 1:].sum(1))[:, None]
    for _ in range(rounds):
        mass = weight[:, None] * share
        prior = (mass.sum(0) + 1) / (weight.sum() + labellers + 1)
        likely = np.ones((labellers, labellers + 1, 3))
        for v in (GOOD, BAD):
            likely[:, :, v] = (seen == v).T.astype(float) @ mass + 1
        likely[:, :, :2] /= likely[:, :, :2].sum(2, keepdims=True)
        z = np.log(prior) + sum(np.log(likely[k][:, seen[:, k]].T) for k in range(labellers))
        new = np.exp(z - z.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - share).max() < tolerance
        share = new
        if done:
            break
    return prior, likely, dict(zip(patterns, share[:, 0].tolist(), strict=True))


_CLASSES = [(re.compile(p), r) for p, r in ((r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"[a-zß-öø-ÿ]+", "a"), (r"[0-9]+", "0"))]


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each; plain ASCII words need no expression."""
    if word.isascii() and word.isalpha():
        if word.islower():
            return "a"
        if word.isupper():
            return "A"
        if word[1:].islower():
            return "Aa"
    for pattern, sign in _CLASSES:
        word = pattern.sub(sign, word)
    return word[:12]


def word_features(word: str, buckets: int) -> list[int]:
    core = word.rstrip(".,;:!?")
    end = word[len(core) :]
    # the signs at the end are no letters, so the shape of the whole is that of its parts
    return [bucket("s" + (shape(core) + end)[:12], buckets), bucket("w" + core.lstrip(".,;:!?").lower()[:24], buckets)]


def text_features(words: np.ndarray, lines: list[str], buckets: int) -> list[int]:
    """In steps of a tenth: words, given as numbers, equal to the one, two or three places before, and different lines."""
    n = max(1, len(words))
    full = [x for x in lines if x and not x.isspace()]
    shares = {f"r{k}": np.count_nonzero(words[k:] == words[:-k]) / n for k in (1, 2, 3)}
    shares["l"] = len(set(full)) / len(full) if len(full) >= 3 else 2
    return [bucket(f"{k}:{int(10 * v)}", buckets) for k, v in shares.items()]


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    prior: np.ndarray
    likely: np.ndarray
    posterior: dict[str, float]
    least_score: float = 0.5

    def rows(self) -> WordRows:
        buckets = len(self.weights)
        return WordRows(self.weights[:, None], lambda word: word_features(word, buckets))

    def score(self, text: str | None, rows: WordRows) -> float:
        words = (text or "").split()
        if not words:
            return float(self.prior[0])
        at = rows.numbers(words)
        total = rows.total(at)
        z = self.bias + total[0] / total[1] + self.weights[text_features(at, text.split("\n"), len(self.weights))].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(texts: list[str], targets: list[float], buckets: int = 1 << 16, epochs: int = 10, rate: float = 2.0, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the hashed scorer for soft targets, by SGD on the logistic loss."""
    bags = []
    for text in texts:
        words = text.split()
        ids: dict[int, float] = {}
        for w in words:
            for i in word_features(w, buckets):
                ids[i] = ids.get(i, 0.0) + 0.5 / len(words)
        number = {w: i for i, w in enumerate(set(words))}
        for i in text_features(np.array([number[w] for w in words]), text.split("\n"), buckets):
            ids[i] = ids.get(i, 0.0) + 1.0
        bags.append((np.fromiter(ids.keys(), np.int64, len(ids)), np.fromiter(ids.values(), float, len(ids))))
    rng = np.random.Generator(np.random.PCG64(seed))
    weights, bias = np.zeros(buckets), 0.0
    steps = epochs * len(bags)
    for step, i in enumerate(np.concatenate([rng.permutation(len(bags)) for _ in range(epochs)]) if steps else []):
        ids, share = bags[i]
        z = float(np.clip(weights[ids] @ share + bias, -60, 60))
        pull = rate * (1 - step / steps) * (1 / (1 + np.exp(-z)) - targets[i])
        weights[ids] -= pull * share
        bias -= 0.1 * pull
    return weights.astype(np.float32), bias


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_pattern: int = 120, most_chars: int = 20_000, most_rows: int = 20_000, most_total: int = 64_000_000, **options) -> QualityModel:
    """EM over the votes of all documents, then a scorer from at most ``per_pattern`` different documents of each vote pattern, of at most ``most_chars`` characters.

    All patterns together have at most ``most_rows`` documents and about ``most_total`` characters; the driver holds no more.
    """
    cast = written(votes(docs, id_col, text_col, most_chars), "votes")
    counts = {r["by"]: r["n"] for r in cast.groupBy("by").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior, likely, posterior = estimate(counts)
    chosen = hash_sample(cast.filter("usable").select("by", "h", "chars"), per_pattern, most_rows, most_total)
    texts = docs.select(content_hash(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    rows = sampled_texts(texts, chosen)
    weights, bias = train([r["text"] for r in rows], [posterior[r["by"]] for r in rows], **options)
    return QualityModel(weights, bias, prior, likely, posterior)


def score_column(model: QualityModel, text_col: str = "text") -> Column:
    @F.pandas_udf("double")
    @lean
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rows = model.rows()
        for texts in batches:
            yield pd.Series([model.score(t, rows) for t in texts], dtype=float)

    return score.asNondeterministic()(F.col(text_col))


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, score, kept``."""
    return docs.select(F.col(id_col).alias("id"), score_column(model, text_col).alias("score")).select(F.col("id").alias(id_col), "score", (F.col("score") >= model.least_score).alias("kept"))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without those the scorer rejects; all columns stay."""
    s = free_name(docs, "_s")
    return docs.withColumn(s, score_column(model, text_col)).filter(F.col(s) >= model.least_score).drop(s)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs))
