"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its words' subwords (the marked
word and its character 2- and 3-grams, hashed to ``buckets``).  Embeddings and
softmax are trained together by stochastic gradient descent in numpy on at most
``per_label`` labelled rows of each language, chosen by hashed id.  A fifth of
that sample trains nothing: it sets the temperature that makes scores honest
probabilities among the learned languages, and two bounds below which a
prediction is rejected.  One is on the score.  The other is on the share of
familiar subwords, those in at least ``usual`` of the training texts, as a text
of no learned language can still have a score near 1; it lies halfway between
the shares of held-out texts and those of the same texts where their own
language, each in turn, is left out of the training texts.

As the classifier is linear, a word's share of the logits is one row computed
once, so prediction adds up rows and runs in one pass over whole texts.

Cases: null text and text without a letter give ``und``, score 0, rejected;
an empty table gives an empty result; repeated rows get equal predictions;
a very long text is predicted whole and left out of training above ``most_chars``; of equal scores the first label in
order wins; below 50 training texts none is held out, and temperature and rejection come from the texts themselves; null ids may be learnt from;
without labelled rows ``fit`` raises ``Unlabelled``, and ``fit_or_unknown``, as
the query and the pipeline use it, gives a model that takes every text for
``und``, score 0, rejected; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import crc32_of_id, free_name, lean, table
from citewell.llm.hashed import WordRows, bucket, content_hash, hash_sample, sampled_texts

UNKNOWN = "und"


class Unlabelled(ValueError):
    """No labelled text to learn from."""


_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(word: str, buckets: int) -> list[int]:
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    return [bucket(g, buckets) for g in {*grams, marked}]


@dataclass
class LanguageModel:
    labels: list[str]
    logits: np.ndarray  # a bucket's row is its embedding times the softmax weights
    bias: np.ndarray
    temperature: float
    least_score: float
    familiar: np.ndarray  # 1 for buckets that are usual in training texts
    least_familiar: float

    def predict(self, text: str | None, rows: WordRows) -> tuple[str, float, bool]:
        if not self.labels or not text or not any(map(str.isalpha, text)) or not (words := words_of(text)):
            return UNKNOWN, 0.0, True
        total = rows.total(rows.numbers(words))
        p = softmax((total[:-2] / total[-1] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best]), bool(p[best] < self.least_score or total[-2] / total[-1] < self.least_familiar)

    def rows(self) -> WordRows:
        buckets = len(self.logits)
        return WordRows(np.column_stack([self.logits, self.familiar]).astype(np.float32), lambda word: subwords(word, buckets))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def familiarity(bags: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rows: np.ndarray, check: np.ndarray, buckets: int, usual: float, most_rejected: float) -> tuple[np.ndarray, float]:
    """Which buckets at least ``usual`` of the texts ``rows`` have, and the least share of them in a text of a learned language, from the texts ``check``."""
    seen = np.zeros((int(target.max()) + 1, buckets))
    for i in rows:
        seen[target[i], bags[i][0]] += 1
    texts = np.bincount(target[rows], minlength=len(seen))
    check = [i for i in check if len(bags[i][0])]

    def known(without: int | None = None) -> np.ndarray:
        left = np.arange(len(seen)) != without
        return seen[left].sum(0) >= max(1.0, usual * texts[left].sum())

    full = known()
    if not check:
        return full, 0.0
    own = float(np.quantile([bags[i][1] @ full[bags[i][0]] for i in check], most_rejected))
    if len(seen) < 2:
        return full, own
    foreign = []
    for label in range(len(seen)):
        rest = known(label)
        foreign += [bags[i][1] @ rest[bags[i][0]] for i in check if target[i] == label]
    return full, min(own, (own + float(np.quantile(foreign, 0.95))) / 2)


def train(
    texts: list[str], labels: list[str], buckets: int = 1 << 16, size: int = 16, epochs: int = 4, rate: float = 0.5, seed: int = 3, most_rejected: float = 0.002,
    usual: float = 0.005,
) -> LanguageModel:
    """Embeddings and softmax by SGD; temperature and rejection from every fifth row, which is not trained on."""
    names = sorted(set(labels))
    target = np.array([names.index(x) for x in labels])
    bags = []
    for text in texts:
        ids: dict[int, int] = {}
        for word in words_of(text):
            for i in subwords(word, buckets):
                ids[i] = ids.get(i, 0) + 1
        at = np.fromiter(ids.keys(), np.int64, len(ids))
        n = np.fromiter(ids.values(), np.float64, len(ids))
        bags.append((at, n / max(1.0, n.sum())))
    rng = np.random.Generator(np.random.PCG64(seed))
    emb = rng.normal(0, 1 / size, (buckets, size))
    out = np.zeros((len(names), size))
    bias = np.zeros(len(names))
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 50 else np.zeros(len(texts), bool)
    rows = np.flatnonzero(~held & np.array([len(a) > 0 for a, _ in bags]))
    steps = epochs * len(rows)
    for step, i in enumerate(np.concatenate([rng.permutation(rows) for _ in range(epochs)]) if steps else []):
        ids, share = bags[i]
        lr = rate * (1 - step / steps)
        h = share @ emb[ids]
        error = softmax(out @ h + bias)
        error[target[i]] -= 1
        back = error @ out
        out -= lr * np.outer(error, h)
        bias -= lr * error
        emb[ids] -= lr * len(ids) ** 0.5 * np.outer(share, back)
    logits = (emb @ out.T).astype(np.float32)
    check = np.flatnonzero(held if held.any() else np.ones(len(texts), bool))
    z = np.array([bags[i][1] @ logits[bags[i][0]] + bias for i in check]) if len(check) else np.zeros((0, len(names)))

    def confidence(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    grid = np.geomspace(0.01, 20, 96)
    # Platt's targets: right answers on all held-out texts are no proof of certainty
    doubt = 1 / (len(check) + 2)
    wanted = np.full((len(check), len(names)), doubt / max(1, len(names) - 1))
    wanted[np.arange(len(check)), target[check]] = 1 - doubt
    loss = [-(wanted * np.log(confidence(t) + 1e-300)).sum(1).mean() for t in grid] if len(check) else [0.0]
    temperature = float(grid[int(np.argmin(loss))])
    p = confidence(temperature)
    right = p.max(1)[p.argmax(1) == target[check]] if len(check) else np.ones(1)
    # at most this share of right predictions may be rejected for their score; chance level is always rejected
    least = max(1.0 / len(names) + 1e-9 if len(names) > 1 else 0.0, float(np.quantile(right, most_rejected)) if len(right) else 0.0)
    familiar, least_familiar = familiarity(bags, target, rows, check, buckets, usual, most_rejected)
    return LanguageModel(names, logits, bias.astype(np.float64), temperature, least, familiar, least_familiar)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 600, most_chars: int = 20_000, most_rows: int = 20_000, most_total: int = 64_000_000, **options) -> LanguageModel:
    """A model from at most ``per_label`` different rows a language whose texts have at most ``most_chars`` characters.

    All languages together have at most ``most_rows`` rows and about ``most_total`` characters; the driver holds no more.
    """
    rows = docs.select(content_hash(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("by"))
    rows = rows.filter(F.col("by").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= most_chars))
    marks = rows.select("by", "h", F.length("text").alias("chars"))
    got = sampled_texts(rows.select("h", "text"), hash_sample(marks, per_label, most_rows, most_total))
    if not got:
        raise Unlabelled("no labelled text to learn from")
    rng = np.random.Generator(np.random.PCG64(1))
    got = [got[i] for i in rng.permutation(len(got))]
    return train([r["text"] for r in got], [r["by"] for r in got], **options)


def fit_or_unknown(docs: DataFrame, **options) -> LanguageModel:
    """As ``fit``; without labelled texts a model that knows no language."""
    try:
        return fit(docs, **options)
    except Unlabelled:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 0.0, np.zeros(1, bool), 0.0)


def prediction(model: LanguageModel, text_col: str = "text") -> Column:
    """A struct ``lang_pred, score, rejected`` for a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    @lean
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows = model.rows()
        for texts in batches:
            made = [model.predict(t, rows) for t in texts]
            yield pd.DataFrame(made, columns=["lang_pred", "score", "rejected"]).astype({"score": float, "rejected": bool})

    return predict.asNondeterministic()(F.col(text_col))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, lang_pred, score, rejected``."""
    made = docs.select(F.col(id_col).alias("id"), prediction(model, text_col).alias("p"))
    return made.select(F.col("id").alias(id_col), "p.lang_pred", "p.score", "p.rejected")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without those whose language the model rejects; all columns stay."""
    p = free_name(docs, "_p")
    return docs.withColumn(p, prediction(model, text_col)).filter(~F.col(p)["rejected"]).drop(p)


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows a model may learn from: CRC-32 of the id modulo 3 isn't 1, or the id is null."""
    return docs.filter(F.coalesce(crc32_of_id(id_col) % 3 != 1, F.lit(True)))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_or_unknown(learnable(docs)))
    return found.select("doc_id", F.coalesce(crc32_of_id() % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
