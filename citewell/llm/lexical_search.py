"""Ranked lexical search: windowed bucket scoring of a stated set of items against all documents.

1. Scan tasks read the documents once.  A task gathers up to ``window``
   documents, puts them in the order of their ids and writes one row for them:
   the postings (place in the window and occurrences) of each term that an item
   asks for, one term after another.  No posting and no text is shuffled, and a
   hot id, source or term only makes windows, never a larger group.
2. Document frequencies and totals are sums over the windows' narrow columns.
3. For each window and item the postings of the item's terms are traversed:
   their gains are added into one array of ``window`` sums, which stays in the
   processor's cache, and a bitset of occupied places says which sums to
   harvest.  The best go into the item's heap, which a task keeps over all its
   windows, so it sends on at most ``k`` rows an item.
4. The heaps of all tasks meet by item under a rank limit.

Items are dealt with in blocks of bounded size (``block_items`` rows or
``block_terms`` different terms), one pass each: what is broadcast doesn't grow
with the table of items, and no item is left out.  One item's text is held whole.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII;
only A to Z are lower-cased.  A term's weight is ``floor(1000 * ln((2 N + 2) /
(2 df + 1)))``; all else is 64-bit integer arithmetic.

Cases: null and empty texts have no terms and match nothing; very long texts
are folded in slices, cut between terms; equal scores go by ascending id, null
ids last; repeated rows are documents, and items, of their own; items without a
term give no row; empty tables give an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heappush, heappushpop
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewell.llm.common import table, written

#: Documents of a window: places fit 16 bits, sums 128 KB.
WINDOW = 1 << 14
#: Bytes of a text that are cut into terms at once, about.
_SLICE = 1 << 22
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WINDOWS = "ids array<long>, sizes binary, terms binary, ends binary, places binary, occurrences binary, n_docs long, n_terms long"
_NAMES = [x.split()[0] for x in _WINDOWS.split(", ")]


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a text in UTF-8, some slices of it at a time."""
    folded = text.translate(_FOLD)
    start = 0
    while start < len(folded):
        end = len(folded) if len(folded) - start <= _SLICE else folded.rfind(b" ", start, start + _SLICE)
        if end <= start:
            end = folded.find(b" ", start + 1) if end < 0 else start + 1
            end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def _window_row(ids: pa.Array, sizes: list[int], found: list[np.ndarray]) -> dict:
    """Postings of one window, by term and then by place in the order of ids."""
    order = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    each = np.fromiter(map(len, found), np.int64, len(found))
    keys = (np.concatenate(found).astype(np.int64) << 16) | np.repeat(place, each)
    keys, n = np.unique(keys, return_counts=True)
    terms, starts = np.unique(keys >> 16, return_index=True)
    n_terms = np.array(sizes, np.int64)
    return {
        "ids": ids.take(pa.array(order)), "sizes": n_terms[order].tobytes(), "terms": terms.astype("<i4").tobytes(),
        "ends": np.append(starts[1:], len(keys)).astype("<i8").tobytes(), "places": (keys & 0xFFFF).astype("<u2").tobytes(),
        "occurrences": n.astype("<i8").tobytes(), "n_docs": int((n_terms > 0).sum()), "n_terms": int(n_terms.sum()),
    }


def _windows(vocabulary, window: int, most: int = 1 << 22):
    """Rows of windows from ``id, text`` batches; a window ends early where its texts hold ``most`` known terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        ids, sizes, found, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            made = _window_row(pa.array(ids, pa.int64()), sizes, found)
            kinds = [pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([made[c].to_pylist() if c == "ids" else made[c]], t) for c, t in zip(_NAMES, kinds, strict=True)], names=_NAMES)

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                n, known = 0, []
                for terms in terms_of(text.as_py() or b""):
                    n += len(terms)
                    at = np.fromiter(map(get, terms, repeat(-1)), np.int32, len(terms))
                    known.append(at[at >= 0])
                ids.append(i)
                sizes.append(n)
                found.append(np.concatenate(known) if known else np.empty(0, np.int32))
                held += len(found[-1])
                if len(ids) == window or held >= most:
                    yield row()
                    ids, sizes, found, held = [], [], [], 0
        if ids:
            yield row()

    return run


def _frequencies(n_terms: int):
    """``term, df`` of a task's windows, one row a term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column("terms"), batch.column("ends"), strict=True):
                df[np.frombuffer(terms.as_py(), "<i4")] += np.diff(np.frombuffer(ends.as_py(), "<i8"), prepend=0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["term", "df"])

    return run


class _Window:
    """Postings of a window with the gain of each."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        sizes = np.frombuffer(row["sizes"], "<i8")
        self.terms = np.frombuffer(row["terms"], "<i4")
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.places = np.frombuffer(row["places"], "<u2")
        n = np.frombuffer(row["occurrences"], "<i8")
        longness = 100 - 25 + (25 * sizes * n_docs) // n_terms if n_terms else sizes
        each = np.diff(self.ends, prepend=0)
        self.gains = np.repeat(weights[self.terms], each) * ((1_000_000_000 * n) // (1000 * n + 12 * longness[self.places]))
        self.sums = np.zeros(len(sizes), np.int64)
        self.bits: dict[int, np.ndarray] = {}

    def occupied(self, k: int, places: np.ndarray) -> np.ndarray:
        """The bitset of the places of the window's k-th term."""
        if k not in self.bits:
            marks = np.zeros(len(self.sums), np.uint8)
            marks[places] = 1
            self.bits[k] = np.packbits(marks)
        return self.bits[k]

    def scores(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occupied places, and their sums, for the item with these terms."""
        at = np.searchsorted(self.terms, terms)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == terms[here]
        occupied = np.zeros((len(self.sums) + 7) // 8, np.uint8)
        for k, q in zip(at[here].tolist(), times[here].tolist(), strict=True):
            a, b = (self.ends[k - 1] if k else 0), self.ends[k]
            places = self.places[a:b]
            self.sums[places] += self.gains[a:b] * q  # a term has a place once
            occupied |= self.occupied(k, places)
        places = np.flatnonzero(np.unpackbits(occupied, count=len(self.sums)))
        found = self.sums[places]
        self.sums[places] = 0
        return places, found


def _harvest(heap: list, places: np.ndarray, scores: np.ndarray, ids: list, k: int) -> None:
    """The best of a window into the item's heap, whose first entry is the worst of the ``k`` kept; places ascend by id."""
    least = max(1, heap[0][0] if len(heap) == k else 1)
    good = scores >= least
    places, scores = places[good], scores[good]
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        good = np.flatnonzero(scores >= bound)
        # of the sums equal to the bound, those with the smallest ids are enough
        good = good[np.argsort(-scores[good], kind="stable")[:k]]
        places, scores = places[good], scores[good]
    for p, s in zip(places.tolist(), scores.tolist(), strict=True):
        i = ids[p]
        entry = (s, i is not None, -(i or 0))
        if len(heap) < k:
            heappush(heap, entry)
        else:
            heappushpop(heap, entry)


def _scored(shared, k: int):
    """At most ``k`` rows ``number, doc_id, score`` an item from the windows of a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = shared.value
        heaps: list[list] = [[] for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                window = _Window(row, weights, n_docs, n_terms)
                for heap, (terms, times) in zip(heaps, items, strict=True):
                    _harvest(heap, *window.scores(terms, times), row["ids"], k)
        rows = [(number, -i if known else None, s) for number, heap in enumerate(heaps) for s, known, i in heap]
        number, ids, scores = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["number", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, block_items: int, block_terms: int) -> Iterator[list[tuple[object, Counter]]]:
    """``item_id`` and the terms' counts of items that have terms, some items at a time."""
    block, terms = [], set()
    for r in items.toLocalIterator():
        count = Counter(t for some in terms_of(bytes(r["text"] or b"")) for t in some)
        if block and (len(block) >= block_items or len(terms | count.keys()) > block_terms):
            yield block
            block, terms = [], set()
        if count:
            block.append((r["item_id"], count))
            terms |= count.keys()
    if block:
        yield block


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search_block(docs: DataFrame, block: list[tuple[object, Counter]], id_type, k: int, window: int) -> DataFrame:
    spark = docs.sparkSession
    number = {t: n for n, t in enumerate(sorted({t for _, count in block for t in count}))}
    vocabulary = spark.sparkContext.broadcast(number)
    windows = written(docs.mapInArrow(_windows(vocabulary, window), _WINDOWS), "windows")
    totals = windows.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = int(totals["docs"] or 0), int(totals["terms"] or 0)
    df = np.zeros(len(number), np.int64)
    for r in windows.select("terms", "ends").mapInArrow(_frequencies(len(number)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = np.array([weight(n_docs, x) for x in df.tolist()], np.int64)
    items = []
    for _, count in block:
        pairs = sorted((number[t], q) for t, q in count.items())
        items.append((np.array([x[0] for x in pairs], np.int64), np.array([x[1] for x in pairs], np.int64)))
    shared = spark.sparkContext.broadcast((items, weights, n_docs, n_terms))
    best = windows.select("ids", "sizes", "terms", "ends", "places", "occurrences").mapInArrow(_scored(shared, k), "number int, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"number int, item_id {id_type}")
    return ranked.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_items: int = 4096, block_terms: int = 1 << 17,
) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``; ``id_col`` is an integer column, ``window`` at most 65,536."""
    if not 1 <= window <= 1 << 16:
        raise ValueError(f"window {window}: places must fit 16 bits")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("text"))
    id_type = asked.schema["item_id"].dataType.simpleString()
    blocks = _blocks(asked, block_items, block_terms)
    found = [_search_block(rows, block, id_type, k, window) for block in blocks]
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark),
asked AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT i, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, totals GROUP BY term),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(terms) * n_docs) // n_terms AS m FROM d, totals WHERE len(terms) > 0),
scores AS (
  SELECT i, item_id, r, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
