"""Language-model scores by prediction by partial matching (PPM), pretrained on the corpus itself.

Model.  A document is a stream of bytes: a start mark, its words joined by one
blank, an end mark.  Each byte after the start mark is predicted from the
longest of its contexts, up to ``depth`` bytes back, over word ends and never
beyond the document's start, that training has seen.  A context with total
count T and d different next bytes gives a byte seen n times n / (T + d) and
keeps d / (T + d) for escape (method C).  After an escape the next shorter
context counts only bytes the longer one had not seen (symbol exclusion); below
the empty context, all bytes not seen at all are equally likely.  The sets of
next bytes grow as contexts shorten, so what a context excludes from the next
shorter one is a property of the context, stored with it.  A document's score
adds up the code length of all its bytes.

Distribution.  Vocabulary and trie grow with the corpus and are only joined.

1. One pass over the training documents gives the byte n-grams with longest
   contexts and the tokens, counted within a task and summed by a shuffle.
   Shortened step by step, the n-grams give the trie, a table of (context,
   byte) counts; joins add totals and exclusions to each context.
2. At most ``hot_grams`` of the most frequent n-grams and ``hot_tokens`` of the
   most frequent short tokens are broadcast, 16 bytes an n-gram, 32 a token at
   most.  They only save traffic: all others take step 3, whatever their number.
3. A second pass over all documents adds up what the broadcast tables know, and
   writes for each block of ``block_bytes`` its other n-grams and tokens,
   numbered, each token and nearly every n-gram once, with each document's numbers.
4. These n-grams and tokens meet the trie and the vocabulary by joins; n-grams
   that training has not seen are followed down the contexts, all levels in one
   join.  The answers go back to their blocks and are added up.

A text of more than ``block_bytes`` is worked on in parts cut at white space,
so memory is bounded for every text but a single word of that size.

Cases: null text is empty and scores its end mark; null ids count as training;
a corpus without training rows scores by the uniform byte model; empty tables
give an empty result; repeated rows count as often as they occur; further
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewell.llm.common import crc32_of_id, lean, table, text_or_empty, written

DEPTH = 6
_MARK = b"\n"
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def streams(text: bytes, most: int, depth: int) -> Iterator[tuple[list[bytes], bytes, bytes]]:
    """A document in parts of about ``most`` bytes: tokens, the bytes before the part that contexts see, the part's bytes."""
    tail, begun, at = _MARK, False, 0
    while True:
        cut = _SPACE.search(text, at + most) if len(text) - at > most else None
        words = text[at : cut.start() if cut else len(text)].split()
        body = (b" " if begun and words else b"") + b" ".join(words)
        begun |= bool(words)
        if not cut:
            yield [*words, _MARK], tail, body + _MARK
            return
        yield words, tail, body
        tail, at = (tail + body)[-depth:], cut.end()


#: Bytes or values that are worked on at once: temporary arrays stay small and in the processor's cache.
_SLICE = 1 << 18


def _slices(leads: list[bytes], bodies: list[bytes], depth: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Leads and bodies in groups of about ``_SLICE`` bytes; longer bodies are cut, and what is before a cut leads on."""
    before, group, held = [], [], 0
    for lead, body in zip(leads, bodies, strict=True):
        for a in range(0, len(body), _SLICE):
            before.append(body[a - depth : a] if a else lead)
            group.append(body[a : a + _SLICE])
            held += len(group[-1])
            if held >= _SLICE:
                yield before, group
                before, group, held = [], [], 0
    if group:
        yield before, group


def coded_grams(leads: list[bytes], bodies: list[bytes], depth: int) -> np.ndarray:
    """For every byte of ``bodies``: its n-gram (a leading 1, the longest context, the byte)."""
    grams = np.empty(sum(map(len, bodies)), np.int64)
    at = 0
    for before, group in _slices(leads, bodies, depth):
        gram = np.frombuffer(b"".join(x for pair in zip(before, group, strict=True) for x in pair), np.uint8).astype(np.int64)
        lead = np.fromiter(map(len, before), np.int64, len(before))
        size = np.fromiter(map(len, group), np.int64, len(group))
        ends = np.cumsum(lead + size)
        have = 1
        while have <= depth:
            more = min(have, depth + 1 - have)
            gram[more:] |= gram[:-more] << 8 * more
            have += more
        gram |= 1 << 8 * (depth + 1)
        place = np.arange(depth)
        early = (ends - lead - size)[:, None] + place
        inside = early < ends[:, None]
        one = np.broadcast_to(1 << 8 * (place + 1), early.shape)[inside]
        gram[early[inside]] = gram[early[inside]] & (one - 1) | one
        coded = np.ones(len(gram), bool)
        coded[early[place < lead[:, None]]] = False
        gram = gram[coded]
        grams[at : at + len(gram)] = gram
        at += len(gram)
    return grams


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(weights, starts) if len(starts) else weights


#: An odd number and its inverse modulo 2**64: products with it spread n-grams evenly and give them back.
_SPREAD = 0x9E3779B97F4A7C15
_GATHER = pow(_SPREAD, -1, 1 << 64)


def spread(grams: np.ndarray) -> np.ndarray:
    return grams.view(np.uint64) * np.uint64(_SPREAD)


def gathered(spreads: np.ndarray) -> np.ndarray:
    """The n-grams of these spread ones."""
    return (spreads * np.uint64(_GATHER)).view(np.int64)


def numbered(spreads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values nearly in order, and the number of each value among them.

    Upper bits and a place are sorted as one number, much faster than an index by value. Where
    different values share all these bits, one may be listed more than once.
    """
    n = len(spreads)
    bits = np.uint64(max(1, n - 1).bit_length())
    key = spreads >> bits
    key <<= bits
    for a in range(0, n, _SLICE):
        key[a : a + _SLICE] |= np.arange(a, min(n, a + _SLICE), dtype=np.uint64)
    key.sort()
    key &= (np.uint64(1) << bits) - np.uint64(1)
    order = key.view(np.int64)
    ordered = spreads[order]
    del spreads  # here and below: arrays of a block are few at a time
    new = np.ones(n, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    different = ordered[new]
    del ordered
    number = np.empty(n, np.int64 if n >= 1 << 31 else np.int32)
    many = 0
    for a in range(0, n, _SLICE):
        part = np.cumsum(new[a : a + _SLICE], dtype=number.dtype)
        part += many - 1
        number[order[a : a + _SLICE]] = part
        many = int(part[-1]) + 1
    return different, number


class Tally:
    """Counts of n-grams in sorted runs, merged whenever what is new outgrows what is held."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, grams: np.ndarray) -> None:
        grams.sort()
        at = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        n = np.diff(at, append=len(grams))
        self.new.append((grams[at], n.astype(np.int32) if len(grams) < 1 << 31 else n))
        self.waiting += len(at)
        if self.waiting > max(1 << 20, len(self.keys) // 2):
            self.merge()

    def merged(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All n-grams in order with their counts, a range at a time, so that no array holds all runs."""
        runs = [(self.keys, self.counts), *self.new] if len(self.keys) else self.new
        if not runs:
            return
        longest = max((k for k, _ in runs), key=len)
        bounds = longest[:: max(1, len(longest) * _SLICE // sum(len(k) for k, _ in runs))][1:]
        cuts = [[0, *np.searchsorted(k, bounds).tolist(), len(k)] for k, _ in runs]
        for i in range(len(bounds) + 1):
            parts = [slice(c[i], c[i + 1]) for c in cuts]
            yield summed(
                np.concatenate([k[p] for (k, _), p in zip(runs, parts, strict=True)]),
                np.concatenate([n[p] for (_, n), p in zip(runs, parts, strict=True)], dtype=np.int64),
            )

    def merge(self) -> None:
        made = list(self.merged())
        self.new, self.waiting = [], 0
        self.keys, self.counts = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (self.keys, self.counts)


def counts(docs: DataFrame, text_col: str, depth: int, chunk_bytes: int, held_grams: int, held_tokens: int) -> DataFrame:
    """``gram, token, n``: how often each n-gram with its longest context and each token occurs; one of the first two is set.

    A row of a token has a negative hash in place of the n-gram, so one shuffle spreads both.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, tokens = Tally(), Counter()
        leads: list[bytes] = []
        bodies: list[bytes] = []
        held = 0

        def rows(gram: np.ndarray, token: list | None, n) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(gram), 1 << 16):
                part = slice(a, a + (1 << 16))
                words = pa.nulls(len(gram[part]), pa.binary()) if token is None else pa.array(token[part], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(gram[part]), words, pa.array(n[part], pa.int64())], ["gram", "token", "n"])

        def tally_up() -> None:
            if leads:
                tally.add(coded_grams(leads, bodies, depth))
            leads.clear()
            bodies.clear()

        def grams_out() -> Iterator[pa.RecordBatch]:
            for gram, n in tally.merged():
                yield from rows(gram, None, n)
            tally.__init__()

        def tokens_out() -> Iterator[pa.RecordBatch]:
            words = list(tokens)
            yield from rows(np.array([-1 - zlib.crc32(t) for t in words], np.int64), words, list(tokens.values()))
            tokens.clear()

        for batch in batches:
            for text in batch.column(0):
                for words, lead, body in streams(text.as_py().encode("utf-8", "surrogatepass").lower(), chunk_bytes, depth):
                    tokens.update(words)
                    leads.append(lead)
                    bodies.append(body)
                    held += len(body)
                    if held >= chunk_bytes:
                        tally_up()
                        held = 0
                    if len(tally.keys) > held_grams:
                        yield from grams_out()
                    if len(tokens) > held_tokens:
                        yield from tokens_out()
        tally_up()
        yield from grams_out()
        yield from tokens_out()

    found = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "gram long, token binary, n long")
    # counts come summed from the tasks: one shuffle first, so that nothing is hashed twice
    return found.repartition("gram").groupBy("gram", "token").agg(F.sum("n").alias("n"))


def _shorter(gram: str, k: str) -> str:
    """SQL: ``gram``, whose context has ``k`` bytes, without its first byte."""
    one = f"shiftleft(cast(1 as bigint), 8 * ({k}))"
    return f"(({gram} & ({one} - 1)) | {one})"


def trie(grams: DataFrame, depth: int, held: int = 1 << 20) -> DataFrame:
    """``gram, k, n``: how often a byte followed a context of k bytes, from ``gram, n`` rows with longest contexts.

    N-grams with equal last bytes meet in a task first, where most shorter ones become complete.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        n: list[np.ndarray] = []

        def levels() -> Iterator[pa.RecordBatch]:
            gram, weight = np.concatenate(keys), np.concatenate(n)
            keys.clear()
            n.clear()
            carried, heavy = np.empty(0, np.int64), np.empty(0, np.int64)
            for k in range(depth, -1, -1):
                own = gram >> 8 * (k + 1) == 1
                carried, heavy = summed(np.concatenate([gram[own], carried]), np.concatenate([weight[own], heavy]))
                for a in range(0, len(carried), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(carried[a : a + (1 << 16)]), pa.array(heavy[a : a + (1 << 16)])], ["gram", "n"])
                # without its first byte the gram is one of the next shorter context
                carried = carried & ((1 << 8 * k) - 1) | 1 << 8 * k if k else carried

        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            n.append(batch.column(1).to_numpy())
            if sum(map(len, keys)) >= held:
                yield from levels()
        if keys:
            yield from levels()

    found = grams.select("gram", "n").repartition(F.expr("gram & 4294967295")).mapInArrow(run, "gram long, n long")
    size = sum((F.col("gram") >= 1 << 8 * (k + 1)).cast("int") for k in range(1, depth + 1))
    return found.groupBy("gram").agg(F.sum("n").alias("n")).select("gram", size.alias("k"), "n")


def contexts(grams: DataFrame) -> DataFrame:
    """``ctx, k, t, d, t2, d2``: count and different bytes of each context, and the same of the next shorter one without them."""
    below = grams.select(F.col("gram").alias("short"), F.col("n").alias("n2"))
    longer = grams.withColumn("short", F.when(F.col("k") > 0, F.expr(_shorter("gram", "k"))))
    own = (
        longer.join(below, "short", "left")
        .groupBy(F.shiftright("gram", 8).alias("ctx"), "k")
        .agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d"), F.sum("n2").alias("s"))
    )
    # a context is an n-gram of one byte fewer, so the same rule shortens it
    own = own.withColumn("short", F.when(F.col("k") > 0, F.expr(_shorter("ctx", "k - 1"))))
    shorter = own.select(F.col("ctx").alias("short"), F.col("t").alias("ts"), F.col("d").alias("ds"))
    return own.join(shorter, "short", "left").select("ctx", "k", "t", "d", (F.col("ts") - F.col("s")).alias("t2"), (F.col("ds") - F.col("d")).alias("d2"))


def seen_grams(grams: DataFrame, stats: DataFrame, depth: int) -> DataFrame:
    """``gram, n, lp``: count and log10 probability of the last byte of every n-gram that training has with its longest context."""
    first = F.expr("shiftright(gram, 8 * k) & 255")
    longest = grams.filter((F.col("k") == depth) | ((F.col("k") > 0) & (first == _MARK[0]))).withColumn("ctx", F.shiftright("gram", 8))
    return longest.join(stats.select("ctx", "t", "d"), "ctx").select("gram", "n", F.log10(F.col("n") / (F.col("t") + F.col("d"))).alias("lp"))


def unseen_grams(grams: DataFrame, stats: DataFrame, needed: DataFrame) -> DataFrame:
    """``gram, lp`` of the different n-grams of ``needed (gram, k)``, none of which training has with its longest context."""
    levels = needed.distinct().select("gram", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("m"))
    one = "shiftleft(cast(1 as bigint), 8 * (m + 1))"
    levels = levels.withColumn("part", F.expr(f"(gram & ({one} - 1)) | {one}")).withColumn("ctx", F.shiftright("part", 8))

    def counted(rows: DataFrame, of: str, hint=lambda df: df) -> DataFrame:
        part = hint(grams.filter(f"k {of}").select(F.col("gram").alias("part"), "n"))
        return rows.filter(f"m {of}").join(part, "part", "left").join(hint(stats.filter(f"k {of}").drop("k")), "ctx", "left")

    # every n-gram asks for contexts of no and of one byte: these tables have at most 65,792 rows
    levels = counted(levels, "<= 1", F.broadcast).unionByName(counted(levels, "> 1"))
    w = Window.partitionBy("gram")
    levels = levels.withColumns(
        {
            "e": F.max(F.when(F.col("t").isNotNull(), F.col("m"))).over(w),
            "j": F.coalesce(F.max(F.when(F.col("n").isNotNull(), F.col("m"))).over(w), F.lit(-1)),
            "n_below": F.lag("n").over(w.orderBy("m")),
        }
    )
    m, e, j, t, d, t2, d2 = (F.col(c) for c in ("m", "e", "j", "t", "d", "t2", "d2"))
    enter = F.when(m == e, F.log10(F.when(j == e, F.col("n")).otherwise(d) / (t + d))).otherwise(0.0)
    step = (
        F.when((m > e) | (m <= j), 0.0)
        .when(m == 0, -F.log10((256 - d).cast("double")))
        .when(m - 1 == j, F.log10(F.col("n_below") / (t2 + d2)))
        .otherwise(F.coalesce(F.log10(F.try_divide(d2, t2 + d2)), F.lit(0.0)))
    )
    nothing = F.when(e.isNull() & (m == 0), -F.log10(F.lit(256.0))).otherwise(0.0)
    return levels.select("gram", F.when(e.isNull(), nothing).otherwise(enter + step).alias("x")).groupBy("gram").agg(F.sum("x").alias("lp"))


def frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows of largest ``n``, at most ``most``, by a bound on ``n`` that all rows on its side meet."""
    step = F.floor(F.log2("n") * 8)
    sizes = rows.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least, total = 1 << 20, 0
    for r in sorted(sizes, reverse=True):
        if total + r["rows"] > most:
            break
        least, total = r["step"], total + r["rows"]
    return rows.filter(step >= least)


def numbering() -> defaultdict:
    """Numbers for tokens in the order met."""
    return defaultdict(count().__next__)


_BLOCKS = (
    "block long, row long, doc_id long, learn boolean, n_tokens long, n_known long, logs double, score double, cold_tokens binary, cold_grams binary, "
    "number long, gram long, token binary"
)
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
_BLOCK_TYPES = {name: _TYPES[kind] for name, kind in (x.split() for x in _BLOCKS.split(", "))}


def _filled(size: int, **columns) -> pa.RecordBatch:
    """A batch of ``_BLOCKS`` with nulls in all columns but those given."""
    arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in _BLOCK_TYPES.items()]
    return pa.RecordBatch.from_arrays(arrays, list(_BLOCK_TYPES))


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of ``sizes`` values each as little-endian unsigned 32-bit integers."""
    ends = np.concatenate(([0], np.cumsum(4 * sizes)))
    if ends[-1] >= 1 << 31:
        return pa.array([x.tobytes() for x in np.split(values.astype("<u4", copy=False), ends[1:-1] // 4)], pa.binary())
    data = pa.py_buffer(np.ascontiguousarray(values, "<u4"))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), data])


def _found(different: np.ndarray, hot_gram: np.ndarray, hot_lp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the n-grams: its log10 probability, 0 if not among the hot ones, and its number among those that are not, else -1."""
    lp, cold = np.zeros(len(different)), np.arange(len(different), dtype=np.int32)
    if len(hot_gram):
        colds = 0
        for a in range(0, len(different), _SLICE):
            part = different[a : a + _SLICE]
            place = np.minimum(np.searchsorted(hot_gram, part), len(hot_gram) - 1)
            known = hot_gram[place] == part
            lp[a : a + _SLICE] = np.where(known, hot_lp[place], 0.0)
            number = np.cumsum(~known, dtype=np.int32)
            cold[a : a + _SLICE] = np.where(known, -1, number + (colds - 1))
            colds += int(number[-1])
    return lp, cold


def _shares(sizes: np.ndarray, number: np.ndarray, lp: np.ndarray, cold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For owners of ``sizes`` n-grams each: their sums, how many of their n-grams are cold, and the numbers of these one after another."""
    m, ends = len(sizes), np.cumsum(sizes)
    score, colds, numbers = np.zeros(m), np.zeros(m, np.int64), []
    for a in range(0, len(number), _SLICE):
        part = number[a : a + _SLICE]
        first = int(np.searchsorted(ends, a, "right"))
        last = int(np.searchsorted(ends, a + len(part), "left")) + 1
        owner = np.repeat(np.arange(last - first), np.diff(np.clip(ends[first:last], a, a + len(part)), prepend=a))
        at = cold[part]
        is_cold = at >= 0
        score[first:last] += np.bincount(owner, lp[part], last - first)
        colds[first:last] += np.bincount(owner[is_cold], minlength=last - first)
        numbers.append(at[is_cold])
    return score, colds, np.concatenate(numbers) if numbers else np.empty(0, np.int32)


def blocks(docs: DataFrame, learn: Column, hot, id_col: str, text_col: str, depth: int, block_bytes: int) -> DataFrame:
    """Rows of document parts (``row`` set), with sums over hot n-grams and tokens and the numbers of others, and rows of these (``number`` set)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_gram, hot_lp, hot_token = hot.value
        block = row = TaskContext.get().partitionId() << 32
        parts: list[tuple] = []
        leads: list[bytes] = []
        bodies: list[bytes] = []
        numbers, at = numbering(), []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            m = len(parts)
            different, number = numbered(spread(coded_grams(leads, bodies, depth)))
            lp, cold = _found(different, hot_gram, hot_lp)
            score, colds, cold_grams = _shares(np.fromiter(map(len, bodies), np.int64, m), number, lp, cold)
            rare = gathered(different[cold >= 0])
            del different, number, lp, cold
            c = np.fromiter(map(hot_token.get, numbers, repeat(-1)), np.int64, len(numbers))
            flat = np.concatenate(at)
            size = np.fromiter(map(len, at), np.int64, m)
            owner = np.repeat(np.arange(m), size)
            logs = np.bincount(owner, np.log10(np.maximum(c, 0) + 1.0)[flat], m)
            n_known = np.bincount(owner, (c > 0)[flat], m).astype(np.int64)
            is_cold = (c < 0)[flat]
            rows = list(zip(*parts, strict=True))
            yield _filled(
                m, block=np.full(m, block), row=rows[0], doc_id=rows[1], learn=rows[2], n_tokens=size, n_known=n_known, logs=logs, score=score,
                cold_tokens=_binary(flat[is_cold], np.bincount(owner[is_cold], minlength=m)), cold_grams=_binary(cold_grams, colds),
            )
            del flat, owner, is_cold, cold_grams, rows
            for a in range(0, len(rare), 1 << 16):
                part = rare[a : a + (1 << 16)]
                yield _filled(len(part), block=np.full(len(part), block), number=np.arange(a, a + len(part)), gram=part)
            words = [(t, i) for i, t in enumerate(numbers) if c[i] < 0]
            for a in range(0, len(words), 1 << 16):
                part = words[a : a + (1 << 16)]
                yield _filled(len(part), block=np.full(len(part), block), number=[i for _, i in part], token=[t for t, _ in part])

        for batch in batches:
            for key, text, learns in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for words, lead, body in streams(text.as_py().encode("utf-8", "surrogatepass").lower(), block_bytes, depth):
                    parts.append((row, key, learns))
                    at.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    leads.append(lead)
                    bodies.append(body)
                    held += len(body)
                    if held >= block_bytes:
                        yield from flush()
                        for x in (parts, at, leads, bodies):
                            x.clear()
                        numbers, block, held = numbering(), block + 1, 0
                row += 1
        if parts:
            yield from flush()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), learn.alias("learn"))
    return source.mapInArrow(run, _BLOCKS)


def _looked_up(texts: pa.Table, known: pa.Table) -> pa.Table:
    """The sums of document parts with those of their cold n-grams and tokens added."""
    is_gram = known.column("is_gram").to_numpy()
    number, value = known.column("number").to_numpy(), known.column("value").to_numpy()
    size = int(number.max()) + 1 if len(number) else 0
    c, lp = np.zeros(size), np.zeros(size)
    c[number[~is_gram]] = value[~is_gram]
    lp[number[is_gram]] = value[is_gram]
    logs = np.log10(c + 1.0)
    more: list[list] = [[], [], []]
    for words, grams in zip(texts.column("cold_tokens"), texts.column("cold_grams"), strict=True):
        at, below = np.frombuffer(words.as_py(), "<u4"), np.frombuffer(grams.as_py(), "<u4")
        for column, x in zip(more, (np.count_nonzero(c[at]), logs[at].sum(), lp[below].sum()), strict=True):
            column.append(x)
    add = lambda name, x: texts.column(name).to_numpy() + np.array(x, float if name != "n_known" else np.int64)
    made = {x: texts.column(x) for x in ("row", "doc_id", "learn", "n_tokens")}
    return pa.table(made | {"n_known": add("n_known", more[0]), "logs": add("logs", more[1]), "score": add("score", more[2])})


def ppm_scores(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = 4 << 20,
    hot_grams: int = 1 << 21, hot_tokens: int = 1 << 17, held_grams: int = 3 << 20, held_tokens: int = 1 << 19,
) -> DataFrame:
    """One row per document: ``doc_id, learn, n_tokens, n_known, train_tokens, base_score, score``.

    Documents where ``learn`` holds are the training set.  ``score`` is the log10
    probability of the document's stream under the PPM model, ``base_score``
    that of its tokens under add-one frequencies.  ``depth`` is 1 to 6: an
    n-gram and its leading 1 take at most 57 bits.  ``held_grams`` and
    ``held_tokens`` are how many a task gathers before it sends them on.
    """
    if not 1 <= depth <= 6:
        raise ValueError(f"depth {depth}: contexts of 1 to 6 bytes fit the key")
    spark = docs.sparkSession
    found = written(counts(docs.filter(learn), text_col, depth, min(block_bytes, 2 << 20), held_grams, held_tokens), "counts")
    tokens = found.filter("token IS NOT NULL").select("token", "n")
    totals = tokens.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    train, known = int(totals["n"] or 0), int(totals["v"])
    grams = written(trie(found.filter("token IS NULL"), depth), "trie")
    stats = written(contexts(grams), "contexts")
    seen = written(seen_grams(grams, stats, depth), "seen")

    often = frequent(seen, hot_grams).select("gram", "lp").toArrow()
    gram, lp = often.column("gram").to_numpy(), often.column("lp").to_numpy()
    gram = spread(gram)  # in the order in which blocks number theirs
    order = np.argsort(gram)
    often_tokens = {bytes(r["token"]): r["n"] for r in frequent(tokens.filter(F.octet_length("token") <= 32), hot_tokens).collect()}
    hot = spark.sparkContext.broadcast((gram[order], lp[order], often_tokens))

    cut = written(blocks(docs, learn, hot, id_col, text_col, depth, block_bytes), "blocks")
    needed = cut.filter("gram IS NOT NULL").select("block", "number", "gram")
    size = sum((F.col("gram") >= 1 << 8 * (k + 1)).cast("int") for k in range(1, depth + 1))
    answered = written(needed.join(seen.select("gram", "lp"), "gram", "left"), "needed")
    unseen = answered.filter("lp IS NULL").select("block", "number", "gram")
    unseen = unseen.join(unseen_grams(grams, stats, unseen.select("gram", size.alias("k"))), "gram")
    values = [
        answered.filter("lp IS NOT NULL").select("block", F.lit(True).alias("is_gram"), "number", F.col("lp").alias("value")),
        unseen.select("block", F.lit(True).alias("is_gram"), "number", F.col("lp").alias("value")),
        cut.filter("token IS NOT NULL").select("block", "number", "token").join(tokens, "token", "left").select("block", F.lit(False).alias("is_gram"), "number", F.coalesce("n", F.lit(0)).cast("double").alias("value")),
    ]
    known_values = values[0].unionByName(values[1]).unionByName(values[2])
    texts = cut.filter("row IS NOT NULL").select("block", "row", "doc_id", "learn", "n_tokens", "n_known", "logs", "score", "cold_tokens", "cold_grams")
    sums = texts.groupBy("block").cogroup(known_values.groupBy("block")).applyInArrow(
        _looked_up, "row long, doc_id long, learn boolean, n_tokens long, n_known long, logs double, score double"
    )
    whole = sums.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("learn").alias("learn"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "score"))
    )
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(train + known + 1)))
    return whole.select("doc_id", "learn", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op1_ppm(spark, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc32_of_id() % 7 == 2, F.lit(False))
    scores = ppm_scores(table(spark, sf_dir, "documents"), ~held_out)
    return scores.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
