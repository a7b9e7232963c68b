"""Removal of repeated byte strings by suffix arrays over shards.

A string of ``span`` bytes that starts at two places of the corpus is repeated;
every byte that a repeated string covers goes.  The verdict on each string
comes from the suffix array of a shard, and shards are made so that equal
strings always meet in one:

1. Each window of ``span`` bytes has a key, a least hash of its pieces
   (``window_runs``); equal windows have equal keys.  Texts become rows of runs
   of windows with one key.  A key of a single run has no repeated window, unless
   its piece recurs in that run.
2. The other runs are cut from their texts, with all bytes of their windows.
   Equal contents become one segment with a count, first within each task.
3. Segments are dealt out by key and gathered to blocks of whole keys, some MB
   each.  A block's segments are one string; the array of its suffixes with
   ``span`` bytes of a segment is sorted by prefix doubling to that depth, and
   those that share ``span`` bytes form an interval.  A window is repeated where
   the counts of an interval's segments sum up to two.
4. Each run takes its segment's verdict; a text's ranges are merged and removed.

A key with more than ``most`` different contents (a passage shorter than ``span`` in
very many surroundings) isn't gathered: its segments become texts with counts
themselves, whose windows get keys by longer pieces, ``pieces`` in turn.  The
last piece is the whole window, where a key has one content.  So no shard grows
with a group, and no string is left out.

Texts are shuffled once to cut runs and again, or with it, to be cleaned.  A text is one worker's;
its hashes are taken slice by slice.  Contents are told apart by two independent
64-bit hashes, and compared in full where they meet; unequal ones would stop the job.

Cases: null texts are empty and nothing of them goes; texts shorter than ``span``
stay; rows that repeat a text lose it wholly if it has ``span`` bytes, as each
of its strings starts elsewhere too; overlapping strings of one text count;
removal may cut a character, so what is kept is binary; ids play no part, so null and
repeated ones are like any other; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import table, written
from citewell.llm.suffixes import span_array
from citewell.llm.window_runs import WindowRuns

SPAN = 200
PIECES = (64, 168)
#: ``n`` counts a run with a window that may recur within it once more.
_RUNS = "a long, b long, at int, windows int, key long, content long, n long"
_SEGMENTS = "key long, content long, segment binary, n long"
_VERDICTS = "key long, content long, ranges array<int>"
#: Windows whose hashes a task takes at once, and bytes of different segments that it holds before it sends them on.
_SLICE, _HELD = 1 << 19, 1 << 25


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a binary column, and where each begins and the last ends."""
    _, offsets, data = column.cast(pa.binary()).buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at


def _runs_of(span: int, piece: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = WindowRuns(span, piece)
        for batch in batches:
            data, at = _bytes_of(batch.column("text"))
            names = [batch.column(c).to_numpy() for c in ("a", "b", "n")]
            # long texts in slices that overlap by all but one byte of a window
            slices = np.maximum(np.diff(at) - span + _SLICE, 0) // _SLICE
            text = np.repeat(np.arange(len(slices)), slices)
            base = (np.arange(len(text)) - np.repeat(np.cumsum(slices) - slices, slices)) * _SLICE
            starts = at[text] + base
            ends = np.minimum(starts + _SLICE + span - 1, at[text + 1])
            groups = np.cumsum(ends - starts) // _SLICE
            for own in np.split(np.arange(len(text)), np.flatnonzero(np.diff(groups)) + 1):
                if len(own):
                    low = starts[own[0]]
                    i, start, windows, key, content, within = made.of(data[low : ends[own].max()], starts[own] - low, ends[own] - low)
                    of = text[own[i]]
                    yield _batch(_RUNS, names[0][of], names[1][of], start + base[own[i]], windows, key, content, names[2][of] + within)

    return run


def _cut(span: int):
    """Segments of the runs of each text, equal ones of a task together as far as it holds them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            keys, contents = zip(*held, strict=True)
            segments, counts = zip(*held.values(), strict=True)
            return _batch(_SEGMENTS, keys, contents, segments, counts)

        for batch in batches:
            for text, n, runs in zip(batch.column("text"), batch.column("n").to_pylist(), batch.column("runs"), strict=True):
                text, found = text.as_py(), runs.values
                columns = [found.field(c).to_pylist() for c in ("at", "windows", "key", "content")]
                for at, windows, *name in zip(*columns, strict=True):
                    name, segment = tuple(name), text[at : at + windows + span - 1]
                    if (known := held.get(name)) is None:
                        held[name] = [segment, n]
                        size += len(segment) + 200
                    else:
                        _same(known[0], segment)
                        known[1] += n
                if size > _HELD:
                    yield rows()
                    held, size = {}, 0
        if held:
            yield rows()

    return run


def _same(x: bytes, y: bytes) -> None:
    if x != y:
        raise ValueError("two contents share 128 bits of hashes")


def _different(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, int]]:
    """Segments in order of key and content, equal ones as one."""
    last = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "segment", "n")), strict=True):
            if last and last[:2] == row[:2]:
                _same(last[2], row[2])
                last = (*last[:3], last[3] + row[3])
            else:
                if last:
                    yield last
                last = row
    if last:
        yield last


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: list[tuple] = []
    for row in _different(batches):
        block.append(row)
        if len(block) == 4096:
            yield _batch(_SEGMENTS, *zip(*block, strict=True))
            block = []
    if block:
        yield _batch(_SEGMENTS, *zip(*block, strict=True))


def repeated_starts(segments: list[bytes], counts: list[int], span: int) -> np.ndarray:
    """For each byte of the segments in a row, each followed by a mark, whether a repeated string of ``span`` bytes starts there."""
    sizes = np.array([len(x) + 1 for x in segments])
    joined = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    ends = np.cumsum(sizes)
    left = np.repeat((ends - 1).astype(np.int32), sizes)
    left -= np.arange(len(joined), dtype=np.int32)
    # bytes in use numbered in order, so that more of them are compared at once
    used = np.bincount(joined, minlength=256) > 0
    symbols = (np.cumsum(used) - 1).astype(np.uint8)[joined]
    # only suffixes with a whole string count; those that share it stand side by side
    sa, interval = span_array(symbols, int(used.sum()), span, left)
    weight = np.repeat(np.array(counts, np.int64), sizes)[sa]
    total = np.bincount(interval, weights=weight)
    found = np.zeros(len(symbols), bool)
    found[sa] = total[interval] >= 2
    return found


def _judged(span: int, block_bytes: int):
    """The repeated windows of each segment, from the suffix arrays of blocks of whole keys."""

    def verdicts(block: list[tuple]) -> pa.RecordBatch:
        keys, contents, segments, counts = zip(*block, strict=True)
        found = repeated_starts(segments, counts, span)
        ends = np.cumsum([len(x) + 1 for x in segments])
        # first and behind-last places of the runs of true values by turns; no run goes over a mark
        edges = np.flatnonzero(np.diff(found, prepend=False, append=False))
        owner = ends.searchsorted(edges, "right")
        places = edges - np.append(0, ends)[owner]
        own, begin = np.unique(owner, return_index=True)
        ranges = pa.ListArray.from_arrays(pa.array(np.append(begin, len(owner)), pa.int32()), pa.array(places, pa.int32()))
        return _batch(_VERDICTS, np.array(keys, np.int64)[own], np.array(contents, np.int64)[own], ranges)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for row in _different(batches):
            if size >= block_bytes and row[0] != block[-1][0]:
                yield verdicts(block)
                block, size = [], 0
            block.append(row)
            size += len(row[2]) + 1
        if block:
            yield verdicts(block)

    return run


def _by_text(runs: DataFrame, *columns: str) -> DataFrame:
    return runs.groupBy("a", "b").agg(F.collect_list(F.struct(*columns)).alias("runs"))


def _repeated(texts: DataFrame, span: int, pieces: tuple[int, ...], most: int, block_bytes: int) -> DataFrame:
    """``a, b, ranges``: where repeated strings start in the texts ``a, b, text, n``, first and behind-last places by turns."""
    piece, *longer = pieces
    runs = texts.select("a", "b", "text", "n").mapInArrow(_runs_of(span, piece), _RUNS)
    often = written(runs.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "keys")
    runs = written(runs.join(often, "key", "left_semi").select("a", "b", "at", "windows", "key", "content"), "runs")
    hot = runs.select("key", "content").distinct().groupBy("key").count().filter(F.col("count") > most).select("key")
    verdicts, cold = None, runs
    if longer:
        hot = written(hot, "hot")
        if hot.head(1):
            cold = runs.join(hot, "key", "left_anti")
            cut = texts.join(_by_text(runs.join(hot, "key", "left_semi"), "at", "windows", "key", "content"), ["a", "b"])
            cut = cut.select("text", "n", "runs").mapInArrow(_cut(span), _SEGMENTS).repartition("key", "content").sortWithinPartitions("key", "content")
            again = cut.mapInArrow(_merged, _SEGMENTS).select(F.col("key").alias("a"), F.col("content").alias("b"), F.col("segment").alias("text"), "n")
            found = _repeated(written(again, "segments"), span, tuple(longer), most, block_bytes)
            verdicts = written(found.select(F.col("a").alias("key"), F.col("b").alias("content"), "ranges"), "verdicts")
    cut = texts.join(_by_text(cold, "at", "windows", "key", "content"), ["a", "b"])
    # all columns of the texts, so that this shuffle of them is that of the last join too
    whole = [c for c in texts.columns if c not in ("a", "b")]
    cut = cut.select(*whole, "runs").mapInArrow(_cut(span), _SEGMENTS).repartition("key").sortWithinPartitions("key", "content")
    judged = cut.mapInArrow(_judged(span, block_bytes), _VERDICTS)
    if verdicts is not None:
        judged = judged.unionByName(verdicts)
    placed = runs.join(judged, ["key", "content"]).select("a", "b", F.transform("ranges", lambda x: x + F.col("at")).alias("ranges"))
    return placed.groupBy("a", "b").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``a, b, id, text, n`` with a number for each row that no later scan changes: its file (a hash of the name) and its place there.

    What isn't read from files is written to the shared folder first.
    """
    columns = [F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")]
    place = [F.xxhash64("_metadata.file_path").alias("a"), F.coalesce("_metadata.row_index", F.lit(-1)).alias("b")]
    try:
        return docs.select(*place, *columns, F.lit(1).cast("long").alias("n"))
    except AnalysisException:
        kept = written(docs.select(*columns), "texts")
        return kept.select(*place, "id", "text", F.lit(1).cast("long").alias("n"))


def _cleaned(span: int, id_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                text = text.as_py()
                if not ranges.is_valid:
                    removed.append([])
                    kept.append(text)
                    continue
                both = np.sort(ranges.values.to_numpy().reshape(-1, 2), axis=0)
                starts, ends = both[:, 0], both[:, 1] + (span - 1)
                apart = np.flatnonzero(starts[1:] > ends[:-1])
                starts, ends = starts[np.append(0, apart + 1)].tolist(), ends[np.append(apart, len(ends) - 1)].tolist()
                removed.append([{"start": x, "end": y} for x, y in zip(starts, ends, strict=True)])
                kept.append(b"".join(text[x:y] for x, y in zip([0, *ends], [*starts, len(text)], strict=True)))
            kinds = [id_type, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.int64()]
            sizes = [len(x.as_py()) for x in batch.column("text")]
            columns = [batch.column("id"), removed, kept, sizes]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "removed", "kept", "n_bytes"])

    return run


def remove_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, pieces: tuple[int, ...] = PIECES, most: int = 8192, block_bytes: int = 1 << 22
) -> DataFrame:
    """One row per document: ``id_col, n_bytes, removed`` (ranges of bytes in order), ``kept`` (the other bytes).

    ``pieces`` are the lengths of the pieces whose hashes are keys, each tried on
    what the one before leaves with more than ``most`` contents a key; the whole
    ``span`` comes after them.  ``block_bytes`` is about how much a suffix array sorts.
    """
    texts = _numbered(docs, id_col, text_col)
    found = _repeated(texts, span, (*pieces, span), most, block_bytes)
    id_type = texts.schema["id"].dataType
    both = texts.join(found, ["a", "b"], "left").select("id", "text", "n", "ranges")
    from pyspark.sql.pandas.types import to_arrow_type

    out = both.mapInArrow(_cleaned(span, to_arrow_type(id_type)), f"id {id_type.simpleString()}, removed array<struct<start: long, end: long>>, kept binary, n_bytes long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "removed", "kept")


def op12_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
