"""Near duplicates: a Jaccard self-join on word n-grams by MinHash banding.

1. Each text becomes the set of 64-bit hashes of its n-grams and ``bands``
   band keys of ``rows`` MinHash values each; both counts follow from the
   target recall at the threshold.  Texts with equal sets form one class and go
   on as its representative, the smallest id, so copies cost nothing further.
2. Representatives meet on band keys.  A bucket gives one edge from each member
   to its smallest member, never all pairs; the components of these edges
   contain every candidate pair.
3. Components are dealt out as blocks of bounded size.  A component too large
   for one block goes whichever way copies its texts less: cut into chunks, each
   pair of chunks a block of its own, or by its buckets, so that a text goes
   only where it may meet another and chains of chance meetings cost each text
   its own buckets at most.  A bucket too large is cut into chunks likewise, and
   a pair is verified in the first band it shares alone.  No block grows with a
   component or bucket and no pair is lost.  Within a block the pairs that share
   a band are verified on their full n-gram sets; the block returns, for each
   member, its number of links and its root by union-find: as many rows as
   members, never the pairs.
4. Roots of components that lie in several blocks are joined up by the same
   component search, on verified links alone.

Cases: null and empty texts have no n-grams, no links and a class of their own;
texts of fewer than n words have one n-gram of all their words; repeated rows
count as copies; an id that repeats with different texts has each of them in the
class and with the links of its own set; very long texts are held whole, as their sets are; of equal ids in a class
the set with the least key leads; an empty table gives an empty result;
further columns are ignored; null ids are left out of classes and come back
with no links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import lean, table, text_or_empty, written
from citewell.llm.components import connected_components

_SPACES = str.maketrans("\t\n\v\f\r", "     ")


def bands_and_rows(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """The most rows a band can have, within ``hashes`` values, so that a pair at the threshold is found with probability ``recall``.

    More rows mean fewer chance meetings; a pair at similarity s meets with
    probability 1 - (1 - s^rows)^bands.
    """
    fits = [(hashes // r, r) for r in range(1, hashes + 1) if 1 - (1 - threshold**r) ** (hashes // r) >= recall]
    if not fits:
        raise ValueError("no banding reaches this recall with so few hashes")
    return fits[-1]


class WordHashes(dict):
    """64-bit hashes of the words of up to 64 characters met so far, emptied when ``limit`` are held."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        made = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        if len(word) <= 64:  # longer ones, as of scripts without blanks, would fill the memory
            if len(self) >= self.limit:
                self.clear()
            self[word] = made
        return made


def ngram_set(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the different n-grams of words; one n-gram of all words where there are fewer than n."""
    words = [w for w in text.translate(_SPACES).split(" ") if w]
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)).view(np.uint64)
    n = min(n, len(h))
    mixed = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        mixed = (mixed ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


class MinHash:
    """``bands`` keys of ``rows`` MinHash values each."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 2**63, bands * rows, np.uint64)
        self.mix = rng.integers(0, 2**63, rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        least = np.empty(len(self.factor), np.uint64)
        work = np.empty(len(grams), np.uint64)
        for i, (a, b) in enumerate(zip(self.factor, self.shift, strict=True)):
            np.multiply(grams, a, out=work)
            np.add(work, b, out=work)
            least[i] = work.min()
        rows = least.reshape(self.bands, self.rows)
        key = np.zeros(self.bands, np.uint64)
        for i in range(self.rows):
            key = (key ^ rows[:, i]) * self.mix[i]
            key ^= key >> np.uint64(31)
        return key.view(np.int64)


_SIGNED = "doc_id long, mark string, set_key binary, n_grams long, bands array<long>"


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int, mark: Column | None = None) -> DataFrame:
    """``doc_id, mark, set_key, n_grams, bands``; key and bands are null for texts without words, and so is ``mark`` unless it is given."""

    @lean
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minhash = WordHashes(), MinHash(bands, rows)
        for batch in batches:
            keys, sizes, found = [], [], []
            for text in batch.column(2):
                grams = ngram_set(text.as_py(), n, hashes)
                sizes.append(len(grams))
                keys.append(hashlib.sha256(grams.tobytes()).digest() if len(grams) else None)
                found.append(minhash.keys(grams).tolist() if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "mark", "set_key", "n_grams", "bands"],
            )

    mark = F.lit(None).cast("string") if mark is None else mark
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("mark"), text_or_empty(text_col).alias("text")).mapInArrow(sign, _SIGNED)


def shared_bands(bands: np.ndarray) -> np.ndarray:
    """Square table of the members that have a band key in common."""
    m = len(bands)
    near = np.zeros((m, m), bool)
    for column in bands.T:
        order = np.argsort(column, kind="stable")
        cuts = np.flatnonzero(np.diff(column[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                near[np.ix_(group, group)] = True
    return near


def verified_links(sets: list[np.ndarray], near: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each member i of ``left`` with the members j > i or of ``right`` that are ``near`` and reach the threshold, on full sets."""
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.empty(0, np.int64)
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 0, bool)
    for i in np.flatnonzero(left):
        partners = near[i] & right
        partners[i] = False
        if np.array_equal(left, right):
            partners[: i + 1] = False
        partners &= (sizes * threshold <= sizes[i]) & (sizes >= sizes[i] * threshold)
        js = np.flatnonzero(partners)
        if not len(js):
            continue
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = True
        common = np.array([np.count_nonzero(mark[flat[starts[j] : starts[j + 1]]]) for j in js])
        mark[own] = False
        js = js[common >= threshold * (sizes[i] + sizes[js] - common) - 1e-9]
        if len(js):
            yield i, js


_FOUND = "rep long, root long, links long"


def _verify(n: int, threshold: float):
    def verify(data: pa.Table) -> pa.Table:
        data = data.sort_by("rep")
        hashes, sets, at = WordHashes(), [], {}
        # an id may repeat with other texts: its set's key tells which is meant
        for i, (rep, key, text) in enumerate(zip(data.column("rep").to_pylist(), data.column("set_key"), data.column("text"), strict=True)):
            if rep not in at:
                grams = ngram_set(text.as_py(), n, hashes)
                if hashlib.sha256(grams.tobytes()).digest() == key.as_py():
                    at[rep] = i
                    sets.append(grams)
        data = data.take(pa.array(list(at.values()), pa.int64()))
        reps = data.column("rep").to_numpy()
        copies = data.column("copies").to_numpy()
        chunk = data.column("chunk").to_numpy()
        a, b, band = (data.column(x)[0].as_py() for x in ("a", "b", "band"))
        bands = np.array(data.column("bands").to_pylist(), np.int64)
        near = shared_bands(bands) if band < 0 else ~shared_bands(bands[:, :band])
        root = list(range(len(reps)))
        links = np.zeros(len(reps), np.int64)

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, js in verified_links(sets, near, chunk == a, chunk == b, threshold):
            links[i] += copies[js].sum()
            links[js] += copies[i]
            for j in js:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
        return pa.table({"rep": reps, "root": pa.array([int(reps[top(i)]) for i in range(len(reps))], pa.int64()), "links": links})

    return verify


#: What names a block: a component or a bucket's band and key, and two of its chunks; the band is -1 for components.
_BLOCK = ("root", "band", "key", "a", "b")


def dealt_out(members: DataFrame, block_docs: int, block_grams: int) -> DataFrame:
    """Members of candidate components, once for each block they take part in, with ``_BLOCK`` and their ``chunk``."""

    def cut(rows: DataFrame, *by: str) -> DataFrame:
        chunks = F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("n_grams") / block_grams)).cast("int")
        return rows.groupBy(*by).agg(chunks.alias("chunks"), F.count(F.lit(1)).alias("m"))

    whole = written(cut(members, "root"), "component-sizes")
    large = members.join(whole.filter("chunks > 1").select("root"), "root", "left_semi")
    placed = large.select("root", "rep", "n_grams", F.posexplode("bands").alias("band", "key"))
    buckets = cut(placed, "root", "band", "key").filter("m > 1")
    by_bucket = whole.join(buckets.groupBy("root").agg(F.sum(F.col("m") * F.col("chunks")).alias("cost")), "root").filter(F.col("cost") < F.col("m") * F.col("chunks")).select("root")
    by_bucket = written(by_bucket, "by-bucket")

    def paired(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        more = [c for c in ("doc",) if c in rows.columns]
        return rows.select(*_BLOCK[:3], F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "rep", "copies", "chunk", "bands", "set_key", *more)

    one_way = members.join(by_bucket, "root", "left_anti").join(whole, "root").withColumns({"band": F.lit(-1), "key": F.lit(0).cast("long")})
    kept = members.join(by_bucket, "root", "left_semi").withColumn("place", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("bands") - 1).alias("band"), F.col("bands").alias("key"))))
    other_way = kept.select("*", "place.band", "place.key").join(buckets, ["root", "band", "key"])
    return paired(one_way).unionByName(paired(other_way))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    hashes: int = 128,
    block_docs: int = 512,
    block_grams: int = 1 << 20,
) -> DataFrame:
    """One row per document: ``id_col, class_id, n_links, set_id, copies``.

    ``class_id`` is the smallest id among all documents that links join up,
    directly or through others; ``n_links`` the number of other documents whose
    n-gram set reaches the threshold, copies counted one by one; ``set_id`` the
    smallest id with the same set and ``copies`` how many have it.
    """
    return _classified(docs, id_col, text_col, n, threshold, recall, hashes, block_docs, block_grams).select(
        F.col("doc_id").alias(id_col), "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("doc").alias("set_id"), F.col("copies").cast("long").alias("copies")
    )


def _classified(docs: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, hashes: int = 128, block_docs: int = 512, block_grams: int = 1 << 20, mark: Column | None = None) -> DataFrame:
    """``doc_id, mark, class_id, n_links, doc, copies, leads`` of each row; ``leads`` where the row's set gives its class its id.

    Sets have numbers of their own, so an id that repeats with different texts has as many places as sets.
    """
    bands, rows = bands_and_rows(threshold, recall, hashes)
    signed = written(signatures(docs, id_col, text_col, n, bands, rows, mark), "signatures")
    classes = signed.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "sets")
    reps = written(
        signed.join(classes.select(F.col("doc").alias("doc_id"), "set_key", "rep", "copies"), ["doc_id", "set_key"])
        .groupBy("rep")
        .agg(F.min_by(F.struct(F.col("doc_id").alias("doc"), "copies", "n_grams", "bands", "set_key"), "set_key").alias("x"))
        .select("rep", "x.*"),
        "representatives",
    )

    placed = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = placed.groupBy("band", "key").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    edges = placed.join(buckets, ["band", "key"]).filter("rep != v").select(F.col("rep").alias("u"), "v")
    blocks = written(connected_components(edges), "blocks")

    dealt = dealt_out(blocks.withColumnRenamed("node", "rep").join(reps, "rep"), block_docs, block_grams)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    found = written(
        texts.join(dealt, "doc")
        .select(*_BLOCK, "rep", "copies", "chunk", "bands", "set_key", "text")
        .groupBy(*_BLOCK)
        .applyInArrow(_verify(n, threshold), _FOUND),
        "verified",
    )
    linked = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    rooted = written(
        classes.join(counts, "rep", "left")
        .join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .select("set_key", "doc", "copies", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "classes",
    )
    # the set with the smallest id names the class; of several sets with that id the one with the least key leads it
    firsts = rooted.groupBy("root").agg(F.min(F.struct("doc", "set_key")).alias("first"))
    by_set = rooted.join(firsts, "root").select("set_key", "doc", "copies", F.col("first.doc").alias("class_id"), "n_links", (F.col("set_key") == F.col("first.set_key")).alias("leads"))
    # texts without words or ids would all meet at one null key
    has_class = F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()
    alone = signed.filter(~has_class).select("doc_id", "mark", F.col("doc_id").alias("class_id"), F.lit(0).alias("n_links"), F.col("doc_id").alias("doc"), F.lit(1).alias("copies"), F.lit(True).alias("leads"))
    joined = signed.filter(has_class).select("doc_id", "mark", "set_key").join(by_set, "set_key").select("doc_id", "mark", "class_id", "n_links", "doc", "copies", "leads")
    return joined.unionByName(alone)


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those whose class has a document with a smaller id; all columns stay.

    A row stays where its own set leads its class, so of an id that repeats with
    different texts each stays or goes by itself; rows that repeat id and text go
    together.  Rows with a null id belong to no class and all stay.
    """
    digest = lambda text: F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    rows = _classified(docs, id_col, text_col, **options, mark=digest(F.col(text_col)))
    stay = rows.filter("leads AND class_id = doc_id").select(F.col("doc_id").alias("_keep"), F.col("mark").alias("_mark")).distinct()
    named = docs.filter(docs[id_col].isNotNull())
    same = (named[id_col] == stay["_keep"]) & (digest(named[text_col]) == stay["_mark"])
    return named.join(stay, same, "left_semi").select(docs.columns).unionByName(docs.filter(docs[id_col].isNull()))


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
