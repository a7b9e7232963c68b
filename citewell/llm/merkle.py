"""Merkle manifest of a dataset: leaves of rows, a tree for each group, a tree over the groups, and a proof for each row.

1. Rows become leaves, digests of their columns, in one scan; only these narrow
   rows go further.  They are sorted by range of group, order, digest and a row
   number, so a group with most of the rows, and a row repeated as often, is cut
   like any other.  The sorted RDD is one object: its shuffle files serve every pass.
2. Each partition counts the rows of its first and last group, the only ones
   that may go on in another; from these counts, two a partition, follow the
   offset of each partition in its groups and the groups' sizes.
3. Each partition builds the complete aligned subtrees over its rows.  Nodes
   whose parent it can't build, a few a level at each end, are shuffled by the
   coordinate of an ancestor some levels up, built up to it, and so on in rounds
   to the group's root; a block of a round holds the nodes of a few partition ends.
4. Roots of groups are the leaves of a last tree, built the same way.
5. A row's proof is what its partition built around it, and above that the nodes
   at the partition's two ends, which were asked for by coordinate and shuffled
   to the partition: again a few a level.

Every ``arity`` consecutive nodes become the digest of their concatenation; the last run of a
level may be shorter, even one node; a level of one node is the root.  Digests are
lowercase hexadecimal SHA-256 of concatenated hexadecimal text.

Cases: a null column is written ``-``; null groups and null orders come first;
empty and very long texts are like any other, as texts are digested in the scan;
ties in order go by digest, and rows that agree in that too are interchangeable;
repeated rows are leaves of their own; an empty table gives an empty result;
further columns don't count, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import crc32_of_id, groups_for, table, written

_NODES = "grp string, size long, level int, at long, digest string, is_root boolean"
_PATH = "array<struct<left: string, right: string>>"
#: Levels that a round builds above the expected height of a partition's subtree, or above the round before.
_ROUND = 6


def digest_of(*columns: Column) -> Column:
    """The leaf of these columns: each ``-`` if null, else the number of its bytes in UTF-8, a colon and the value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts += [F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))]
    return F.sha2(F.concat(*parts), 256)


def _join(digests: Iterable[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def local_levels(leaves: list[str], first: int, size: int, arity: int) -> list[tuple[int, list[str]]]:
    """The complete nodes over some leaves of a group of ``size``, of which ``first`` come before: each level's first coordinate and digests."""
    levels = [(first, leaves)]
    while size > 1:
        first, nodes = levels[-1]
        end = first + len(nodes)
        low = -(-first // arity)
        high = -(-end // arity) if end == size else end // arity
        if high <= low:
            break
        levels.append((low, [_join(nodes[j * arity - first : (j + 1) * arity - first]) for j in range(low, high)]))
        size = -(-size // arity)
    return levels


def _ragged(levels: list[tuple[int, list[str]]], arity: int) -> Iterator[tuple[int, int, str]]:
    """``level, at, digest`` of the nodes whose parent isn't among ``levels``."""
    for k, (first, nodes) in enumerate(levels):
        low, above = levels[k + 1] if k + 1 < len(levels) else (0, [])
        for j, digest in enumerate(nodes, first):
            if not low <= j // arity < low + len(above):
                yield k, j, digest


def _sizes(size: int, arity: int) -> list[int]:
    """The number of nodes of each level of a group, to the root."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


class _Places:
    """Where each partition's first and last group lie in their groups, from the counts of all partitions."""

    def __init__(self, edges: list[tuple[int, list[tuple[str | None, int]]]]):
        runs, sizes = [], []
        for part, groups in sorted(edges, key=lambda e: e[0]):
            for end, (group, n) in enumerate(groups):
                if end or not runs or runs[-1][1] != group:
                    sizes.append(0)
                runs.append((part, group, len(sizes) - 1, sizes[-1]))
                sizes[-1] += n
        #: ``part, group, rows before, size`` of the groups at partitions' ends.
        self.ends: dict[int, list[tuple[int, int]]] = {}
        self.open: list[tuple[int, str | None, int, int, int]] = []
        counts = {p: [n for _, n in groups] for p, groups in edges}
        for part, group, number, before in runs:
            self.ends.setdefault(part, []).append((before, sizes[number]))
            n = counts[part][len(self.ends[part]) - 1]
            if n < sizes[number]:
                self.open.append((part, group, before, n, sizes[number]))

    def of(self, part: int, k: int, runs: int, n: int) -> tuple[int, int]:
        """Rows before, and size, of the k-th group of a partition."""
        return self.ends[part][-1 if k else 0] if k in (0, runs - 1) else (0, n)


def _edges(part: int, rows: Iterable) -> Iterator:
    counts: list[tuple[str | None, int]] = []
    for group, run in groupby(rows, key=lambda r: r[0]):
        counts = [*counts[:1], (group, sum(1 for _ in run))]
    if counts:
        yield part, counts


def _runs(rows: Iterable) -> list[tuple[str | None, list]]:
    return [(group, list(run)) for group, run in groupby(rows, key=lambda r: r[0])]


def _own_nodes(places, arity: int):
    """Nodes of a partition that others need: those without a parent here, roots of whole groups included."""

    def run(part: int, rows: Iterable) -> Iterator:
        runs = _runs(rows)
        for k, (group, own) in enumerate(runs):
            first, size = places.value.of(part, k, len(runs), len(own))
            for node in _ragged(local_levels([r[1] for r in own], first, size, arity), arity):
                yield group, size, *node, node[0] == len(_sizes(size, arity)) - 1

    return run


def _built(top: int, arity: int):
    """The nodes that follow, up to level ``top``, from those of one block."""

    def run(block: tuple) -> Iterator:
        (group, size, _), nodes = block
        sizes = _sizes(size, arity)
        levels: dict[int, dict[int, str]] = {}
        for level, at, digest in nodes:
            levels.setdefault(level, {})[at] = digest
        for level in range(min(levels), min(top, len(sizes) - 1)):
            here = levels.get(level, {})
            for parent in sorted({at // arity for at in here}):
                children = range(parent * arity, min((parent + 1) * arity, sizes[level]))
                digest = _join(here[j] for j in children)
                levels.setdefault(level + 1, {})[parent] = digest
                yield group, size, level + 1, parent, digest, level + 2 == len(sizes)

    return run


def _wanted(arity: int):
    """``(group, size, level, at), part`` of the nodes beside the ways from a run's first and last row to the root."""

    def run(end: tuple) -> Iterator:
        part, group, first, n, size = end
        low, high = first, first + n - 1
        for level, nodes in enumerate(_sizes(size, arity)[:-1]):
            for at in sorted({j for x in (low, high) for j in range(x // arity * arity, min((x // arity + 1) * arity, nodes))}):
                yield (group, size, level, at), part
            low, high = low // arity, high // arity

    return run


class _Paths:
    """Siblings on the way from a row to its group's root, those shared with the row before kept."""

    def __init__(self, leaves: list[str], first: int, size: int, arity: int, outer: dict[tuple[int, int], str]):
        self.levels, self.sizes, self.arity, self.outer = local_levels(leaves, first, size, arity), _sizes(size, arity), arity, outer
        self.held: dict[int, tuple[int, tuple]] = {}

    def node(self, level: int, at: int) -> str:
        if level < len(self.levels):
            first, nodes = self.levels[level]
            if first <= at < first + len(nodes):
                return nodes[at - first]
        return self.outer[level, at]

    def of(self, level: int, at: int) -> tuple:
        if self.sizes[level] == 1:
            return ()
        low = at // self.arity * self.arity
        high = min(low + self.arity, self.sizes[level])
        above = self.held.get(level + 1)
        if not above or above[0] != low // self.arity:
            above = self.held[level + 1] = (low // self.arity, self.of(level + 1, low // self.arity))
        return (("".join(self.node(level, j) for j in range(low, at)), "".join(self.node(level, j) for j in range(at + 1, high))), *above[1])


def _with_paths(places, arity: int):
    """Rows with their paths from a partition and the nodes it asked for."""

    def run(both: tuple) -> Iterator:
        (part, rows), answers = both
        runs = _runs(rows)
        for k, (group, own) in enumerate(runs):
            first, size = places.value.of(part, k, len(runs), len(own))
            outer = {(level, at): digest for (of, n, level, at), digest in answers if of == group and n == size}
            paths = _Paths([r[1] for r in own], first, size, arity, outer)
            for x, row in enumerate(own, first):
                yield (*row, paths.of(0, x))

    return run


def _tree(leaves: DataFrame, order: list[str], keep: list[str], arity: int, each: int) -> tuple[DataFrame, DataFrame]:
    """The tree of each group of ``grp, leaf`` and further columns: the leaves in order with their paths to the group's root, and ``grp, digest`` of the roots."""
    spark = leaves.sparkSession
    dealt = leaves.repartitionByRange(groups_for(leaves.count(), each), "grp", *order).sortWithinPartitions("grp", *order)
    rows = dealt.select("grp", "leaf", *keep).rdd.map(tuple)
    parts = rows.getNumPartitions()
    known = _Places(rows.mapPartitionsWithIndex(_edges).collect())
    places = spark.sparkContext.broadcast(known)

    nodes = written(spark.createDataFrame(rows.mapPartitionsWithIndex(_own_nodes(places, arity)), _NODES, verifySchema=False), "nodes")
    height = max((len(_sizes(size, arity)) - 1 for *_, size in known.open), default=0)
    top = min(height, len(_sizes(each, arity)) + _ROUND) if height else 0
    below = 0
    while below < height:
        due = nodes.filter((F.col("level") < top) & (F.col("level") >= below) & ~F.col("is_root"))
        blocks = due.rdd.map(lambda r, top=top: ((r.grp, r.size, r["at"] // arity ** (top - r.level)), (r.level, r["at"], r.digest))).groupByKey()
        built = spark.createDataFrame(blocks.flatMap(_built(top, arity)), _NODES, verifySchema=False)
        nodes = nodes.unionByName(written(built, "nodes"))
        below, top = top, min(height, top + _ROUND)

    asked = spark.sparkContext.parallelize(known.open, max(1, min(parts, len(known.open)))).flatMap(_wanted(arity))
    there = nodes.rdd.map(lambda r: ((r.grp, r.size, r.level, r["at"]), r.digest))
    answers = asked.join(there).map(lambda x: (x[1][0], (x[0], x[1][1]))).partitionBy(parts, int).values()
    whole = rows.mapPartitionsWithIndex(lambda p, own: [(p, list(own))])
    if more := answers.getNumPartitions() - parts:  # where the session deals keys to more partitions than asked for
        whole = whole.union(spark.sparkContext.parallelize([(parts + i, []) for i in range(more)], more))
    whole = whole.zip(answers.glom())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.select(*keep).schema)
    paths = spark.createDataFrame(whole.flatMap(_with_paths(places, arity)), f"grp string, leaf string, {kinds}{', ' if kinds else ''}path {_PATH}", verifySchema=False)
    return paths, nodes.filter("is_root").select("grp", "digest")


def manifest(
    docs: DataFrame, leaf: Column, keep: dict[str, Column], group_col: str = "lang", order_col: str = "doc_id", arity: int = 2, each: int = 1 << 16
) -> DataFrame:
    """One row a row of ``docs``: the columns ``keep``, then ``leaf, subroot, root, path``.

    ``leaf`` is the digest of a row, as by ``digest_of``.  ``path`` has, from the leaf up
    to the root, what stands left and right of the own node in each run; ``folded`` goes that way.
    ``each`` is how many rows a partition sorts and builds over.
    """
    if arity < 2:
        raise ValueError(f"arity {arity}: a run has two nodes at least")
    kept = [f"_{i}" for i in range(len(keep))]
    columns = [c.alias(k) for c, k in zip(keep.values(), kept, strict=True)]
    rows = docs.select(F.col(group_col).cast("string").alias("grp"), F.col(order_col).alias("by"), leaf.alias("leaf"), F.monotonically_increasing_id().alias("row"), *columns)
    paths, subroots = _tree(written(rows, "leaves"), ["by", "leaf", "row"], kept, arity, each)
    subroots = written(subroots.select(F.lit(None).cast("string").alias("grp"), F.col("digest").alias("leaf"), F.col("grp").alias("name")), "subroots")
    tops, top = _tree(subroots, ["name"], ["name"], arity, each)
    root = top.first()
    tops = written(tops.select("name", F.col("leaf").alias("subroot"), F.col("path").alias("further")), "tops")
    out = paths.join(tops, paths["grp"].eqNullSafe(tops["name"]))
    named = [F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)]
    return out.select(*named, "leaf", "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), F.concat("path", "further").alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda digest, beside: F.sha2(F.concat(beside["left"], digest, beside["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The digest of a path's digests, from the leaf up, in each run from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda beside: F.concat(beside["left"], beside["right"])), ""), 256)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    forged = digest_of(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields))
    keep = {"doc_id": F.col("doc_id"), "tampered": F.when(crc32_of_id() % 7 == 0, forged)}
    out = manifest(docs, digest_of(*map(F.col, fields)), keep)
    out = out.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": folded(F.coalesce("tampered", "leaf"), F.col("path"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP11_SQL = """
WITH RECURSIVE
d AS (
  SELECT row_number() OVER () AS r, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS a, coalesce(strlen(source) || ':' || source, '-') AS b, coalesce(strlen(lang) || ':' || lang, '-') AS c,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n_forged,
         coalesce(strlen(text) || ':' || text, '-') AS t,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i::INTEGER, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS crc
  FROM documents),
leaves AS (
  SELECT r, doc_id, g, sha256(a || b || c || n || t) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(a || b || c || n_forged || t) ELSE sha256(a || b || c || n || t) END AS given
  FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY g) AS size FROM leaves),
nodes AS (
  SELECT g, 0 AS level, pos, size, leaf AS digest FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY g, level, pos // 2, size),
subroots AS (SELECT g, digest AS subroot FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS g, 0 AS level, g - 1 AS pos, (SELECT count(*) FROM subroots) AS size, subroot AS digest FROM subroots
  UNION ALL
  SELECT g, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE size > 1 GROUP BY g, level, pos // 2, size),
everything AS (SELECT * FROM nodes UNION ALL SELECT * FROM tops),
way AS (
  SELECT r, g, 0 AS level, pos, size, given AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT r, CASE WHEN w.size = 1 THEN 0 ELSE w.g END, CASE WHEN w.size = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.size = 1 THEN w.g - 1 ELSE w.pos // 2 END,
         CASE WHEN w.size = 1 THEN (SELECT count(*) FROM subroots) ELSE (w.size + 1) // 2 END,
         CASE WHEN w.size = 1 THEN folded WHEN w.pos % 2 = 1 THEN sha256(coalesce(e.digest, '') || folded) ELSE sha256(folded || coalesce(e.digest, '')) END,
         CASE WHEN w.size = 1 THEN proof ELSE proof || coalesce(e.digest, '') END
  FROM way w LEFT JOIN everything e ON e.g = w.g AND e.level = w.level AND e.pos = xor(w.pos, 1)
  WHERE w.size > 1 OR w.g > 0),
ended AS (SELECT r, folded, proof FROM way WHERE size = 1 AND g = 0),
root AS (SELECT digest AS root FROM tops WHERE size = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed JOIN subroots USING (g) JOIN ended USING (r) CROSS JOIN root
"""


