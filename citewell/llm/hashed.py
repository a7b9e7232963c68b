"""Sums of hashed feature rows per word, computed once for each word a worker meets."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(feature: str, buckets: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % buckets


class WordRows:
    """``at``: word to row number of ``rows``, different for different words of a text; a row holds the sum of the word's feature rows in ``table``, then their number.

    With ``limit`` words, ``most_chars`` characters in them or ``most_bytes`` of rows the dictionary
    starts anew before the next text, so memory is bounded by these and one text, whatever the script and the number of labels.
    """

    def __init__(self, table: np.ndarray, features: Callable[[str], list[int]], limit: int = 300_000, most_chars: int = 1 << 23, most_bytes: int = 1 << 26):
        self.at: dict[str, int] = {}
        self.chars, self.most_chars = 0, most_chars
        self.table, self.features, self.limit = table, features, max(1, min(limit, most_bytes // (4 * table.shape[1] + 4)))
        self.rows = np.zeros((4096, table.shape[1] + 1), np.float32)

    def _learn(self, words: set[str]) -> None:
        """Rows for all new words of a text at once; each word has a feature or more."""
        found = [self.features(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        at = len(self.at)
        while at + len(found) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at : at + len(found), :-1] = np.add.reduceat(self.table[ids], np.cumsum(sizes) - sizes)
        self.rows[at : at + len(found), -1] = sizes
        self.at.update(zip(words, range(at, at + len(found)), strict=True))
        self.chars += sum(map(len, words))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The row number of each word of a text."""
        if len(self.at) >= self.limit or self.chars >= self.most_chars:
            self.at.clear()
            self.chars = 0
            self.rows = self.rows[: max(4096, self.limit)]  # what one long text took more goes back
        if new := set(words).difference(self.at):
            self._learn(new)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def total(self, numbers: np.ndarray) -> np.ndarray:
        """The sum of the rows of these numbers, in double precision."""
        return self.rows[numbers].sum(0, dtype=np.float64)


def content_hash(id_col: Column, text_col: Column) -> Column:
    """What a sample goes by: equal rows are one, and every partitioning gives the same choice."""
    return F.xxhash64(id_col, text_col)


def hash_sample(marks: DataFrame, each: int, most_rows: int, most_chars: int) -> DataFrame:
    """``by, h`` of at most ``each`` of the smallest hashes of every value of ``by``, from ``by, h, chars`` rows.

    All values together have at most ``most_rows`` hashes (one a value at least)
    and about ``most_chars`` characters.  The number of different hashes of each
    value, about right, comes first and gives a bound on them below which half again as many as wanted
    are expected, so tasks send on only these, however many rows a value has.
    """
    counts = marks.groupBy("by").agg(F.approx_count_distinct("h").alias("n"))
    values = max(1, counts.count())
    each = max(1, min(each, most_rows // values))
    # hashes are spread evenly over 64 bits
    share = (F.lit(1.5) * each + 50) / F.col("n")
    near = counts.select("by", (share * 2.0**64 - 2.0**63).alias("bound")).withColumnRenamed("by", "_by")
    some = marks.join(near, marks["by"].eqNullSafe(near["_by"])).filter(F.col("h").cast("double") < F.col("bound"))
    some = some.groupBy("by", "h").agg(F.max("chars").alias("chars"))
    order = Window.partitionBy("by").orderBy("h")
    ranked = some.withColumns({"rank": F.row_number().over(order), "upto": F.sum("chars").over(order)})
    return ranked.filter((F.col("rank") == 1) | (F.col("rank") <= each) & (F.col("upto") <= most_chars // values)).select("by", "h")


def sampled_texts(rows: DataFrame, chosen: DataFrame) -> list:
    """``h, text, by`` of the chosen hashes, once each in the order of ``h`` and ``by``; ``rows`` has ``h, text``.

    ``chosen`` is as small as ``hash_sample`` makes it, so it is broadcast and no text is shuffled but those chosen.
    """
    hashes = chosen.select("h").distinct()
    texts = rows.join(F.broadcast(hashes), "h", "left_semi").groupBy("h").agg(F.max("text").alias("text"))
    return sorted(texts.join(chosen, "h").select("h", "text", "by").collect())
