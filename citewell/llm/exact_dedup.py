"""Exact duplicates by skew-safe combining, with DataFrame operations only.

Texts are equal when they agree after every run of white space became one
blank.  Three combining steps, each grouping by the full text beside its
digest, so a digest alone never decides:

1. local: within a scan task, copies become one row (the map side of the first
   aggregate), so a text that fills a third of the table leaves one row a task;
2. salted: these rows meet in ``salts`` groups for each digest;
3. global: at most ``salts`` winners of a text meet in one group.

Each document then finds its group by the digest, which is exact where all
texts of the digest were seen to be equal.  Where two texts share a digest, the
rows of that digest alone are matched by digest and full text.  The table of
digests is narrow and written to the shared folder, so texts are shuffled
twice and no more.  The last join has one row a digest on that side, so
adaptive execution may split a hot digest freely.

Cases: null text counts as empty; empty texts are copies of each other; ties go
to the smallest id, and rows that repeat that id all stay; null ids never win
against another id; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import table, written

#: A run that one blank replaces: two or more of any white space, or one that isn't the blank.
_RUN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    """Null as empty, each run of white space as one blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256_hex
) -> DataFrame:
    """One row for each different text: ``digest, content, keep_id, group_size``."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("content")).select(
        "id", "content", digest(F.col("content")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
    )
    salted = rows.groupBy("digest", "salt", "content").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "content").agg(F.min("first").alias("keep_id"), F.sum("n").alias("group_size"))


def digest_table(groups: DataFrame) -> DataFrame:
    """One narrow row for each digest, written once: ``digest, contents, keep_id, group_size``; ``contents`` counts its different texts."""
    made = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return written(made, "digests")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256_hex
) -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, digest``."""
    groups = exact_groups(docs, id_col, text_col, salts, digest)
    digests = digest_table(groups)
    content = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), digest(content).alias("digest"))
    out = rows.join(digests.filter("contents = 1"), "digest").select("id", "keep_id", "group_size", "digest")
    shared = digests.filter("contents > 1").select("digest")
    if shared.head(1):
        again = docs.select(F.col(id_col).alias("id"), content.alias("content"), digest(content).alias("digest"))
        rivals = groups.join(shared, "digest", "left_semi")
        out = out.unionByName(again.join(rivals, ["digest", "content"]).select("id", "keep_id", "group_size", "digest"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """``docs`` without the rows that repeat the text of a row with a smaller id; all columns stay.

    As in ``exact_dedup``, a null id never wins against another id, and where a
    text has null ids only, its rows all stay, as rows that repeat an id and its
    text do.  A row is told by id and digest, so an id that repeats with
    different texts has each of them stay or go by itself.
    """
    groups = exact_groups(docs, id_col, text_col, salts)
    stay = groups.select(F.col("keep_id").alias("_keep"), F.col("digest").alias("_digest")).distinct()
    same = docs[id_col].eqNullSafe(stay["_keep"]) & (sha256_hex(normalised(docs[text_col])) == stay["_digest"])
    return docs.join(stay, same, "left_semi").select(docs.columns)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents)
SELECT doc_id,
       min(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept,
       sha256(content) AS text_sha256
FROM t WINDOW w AS (PARTITION BY content)
"""
