"""Cubes from a stored state that is refreshed by what has changed.

The state has a row for each journal, country and year: sums and counts, from
which every figure of every level follows, and sketches that can be merged.
Sums of ratios are decimals, so they add up alike in any order and a refreshed
state equals one built anew.  Beside it stands a print of each journal: its
number of works, largest update date and a checksum of ids and dates.  A refresh
reads these three narrow columns of all works, finds journals with added, changed
or removed works, reads the works of these alone, and puts their rows in place of the old ones.

States are versions in one folder; a version counts when its prints, which are
written last, are complete, so a refresh that dies leaves the one before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.plans import cubes
from citewell.plans.indicators import LANGUAGES, STATUSES, count_exprs, grouped_sets, shares
from citewell.schemas import require

GRAIN = ("journal_id", "country_code", "year")
_SUMS = ("fwci", "percentile")
#: A ratio in a sum: 18 places, ten before the point, and twenty in sums over all works.
_EXACT = "decimal(28, 18)"
#: Standard errors of the sketches: 1.04 / sqrt(2**12) of a distinct count, about 1.3 % of rank for a quantile.
LOG_K, KLL_K = 12, 200


def _not_nan(c: str) -> Column:
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c))


@dataclass(frozen=True)
class CubeState:
    """A state at ``path``.  ``distinct`` are columns whose values are counted, ``quantiles`` columns whose spread is kept, both by sketches."""

    path: str
    nulls: str = "zero"
    work: str = "work_id"
    updated: str = "updated"
    distinct: Sequence[str] = ()
    quantiles: Sequence[str] = ()
    statuses: Sequence[str] = field(default=STATUSES)
    languages: Sequence[str] = field(default=LANGUAGES)

    def _counts(self) -> list[str]:
        return ["num_documents", "total_citations", "top_10_count", "top_1_count", "oa_total_count", *[f"oa_{s}_count" for s in self.statuses], *[f"lang_{x}_count" for x in self.languages], "lang_other_count"]

    def rows(self, works: DataFrame) -> DataFrame:
        """The state of some works, one row a journal, country and year; rows without a year or journal are kept under null."""
        require(works, *GRAIN, self.work, self.updated, *self.distinct, *self.quantiles, "cited_by_count", "fwci", "percentile", "is_oa", "oa_status", "language")
        made = works.groupBy(*GRAIN).agg(
            *count_exprs(self.nulls, self.statuses, self.languages), F.max(self.updated).alias("updated"),
            *[F.sum(_not_nan(c).cast(_EXACT)).alias(f"{c}_sum") for c in _SUMS], *[F.count(_not_nan(c)).alias(f"{c}_n") for c in _SUMS],
            *[F.hll_sketch_agg(F.col(c).cast("string"), LOG_K).alias(f"{c}_hll") for c in self.distinct],
            *[F.kll_sketch_agg_double(F.col(c).cast("double"), KLL_K).alias(f"{c}_kll") for c in self.quantiles],
        )
        return made.drop("fwci_avg", "avg_percentile")

    def prints(self, works: DataFrame) -> DataFrame:
        mark = F.xxhash64(self.work, F.col(self.updated).cast("string"))
        return works.groupBy("journal_id").agg(F.count(F.lit(1)).alias("n"), F.max(self.updated).alias("latest"), F.bit_xor(mark).alias("marks"), F.sum(mark.cast("decimal(20, 0)")).alias("sums"))

    def _versions(self, spark: SparkSession) -> list[int]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [x.getPath().getName() for x in files.listStatus(folder)]
        done = [n for n in names if n.startswith("v=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/prints/_SUCCESS"))]
        return sorted(int(n.removeprefix("v=")) for n in done)

    def _put(self, version: int, rows: DataFrame, prints: DataFrame) -> None:
        rows.sortWithinPartitions("journal_id").write.mode("overwrite").parquet(f"{self.path}/v={version}/state")
        prints.write.mode("overwrite").parquet(f"{self.path}/v={version}/prints")

    def build(self, works: DataFrame) -> None:
        """A new version from all works."""
        version = max(self._versions(works.sparkSession), default=0) + 1
        self._put(version, self.rows(works), self.prints(works))

    def changed(self, works: DataFrame) -> DataFrame:
        """``journal_id, gone``: journals whose works are not those of the state; ``gone`` where none is left."""
        spark = works.sparkSession
        old = spark.read.parquet(f"{self.path}/v={self._versions(spark)[-1]}/prints").withColumnsRenamed({c: f"old_{c}" for c in ("journal_id", "n", "latest", "marks", "sums")})
        new = self.prints(works)
        both = new.join(old, new["journal_id"].eqNullSafe(old["old_journal_id"]), "full")
        same = F.col("n").eqNullSafe(F.col("old_n")) & F.col("latest").eqNullSafe(F.col("old_latest")) & F.col("marks").eqNullSafe(F.col("old_marks")) & F.col("sums").eqNullSafe(F.col("old_sums"))
        return both.filter(~same).select(F.coalesce("journal_id", "old_journal_id").alias("journal_id"), F.col("n").isNull().alias("gone"))

    def refresh(self, works: DataFrame) -> DataFrame:
        """The next version from the last and the works of changed journals; gives the changed journals, as ``changed`` does.

        Without a version it builds one and gives all journals.
        """
        spark = works.sparkSession
        versions = self._versions(spark)
        if not versions:
            self.build(works)
            return self.prints(works).select("journal_id", F.lit(False).alias("gone"))
        last, path = versions[-1], f"{self.path}/v={versions[-1] + 1}"
        self.changed(works).write.mode("overwrite").parquet(f"{path}/changed")
        changed = spark.read.parquet(f"{path}/changed")
        if not changed.head(1):
            return changed
        old = spark.read.parquet(f"{self.path}/v={last}/state")
        named = changed.select(F.col("journal_id").alias("_changed"))
        kept = old.join(named, old["journal_id"].eqNullSafe(named["_changed"]), "left_anti")
        # with few journals their ids reach the scan, where row groups and partitions without them are skipped
        few = [r["_changed"] for r in named.limit(1001).collect()]
        read = works
        if len(few) <= 1000:
            known = F.col("journal_id").isin([x for x in few if x is not None])
            read = works.filter(known | F.col("journal_id").isNull() if None in few else known)
        again = read.join(named, read["journal_id"].eqNullSafe(named["_changed"]), "left_semi")
        self._put(last + 1, kept.unionByName(self.rows(again)), self.prints(works))
        return changed

    def load(self, spark: SparkSession) -> DataFrame:
        """The rows of the last version; none is an error."""
        versions = self._versions(spark)
        if not versions:
            raise FileNotFoundError(f"no complete state in {self.path}")
        return spark.read.parquet(f"{self.path}/v={versions[-1]}/state")

    def _merged(self, rows: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
        """Figures of several sets of keys from rows of the state."""
        merges = [F.sum(c).alias(c) for c in self._counts()]
        merges += [F.sum(f"{c}_sum").alias(f"{c}_sum") for c in _SUMS] + [F.sum(f"{c}_n").alias(f"{c}_n") for c in _SUMS]
        merges += [F.hll_union_agg(f"{c}_hll").alias(f"{c}_hll") for c in self.distinct] + [F.kll_merge_agg_double(f"{c}_kll").alias(f"{c}_kll") for c in self.quantiles]
        made = grouped_sets(rows, sets, merges)
        over = lambda c: F.col("num_documents") if self.nulls == "zero" else F.col(f"{c}_n")
        mean = lambda c: F.coalesce(F.try_divide(F.col(f"{c}_sum").cast("double"), over(c)), F.lit(0.0))
        figures = shares(made.withColumns({"fwci_avg": mean("fwci"), "avg_percentile": 100 * mean("percentile")}))
        more = {f"distinct_{c}": F.hll_sketch_estimate(f"{c}_hll") for c in self.distinct}
        more |= {f"{c}_quantiles": F.kll_sketch_get_quantile_double(f"{c}_kll", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])) for c in self.quantiles}
        out = figures.withColumns(more) if more else figures
        return out.drop(*[f"{c}_{x}" for c in _SUMS for x in ("sum", "n")], *[f"{c}_hll" for c in self.distinct], *[f"{c}_kll" for c in self.quantiles])

    def cubes(self, spark: SparkSession, recent: tuple[int, int], levels: Sequence[str] = tuple(cubes.LEVELS), years: tuple[int, int] | None = None) -> DataFrame:
        """Annual, period and recent figures of the levels, as ``cubes.level_cubes`` makes from works, with the sketches' figures besides."""
        rows = self.load(spark)
        return cubes.level_cubes(rows, levels, years or cubes.year_range(rows), recent, grouped=self._merged)
