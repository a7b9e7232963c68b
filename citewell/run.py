"""From a snapshot to cubes in one command: ``python -m citewell.run --snapshot ROOT --out FOLDER --recent 2021 2025``.

Documents of the entities are ingested once each, works become a state of sums
that is refreshed by what has changed, and the cubes of the levels asked for are
written from it.  ``--force`` reads all works again and builds the state anew.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.plans import cubes, normalise
from citewell.plans.cube_state import CubeState
from citewell.session import session
from citewell.sources import snapshot


def latest_works(spark: SparkSession, documents: str) -> DataFrame:
    """Works with a date of update and their sources' countries, from the ingested documents, the last of each id."""
    newest = lambda entity: snapshot.latest_documents(spark.read.parquet(documents).filter(F.col("entity") == entity))
    raw = newest("works").select("raw_data", F.get_json_object("raw_data", "$.updated_date").alias("updated"))
    parsed = raw.select("updated", F.from_json("raw_data", normalise.WORK_JSON).alias("d")).select("updated", "d.*")
    works = normalise.cube_works(parsed, more=["updated"])
    sources = normalise.parsed(newest("sources"), "source").select(F.col("id").alias("journal_id"), "country_code")
    return works.join(sources, "journal_id", "left")


def run(spark: SparkSession, root: str, out: str, recent: tuple[int, int], entities: Sequence[str] = ("sources", "works"), levels: Sequence[str] = tuple(cubes.LEVELS), force: bool = False) -> DataFrame:
    """Ingests, refreshes and writes; gives the cubes."""
    documents, ledger = f"{out}/documents", f"{out}/ledger"
    for entity in entities:
        snapshot.ingest(spark, root, documents, ledger, entity)
    works = latest_works(spark, documents)
    state = CubeState(f"{out}/state")
    if force:
        state.build(works)
    else:
        state.refresh(works)
    state.cubes(spark, recent, levels).write.mode("overwrite").partitionBy("level", "kind").parquet(f"{out}/cubes")
    return spark.read.parquet(f"{out}/cubes")


def main(arguments: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--snapshot", required=True, help="folder with a folder of gzip JSON lines for each entity")
    p.add_argument("--out", required=True, help="folder for documents, ledger, state and cubes")
    p.add_argument("--recent", type=int, nargs=2, required=True, metavar=("FIRST", "LAST"))
    p.add_argument("--entities", nargs="+", default=["sources", "works"])
    p.add_argument("--levels", nargs="+", default=list(cubes.LEVELS), choices=list(cubes.LEVELS))
    p.add_argument("--force", action="store_true", help="build the state anew")
    a = p.parse_args(arguments)
    made = run(session(), a.snapshot.rstrip("/"), a.out.rstrip("/"), tuple(a.recent), a.entities, a.levels, a.force)
    made.groupBy("level", "kind").count().orderBy("level", "kind").show()


if __name__ == "__main__":
    main()
