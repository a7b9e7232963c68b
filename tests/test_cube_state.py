"""A refreshed state against one built anew, and sketches against exact figures."""

import random
import re
from datetime import datetime, timedelta

import pytest
from citewell.plans import cubes
from citewell.plans.cube_state import CubeState

RECENT = (2001, 2002)
SCHEMA = "work_id long, updated timestamp, journal_id long, country_code string, year int, cited_by_count long, fwci double, percentile double, is_oa boolean, oa_status string, language string, author string"


def some_works(seed, n=160):
    r = random.Random(seed)
    journal = lambda: r.choice([1, 1, 1, 2, 3, 4, None])
    rows = []
    for i in range(n):
        j = journal()
        rows.append((i, datetime(2024, 1, 1) + timedelta(days=r.randrange(90)), j, None if j == 4 else f"C{(j or 0) % 2}", r.choice([2000, 2001, 2002, None]), r.randrange(9), r.choice([None, r.random() * 3, 0.1]), r.choice([None, r.random()]), r.random() < 0.5, r.choice(["gold", "closed", None]), r.choice(["en", "xx", None]), f"a{r.randrange(40)}"))
    return rows


def plain(df):
    return sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("nulls", ["zero", "skip"])
def test_refresh_equals_a_full_build(spark, tmp_path, nulls):
    before = some_works(1)
    day = datetime(2024, 6, 1)
    after = [w for w in before if w[0] % 9 and w[2] != 3]  # removed: single works, and a journal with all of them
    after = [(*w[:1], day, *w[2:5], w[5] + 100, *w[6:]) if w[0] % 7 == 1 and w[2] == 1 else w for w in after]  # changed
    after = [(*w[:1], day, 4, None, *w[4:]) if w[0] == 11 else w for w in after]  # moved to another journal
    after += [(1000 + i, day, 77, "C1", 2002, 5, 1.0, 0.95, True, "gold", "en", "a1") for i in range(3)]  # a new journal
    frames = [spark.createDataFrame(x, SCHEMA).repartition(3) for x in (before, after)]
    state = CubeState(str(tmp_path / "state"), nulls)
    state.build(frames[0])
    want = lambda w: cubes.level_cubes(w, tuple(cubes.LEVELS), (2000, 2002), RECENT, nulls=nulls)
    assert plain(state.cubes(spark, RECENT)) == plain(want(frames[0]))
    changed = {r.journal_id: r.gone for r in state.refresh(frames[1]).collect()}
    assert changed[3] is True and changed[77] is False and {1, 4, 77, 3} <= set(changed)
    assert plain(state.cubes(spark, RECENT)) == plain(want(frames[1]))
    assert state.refresh(frames[1]).collect() == [] and len(state._versions(spark)) == 2


def test_only_changed_journals_are_read(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1), i % 40, "C", 2001, 1, 1.0, 0.5, True, "gold", "en", "a") for i in range(400)]
    path = str(tmp_path / "works")
    spark.createDataFrame(rows, SCHEMA).repartition("journal_id").write.partitionBy("journal_id").parquet(path)
    works = spark.read.parquet(path)
    state = CubeState(str(tmp_path / "state"))
    state.build(works)
    spark.createDataFrame([(999, datetime(2024, 2, 1), 7, "C", 2001, 1, 1.0, 0.5, True, "gold", "en", "a")], SCHEMA).write.partitionBy("journal_id").mode("append").parquet(path)
    seen = []
    whole = CubeState.rows
    try:
        CubeState.rows = lambda self, w: seen.append(w._jdf.queryExecution().executedPlan().toString()) or whole(self, w)
        assert [r.journal_id for r in state.refresh(spark.read.parquet(path)).collect()] == [7]
    finally:
        CubeState.rows = whole
    assert re.search(r"PartitionFilters: \[[^]]*journal_id#\d+L? (= 7|IN \(7\))", seen[0])  # other partitions aren't read
    assert {r.journal_id: r.num_documents for r in state.load(spark).collect()} == {i: 11 if i == 7 else 10 for i in range(40)}


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    works = spark.createDataFrame(some_works(2, 60), SCHEMA)
    state = CubeState(str(tmp_path / "state"))
    with pytest.raises(FileNotFoundError):
        state.load(spark)
    state.refresh(works)
    before = plain(state.load(spark))
    state.rows(works.limit(3)).write.parquet(f"{state.path}/v=2/state")  # prints are missing
    assert plain(state.load(spark)) == before
    state.refresh(works.filter("work_id % 2 = 0"))
    assert state._versions(spark) == [1, 2] and plain(state.cubes(spark, RECENT)) == plain(cubes.level_cubes(works.filter("work_id % 2 = 0"), tuple(cubes.LEVELS), cubes.year_range(state.load(spark)), RECENT))


def test_sketches_are_near_the_exact_figures(spark, tmp_path):
    """Distinct counts within three standard errors (1.04 / 64), quantiles within 3 % of rank, from states merged up to the world."""
    r = random.Random(5)
    rows = [(i, datetime(2024, 1, 1), i % 20, f"C{i % 3}", 2001, 1, r.gauss(10, 3), 0.5, True, "gold", "en", f"a{r.randrange(9000)}") for i in range(12_000)]
    works = spark.createDataFrame(rows, SCHEMA)
    state = CubeState(str(tmp_path / "state"), distinct=["author"], quantiles=["fwci"])
    state.build(works)
    got = {(x.level, x.entity): x for x in state.cubes(spark, RECENT).filter("kind = 'period'").collect()}
    for level, entity, pick in (("world", "ALL", lambda w: True), ("country", "C1", lambda w: w[3] == "C1"), ("journal", "7", lambda w: w[2] == 7)):
        own = [w for w in rows if pick(w)]
        x, exact = got[level, entity], len({w[-1] for w in own})
        assert abs(x.distinct_author - exact) <= 3 * 1.04 / 64 * exact + 1
        values = sorted(w[6] for w in own)
        for p, q in zip((0.25, 0.5, 0.75), x.fwci_quantiles, strict=True):
            assert abs(sum(v <= q for v in values) / len(values) - p) <= 0.03
