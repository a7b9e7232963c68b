"""Hand-computed answers for the indicator engine."""

import pytest
from pyspark.sql import functions as F

from citewell.dims import region_for, with_region
from citewell.functions import scalars as S
from citewell.operators import frames, layout, series
from citewell.plans import checks, cubes, indicators, normalise, topics
from citewell.schemas import MissingColumns, require

WORK = "journal_id long, year int, cited_by_count long, fwci double, percentile double, is_oa boolean, oa_status string, language string"


def work(j=1, y=2000, c=0, f=None, p=None, oa="closed", lang="en"):
    return (j, y, c, f, p, oa != "closed", oa, lang)


def test_missing_impact_counts_as_zero_or_is_skipped(spark):
    w = spark.createDataFrame([work(f=2.5), work(f=None), work(f=3.0)], WORK)
    assert indicators.indicator_cube(w, ["journal_id"]).first().fwci_avg == pytest.approx(5.5 / 3)
    assert indicators.indicator_cube(w, ["journal_id"], nulls="skip").first().fwci_avg == pytest.approx(2.75)


def test_shares_and_thresholds(spark):
    w = spark.createDataFrame([work(p=0.9, oa="gold", lang="xx"), work(p=0.99, lang=None), work(p=0.5), work(p=None)], WORK)
    r = indicators.indicator_cube(w, ["journal_id"]).first()
    assert (r.pct_top_10, r.pct_top_1, r.pct_oa_gold, r.pct_oa_total, r.pct_lang_en, r.pct_lang_other) == (50, 25, 25, 25, 50, 50)


def test_null_keys_are_left_out_and_columns_required(spark):
    w = spark.createDataFrame([work(), work(j=None)], WORK)
    assert indicators.indicator_cube(w, ["journal_id"]).count() == 1
    with pytest.raises(MissingColumns):
        require(w, "fwci", "nothing")


def test_mean_of_ratios_is_not_ratio_of_sums(spark):
    w = spark.createDataFrame([work(j=1, p=0.95)] + [work(j=2, p=0.1)] * 9, WORK)
    cube = indicators.indicator_cube(w, ["journal_id"]).withColumn("region", F.lit("r"))
    assert indicators.mean_of_ratios(cube, ["region"], distinct="journal_id").first().pct_top_10 == 50
    assert indicators.indicator_cube(w, []).first().pct_top_10 == 10


def test_weighted_means(spark):
    df = spark.createDataFrame([(1, 10, 1.0), (1, 30, 2.0), (1, 0, None), (2, 0, None)], "k int, num_documents long, x double")
    got = {r.k: r.x for r in indicators.weighted(df, ["k"], ["x"]).collect()}
    assert got == {1: 1.75, 2: 0.0}


def test_dense_years(spark):
    w = spark.createDataFrame([work(y=2000), work(y=2002)], WORK)
    rows = {r.year: r for r in cubes.dense(cubes.annual(w, ["journal_id"]), ["journal_id"], 2000, 2002).collect()}
    assert len(rows) == 3 and rows[2001].num_documents == 0 and rows[2001].pct_oa_gold == 0 and rows[2001].pct_lang_en is None


def test_incremental_equals_full(spark):
    w = spark.createDataFrame([work(j=j) for j in (1, 1, 2, 3)], WORK)
    build = lambda x: indicators.indicator_cube(x, ["journal_id"])
    part = build(w.filter("journal_id = 1"))
    assert sorted(cubes.refreshed(part, w, "journal_id", build).collect()) == sorted(build(w).collect())


def test_all_cubes_equal_their_parts(spark, tmp_path):
    rows = [(*work(j=j, y=y, c=1, p=p, oa="gold"), n) for j, y, p, n in [(1, 2000, 0.95, "x"), (1, 2001, 0.1, "x"), (2, 2001, 0.99, "y"), (3, 2002, 0.2, None), (None, 2002, 0.3, "y")]]
    w = spark.createDataFrame(rows, WORK + ", country_code string")
    path, recent = str(tmp_path / "cubes"), (2001, 2002)
    plain = lambda df: sorted(tuple(map(str, r)) for r in df.collect())

    def agrees(made):
        figures = [c for c in made.columns if c not in ("level", "kind", "entity", "year", "period")]
        for level, key in cubes.LEVELS.items():
            keys, entity = ([key], F.col(key).cast("string")) if key else ([], F.lit("ALL"))
            wanted = {
                "annual": cubes.annual(w, keys).withColumn("period", F.lit(None).cast("string")),
                "period": cubes.period(w, keys, 2000, 2002).withColumn("year", F.lit(None).cast("int")),
                "recent": cubes.period(w, keys, *recent).withColumn("year", F.lit(None).cast("int")),
            }
            for kind, want in wanted.items():
                columns = ["year", "period", *figures]
                assert plain(made.filter(f"level = '{level}' and kind = '{kind}'").select("entity", *columns)) == plain(want.select(entity.alias("entity"), *columns)), (level, kind)

    agrees(cubes.build_cubes(w, path, recent))
    other = str(tmp_path / "more")
    cubes.build_cubes(w.filter("journal_id = 1"), other, recent, levels=["journal", "country"], years=(2000, 2002))
    made = cubes.build_cubes(w, other, recent, incremental=True)
    agrees(made)
    assert cubes.build_cubes(w, other, recent, incremental=True).count() == made.count()


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda df: series.smoothed(df, ["id"], ["v"], 3), [1.0, 2.5, 5.344707, 6.456701, 3.88259]),
        (lambda df: series.smoothed(df, ["id"], ["v"], 5), [1.357609, 3.509856, 4.709603, 6.456701, 3.89316]),
        (lambda df: series.centred_mean(df, ["id"], ["v"], 3), [1.0, 2.5, 6.5, 5.0, 5.5]),
        (lambda df: series.trailing_mean(df, ["id"], ["v"], 3), [1.0, 1.0, 2.5, 6.5, 5.0]),
    ],
)
def test_smoothing(spark, make, want):
    df = spark.createDataFrame([("a", 2000 + i, v) for i, v in enumerate([1.0, None, 4.0, 9.0, 2.0])], "id string, year int, v double")
    assert [r.v for r in make(df).orderBy("year").collect()] == pytest.approx(want, abs=1e-6)


def test_rollup_and_levels(spark):
    rows = [("a", "x", "p")] + [("a", "x", "q")] * 2 + [("a", "y", "r")] * 3 + [("b", "z", "s")] * 4
    df = spark.createDataFrame(rows, "domain string, field string, subfield string").withColumn("k", F.lit("k"))
    got = {(r.domain, r.field, r.subfield): (r.level, r.num_documents) for r in topics.rollup_levels(df, ["k"]).collect()}
    assert len(got) == 10 and got["ALL", "ALL", "ALL"] == ("total", 10) and got["a", "ALL", "ALL"] == ("domain", 6) and got["a", "x", "ALL"] == ("field", 3)


def test_share_normalisation(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 0.2), (2, 0.6)], "id int, share double")
    assert sorted((r.id, round(r.share, 9)) for r in topics.normalised_shares(df, ["id"]).collect()) == [(1, 0.5), (1, 0.5), (2, 0.25), (2, 0.75)]


def test_max_normalisation(spark):
    df = spark.createDataFrame([(2.0, 0.0), (4.0, 0.0), (1.0, 0.0)], "a double, b double")
    assert [tuple(r) for r in series.max_normalised(df, ["a", "b"]).collect()] == [(0.5, 0.0), (1.0, 0.0), (0.25, 0.0)]


def test_index_and_abstract_without_a_shuffle(spark, tmp_path):
    from citewell.plans import catalogue

    texts = ["b a b", "", " ", "a  a ", None, "x", "other words", "\U0001f600 é a\u00a0b \U0001f600"]
    spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["ar02_abstract"](spark, str(tmp_path))
    # two rows of one id stay two texts
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted((i // 2, t) for i, t in enumerate(texts) if t is not None)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    index = spark.createDataFrame([("b a b",), ("",)], "t string").select(S.inverted_index(F.col("t")).alias("i")).collect()
    assert [r.i for r in index] == [{"a": [1], "b": [0, 2]}, {"": [0]}]


def test_abstract_keeps_gaps(spark):
    df = spark.sql("SELECT map('the', array(0, 3), 'cat', array(1)) AS i UNION ALL SELECT map()")
    assert [r[0] for r in df.select(S.abstract_text(F.col("i"))).collect()] == ["the cat  the", ""]


def test_regions(spark):
    want = {"BR": "Latinoamérica y Caribe", "HK": "China", "GB": "Norteamérica Anglosajona", "ES": "Europa Central/Occidental", "HT": "Other", None: "Other"}
    df = spark.createDataFrame([(c,) for c in want], "country_code string")
    assert {r.country_code: r.region for r in with_region(df).collect()} == want
    assert all(region_for(c) == r for c, r in want.items())


def test_hexagons_and_rounding(spark):
    one = spark.range(1)
    for kind, want in (("pointy", (4.330127, 1.5)), ("flat", (3.0, 1.732051))):
        assert tuple(one.select(*S.hex_center(F.lit(1), F.lit(2), 1.0, kind)).first()) == pytest.approx(want, abs=1e-6)
    assert tuple(one.select(S.rounded(F.lit(0.125), 2), S.rounded(F.lit(0.125), 2, "half_even")).first()) == (0.13, 0.12)
    corners = one.select(S.hex_corners(F.lit(0.0), F.lit(0.0)).alias("c")).first().c
    assert len(corners) == 7 and (corners[0].x, corners[0].y) == pytest.approx((corners[6].x, corners[6].y))


def test_nested_tables(spark):
    raw = spark.createDataFrame(
        [('{"id":"1","authorships":[{"author":{"id":"a"},"institutions":[]},{"author":{"id":"b"},"institutions":[{"id":"i1"},{"id":"i2"}]}],"topics":[{"id":"1"},{"id":"2"},{"id":"3"},{"id":"4"},{"id":"5"}]}',), ('{"id":"2","topics":[]}',)],
        "raw_data string",
    )
    w = normalise.parsed(raw)
    assert sorted((r.author_id, r.institution_id or "") for r in normalise.authorship_rows(w).collect()) == [("a", ""), ("b", "i1"), ("b", "i2")]
    assert [r.topic_id for r in normalise.topic_rows(w).collect()] == ["1", "2", "3"]


def test_standardisation_uses_the_population(spark):
    df = spark.createDataFrame([(1.0, 5.0), (4.0, 5.0), (9.0, 5.0), (2.0, 5.0)], "a double, b double")
    rows = layout.standardised(df, ["a", "b"]).collect()
    assert rows[0].a == pytest.approx((1 - 4) / 3.0822, abs=1e-4) and all(r.b == 0 for r in rows)


def test_frames(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("a", 2, 5)], "r string, c int, v long")
    assert sorted(map(tuple, frames.pivot_sum(df, "r", "c", [1, 2], "v").collect())) == [("a", 2, 5, 7), ("b", 3, 0, 3)]
    assert frames.sample_rows(df, 2, ["r", "c"]).collect() == frames.sample_rows(df, 2, ["r", "c"]).collect()
    assert checks.zero_share(df.withColumn("z", F.lit(0)), "z").first().pct_zero == 100
    assert [r.c for r in frames.latest_year(df, "c").collect()] == [2]


def test_latest_keeps_rows_without_an_order(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 5, "b"), (2, None, "c"), (2, 4, "d"), (None, 1, "e")], "k int, year int, v string")
    got = sorted(map(tuple, series.latest(df, ["k"]).collect()), key=str)
    assert got == sorted([(1, None, "a"), (2, 5, "b"), (None, 1, "e")], key=str)


def test_table_functions(spark):
    from citewell.functions import table_functions

    table_functions.register(spark)
    rows = [(1, [("t1", 0.5, ("f", [1])), None, ("t3", None, None)]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id int, topics array<struct<name: string, share: double, field: struct<a: string, b: array<int>>>>")
    got = spark.sql("SELECT d.id, n.* FROM {d} d, LATERAL nested_rows(d.topics) n", d=df).collect()
    want = df.select("id", F.posexplode("topics").alias("position", "t")).select("id", "position", "t.*").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 3
    assert spark.sql("SELECT * FROM {d} d, LATERAL nested_rows(d.topics, 1) n", d=df).count() == 1
    with pytest.raises(Exception, match="array of structs"):
        spark.sql("SELECT * FROM nested_rows(array(1, 2))").collect()
    spark.createDataFrame([("a", 3, None), ("a", 1, "x"), ("a", 2, "y"), (None, 1, "z")], "k string, n int, v string").createOrReplaceTempView("citewell_rows")
    first = spark.sql("SELECT * FROM first_rows(TABLE(citewell_rows), 2, 'k', 'n')").collect()
    assert sorted(map(tuple, first), key=str) == sorted([("a", 1, "x", 1), ("a", 2, "y", 2), (None, 1, "z", 1)], key=str)
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM first_rows(TABLE(citewell_rows), 2, 'k', 'nothing')").collect()


def test_nested_parts(spark):
    import json

    from citewell.operators import frames

    rows = [("hot", i % 40, None if i % 7 == 0 else f"v{i}") for i in range(90)] + [("b", 1, "x"), (None, 2, None)]
    made = frames.nested_parts(spark.createDataFrame(rows, "k string, n int, v string"), "k", ["n", "v"], each=25).collect()
    whole = {}
    for r in sorted(made, key=lambda r: (str(r.k), r.part)):
        items = json.loads(r["items"])
        assert 0 < len(items) <= 25
        whole.setdefault(r.k, []).extend((i["n"], i.get("v")) for i in items)
    assert len(made) == 6 and {k: len(v) for k, v in whole.items()} == {"hot": 90, "b": 1, None: 1}
    assert whole["hot"] == sorted(((n, v) for k, n, v in rows if k == "hot"), key=lambda x: (x[0], x[1] is not None, x[1] or ""))


def test_first_rows_by_batches(spark):
    from citewell.functions import table_functions

    table_functions.register(spark)
    rows = [(i % 3000 if i % 7 else None, 2, i, f"t{i}") for i in range(20_000)] + [(-1, 2, i, "much") for i in range(25_000)]
    df = spark.createDataFrame(rows, "k long, place_of int, n long, t string")
    df.createOrReplaceTempView("citewell_many")
    got = spark.sql("SELECT * FROM first_rows(TABLE(citewell_many), 3, 'k', 'n')")
    want = {}
    for k, _, n, t in sorted(rows, key=lambda r: r[2]):
        want.setdefault(k, []).append((n, t))
    assert sorted((str(r.k), r.place, r.n, r.t) for r in got.collect()) == sorted((str(k), i + 1, *x) for k, v in want.items() for i, x in enumerate(v[:3]))
    # no Arrow batch for each call
    assert "ArrowEvalPythonUDTF" not in got._jdf.queryExecution().executedPlan().toString()
