"""The pipeline against brute force, stage by stage, on the smallest tables."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from citewell.llm import language_id, quality_model
from citewell.llm.common import table

SF = "/root/testdata/sf0.001"


def grams(text):
    w = [x for x in text.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = language_id.fit(language_id.learnable(docs))
    rows = model.rows()
    left = {r.doc_id: r.text or "" for r in docs.collect() if not model.predict(r.text, rows)[2]}

    quality = quality_model.fit(docs.filter(docs.doc_id.isin(list(left))))
    rows = quality.rows()
    left = {i: t for i, t in left.items() if quality.score(t, rows) >= quality.least_score}

    first = {}
    for i in sorted(left):
        first.setdefault(" ".join(("x" + left[i] + "x").translate(str.maketrans("\t\n\v\f\r", "     ")).split()), i)
    left = {i: left[i] for i in first.values()}

    sets, root = {i: grams(t) for i, t in left.items()}, {i: i for i in left}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(left)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            x, y = sets[i], sets[j]
            if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    left = {i: t for i, t in left.items() if top(i) == i}

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_null_ids_stay(spark):
    from citewell.llm import exact_dedup, ngram_join

    rows = [(1, "a b"), (None, "a  b"), (None, "only here"), (None, "only  here"), (None, "another text"), (2, "c"), (3, "c"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    left = [r for r in rows if r not in [(None, "a  b"), (3, "c")]]
    assert plain(exact_dedup.keep_first_copies(docs)) == sorted(left, key=repr)
    assert len(left) == exact_dedup.exact_dedup(docs).filter("kept").count()
    assert plain(ngram_join.keep_one_per_class(docs)) == sorted([r for r in rows if r != (3, "c")], key=repr)


def test_nothing_labelled(spark, tmp_path):
    docs = table(spark, SF, "documents")
    unlabelled = docs.limit(5).withColumn("lang", language_id.F.lit(None).cast("string"))
    for name, df, n in (("empty", docs.limit(0), 0), ("unlabelled", unlabelled, 5)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = language_id.op6_language_id(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == n and all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for r in got)
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null texts and ids, repeated rows, a very long text, and columns with names that stages use themselves."""
    docs = table(spark, SF, "documents")
    null = lambda c: language_id.F.lit(None).cast(docs.schema[c].dataType)
    few = docs.orderBy("doc_id").limit(4)
    long = few.limit(1).withColumn("doc_id", language_id.F.lit(-7).cast(docs.schema["doc_id"].dataType)).withColumn("text", language_id.F.repeat("text", 300))
    odd = docs.union(few).union(few.withColumn("text", null("text"))).union(few.withColumn("doc_id", null("doc_id"))).union(long)
    odd = odd.withColumns({c: language_id.F.lit("x") for c in ("_p", "_s", "h", "id", "row", "group", "keep_id", "rep", "start", "length", "sequence_id")})
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    odd = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, odd, str(tmp_path))
        assert left.columns == odd.columns and left.exceptAll(odd).count() == 0
    total = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        total.setdefault((r.doc_id, r.doc_tokens), []).append(r.length)
    assert total and all(sum(x) % tokens == 0 for (_, tokens), x in total.items())
