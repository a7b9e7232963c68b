"""Exact copies, quality rules, packing, languages, quality model, pages and pieces on small tables."""

import time
import functools
import math
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewell.llm import exact_dedup, hashed, html_text, language_id, ngram_join, packing, quality_model, quality_rules, sentence_pieces

DOC = "doc_id long, text string"
ODD = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, " a\tb\n"), (6, "a\x0bb"), (7, " a b "), (2, "a b"), (9, "x" * 50_000)]


def docs(spark, rows=ODD):
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({"keep_id": F.lit(-1), "digest": F.lit("d"), "kept": F.lit("k"), "salt": F.lit(0), "_w": F.lit(1), "content": F.lit("c")})


def by_text(rows):
    groups = {}
    for i, t in rows:
        out, gap = [], False
        for c in t or "":
            blank = c in " \t\n\x0b\f\r"
            if blank and not gap:
                out.append(" ")
            elif not blank:
                out.append(c)
            gap = blank
        groups.setdefault("".join(out), []).append(i)
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_copies(spark, weak):
    digest = (lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)) if weak else exact_dedup.sha256_hex
    rows = ODD + [(100 + i, f"t{i % 40}") for i in range(120)]
    got = exact_dedup.exact_dedup(docs(spark, rows), digest=digest, salts=3).collect()
    want = by_text(rows)
    assert len(got) == len(rows)
    assert all((r.keep_id, r.group_size) == want[r.doc_id] and r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(docs(spark, []), digest=digest).count() == 0


def test_first_copies_stay_with_all_columns(spark):
    rows = [r for r in ODD if r != (2, "a b")] + [(2, "a b")]
    df = docs(spark, rows)
    left = exact_dedup.keep_first_copies(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted({v[0] for v in by_text(rows).values()})


def repeats(text):
    w = [x for x in quality_words(text)]
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)})


def quality_words(text):
    return (text or "").encode().split()


def test_quality_counts(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcd#") for _ in range(r.randrange(90)))) for i in range(60)] + [(100, None), (101, ""), (102, "x\n\nx\ny y\ny y\n"), (103, "a a a a a")]
    got = quality_rules.quality_rules(docs(spark, rows)).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for x in got:
        text = texts[x.doc_id] or ""
        lines = [y for y in text.split("\n") if y.strip(" \t\x0b\f\r")]
        words = quality_words(text)
        assert (x.n_words, x.n_dup_lines, x.n_repeat_words) == (len(words), len(lines) - len(set(lines)), repeats(text)), text
        assert x.n_symbols == sum(c in "#*$%&|<>" for c in text) and x.word_chars == sum(len(w.decode()) for w in words)
        assert x.base_failed == (len(words) < 50 or 100 * repeats(text) > 50 * len(words))
    assert quality_rules.quality_rules(docs(spark, [])).count() == 0


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_first_fit_equals_the_plain_rule(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, want = [], []
    for n in lengths:
        at = next((i for i, used in enumerate(bins) if used + n <= 64), len(bins))
        if at == len(bins):
            bins.append(0)
        want.append((at, bins[at]))
        bins[at] += n
    assert packing.first_fit(lengths, 64) == want


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, plain = packing.Encoder(path, 50), Tokenizer.from_file(path)
    odd = ["", " ", "a  b", "a \n b", " x", "x ", "  \t\n x", "don't  stop's it's", "é   x 12 3½²", "a <|endoftext|> b", "\x1c a \x1c\x1d b", "a  b", "日本 語 ☃ \U0001f600 x", "ﬁ'S 'sé x_y"]
    for text in odd:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


ODD_CHARACTERS = "ab Zé\u00d7\u00aa\u024f\u0250ﬁ'sdtlvrem09½²_-!.<|> \t\n\r\x0b\x1c\u0085\u00a0\u3000\u200b日☃\U0001f600\u0301"


@given(st.lists(st.one_of(st.text(alphabet=ODD_CHARACTERS, max_size=12), st.text(max_size=8), st.sampled_from(["don't", "  ", " 's", "<|endoftext|>"])), max_size=12))
@settings(max_examples=400, deadline=None)
def test_ids_of_any_text_equal_the_tokenizer(parts):
    encode, plain = encoders()
    for text in ("".join(parts), " ".join(parts)):
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@functools.cache
def encoders():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.Encoder(path, 200), Tokenizer.from_file(path)


def test_packing_keeps_every_id_once(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, "word " * (i * 37 % 700)) for i in range(40)] + [(99, None), (98, "z" * 9000)]
    got = packing.pack_documents(docs(spark, rows), path, pieces_per_group=12).collect()
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert {i: sum(p.length for p in ps) for i, ps in pieces.items()} == {i: len(x) for i, x in ids.items()}
    for filled in bins.values():
        at = 0
        for offset, length in sorted(filled):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_languages_on_held_out_rows(spark):
    rows = language_id.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    model = language_id.train(["the cat and the dog"] * 5 + ["der Hund und die Katze"] * 5, ["en"] * 5 + ["de"] * 5)
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the dog"), (5, "und die"), (4, "the dog")]
    got = sorted((r.doc_id, r.lang_pred, r.rejected) for r in language_id.identify(docs(spark, rows), model).collect())
    assert [x[:2] for x in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")] and all(x[2] for x in got[:3])
    kept = language_id.keep_identified(docs(spark, rows), model)
    assert kept.columns == docs(spark).columns and set(r.doc_id for r in kept.collect()) <= {4, 5}
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame([], DOC + ", lang string"))


FOREIGN = {
    "ru": "Съешь же ещё этих мягких французских булок да выпей чаю. Это предложение написано по-русски.",
    "zh": "这是一个用中文写的句子 没有别的意思",
    "fi": "Tämä on suomenkielinen lause jossa on paljon pitkiä sanoja ja outoja kirjaimia",
    "it": "Questa è una frase scritta in italiano per vedere se viene riconosciuta come lingua straniera",
    "nl": "Dit is een zin die in het Nederlands is geschreven om te zien of deze wordt herkend",
    "letters": "xqzvk wjfpq zzkxv qjwhg vbnxk qpwzj kkzxq",
}


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(language_id.learnable(docs))
    rows = model.rows()
    assert {k for k, text in FOREIGN.items() if not model.predict(text, rows)[2]} == set()
    held = [r for r in docs.filter("crc32(cast(doc_id as string)) % 3 = 1").collect() if r.text and language_id.words_of(r.text)]
    assert sum(model.predict(r.text, rows)[2] for r in held) <= 0.02 * len(held)
    other = language_id.fit(language_id.learnable(docs.filter("lang != 'fr'")))
    rows = other.rows()
    french = [r.text for r in held if r.lang == "fr"]
    assert len(french) > 20 and sum(other.predict(t, rows)[2] for t in french) > 0.9 * len(french)


def test_weak_labels_find_the_faulty(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality_model.op9_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) > 0.9 * len(bad)


def test_estimates_recover_accuracies():
    rng = np.random.Generator(np.random.PCG64(2))
    counts = {}
    for _ in range(20_000):
        fault = rng.integers(0, 3) if rng.random() < 0.2 else -1
        p = "".join(str(quality_model.BAD if (rng.random() < 0.9) == (k == fault) and (k == fault or rng.random() < 0.1) else quality_model.GOOD) for k in range(6))
        counts[p] = counts.get(p, 0) + 1
    prior, likely, posterior = quality_model.estimate(counts)
    assert prior.sum() == pytest.approx(1, abs=1e-3) and posterior["111111"] > 0.9
    assert quality_model.estimate({})[2] == {}


def test_scores_equal_a_plain_reading(spark):
    """Votes and scores of the quality model, and predictions of the language model, word by word."""
    texts = ["The cat, sat on THE mat.\nThe cat, sat on the mat.\n\nx1 Été?", "spam spam spam $$$ |||" * 5, "ok " * 30, "Ähnlich  wie McDonald's 2nd\tplace!!"]
    rng = np.random.Generator(np.random.PCG64(3))
    model = quality_model.QualityModel(rng.normal(size=1 << 10).astype(np.float32), 0.3, np.array([0.6]), None, {})
    expressions = [(r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"[a-zß-öø-ÿ]+", "a"), (r"[0-9]+", "0")]

    def features(word):
        form = word
        for pattern, sign in expressions:
            form = re.sub(pattern, sign, form)
        return [zlib.crc32(("s" + form[:12]).encode()) % 1024, zlib.crc32(("w" + word.strip(".,;:!?").lower()[:24]).encode()) % 1024]

    got = {r.doc_id: r.score for r in quality_model.classify(docs(spark, list(enumerate(texts))), model).collect()}
    for i, text in enumerate(texts):
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        z = 0.3 + np.mean([model.weights[f] for w in words for f in features(w)])
        shares = {f"r{k}": sum(a == b for a, b in zip(words, words[k:])) / len(words) for k in (1, 2, 3)}
        shares["l"] = len(set(lines)) / len(lines) if len(lines) >= 3 else 2
        z += sum(model.weights[zlib.crc32(f"{k}:{int(10 * v)}".encode()) % 1024] for k, v in shares.items())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-5)

    lang = language_id.train(["the cat and the dog"] * 5 + ["der Hund und die Katze"] * 5, ["en"] * 5 + ["de"] * 5, buckets=1 << 10)
    for text in ("The dog, und 12 cats", "Katze"):
        grams = [g for w in re.findall(r"[^\W\d_]+", text.lower()) for g in {f"<{w}>", *(f"<{w}>"[i : i + n] for n in (2, 3) for i in range(len(w) + 3 - n))}]
        z = (np.mean([lang.logits[zlib.crc32(g.encode()) % 1024] for g in grams], axis=0, dtype=float) + lang.bias) / lang.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert lang.predict(text, lang.rows())[:2] == (lang.labels[int(p.argmax())], pytest.approx(p.max(), rel=1e-4))


def test_samples_are_bounded_and_the_same_on_every_partitioning(spark):
    rows = [(i, "word " * (i % 50 + 1), "en" if i % 3 else "de") for i in range(3000)] + [(7, "same", "fr")] * 500 + [(None, "no id", "fr")]
    df = spark.createDataFrame(rows, DOC + ", lang string")
    marks = lambda d: d.select(F.col("lang").alias("by"), hashed.content_hash(F.col("doc_id"), F.col("text")).alias("h"), F.length("text").alias("chars"))
    chosen = [sorted(map(tuple, hashed.hash_sample(marks(d), 40, 10_000, 10**6).collect())) for d in (df, df.repartition(7))]
    assert chosen[0] == chosen[1] and {x: sum(b == x for b, _ in chosen[0]) for x in ("en", "de", "fr")} == {"en": 40, "de": 40, "fr": 2}
    assert len(hashed.hash_sample(marks(df), 40, 30, 10**6).collect()) == 22 and len(hashed.hash_sample(marks(df), 40, 10_000, 3).collect()) == 3


@pytest.mark.parametrize("stage", ["language", "quality"])
def test_filters_keep_columns_that_clash(spark, stage):
    rows = [(1, "the cat and the dog " * 9), (None, "the cat and the dog " * 9), (None, None), (1, "the cat and the dog " * 9), (4, "")]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(c) for c in ("_p", "_s", "id", "p", "score", "h")})
    if stage == "language":
        model = language_id.train(["the cat and the dog"] * 5 + ["der Hund und die Katze"] * 5, ["en"] * 5 + ["de"] * 5)
        kept = language_id.keep_identified(df, model)
        assert language_id.identify(df, model).count() == 5
    else:
        model = quality_model.fit(df)
        kept = quality_model.keep_good(df, model)
        assert quality_model.classify(df, model).count() == 5
    got = kept.collect()
    assert kept.columns == df.columns and all(r["_p"] == "_p" and r["_s"] == "_s" for r in got) and sum(r.text == rows[0][1] for r in got) == 3


def test_quality_cases(spark):
    df = docs(spark, [(1, None), (2, ""), (3, "one"), (3, "one")])
    model = quality_model.fit(df)
    assert quality_model.classify(df, model).count() == 4
    assert quality_model.classify(docs(spark, []), model).count() == 0
    assert quality_model.fit(docs(spark, [])).posterior == {}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><!-- a <p>comment</p> -->
<div class="cookie-notice">We use cookies on this site, and more than a few.</div>
<article><header><h1>Head &amp; line</h1></header><p>First  <b>bold</b>\npart&nbsp;here.<br>Same block<p>Second &lt;b&gt; block
<div class="ad">Buy now, a long advertisement that has many words in it</div><aside>Aside</aside>
<form><label>Mail</label><input><button>Go</button></form><p>Th&eacute; end.</p><section id="comments"><p>First reader says something long enough to be text.</p></section></article>
<div class="sidebar"><p>Popular</p></div><footer>&copy; x</footer></body></html>"""


def test_main_text():
    tree = html_text.grow(*html_text.labelled_table())
    want = "Head & line\n\nFirst bold part here. Same block\n\nSecond <b> block\n\nThé end."
    assert html_text.main_text(PAGE, tree) == want
    bare = "<div><a href=1>One</a> <a href=2>Two</a></div><div>" + "Plain words of a page without an article. " * 5 + "</div><div class=footer>Foot words " * 3
    assert html_text.main_text(bare, tree).startswith("Plain words") and "Foot" not in html_text.main_text(bare, tree)
    marked = '<div class="siteHeader">Name of the site and a claim</div><div id="mainText">' + "Words of the text that count here. " * 9 + '</div><div class="userComments">A reader says this and that, at some length.</div>'
    assert html_text.main_text(marked, tree) == ("Words of the text that count here. " * 9).strip()
    for odd in (None, "", "<", "<p", "<!-- open", "<script>open", "a < b & c", "<p title='x>y'>t"):
        assert isinstance(html_text.main_text(odd, tree), str)


def test_names_of_wrappers_and_contents_of_the_article_count_for_nothing():
    tree = html_text.grow(*html_text.labelled_table())
    article = "<nav><a href=1>A</a></nav><article><h1>Title of it</h1>" + "".join(f"<p>{'Some words in a sentence. ' * n}</p>" for n in (9, 1, 14))
    article += "<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be given and <object>shown</object>.</p></article><footer>foot of page</footer>"
    want = html_text.main_text(f"<body>{article}</body>", tree)
    assert want.startswith("Title of it") and want.endswith("Let x=1 be given and shown.")
    for name in ("right-sidebar", "home page no-sidebar", "single comments-open", "modal"):
        assert html_text.main_text(f'<body class="{name}"><div id="page" class="{name}">{article}</div></body>', tree) == want


def test_teaser_article_beside_the_text():
    tree = html_text.grow(*html_text.labelled_table())
    text = ["Head of the page", *("Words of the text that runs on for a while here. " * n for n in (4, 2, 6))]
    page = "<h1>" + "</p><p>".join(text).replace("</p>", "</h1>", 1) + "</p><article><h3><a href=1>Another story to read</a></h3></article><footer>foot</footer>"
    assert html_text.main_text(page, tree) == "\n\n".join(x.strip() for x in text)


class PlainPage(HTMLParser):
    """Blocks by the standard library's parser: words, linked words, kind, marked, in an article."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.blocks, self.open, self.text, self.linked, self.link = [], [], "", "", False
        self.feed(html)
        self.close()
        self.cut()

    def cut(self):
        words = self.text.split()
        names = [n for n, _ in self.open]
        if words and "head" not in names:
            kind = names[-1] if names else ""
            marked = any(c == "ad" or n in ("nav", "footer") for n, c in self.open)
            self.blocks.append((len(words), len(self.linked.split()) / len(words), kind, marked, "article" in names, " ".join(words)))
        self.text = self.linked = ""
        self.link = False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        elif tag == "br":
            self.text += " "
        elif tag in html_text._BLOCKS or tag in ("script", "style", "title"):
            self.cut()
            if self.open and self.open[-1][0] in ("p", tag if tag == "li" else "p"):
                self.open.pop()
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        elif tag in [n for n, _ in self.open]:
            self.cut()
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.text += data
        self.linked += data + " " if self.link else ""


def plain_main_text(html, tree):
    b = PlainPage(html).blocks
    plain = [n if links < 0.34 and not marked else 0 for n, links, _, marked, _, _ in b]
    share = sum(n for n, x in zip(plain, b) if x[4]) / max(1, sum(plain))
    kept = []
    for i, (n, links, kind, marked, inside, text) in enumerate(b):
        row = {"words": n, "links": links, "paragraph": kind == "p", "heading": kind == "h1", "item": kind == "li", "marked": marked}
        row["words_before"], row["links_before"] = b[i - 1][:2] if i else (0, 0)
        row["words_after"], row["links_after"] = b[i + 1][:2] if i + 1 < len(b) else (0, 0)
        row["plain_nearby"] = max([0, *(plain[j] for j in range(len(b)) if j != i and abs(i - j) <= 3)])
        row["place"] = (1 if inside else -1) if share >= 0.4 else 0
        node = tree
        while node.feature >= 0:
            node = node.right if row[html_text.FEATURES[node.feature]] > node.bound else node.left
        kept += [text] * (node.share >= 0.5)
    return "\n\n".join(kept)


def test_equals_a_plain_reading_of_the_pages(spark):
    tree = html_text.grow(*html_text.labelled_table())
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_text.op5_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages) and all(got[r.page_id] == plain_main_text(r.html or "", tree) for r in pages)


@pytest.mark.parametrize("div", [False, True])
def test_without_names_and_without_sectioning_tags(spark, div):
    """The truth is what lies in the article; words, links and neighbours have to find it."""
    tree = html_text.grow(*html_text.labelled_table())
    wrong = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        html = re.sub(r'\s(class|id|role)="[^"]*"', "", r.html or "")
        if div:
            html = re.sub(r"<(/?)(nav|aside|header|footer|form|article|main)\b", r"<\1div", html)
        truth = [bool(b.articles) for b in html_text.page_of(r.html or "").blocks]
        got = [html_text.is_main(tree, row) for row in html_text.rows_of(html_text.page_of(html))]
        total += len(truth)
        wrong += sum(a != b for a, b in zip(truth, got, strict=True))
    assert wrong <= 0.03 * total


def test_page_cases(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "v", PAGE), (2, "v", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract_text(df).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [0, len(got[1].text), len(got[1].text)] and html_text.extract_text(df.limit(0)).count() == 0


def best_score(word, pieces):
    best = [0.0] + [-1e300] * len(word)
    for j in range(1, len(word) + 1):
        best[j] = best[j - 1] + pieces.below
        for i in range(j):
            if word[i:j] in pieces.ids:
                best[j] = max(best[j], best[i] + pieces.ids[word[i:j]][1])
    return best[-1]


@given(st.lists(st.text(alphabet="▁abct hé☃", max_size=12), max_size=30))
@settings(max_examples=60, deadline=None)
def test_shared_prefixes_find_the_best_segmentation(words):
    toy = sentence_pieces.Pieces({p: (i, -0.37 * i - 0.1) for i, p in enumerate("▁ a b c t h ▁a ab at the ▁th ca abc ▁▁".split())}, [], 99, ["x"] * 100, {})
    found = sentence_pieces.segment([w for w in words if w], toy)
    score = {i: s for i, s in toy.ids.values()}
    for w, ids in found.items():
        assert sum(score.get(i, toy.below) for i in ids) == pytest.approx(best_score(w, toy))


def test_pieces_decode_to_the_text(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    public, pieces = SentencePieceProcessor(model_file=path), sentence_pieces.load(path)
    rows = [(1, None), (2, ""), (3, " "), (4, "a  b"), (5, "Ünï ☃\U0001f600\n\tx "), (6, "hello hello help"), (6, "hello hello help")]
    encoded = sentence_pieces.encode(docs(spark, rows), path, batch_chars=8)
    for r in encoded.collect():
        assert public.decode(list(r.ids)) == (dict(rows)[r.doc_id] or "") == sentence_pieces.decode(r.ids, pieces)
    assert sorted((r.doc_id, r.text) for r in sentence_pieces.decoded(encoded, path).collect()) == sorted((i, t or "") for i, t in rows)
    assert all(r.exact for r in sentence_pieces.round_trip(docs(spark, rows), path).collect())
    assert sentence_pieces.encode(docs(spark, []), path).count() == 0
    assert isinstance(encoded.schema["ids"].dataType, T.ArrayType)


def test_attributes_are_whole_names():
    """A word in another attribute's value or name says nothing, and an id inside an article may be a chapter's."""
    tree = html_text.grow(*html_text.labelled_table())
    body = f"<p>{'Words of the text that count here and there. ' * 4}</p>" * 3
    page = lambda article, div="": f"<body><nav><a href=x>Home</a></nav><article {article}><div {div}>{body}</div></article></body>"
    want = html_text.main_text(page(""), tree)
    assert len(want) > 500
    for name in ('data-title="The hidden valley"', "title='A life hidden'", 'aria-label="hidden gems"', 'data-hidden="false"', 'onclick="x.hidden=true"', 'data-style="display:none"', 'title="a > b hidden class=ad"'):
        assert html_text.main_text(page(name), tree) == want and html_text.main_text(page("", name), tree) == want
    for name in ("hidden", "HIDDEN=x", 'aria-hidden="true"', "style='display: none'"):
        assert html_text.main_text(page("", name), tree) == ""
    for name in ("search", "login", "register", "form"):
        chapter = f"<body><article>{body}<section id='{name}'><h2>A chapter</h2>{body}</section></article></body>"
        assert html_text.main_text(chapter, tree) == f"{want}\n\nA chapter\n\n{want}"
    comments = f"<body><article>{body}<div id='comments'><p>A reader says so.</p></div></article></body>"
    assert html_text.main_text(comments, tree) == want
    assert html_text.main_text("Just plain\n text", tree) == "Just plain text"


@pytest.mark.parametrize("html", ["<div class=ad>" * 100_000 + "x", "<div>" * 50_000 + "</p>" * 50_000, "<article class=ad>" * 100_000 + "x", "a " * 2_000_000])
def test_long_and_deep_pages(html):
    tree = html_text.grow(*html_text.labelled_table())
    began = time.process_time()
    assert isinstance(html_text.main_text(html, tree), str)
    assert time.process_time() - began < 20


def test_copies_go_whatever_their_ids(spark):
    docs = spark.createDataFrame([(9, "a"), (9, "b"), (5, "a"), (None, "b"), (None, "c"), (None, "c"), (4, None), (4, " "), (7, "d"), (7, "d")], DOC)
    got = sorted(((r.doc_id, r.text) for r in exact_dedup.keep_first_copies(docs).collect()), key=str)
    assert got == sorted([(5, "a"), (9, "b"), (None, "c"), (None, "c"), (4, None), (4, " "), (7, "d"), (7, "d")], key=str)


def test_worker_tables_are_bounded():
    """Paragraphs without blanks aren't held, and rows of many labels make tables of fewer words."""
    table = np.ones((64, 200), np.float32)
    held = hashed.WordRows(table, lambda w: [len(w) % 64], most_chars=10_000, most_bytes=1 << 20)
    assert held.limit == (1 << 20) // 804
    for i in range(400):
        assert (held.total(held.numbers([f"{i}" + "語" * 300, "a"]))[-1]) == 2
        assert held.chars <= 10_000 + 304 and len(held.rows) <= 4096
    wide = [f"w{i}" for i in range(9000)]
    assert len(set(held.numbers(wide).tolist())) == 9000 and held.numbers(["a"]).tolist() == [0] and len(held.rows) <= 4096
    words = ngram_join.WordHashes()
    texts = [chr(0x4E00 + i % 20_000) * 300 + str(i) for i in range(5000)]
    assert all(words[t] == words[t] for t in texts[:50]) and not words
    pieces, known = sentence_pieces.load(public_tokenizers.path("piece_bpe_32k.model")), {}
    sentence_pieces.encode_batch([*texts[:50], "some words"], pieces, known)
    assert known and max(map(len, known)) <= 64


def test_lean_gives_memory_back_after_the_tables(monkeypatch):
    import weakref

    from citewell.llm import common

    class Table:
        pass

    seen, given = [], []
    monkeypatch.setattr(common, "give_back", lambda: given.append(seen[0]() is None))

    @common.lean
    def run(batches):
        table = Table()
        seen.append(weakref.ref(table))
        for b in batches:
            yield b + 1

    assert list(run(iter([1, 2]))) == [2, 3] and given == [True]
    monkeypatch.undo()
    common.give_back()
