"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

The table below lists measures, bounds and the smallest text they apply to.
``rule_columns`` turns it into boolean columns over the measures, and
``measures`` computes these with built-in functions, once for each text.

Windows of words: the words of a text, numbered, are sorted by the three-word
window that begins there; equal neighbours are repeats.  Their positions, in
order, cover as many words as the sum of min(3, distance to the next).

Cases: null text has no words and fails the base rule; empty text likewise;
very long texts are split whole, in memory in proportion to the text; there are no ties to break, as each row
is judged by itself; null ids are like any other; empty tables give an empty result; repeated rows give repeated rows; further
columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import table

#: Frequent function words of the languages served, lower case.
STOP_WORDS = (
    "the of and to in that is for it with as was on be by this are or from "
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par au sur pas "
    "el que y los se las por con una su para es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [``least``, ``most``]; texts with fewer than ``from_words`` words are not judged by it."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The production thresholds.
RULES = (
    Rule("word_length", "mean_word_chars", least=2.0, most=14.0),
    Rule("symbols", "symbol_ratio", most=0.05),
    Rule("capitals", "capital_ratio", most=0.3),
    Rule("stop_words", "stop_word_ratio", least=0.05),
    Rule("repeated_lines", "dup_line_ratio", most=0.40),
    Rule("line_length", "words_per_line", least=2.0),
)


def fold(items: Column, bind) -> Column:
    """``bind`` of a computed value, so that lambdas below see it computed once."""
    return F.element_at(F.transform(F.array(items), bind), 1)


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more in the array ``words``, the first ones included."""

    def count(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.struct(F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("k"), i.alias("p")),
        )
        return fold(F.array_sort(windows), marked)

    def marked(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["k"] == F.get(s, b)["k"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(i - 1, i) | same(i, i + 1))
        return fold(F.array_sort(F.transform(twice, lambda x: x["p"])), covered)

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
        )

    return F.when(F.size(words) >= 4, fold(words, count)).otherwise(F.lit(0).cast("long"))


def _echo_words(words: Column) -> Column:
    """Words equal to one of the three before them."""
    near = lambda a, i: F.coalesce((F.get(a, i) == F.get(a, i - 1)) | (F.get(a, i) == F.get(a, i - 2)) | (F.get(a, i) == F.get(a, i - 3)), F.lit(False))
    return fold(words, lambda a: F.size(F.filter(a, lambda w, i: near(a, i))))


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns beside the counts and ratios that rules may name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*keep, text.alias("_t"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        _echo_words(F.col("_w")).cast("long").alias("n_echo_words"),
        F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return counted.withColumns(
        {
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "word_chars"),
            "capital_ratio": ratio("n_capitals", "n_letters"),
            "stop_word_ratio": ratio("n_stop_words", "n_words"),
            "echo_ratio": ratio("n_echo_words", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "words_per_line": ratio("n_words", "n_lines"),
        }
    )


def rule_columns(rules=RULES) -> dict[str, Column]:
    """A boolean column for each rule: true where the text passes it."""
    made = {}
    for rule in rules:
        ok = F.lit(True)
        if rule.least is not None:
            ok = ok & (F.col(rule.measure) >= rule.least)
        if rule.most is not None:
            ok = ok & (F.col(rule.measure) <= rule.most)
        made[f"ok_{rule.name}"] = ok | (F.col("n_words") < rule.from_words)
    return made


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``kept`` and a column for each rule."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measures(docs, text_col, (id_col,)).withColumn("base_failed", base).withColumns(rule_columns(rules))
    passed = ~F.col("base_failed")
    for rule in rules:
        passed = passed & F.col(f"ok_{rule.name}")
    return judged.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", passed.alias("kept"), *[f"ok_{r.name}" for r in rules]
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _rules_sql() -> str:
    """The rules as SQL boolean columns over the measures."""
    made = []
    for r in RULES:
        parts = [f"{r.measure} >= {r.least}"] * (r.least is not None) + [f"{r.measure} <= {r.most}"] * (r.most is not None)
        made.append(f"(({' AND '.join(parts)}) OR n_words < {r.from_words}) AS ok_{r.name}")
    return ",\n         ".join(made)


OP2_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT r, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS k
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS p FROM d)),
twice AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT r, CAST(sum(least(3, coalesce(q - p, 3))) AS BIGINT) AS n
  FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS q FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals,
         len(list_filter(ws, lambda w: list_contains([{", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))}], lower(w)))) AS n_stop_words
  FROM d LEFT JOIN covered USING (r)),
ratios AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio,
         coalesce(n_capitals / nullif(n_letters, 0), 0) AS capital_ratio, coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_word_ratio,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_words / nullif(n_lines, 0), 0) AS words_per_line
  FROM m),
judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         {_rules_sql()}
  FROM ratios)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(f"ok_{r.name}" for r in RULES)}) AS kept, {", ".join(f"ok_{r.name}" for r in RULES)}
FROM judged
"""
