"""Scalar expressions with the engine's null and default rules; all are built-in columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(raw: Column, path: str) -> Column:
    """A value by JSON path as text, empty where absent."""
    return F.coalesce(F.get_json_object(raw, path), F.lit(""))


def json_int(raw: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(raw, path).try_cast("long"), F.lit(0))


def json_bool(raw: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(raw, path) == "true", F.lit(False))


def or_zero(text: Column, kind: str = "double") -> Column:
    """A number from text, 0 where it isn't one."""
    return F.coalesce(text.try_cast(kind), F.lit(0).cast(kind))


def percentile_value(raw: Column) -> Column:
    """A percentile given as a number or as an object with ``value``."""
    return F.coalesce(raw.try_cast("double"), F.get_json_object(raw, "$.value").try_cast("double"))


def ratio(a: Column, b: Column, scale: float = 1.0, empty: float | None = 0.0) -> Column:
    """``scale * a / b``; ``empty`` where b is zero or null."""
    made = F.try_divide(a.cast("double") * scale, b)
    return made if empty is None else F.coalesce(made, F.lit(empty))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def rounded(x: Column, digits: int, mode: str = "half_up") -> Column:
    """``half_even`` rounds as numpy does."""
    return F.bround(x, digits) if mode == "half_even" else F.round(x, digits)


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def contains_flag(text: Column, part: str) -> Column:
    """1 where ``text`` has ``part``, case mattering; null counts as without."""
    return F.coalesce(text.contains(part), F.lit(False)).cast("int")


def filled(text: Column) -> Column:
    """Whether a text is neither null nor empty."""
    return F.coalesce(text, F.lit("")) != ""


def or_all(text: Column) -> Column:
    """``ALL`` in place of null and empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("ALL"))


def scrubbed(text: Column) -> Column:
    """Tabs and line ends as blanks, NUL characters gone."""
    return F.translate(text, "\t\n\r\x00", "   ")


def copy_text(text: Column) -> Column:
    r"""A field of a bulk-copy file: scrubbed, ``\N`` for null."""
    return F.coalesce(scrubbed(text), F.lit("\\N"))


def label_of(column_name: Column, prefix: str) -> Column:
    """A column name as a label: prefix off, first letter upper case."""
    bare = F.regexp_replace(column_name, f"^{prefix}", "")
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.lower(F.substring(bare, 2, 1 << 30)))


def true_text(text: Column) -> Column:
    """Whether a text is one of the spellings of true."""
    return F.coalesce(F.lower(text).isin("true", "1"), F.lit(False))


def period_label(first: Column | int, last: Column | int) -> Column:
    as_text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.concat_ws("-", as_text(first), as_text(last))


def abstract_text(index: Column) -> Column:
    """A text from its inverted index (token to positions).

    Positions without a token are empty, so two blanks meet there; of tokens at
    one position the last stays.
    """
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    once = lambda items, bind: F.element_at(F.transform(F.array(items), bind), 1)
    sorted_pairs = F.array_sort(F.transform(pairs, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["w"].alias("w"))))
    last_of_place = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["p"] != x["p"], F.lit(True)))
    # as many blanks as places passed, so a text takes one sort and one pass
    word = lambda s: lambda x, i: F.concat(F.repeat(F.lit(" "), (x["p"] - F.coalesce(F.get(s, i - 1)["p"], F.lit(0))).cast("int")), x["w"])
    text = once(sorted_pairs, lambda s: once(last_of_place(s), lambda t: F.array_join(F.transform(t, word(t)), "")))
    return F.when(F.size(pairs) > 0, text).otherwise("")


def parsed_once(document: Column) -> Column:
    """A parsed document as the one row of a generator: filters on its fields stay above it, where Spark would otherwise parse anew for each."""
    return F.explode(F.array(document))


def inverted_index(text: Column) -> Column:
    """The inverted index of a text's tokens between single blanks: token to ascending positions; made row by row, without a shuffle."""
    once = lambda item, bind: F.element_at(F.transform(F.array(item), bind), 1)
    tokens = F.array_sort(F.transform(F.split(text, " "), lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
    # the places in sorted order where a token's run begins, and behind them the end of the last
    begins = lambda s: F.concat(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"])), F.array(F.size(s)))
    run = lambda s, b: lambda k: F.struct(F.get(s, F.get(b, k))["w"].alias("w"), F.transform(F.slice(s, F.get(b, k) + 1, F.get(b, k + 1) - F.get(b, k)), lambda x: x["p"]).alias("ps"))
    runs = lambda s: once(begins(s), lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 2), run(s, b)))
    return F.map_from_entries(once(tokens, runs))


def hex_center(row: Column, col: Column, size: float = 1.0, orientation: str = "pointy") -> tuple[Column, Column]:
    """Centre of a cell of a hexagonal grid: shifted odd rows (pointy) or odd columns (flat)."""
    long, short = math.sqrt(3.0) * size, 1.5 * size
    if orientation == "pointy":
        return long * (col + 0.5 * (row % 2)), short * row
    return short * col, long * (row + 0.5 * (col % 2))


def hex_corners(x: Column, y: Column, size: float = 1.0, orientation: str = "pointy") -> Column:
    """Array of seven corners, the first again at the end."""
    start = 90 if orientation == "pointy" else 0
    angle = lambda i: F.radians(F.lit(start) + 60.0 * i)
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct((x + size * F.cos(angle(i))).alias("x"), (y + size * F.sin(angle(i))).alias("y")))
