"""Cascades, code maps and small helpers shared by the other column modules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def rx(pattern: str, flags: str = "iU") -> str:
    """Java pattern with inline flags: ``i`` ignore case, ``U`` Unicode classes, ``s`` dot matches newline."""
    return f"(?{flags}){pattern}" if flags else pattern


def has(c, pattern: str, flags: str = "iU") -> Column:
    """Regex search as a non-null boolean."""
    return F.coalesce(col(c).rlike(rx(pattern, flags)), F.lit(False))


def grab(c, pattern: str, group: int = 1, flags: str = "iU") -> Column:
    """Group of the first match, NULL when there is none (or the group is empty)."""
    return F.nullif(F.regexp_extract(col(c), rx(pattern, flags), group), F.lit(""))


def grab_all(c, pattern: str, group: int = 1, flags: str = "") -> Column:
    return F.regexp_extract_all(col(c), F.lit(rx(pattern, flags)), F.lit(group))


def swap(c, pattern: str, replacement: str, flags: str = "") -> Column:
    return F.regexp_replace(col(c), rx(pattern, flags), replacement)


def squeeze(c) -> Column:
    """Collapse whitespace runs (Unicode) and trim."""
    return F.trim(swap(c, r"\s+", " ", "U"))


def contains_any(c, words: Iterable[str]) -> Column:
    """Any of the literal words occurs. One alternation, so the text expression is written (and computed) once."""
    return F.coalesce(col(c).rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def cascade(*cols) -> Column:
    """First non-NULL signal, highest precedence first."""
    return F.coalesce(*[col(c) for c in cols])


def text_or_null(c) -> Column:
    """Blank-is-missing reading of a string."""
    return F.when(F.length(col(c)) > 0, col(c))


def array_or_null(c) -> Column:
    return F.when(F.size(col(c)) > 0, col(c))


def number_or_null(c) -> Column:
    return F.when(col(c) != 0, col(c))


def first_truthy(*cols) -> Column:
    """First value that is not missing; strings and collections count as missing when empty.

    Pass ``text_or_null`` / ``array_or_null`` / ``number_or_null`` columns for the types involved.
    """
    return F.coalesce(*[col(c) for c in cols])


def code_map(mapping: Mapping) -> Column:
    items = []
    for key, value in mapping.items():
        items += [F.lit(key), F.lit(value)]
    return F.create_map(*items)


def map_codes(c, mapping: Mapping, default=None) -> Column:
    """Code -> label; unmapped or NULL gives ``default`` (NULL lets a cascade fall through)."""
    c = col(c)
    hit = F.when(c.isNotNull(), F.try_element_at(code_map(mapping), c))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def fmt_num(c) -> Column:
    """9.0 -> '9', 13.5 -> '13.5'; NULL stays NULL."""
    c = col(c).cast("double")
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def trim_zeros(c) -> Column:
    """'10.00' -> '10', '10.50' -> '10.5'; integers untouched."""
    c = col(c)
    return F.when(c.contains("."), swap(swap(c, r"0+$", ""), r"\.$", "")).otherwise(c)


def ordered_distinct(*cols) -> Column:
    """Distinct non-empty values of several columns, in column order."""
    values = F.array(*[text_or_null(c) for c in cols])
    return F.array_distinct(F.array_compact(values))


def pct(part, total) -> Column:
    """Percentage with one decimal, half-even like the source system; 0.0 on an empty table."""
    return F.when(col(total) > 0, F.bround(F.lit(100.0) * col(part) / col(total), 1)).otherwise(F.lit(0.0))


def let(value, body) -> Column:
    """Bind an expression once and use it many times in ``body``.

    Without it Catalyst may inline a long expression at every place that refers to it, and higher-order functions would
    evaluate it again for every element.
    """
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


def bind(body, **values) -> Column:
    """``let`` for several named values: ``body`` receives a STRUCT of them."""
    return let(F.struct(*[col(v).alias(n) for n, v in values.items()]), body)


def match_window(c, pattern: str, before: int, after: int) -> Column:
    """First match with context on both sides, clamped to the text; NULL without a match."""
    at = F.regexp_instr(col(c), F.lit(rx(pattern)))
    size = F.length(F.regexp_extract(col(c), rx(pattern), 0))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, col(c).substr(start, at - start + size + after))


_CUT = "\u0001"
#: Elements that are summed, and characters that are searched, at once; both keep the cost of a row in proportion to its length.
_RUN, _PAGE = 256, 1024


def running(steps) -> Column:
    """Sum of all earlier elements, for every element of an ARRAY<INT>.

    An array that grows by one element is copied each time, so sums run inside stretches of bounded length and over their totals.
    """
    def local(part):
        step = lambda acc, x: F.struct((acc["end"] + x).alias("end"), F.concat(acc["all"], F.array(acc["end"])).alias("all"))
        return F.aggregate(part, F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("all")), step)
    def joined(b):
        shifted = lambda totals: F.transform(b["runs"], lambda r, i: F.transform(r["all"], lambda v: v + F.get(totals, i)))
        return F.flatten(let(local(F.transform(b["runs"], lambda r: r["end"]))["all"], shifted))
    def cut(s):
        starts = F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1)), F.lit(_RUN))
        return bind(joined, runs=F.transform(starts, lambda a: local(F.slice(s, a, F.lit(_RUN)))))
    return let(steps, cut)


def find_all(c, pattern: str, flags: str = "iU", before: int = 0, after: int = 0) -> Column:
    """All matches in order as ARRAY<STRUCT<at,hit,pre,post>>: 0-based offset, matched text, and its context.

    Offsets come from the lengths of the pieces between matches, so everything stays inside the row, and the cost grows with the text.
    The pieces are cut at a control character put in place of each match: a regex split would compile the pattern again for every row.
    Contexts are taken from pages of the text, because taking a substring counts characters from the beginning.
    """
    p = rx(pattern, flags)
    text = col(c)
    page = max(_PAGE, before, after)
    def around(pages, start, length):
        k = (start / page).cast("int")
        return F.concat(F.get(pages, k), F.coalesce(F.get(pages, k + 1), F.lit(""))).substr(start - k * page + 1, length)
    def located(b):
        sizes = F.transform(F.arrays_zip(b["gaps"].alias("gap"), b["hits"].alias("hit")), lambda x: x["gap"] + F.length(x["hit"]))
        def one(x):
            at = x["start"] + x["gap"]
            first, end = F.greatest(F.lit(0), at - before), at + F.length(x["hit"])
            return F.struct(at.alias("at"), x["hit"].alias("hit"), (around(b["pages"], first, at - first) if before else F.lit("")).alias("pre"),
                            (F.coalesce(around(b["pages"], end, F.lit(after)), F.lit("")) if after else F.lit("")).alias("post"))
        return F.transform(F.arrays_zip(b["hits"].alias("hit"), b["gaps"].alias("gap"), running(sizes).alias("start")), one)
    def search(t):
        gaps = F.transform(F.split(F.regexp_replace(t, p, _CUT), _CUT, -1), F.length)
        pages = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{page}}}"), F.lit(0)) if before or after else F.array().cast("array<string>")
        found = bind(located, hits=F.regexp_extract_all(t, F.lit(p), F.lit(0)), gaps=let(gaps, lambda g: F.slice(g, F.lit(1), F.size(g) - 1)), pages=pages)
        return F.when(t.rlike(p), found).otherwise(F.array().cast("array<struct<at:int,hit:string,pre:string,post:string>>"))
    return let(F.replace(text, F.lit(_CUT), F.lit(" ")), search)


def first_hits(values, key) -> Column:
    """Elements whose key occurs for the first time, in order; ``key`` maps an element to its key, and elements without one go.

    Where keys repeat, (key, place) pairs are sorted once; the first of each run of equal keys names the element to keep.
    """
    def kept(v):
        places = F.transform(v, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))
        ordered = F.sort_array(F.filter(places, lambda p: p["k"].isNotNull()))
        firsts = let(ordered, lambda s: F.filter(s, lambda p, n: (n == 0) | (F.get(s, n - 1)["k"] != p["k"])))
        return F.transform(F.sort_array(F.transform(firsts, lambda p: p["i"])), lambda i: F.get(v, i))
    def plain(v):  # nothing to drop: no sorting
        whole = lambda k: (F.size(F.array_compact(k)) == F.size(v)) & (F.size(F.array_distinct(k)) == F.size(v))
        return F.when(let(F.transform(v, key), whole), v).otherwise(kept(v))
    return let(values, plain)
