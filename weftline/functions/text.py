"""String clean-up, keys and URLs."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from weftline import fixed_values as fx
from weftline.functions.core import bind, col, contains_any, grab, has, squeeze, swap, text_or_null


#: What ``html.unescape`` replaces; the cut itself counts as a hit, so that texts with it stay whole.
_CUT = "\u0001"
_ENTITY = rf"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{{1,32}};?)|{_CUT}"


@F.pandas_udf(ArrayType(StringType()))
def _unescape_each(s: pd.Series) -> pd.Series:
    return s.map(lambda hits: [html.unescape(h) for h in hits], na_action="ignore")


@F.pandas_udf(StringType())
def _unescape_nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t)), na_action="ignore")


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c) -> Column:
    """Decode HTML entities of short texts, also inside other expressions. Only rows with an ampersand are sent to Python."""
    c = col(c)
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def unescape_page(c) -> Column:
    """Decode HTML entities of long texts. Python sees the entities of a row, never its text; rows without an ampersand stay away."""
    c = col(c)
    some = c.contains("&")
    plain = _unescape_each(F.when(some, F.regexp_extract_all(c, F.lit(_ENTITY), F.lit(0))))
    woven = lambda w: F.array_join(F.flatten(F.transform(w["gaps"], lambda g, i: F.array(g, F.coalesce(F.get(w["plain"], i), F.lit(""))))), "")
    return F.when(some, bind(woven, gaps=F.split(F.regexp_replace(c, _ENTITY, _CUT), _CUT, -1), plain=plain)).otherwise(c)


def fold_width(c) -> Column:
    """Decode entities and apply NFKC; plain ASCII rows without an ampersand never leave the JVM."""
    c = col(c)
    return F.coalesce(_unescape_nfkc(F.when(c.rlike(r"[^\x00-\x7F]|&"), c)), c)


def decode_listed_entities(c) -> Column:
    out = col(c)
    for entity, char in fx.BENEFIT_ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def slugify(c, empty: str = "unknown") -> Column:
    s = swap(swap(F.lower(col(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(text_or_null(s), F.lit(empty)) if empty else s


def humanize(c) -> Column:
    """'museum-of-art' -> 'Museum Of Art' (a capital after every non-letter, as in a title)."""
    return title_case(F.replace(col(c), F.lit("-"), F.lit(" ")))


def title_case(c) -> Column:
    """Capital after any non-letter, lower case elsewhere (``initcap`` only looks at blanks)."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
    return F.array_join(F.transform(words, cap), "")


def clean_title(c) -> Column:
    """Presentable name from a page title."""
    name = F.trim(unescape(c))
    name = swap(name, fx.TITLE_LEAD, "", "iU")
    head = F.trim(swap(name, fx.TITLE_TAIL, "", "U"))
    name = squeeze(F.coalesce(text_or_null(head), name))
    shouted = (F.upper(name) == name) & name.rlike("[A-Z]")
    return text_or_null(F.when(shouted, title_case(name)).otherwise(name))


def last_segment(url) -> Column:
    return grab(swap(url, r"/+$", ""), r"([^/]*)$", 1, "")


def tighten(c) -> Column:
    """Trim every line and drop the blank ones."""
    lines = F.split(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""), "\n")


def same_text(c) -> Column:
    """Comparison form: whitespace collapsed, one trailing run of dots dropped."""
    return F.rtrim(squeeze(F.coalesce(col(c), F.lit(""))), F.lit("."))


def origin(url) -> Column:
    return F.coalesce(grab(url, r"^(https?://[^/]+)", 1, ""), col(url))


def site_root(url) -> Column:
    """scheme://host/ with https assumed when the scheme is missing."""
    u = F.when(col(url).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), col(url)).otherwise(F.concat(F.lit("https://"), col(url)))
    return F.concat(grab(u, r"^([^:]+)://", 1, ""), F.lit("://"), F.coalesce(grab(u, r"^[^:]+://([^/?#]*)", 1, ""), F.lit("")), F.lit("/"))


def base_url(*fields) -> Column:
    """scheme://host/ of the first usable field; NULL when there is none."""
    first = F.coalesce(*[text_or_null(f) for f in fields])
    host = F.try_parse_url(first, F.lit("HOST"))
    scheme = F.try_parse_url(first, F.lit("PROTOCOL"))
    return F.when(host.isNotNull(), F.concat(scheme, F.lit("://"), host, F.lit("/")))


def host_label(url) -> Column:
    """Host without a leading 'www.', followed by the path unless it is the root."""
    host = F.lower(F.try_parse_url(col(url), F.lit("HOST")))
    path = F.try_parse_url(col(url), F.lit("PATH"))
    shown = F.when(path.isin("", "/"), F.lit("")).otherwise(F.coalesce(path, F.lit("")))
    return F.coalesce(F.concat(swap(host, r"^www\.", ""), shown), col(url))


def url_key(url) -> Column:
    return F.sha1(col(url).cast("binary"))


def status_kind(s) -> Column:
    """ok / empty / failed, NULL for anything else."""
    s = col(s)
    return F.when(s.isin("ok", "empty"), s).when(s.startswith("failed:"), F.lit("failed"))


def status_reason(s) -> Column:
    return F.when(col(s).startswith("failed:"), col(s).substr(F.lit(8), F.length(col(s))))


def matches_search(term: str, name, key) -> Column:
    """Case-insensitive substring on the name, plain substring on the key; an empty term keeps all rows."""
    q = term.strip().lower()
    if not q:
        return F.lit(True)
    return F.lower(col(name)).contains(q) | col(key).contains(q)


def summary_matches(expected, body) -> Column:
    """Tolerant comparison of a short offer label with a page body."""
    e, b = F.lower(squeeze(expected)), F.lower(squeeze(body))
    return (F.when(e == "disc", b.contains("discount") | b.contains("off"))
            .when(e == "free", b.contains("free"))
            .otherwise(b.contains(e)))


def is_bad_page(html_col) -> Column:
    return contains_any(F.lower(col(html_col)), fx.BAD_PAGE_MARKERS)


def address_struct(c) -> Column:
    """US address -> street, city, state, zip; the whole string stays in street when the tail does not parse."""
    raw = F.trim(col(c))
    ok = raw.rlike(fx.US_ADDRESS)
    part = lambda g: F.regexp_extract(raw, fx.US_ADDRESS, g)
    none = F.lit(None).cast("string")
    parsed = F.struct(F.trim(part(1)).alias("street"), F.trim(part(2)).alias("city"),
                      part(3).alias("state"), F.substring(part(4), 1, 5).alias("zip"))
    kept = F.struct(raw.alias("street"), none.alias("city"), none.alias("state"), none.alias("zip"))
    return F.when((F.length(raw) > 0) & (raw != "MA"), F.when(ok, parsed).otherwise(kept))


def clean_address(c) -> Column:
    out = col(c)
    for noise in fx.ADDRESS_NOISE:
        out = swap(out, noise, "", "iU")
    out = swap(out, r"\b(\d+)\s*-\s*\d+\b", "$1")
    out = swap(out, r",\s*,", ",")
    return F.trim(swap(out, r"\s+", " ", "U"), F.lit(", "))


def plain_name(c) -> Column:
    return squeeze(F.split_part(swap(c, r"\s*\(.*?\)\s*", " "), F.lit("/"), F.lit(1)))


def geocode_queries(name, address, region: str, known=None) -> Column:
    """Ordered distinct query strings to try for one place; ``known`` is a curated query that goes first."""
    addr, nm = F.trim(F.coalesce(col(address), F.lit(""))), F.trim(F.coalesce(col(name), F.lit("")))
    short = plain_name(nm)
    with_region = lambda c: F.when(F.length(c) > 0, F.concat(c, F.lit(region)))
    values = [text_or_null(known)] if known is not None else []
    values += [text_or_null(addr), text_or_null(clean_address(addr)), with_region(nm), text_or_null(nm),
               with_region(short), text_or_null(short)]
    return F.array_distinct(F.array_compact(F.array(*values)))


def library_mentions(text, longest: int | None = None) -> Column:
    """Distinct 'X (Public) Library' names that open a line, in reading order; ``longest`` leaves out longer names (the surveyed rule was 80)."""
    lines = F.transform(F.split(col(text), "\n"), lambda ln: F.regexp_extract(F.trim(ln), "(?U)" + fx.LIBRARY_MENTION, 1))
    fits = lambda n: F.length(n) >= 6 if longest is None else F.length(n).between(6, longest)
    return F.array_distinct(F.filter(lines, fits))


def claims_free(notes) -> Column:
    return contains_any(F.lower(F.coalesce(col(notes), F.lit(""))), fx.FREE_CLAIMS)


def source_marker(html_col) -> Column:
    """URL of the first provenance comment of the whole text."""
    return grab(col(html_col), fx.SOURCE_MARKER, 1, "")
