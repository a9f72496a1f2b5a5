"""Markup to text, page metadata, anchors; all on one text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions.core import col, contains_any, grab, grab_all, has, let, squeeze, swap
from weftline.functions.text import unescape, unescape_page


def strip_tags(c, gap: str = " ") -> Column:
    return squeeze(swap(c, fx.TAG, gap))


def html_text(c) -> Column:
    """Flat text: scripts and styles out, tags to blanks, entities decoded, whitespace collapsed."""
    body = swap(swap(c, fx.SCRIPT_STYLE, " "), fx.TAG, " ")
    return squeeze(unescape(body))


def paragraph_body(c) -> Column:
    """Markup out, paragraph ends as line breaks; entities still encoded."""
    body = swap(col(c), fx.DROPPED_BLOCKS, " ")
    return swap(swap(swap(body, fx.COMMENT, " "), fx.BLOCK_END, "\n"), fx.TAG, " ")


def paragraphs_of(body, cap: int | None = None) -> Column:
    lines = F.transform(F.split(unescape_page(body), "\n"), lambda ln: F.trim(F.regexp_replace(ln, "[ \t ]+", " ")))
    text = swap(swap(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    if cap is None:
        return text
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("\n…[truncated]"))).otherwise(text)


def html_paragraphs(c, cap: int | None = None) -> Column:
    """Readable text that keeps paragraph breaks; longer text ends with the truncation mark when a cap is given."""
    return paragraphs_of(paragraph_body(c), cap)


def line_body(c) -> Column:
    """Tags become line breaks; entities still encoded."""
    return swap(swap(c, fx.SCRIPT_STYLE, " "), fx.TAG, "\n")


def lines_of(body) -> Column:
    lines = F.transform(F.split(unescape_page(body), "\n"), lambda ln: F.trim(F.regexp_replace(ln, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def line_text(c) -> Column:
    """Tags become line breaks; blank lines dropped."""
    return lines_of(line_body(c))


def policy_text(c, blocks: int | None = None, longest: int | None = None) -> Column:
    """Distinct paragraph-like blocks of more than 20 characters in page order; all of them unless the caller sets limits."""
    texts = F.transform(grab_all(c, fx.POLICY_BLOCK, 1), lambda b: squeeze(F.regexp_replace(b, fx.TAG, "")))
    kept = F.array_distinct(F.filter(texts, lambda t: (F.length(t) > 20) & (F.length(t) <= longest if longest else F.lit(True))))
    return F.array_join(F.slice(kept, 1, blocks) if blocks else kept, "\n")


def page_title(c) -> Column:
    return F.trim(grab(c, fx.PAGE_TITLE, 1, ""))


def absolute(base, href) -> Column:
    """Resolve a link against its page (absolute, scheme-relative, root-relative, query-only, path-relative with dot segments)."""
    h, b = F.trim(col(href)), col(base)
    root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    path = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    joined = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), h)
    rest = F.regexp_extract(joined, r"([?#].*)$", 1)
    parts = F.split(F.regexp_replace(joined, r"[?#].*$", ""), "/")
    empty = F.array().cast("array<string>")
    flat = F.aggregate(parts, empty, lambda acc, p: (
        F.when(p == ".", acc)
        .when((p == "..") & (F.size(acc) > 1), F.slice(acc, 1, F.size(acc) - 1))
        .when(p == "..", acc).otherwise(F.concat(acc, F.array(p)))))
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    relative = F.concat(root, F.array_join(flat, "/"), tail, rest)
    return (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, h))
            .when(h.startswith("/"), F.concat(root, h))
            .when(h == "", b)
            .when(h.startswith("?"), F.concat(root, path, h))
            .otherwise(relative))


def og_image(c, base=None) -> Column:
    """og:image of the page, either attribute order, made absolute when a base is known."""
    url = F.trim(F.coalesce(grab(c, fx.OG_IMAGE, 1, ""), grab(c, fx.OG_IMAGE_REVERSED, 1, "")))
    full = url.rlike("^https?://")
    return F.when(full, url) if base is None else F.when(full, url).when(col(base).isNotNull() & url.isNotNull(), absolute(base, url))


def anchors(c, pattern: str = fx.ANCHOR) -> Column:
    """ARRAY<STRUCT<href,inner>> of the links in page order."""
    return F.arrays_zip(grab_all(c, pattern, 1).alias("href"), grab_all(c, pattern, 2).alias("inner"))


def _navigable(href) -> Column:
    return href.rlike(r"^(https?://|/)")


def visit_links(c) -> Column:
    """STRUCT<booking_url,pass_holder_url> from one reading of the page's links.

    Booking: first link to a known ticketing host, or a navigable link with a ticketing path. Pass holders: first navigable
    link whose path or visible text speaks of library passes / pass holders.
    """
    def booking(a):
        low = F.lower(a["href"])
        return contains_any(low, fx.BOOKING_HOSTS) | (contains_any(low, fx.BOOKING_PATHS) & _navigable(a["href"]))
    def pass_holder(a):
        visible = squeeze(F.regexp_replace(a["inner"], fx.TAG, " "))
        return (has(a["href"], fx.PASS_HOLDER_PATH, "i") | has(visible, fx.PASS_HOLDER_TEXT)) & _navigable(a["href"])
    first = lambda links, test: F.get(F.filter(links, test), F.lit(0))["href"]
    return let(anchors(c), lambda links: F.struct(first(links, booking).alias("booking_url"), first(links, pass_holder).alias("pass_holder_url")))


def link_score(text, path) -> Column:
    blob = F.lower(F.concat_ws(" ", col(text), col(path)))
    score = F.lit(0)
    for word, weight in fx.LINK_KEYWORDS.items():
        score = score + F.when(blob.contains(word), F.lit(weight)).otherwise(F.lit(0))
    return score


def body_slice(c) -> Column:
    """Text of the description block, or of the whole page when the block is missing."""
    return strip_tags(F.coalesce(grab(c, fx.DESCRIPTION_DIV, 1, ""), col(c)))


def response_verdict(body, kind: str) -> Column:
    """Ranked reading of a captured reservation response; ``kind`` is wizard, calendar or login."""
    out = F.lit(None).cast("string")
    for pattern, verdict in fx.RESPONSE_RULES[kind]:
        out = F.coalesce(out, F.when(has(body, pattern), F.lit(verdict)))
    return F.coalesce(out, F.lit("unknown"))


def retry_verdict(body) -> Column:
    """Reading of a retried response by plain phrases."""
    t = F.lower(col(body))
    hit = lambda *w: contains_any(t, w)
    return (F.when(hit("does not appear to be valid", "blocked from making this type of reservation"), "rejected_resident")
            .when(hit("first name *", "reserver information", "available pass"), "accepted")
            .when(hit("please check the following") & hit("library card"), "format_error").otherwise("unknown"))
