"""Extraction jobs over page tables: one row per page (entity, page order, HTML), results folded per entity.

Pages of one entity are never concatenated: each page is read on its own and the hits are reduced with order-aware
aggregates, so an entity with very many pages is spread over tasks like any other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions.core import bind, code_map, col, find_all, grab, has, let, map_codes, match_window, rx, squeeze
from weftline.functions.html import absolute, anchors, html_paragraphs, html_text, link_score, visit_links
from weftline.functions.text import source_marker
from weftline.functions.weekly import clock_span
from weftline.operators.keys import ranked_top
from weftline.operators.layout import with_value


def page_order(name) -> Column:
    """Landing page first, then subpages by name."""
    return F.struct(col(name).contains("__"), col(name))


def evidence_rows(df: DataFrame, entity: str, page: str, html: str, base_url: str | None = None) -> DataFrame:
    """Readable text per page with its header, ordered inside the entity by ``page_order``."""
    src = F.coalesce(source_marker(html), col(base_url) if base_url else F.lit(None).cast("string"), F.lit("(unknown)"))
    d = df.withColumn("source_url", src).withColumn("_body", html_paragraphs(html))
    head = F.concat(F.lit("=== "), F.col(page), F.lit(" ===\nsource_url: "), F.col("source_url"), F.lit("\n\n"))
    return d.select(entity, page, "source_url", F.concat(head, F.col("_body")).alias("chunk"))


def evidence_manifest(entities: DataFrame, pages: DataFrame, entity: str) -> DataFrame:
    """Every entity with the number of pages inspected; 0 marks a null stub."""
    n = pages.groupBy(entity).agg(F.count("*").alias("_n"))
    return entities.join(n, entity, "left").select(*entities.columns, F.coalesce("_n", F.lit(0)).alias("pages_inspected"))


# ---------------------------------------------------------------- admission prices
def _nearest_audience(ctx: Column, at: Column) -> Column:
    """Audience keyword closest to the price (distance to either end of the word); earlier audience wins a tie."""
    def closest(i, label, pattern):
        dist = F.transform(find_all(ctx, pattern), lambda m: F.least(F.abs(m["at"] - at), F.abs(m["at"] + F.length(m["hit"]) - at)))
        return let(F.array_min(dist), lambda d: F.when(d.isNotNull(), F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(label).alias("label"))))
    found = [closest(i, label, pattern) for i, (label, pattern) in enumerate(fx.PRICE_AUDIENCES)]
    return F.array_min(F.array_compact(F.array(*found)))["label"]


def nearest_label(df: DataFrame, context: str, at: str, out: str = "label") -> DataFrame:
    return df.withColumn(out, _nearest_audience(F.col(context), F.col(at)))


def price_tokens(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """One row per '$N' token with 60 characters of context on both sides."""
    d = with_value(df.filter(F.col(html).contains("$")), _t=html_text(html)).filter(F.col("_t").rlike(r"\$\s*\d"))
    return _priced(d.select(*keys, F.posexplode(_price_hits("_t")).alias("token_no", "_k")), keys)


def _price_hits(text: str) -> Column:
    return find_all(text, r"\$\s*\d+(?:\.\d{1,2})?", "U", 60, 60)


def _priced(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tokens.select(*keys, "token_no", "_k.pre", "_k.hit", "_k.post", F.regexp_extract("_k.hit", r"(\d+(?:\.\d{1,2})?)", 1).cast("double").alias("price"))


def extract_prices(df: DataFrame, entity: str, order: str, html: str, max_price: float | None = None) -> DataFrame:
    """Admission prices (entity, audience, price, ages, phrase): one row per audience and price, first mention wins.

    ``max_price`` leaves out larger sums (the surveyed rule was 500); without it every price counts. The phrase is the whole context.
    """
    return fold_prices(price_tokens(df, [entity, order], html), entity, order, max_price)


def fold_prices(tokens: DataFrame, entity: str, order: str, max_price: float | None = None) -> DataFrame:
    """The rows of ``price_tokens`` read and folded per entity."""
    t = tokens.filter(F.col("price") > 0)
    t = t if max_price is None else t.filter(F.col("price") <= max_price)
    near = F.concat(F.right("pre", F.lit(35)), F.col("hit"), F.left("post", F.lit(35)))
    lead = F.right("pre", F.lit(20))
    t = t.filter(~has(near, fx.PRICE_NEGATIVE) & ~has(lead, fx.TIER_DROP))
    t = t.withColumn("_ctx", F.concat("pre", "hit", "post"))
    after = grab(F.left("post", F.lit(22)), fx.PRICE_FOLLOWER, 0, "U")
    bound = F.coalesce(*[F.when(has(after, p), F.lit(label)) for label, p in fx.PRICE_AUDIENCES])
    label = F.when(has(lead, fx.TIER_KEEP), F.lit("adult")).otherwise(F.coalesce(bound, _nearest_audience(F.col("_ctx"), F.length("pre"))))
    ages = F.struct(grab("_ctx", fx.PAREN_AGE_RANGE, 1).try_cast("int").alias("min"), grab("_ctx", fx.PAREN_AGE_RANGE, 2).try_cast("int").alias("max"))
    t = with_value(t, audience=label).select(entity, order, "token_no", "price", "audience",
                 F.struct(F.when(ages["min"].isNotNull(), ages).alias("age_range"), F.trim("_ctx").alias("source_phrase")).alias("_v"))
    at = F.struct(order, "token_no")
    return t.filter(F.col("audience").isNotNull()).groupBy(entity, "audience", "price").agg(F.min_by("_v", at).alias("_v"), F.min(at).alias("first_at")) \
        .select(entity, "audience", "price", F.col("_v.age_range").alias("age_range"), F.col("_v.source_phrase").alias("source_phrase"), "first_at")


# ---------------------------------------------------------------- weekly hours
def _day_number(word: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(word), r"\.+$", ""), r"s+$", "")
    return F.when(word.isNotNull(), F.try_element_at(code_map(fx.DAY_NUMBERS), bare))


def _group_no(pattern: str, name: str) -> int | None:
    order = [g for g in ("d1", "d2", "t1", "t2") if f"(?<{g}>" in pattern]
    order.sort(key=lambda g: pattern.index(f"(?<{g}>"))
    return order.index(name) + 1 if name in order else None


def _hour_hits(text: Column) -> Column:
    """All hits of all patterns: ARRAY<STRUCT<rank,at,kind,d1,d2,t1,t2,pre,hit>>."""
    def hits(rank, kind, pattern):
        def group(m, name):
            n = _group_no(pattern, name)
            return (F.regexp_extract(m["hit"], rx(pattern), n) if n else F.lit(None).cast("string")).alias(name)
        return F.transform(find_all(text, pattern, "iU", 25), lambda m: F.struct(
            F.lit(rank).alias("rank"), m["at"].alias("at"), F.lit(kind).alias("kind"), *[group(m, g) for g in ("d1", "d2", "t1", "t2")],
            m["pre"].alias("pre"), m["hit"].alias("hit")))
    return F.concat(*[hits(rank, kind, pattern) for rank, (kind, pattern) in enumerate(fx.HOURS_PATTERNS)])


def _covered(h: Column) -> Column:
    """Day numbers a hit speaks about; NULL when a day word is not one."""
    def span(b):
        first, last = b["first"], b["last"]
        return F.when(first <= last, F.sequence(first, last)).when(first > last, F.concat(F.sequence(first, F.lit(6)), F.sequence(F.lit(0), last)))
    def days(b):
        kind = h["kind"]
        return (F.when(kind.isin("daily", "daily_after"), F.sequence(F.lit(0), F.lit(6)))
                .when(kind == "weekdays", F.sequence(F.lit(0), F.lit(4))).when(kind == "weekends", F.array(F.lit(5), F.lit(6)))
                .when(kind == "pair", F.when(b["first"].isNotNull() & b["last"].isNotNull(), F.array(b["first"], b["last"])))
                .when(kind.isin("range", "range_after", "closed_range"), span(b))
                .otherwise(F.when(b["first"].isNotNull(), F.array(b["first"]))))
    return bind(days, first=_day_number(h["d1"]), last=_day_number(h["d2"]))


def _stated(h: Column) -> Column:
    """'closed' or an opening span; NULL for age ranges and unreadable times."""
    bare = h["t1"].rlike(r"^\s*\d{1,2}\s*$") & h["t2"].rlike(r"^\s*\d{1,2}\s*$")
    return F.when(h["kind"].startswith("closed"), F.lit("closed")).when(~(bare & has(h["pre"], fx.AGE_CONTEXT)), clock_span(h["t1"], h["t2"]))


def _season(text: Column) -> Column:
    """STRUCT<start_month,end_month,note> of 'Open May - October', NULL without one."""
    month = lambda g: map_codes(F.lower(grab(text, fx.SEASON, g)), fx.MONTH_NUMBERS)
    return bind(lambda b: F.when(b["start_month"].isNotNull() & b["end_month"].isNotNull(), b),
                start_month=month(1), end_month=month(2), note=grab(text, fx.SEASON, 0))


def hour_statements(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """(keys, season, statement STRUCT<days,value,rank,at,hit> or NULL): pages without a statement keep one row."""
    flat = F.regexp_replace(html_text(html), fx.DASHES, "-")
    d = df.select(*keys, flat.alias("_t")).select(*keys, let("_t", _hours_of).alias("_p"))
    return d.select(*keys, "_p.season", F.explode_outer("_p.statements").alias("s"))


def _hours_of(text: Column) -> Column:
    """STRUCT<season,statements> of one page's flat text with plain dashes."""
    read = lambda h: F.struct(_covered(h).alias("days"), _stated(h).alias("value"), h["rank"].alias("rank"), h["at"].alias("at"), h["hit"].alias("hit"))
    hinted = lambda t: t.rlike(r"(?i)\d|noon|midnight|closed")
    return F.struct(_season(text).alias("season"), F.when(hinted(text), F.transform(_hour_hits(text), read)).alias("statements"))


def extract_hours(df: DataFrame, entity: str, order: str, html: str) -> DataFrame:
    """Seven day columns per entity ('unknown' where nothing is stated), phrase and season.

    Patterns are tried in rank order over all pages; the first statement about a day stands. One scan and one aggregate.
    """
    return fold_hours(hour_statements(df, [entity, order], html), entity, order)


def fold_hours(statements: DataFrame, entity: str, order: str) -> DataFrame:
    """The rows of ``hour_statements`` folded per entity."""
    d = statements
    at = F.struct(F.col("s.rank"), F.col(order), F.col("s.at").alias("at"))
    said = F.col("s.value").isNotNull()
    day = lambda i: F.min_by(F.col("s.value"), F.when(said & F.array_contains("s.days", i), at))
    spoken = said & (F.col("s.value") != "closed") & F.col("s.days").isNotNull()
    return d.groupBy(entity).agg(
        *[F.coalesce(day(i), F.lit("unknown")).alias(name) for i, name in enumerate(fx.WEEK)],
        F.trim(F.min_by(F.col("s.hit"), F.when(spoken, at))).alias("source_phrase"),
        F.min_by("season", F.when(F.col("season").isNotNull(), F.col(order))).alias("seasonal"))


# ---------------------------------------------------------------- reservations
def extract_reservation(df: DataFrame, entity: str, order: str, html: str) -> DataFrame:
    """Reservation policy per entity: a timed-entry cue on any page beats a walk-in cue; links from the first page that has one."""
    d = df.withColumn("_t", html_text(html)).select(entity, order, *_reservation_cues("_t", html))
    return fold_reservation(d.select(entity, order, "_timed", "_walk", F.col("_l.booking_url").alias("_book"), F.col("_l.pass_holder_url").alias("_pass")), entity, order)


def _reservation_cues(text: str, html: str) -> list[Column]:
    return [match_window(text, fx.TIMED_ENTRY, 80, 80).alias("_timed"), match_window(text, fx.WALK_IN_WELCOME, 80, 80).alias("_walk"), visit_links(html).alias("_l")]


def fold_reservation(d: DataFrame, entity: str, order: str) -> DataFrame:
    """Cues and links of pages (_timed, _walk, _book, _pass) folded per entity."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    g = d.groupBy(entity).agg(*[first(c) for c in ("_timed", "_walk", "_book", "_pass")])
    timed, walk = F.col("_timed").isNotNull(), F.col("_walk").isNotNull()
    return g.select(
        entity, F.when(timed, "timed_entry").otherwise("walk_in_ok").alias("required"), F.col("_book").alias("booking_url"),
        F.when(~timed, F.lit(0)).alias("lead_time_hours"), F.when(F.col("_pass").isNotNull(), "dedicated_pass_holders_url").otherwise("unknown").alias("pass_holder_path"),
        F.col("_pass").alias("pass_holder_url"),
        F.when(timed, "timed-entry cue found").when(walk, "walk-in welcome").otherwise("no explicit reservation language; defaulted to walk_in_ok").alias("notes"),
        F.coalesce("_timed", "_walk").alias("source_phrase"))


# ---------------------------------------------------------------- visitor eligibility
def visitor_eligibility(text) -> Column:
    """STRUCT<rank,residency,scope,locals_free,note,source_phrase> of one page; lower rank is the stronger reading."""
    local = lambda h: F.concat(F.right(h["pre"], F.lit(25)), h["hit"], F.left(h["post"], F.lit(5)))
    genuine = lambda h: ~has(local(h), fx.RESIDENT_FALSE_POSITIVE)
    whole = lambda h: F.trim(F.concat(h["pre"], h["hit"], h["post"]))
    none = F.lit(None).cast("string")
    row = lambda rank, residency, scope, locals_free, note, phrase: F.struct(
        F.lit(rank).alias("rank"), F.lit(residency).alias("residency"), scope.alias("scope"), locals_free.alias("locals_free"), note.alias("note"),
        phrase.alias("source_phrase"))
    def state_row(h):
        return F.when(h.isNotNull() & genuine(h), let(whole(h), lambda w: row(1, "ma_resident", F.lit("MA"), has(w, fx.FREE_NEARBY), F.lit("MA residents mentioned"), w)))
    def town_row(h):
        town = grab(F.right(h["pre"], F.lit(60)), fx.PRECEDING_TOWN, 1, "")
        window = F.trim(F.concat(F.right(h["pre"], F.lit(90)), h["hit"], F.left(h["post"], F.lit(90))))
        return F.when(h.isNotNull(), let(town, lambda t: row(
            2, "none", t, F.lit(True), F.concat(F.lit("locals-free day mentioned for "), F.coalesce(t, F.lit("town residents"))), window)))
    def reading(b):
        real = b["real"]
        free = F.get(F.filter(real, lambda h: has(whole(h), fx.FREE_NEARBY)), F.lit(0))
        state = F.get(find_all(b["t"], fx.PAGE_MA_RESIDENT, "iU", 80, 80), F.lit(0))
        vague = row(3, "unknown", none, F.lit(False), F.lit("ambiguous residency mention, no free-admission association"), local(F.get(real, F.lit(0))))
        return F.when(F.size(real) > 0, F.coalesce(let(state, state_row), let(free, town_row), vague))
    silent = row(4, "unknown", none, F.lit(False), F.lit("no residency policy found on page"), none)
    hits = lambda t: F.filter(find_all(t, r"residents?\b", "iU", 100, 100), genuine)
    return F.coalesce(F.when(col(text).rlike("(?i)resident"), let(text, lambda t: bind(reading, t=t, real=hits(t)))), silent)


def extract_visitor_eligibility(df: DataFrame, entity: str, order: str, html: str) -> DataFrame:
    """Strongest reading over the pages of an entity, earliest page on equal strength."""
    return fold_visitors(df.withColumn("_t", html_text(html)).select(entity, order, visitor_eligibility("_t").alias("_v")), entity, order)


def fold_visitors(d: DataFrame, entity: str, order: str) -> DataFrame:
    """Readings of pages (_v) folded per entity."""
    return d.groupBy(entity).agg(F.min_by("_v", F.struct("_v.rank", order)).alias("_v")).select(
        entity, "_v.residency", "_v.scope", "_v.locals_free", "_v.note", "_v.source_phrase")


# ---------------------------------------------------------------- all facts of a page at once
FACTS = ("price", "hours", "reservation", "visitors")


def page_facts(df: DataFrame, entity: str, order: str, html: str) -> DataFrame:
    """Every fact of every page from one scan that strips a page once: (entity, order, kind, fact_no, price, hours, reservation, visitors).

    A row carries one kind (see FACTS) and its value in the column of that name, the others are null, so that the rows can be written
    partitioned by kind and each fold reads its own part (``facts_of``). Every page gives one reservation and one visitors row, one hours row per
    statement (at least one, for the season) and one price row per sum of money. A null page reads as one without text.
    """
    d = with_value(df.select(entity, order, F.coalesce(html, F.lit("")).alias("_html")), _t=html_text("_html"))
    dashed = F.regexp_replace("_t", fx.DASHES, "-")
    timed, walk, links = _reservation_cues("_t", "_html")
    d = with_value(d, _price=F.when(F.col("_t").contains("$"), _price_hits("_t")), _hours=let(dashed, _hours_of),
                   _res=F.struct(timed, walk, links), _vis=visitor_eligibility("_t"))
    statements = F.when(F.size("_hours.statements") > 0, F.col("_hours.statements")).otherwise(F.array(F.lit(None)))
    hours = F.transform(statements, lambda s: F.struct(F.col("_hours.season").alias("season"), s.alias("s")))
    values = {"price": F.col("_price"), "hours": hours, "reservation": F.array("_res"), "visitors": F.array("_vis")}
    null = {k: F.get(v, F.lit(-1)) for k, v in values.items()}  # of the kind's own type
    def tagged(kind):
        return F.transform(values[kind], lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("fact_no"), *[(v if o == kind else null[o]).alias(o) for o in FACTS]))
    always = [tagged(k) for k in FACTS[1:]]
    rows = F.concat(F.coalesce(tagged("price"), F.slice(always[0], 1, 0)), *always)
    return d.select(entity, order, F.explode(rows).alias("_f")).select(entity, order, "_f.*")


def facts_of(facts: DataFrame, kind: str, entity: str, order: str, max_price: float | None = None) -> DataFrame:
    """One kind of the rows of ``page_facts`` folded per entity, as its own extraction gives it."""
    d = facts.filter(F.col("kind") == kind)
    if kind == "price":
        return fold_prices(_priced(d.select(entity, order, F.col("fact_no").alias("token_no"), F.col("price").alias("_k")), [entity, order]), entity, order, max_price)
    if kind == "hours":
        return fold_hours(d.select(entity, order, "hours.season", "hours.s"), entity, order)
    if kind == "reservation":
        return fold_reservation(d.select(entity, order, "reservation._timed", "reservation._walk", F.col("reservation._l.booking_url").alias("_book"), F.col("reservation._l.pass_holder_url").alias("_pass")), entity, order)
    if kind == "visitors":
        return fold_visitors(d.select(entity, order, F.col("visitors").alias("_v")), entity, order)
    raise ValueError(f"kind {kind!r}")


# ---------------------------------------------------------------- links
def page_links(df: DataFrame, keys: Sequence[str], html: str, base: str) -> DataFrame:
    """Scored same-site links below the home page: (keys, url, score), best score per URL."""
    d = df.filter(F.col(html).contains("<a")).select(*keys, F.col(base).alias("_base"), F.explode(anchors(html, fx.ANCHOR_NO_FRAGMENT)).alias("_a"))
    d = d.select(*keys, "_base", squeeze(F.regexp_replace("_a.inner", fx.TAG, " ")).alias("_text"), absolute("_base", "_a.href").alias("_url"))
    bare = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    site = r"^(https?)://([^/?#]*)([^?#]*)"
    piece = lambda url, g: F.regexp_extract(url, site, g)
    d = d.filter(F.col("_url").rlike(r"^https?://") & (bare(piece(F.col("_url"), 2)) == bare(piece(F.col("_base"), 2))))
    d = d.withColumn("_path", F.regexp_replace(piece(F.col("_url"), 3), "/+$", "")).filter(F.col("_path") != "")
    d = d.filter(~F.col("_path").rlike(fx.LINK_FILE_EXCLUDED) & ~F.col("_path").rlike(fx.LINK_PATH_EXCLUDED))
    d = d.withColumn("score", link_score("_text", "_path")).filter(F.col("score") > 0)
    clean = F.concat(piece(F.col("_url"), 1), F.lit("://"), piece(F.col("_url"), 2), F.col("_path"))
    d = d.withColumn("url", clean).filter(F.col("url") != F.regexp_replace("_base", "/+$", ""))
    return d.groupBy(*keys, "url").agg(F.max("score").alias("score"))


def top_links(df: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    return ranked_top(df, keys, [F.col("score").desc(), F.col("url")], k, "link_no")


def fill_missing(entities: DataFrame, extracted: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Every entity once; those without a page get the default reading."""
    out = entities.select(key).distinct().join(extracted, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


NO_PAGE_VISITORS = {"residency": "unknown", "locals_free": False, "note": "no html available"}
NO_PAGE_RESERVATION = {"required": "walk_in_ok", "pass_holder_path": "unknown", "notes": "no html available"}
NO_PAGE_HOURS = dict.fromkeys(fx.WEEK, "unknown")


def segments(text, pattern: str) -> Column:
    """Pieces of a document, each starting at a header match and ending before the next one."""
    return F.filter(F.split(col(text), f"(?={pattern})", -1), lambda s: s.rlike(f"^{pattern}"))
