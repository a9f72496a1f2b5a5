"""Listing, detail and calendar pages -> rows. Items are cut out inside the row (no shuffle), then exploded as small structs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions.benefit import classify_pass_type_text, normalize_benefit, pass_type_from_body, pass_type_from_detail
from weftline.functions.core import bind, col, find_all, first_hits, grab, grab_all, has, let, map_codes, squeeze, swap, text_or_null
from weftline.functions.html import html_text, strip_tags
from weftline.functions.text import slugify, title_case, unescape, url_key
from weftline.operators.keys import first_per
from weftline.operators.page_jobs import segments


_CUT = "\u0001"


def _rows(df: DataFrame, keys: Sequence[str], items: Column) -> DataFrame:
    return df.select(*keys, F.posexplode(items).alias("pos", "_i")).select(*keys, "pos", "_i.*")


def _cut_at(html: str, pattern: str, **groups: int) -> Column:
    """STRUCT<first,cells>: the text before the first match, and for each match its groups, itself (`hit`) and the text up to the next one (`after`).

    The text is searched twice whatever the number of groups; groups are read from the matches.
    """
    def cut(t):
        cells = lambda b: F.transform(b["hits"], lambda h, i: F.struct(*[F.regexp_extract(h, pattern, g).alias(n) for n, g in groups.items()], h.alias("hit"), F.get(b["pieces"], i + 1).alias("after")))
        return bind(lambda b: F.struct(F.get(b["pieces"], F.lit(0)).alias("first"), cells(b).alias("cells")), hits=grab_all(t, pattern, 0), pieces=F.split(swap(t, pattern, _CUT), _CUT))
    return let(F.replace(F.col(html), F.lit(_CUT), F.lit(" ")), cut)


# ---------------------------------------------------------------- by-museum index
def parse_index_page(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """One row per pass link: key, title, URL, benefit text (all paragraphs), pass type nearest before the link.

    The page is cut at its links: a pass has what lies between its link and the next link of another pass, and its type stands between
    the link before and its own. Of several such parts (a menu, say) the first that says something counts.
    """
    h = F.col(html)
    def step(acc, x):  # neighbouring links of one pass make one part
        last = F.get(acc, F.size(acc) - 1)
        part = lambda url, text: F.array(F.struct(x["key"].alias("key"), url.alias("url"), text.alias("text")))
        return F.when(last["key"] == x["key"], F.concat(F.slice(acc, 1, F.size(acc) - 1), part(last["url"], F.concat(last["text"], x["hit"], x["after"])))).otherwise(F.concat(acc, part(x["url"], x["after"])))
    def read(b):
        def one(x, i):
            before = F.when(i == 0, b["first"]).otherwise(F.get(b["parts"], i - 1)["text"])
            paras = F.transform(grab_all(F.regexp_extract(x["text"], fx.INDEX_BENEFITS, 1), fx.PARAGRAPH, 1), lambda p: strip_tags(p))
            kinds = F.regexp_extract_all(before, F.lit(fx.INDEX_PASS_TYPE), F.lit(1))
            return F.struct(x["key"].alias("key"), x["url"].alias("url"), F.filter(paras, lambda p: F.length(p) > 5).alias("paras"), F.when(F.size(kinds) > 0, strip_tags(F.element_at(kinds, -1))).alias("kind"))
        return F.transform(b["parts"], one)
    parts = lambda cells: F.aggregate(cells, F.array().cast("array<struct<key:string,url:string,text:string>>"), step)
    read_parts = let(_cut_at(html, fx.INDEX_LINK, url=1, key=2), lambda c: bind(read, first=c["first"], parts=parts(c["cells"])))
    def item(a, parts):
        own = F.filter(parts, lambda p: p["key"] == a["key"])
        paras = F.coalesce(F.get(F.filter(own, lambda p: F.size(p["paras"]) > 0), F.lit(0))["paras"], F.array().cast("array<string>"))
        return F.struct(a["key"].alias("attraction_slug"), a["url"].alias("detail_url"), paras.alias("source_phrases"),
                        F.when(F.size(paras) > 0, F.array_join(paras, "\n")).alias("benefit_text"), F.get(F.filter(own, lambda p: p["kind"].isNotNull()), F.lit(0))["kind"].alias("pass_type_text"))
    items = let(read_parts, lambda parts: F.transform(first_hits(parts, lambda a: a["key"]), lambda a: item(a, parts)))
    d = _rows(df.filter(h.contains("/museum-passes/by-museum/")), keys, items)
    return d.withColumns({"title": title_case(F.replace("attraction_slug", F.lit("-"), F.lit(" "))), "pass_type": classify_pass_type_text("pass_type_text")})


# ---------------------------------------------------------------- calendars
def cell_status(classes) -> Column:
    """Status of a calendar cell from its class list; NULL for grid padding."""
    def read(t):
        on = lambda c: t.contains(f" {c} ")
        return F.when(~on("day-blank"), F.when(on("day-has-openings"), "available").when(on("day-past"), "closed")
                      .when(on("day-unavailable"), "unavailable").when(on("day-no-openings"), "booked").otherwise("unavailable"))
    return let(F.concat(F.lit(" "), F.regexp_replace(col(classes), "[\t\n\r]", " "), F.lit(" ")), read)


def _first_days(cells: Column) -> Column:
    return first_hits(F.filter(cells, lambda c: c["status"].isNotNull()), lambda c: c["day"])


def parse_calendar(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """Calendar page -> (day, status); the first real cell of a day counts."""
    cells = F.transform(grab_all(html, fx.CALENDAR_CELL, 1), lambda c: F.struct(F.regexp_extract(c, fx.CELL_DAY, 0).alias("day"), cell_status(c).alias("status")))
    return _rows(df, keys, _first_days(cells)).withColumn("day", F.col("day").try_cast("date"))


def parse_fragment(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """Calendar fragment -> (day, status) in the common vocabulary; neighbouring months' cells are dropped."""
    raw = F.arrays_zip(*[grab_all(html, fx.FRAGMENT_DAY, g).alias(n) for g, n in ((1, "c"), (3, "b"))])
    def cell(x):
        token = F.nullif(F.regexp_extract(x["b"], fx.FRAGMENT_STATUS, 1), F.lit(""))
        status = F.coalesce(map_codes(token, fx.FRAGMENT_STATUS_MAP), F.lit("unavailable"))
        other = x["c"].contains("day-other-month") & x["c"].rlike(r"(?:^|\s)day-other-month(?:\s|$)")
        return F.struct(F.regexp_extract(x["c"], fx.CELL_DAY, 0).alias("day"), F.when(~other, status).alias("status"))
    return _rows(df, keys, _first_days(F.transform(raw, cell))).withColumn("day", F.col("day").try_cast("date"))


def parse_fragment_two_state(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """Older reading of the fragment: available or booked; past and other-month cells skipped, last cell of a day counts. A cell ends where the next one begins at the latest."""
    kept = F.filter(_cut_at(html, fx.OLD_FRAGMENT_DAY, d=1, c=2)["cells"], lambda x: ~x["c"].contains("other-month") & ~x["c"].contains("day-past"))
    free = lambda b: b.contains("s-lc-pass-available") & ~b.contains("s-lc-pass-unavailable") & ~b.contains("s-lc-pass-not-yet-available")
    def body(after):  # at least one character, then up to the cell's end
        return let(F.regexp_instr(after.substr(F.lit(2), F.length(after)), F.lit(fx.OLD_FRAGMENT_END)), lambda n: F.when(n > 0, after.substr(F.lit(1), n)).otherwise(after))
    cells = F.transform(kept, lambda x: F.struct(x["d"].alias("day"), let(body(x["after"]), lambda b: F.when(free(b), "available").otherwise("booked")).alias("status")))
    return _rows(df, keys, F.reverse(first_hits(F.reverse(cells), lambda c: c["day"]))).withColumn("day", F.col("day").try_cast("date"))


def parse_calendar_limited(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """Older calendar: available / booked, upgraded to 'limited' where a partial-availability mark follows before the next cell.

    Every strict cell is also one of the loose cells, with the same beginning and end, so a page is searched once; it is cut only where it has a mark.
    """
    marked = F.filter(_cut_at(html, fx.OLD_ANY_CELL, d=1)["cells"], lambda x: x["after"].contains("time-partially-available"))
    partial = F.when(F.col(html).contains("time-partially-available"), F.transform(marked, lambda x: x["d"])).otherwise(F.array().cast("array<string>"))
    def cell(hit, partial):
        def read(x):
            status = F.when(x["c"].contains("day-has-openings"), "available").when(x["c"].contains("day-no-openings"), "booked")
            hidden = (x["d"] == "") | x["c"].contains("day-past") | x["c"].contains("day-blank")
            limited = (status == "available") & F.array_contains(partial, x["d"])
            return F.struct(x["d"].alias("day"), F.when(~hidden, F.when(limited, "limited").otherwise(status)).alias("status"))
        return bind(read, d=F.regexp_extract(hit, fx.OLD_CELL, 1), c=F.regexp_extract(hit, fx.OLD_CELL, 2))
    cells = F.filter(bind(lambda b: F.transform(b["hits"], lambda h: cell(h, b["partial"])), hits=grab_all(html, fx.OLD_ANY_CELL, 0), partial=partial), lambda c: c["status"].isNotNull())
    return _rows(df, keys, F.reverse(first_hits(F.reverse(cells), lambda c: c["day"]))).withColumn("day", F.col("day").try_cast("date"))


# ---------------------------------------------------------------- pass listing and detail
def parse_pass_links(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """Listing page -> one row per pass id; button links are skipped in favour of the title link."""
    raw = F.arrays_zip(*[grab_all(html, fx.PASS_LINK, g).alias(n) for g, n in ((1, "url"), (2, "id"), (3, "t"))])
    usable = F.filter(raw, lambda a: (a["id"] != "passes") & (F.trim(a["t"]) != "") & ~F.lower(F.trim(a["t"])).isin(*fx.BUTTON_TITLES))
    d = _rows(df, keys, first_hits(usable, lambda a: a["id"]))
    d = d.withColumn("title", F.trim(unescape("t")))
    return d.select(*keys, "pos", F.col("id").alias("pass_id"), "title", slugify("title").alias("attraction_slug"),
                    F.when(F.col("url").startswith("http"), F.col("url")).alias("detail_url"))


def parse_pass_detail(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """Detail page -> title, name, address, website, benefit text, pass type, museum id, short label, status."""
    h = F.col(html)
    start = F.regexp_instr(h, F.lit(fx.DETAIL_TITLE))
    after = F.when(start > 0, h.substr(start + F.length(F.regexp_extract(h, fx.DETAIL_TITLE, 0)), F.length(h))).otherwise(h)
    foot = F.regexp_instr(after, F.lit(fx.DETAIL_FOOTER))
    body = F.when(foot > 0, after.substr(F.lit(1), foot - 1)).otherwise(after)
    d = df.withColumns({
        "_title": F.trim(unescape(strip_tags(F.regexp_extract(h, fx.DETAIL_TITLE, 1)))),
        "address": F.trim(unescape(strip_tags(grab(html, fx.DETAIL_ADDRESS, 1, "")))),
        "_paras": F.array_join(F.transform(grab_all(body, fx.PARAGRAPH, 1), lambda p: squeeze(F.regexp_replace(F.regexp_replace(p, fx.SCRIPT_STYLE, " "), fx.TAG, " "))), "\u0001")})
    d = d.withColumn("_paras", F.split(unescape("_paras"), "\u0001"))
    paras = F.filter(F.transform("_paras", squeeze), lambda p: (p != "") & ~has(p, fx.SKIPPED_PARAGRAPH) & ~p.eqNullSafe(F.col("address")))
    d = d.withColumn("benefits_text", F.array_join(paras, " "))
    d = d.withColumn("_kind", pass_type_from_detail("_title", "benefits_text")).withColumn("_label", normalize_benefit("benefits_text"))
    name = text_or_null(F.trim(swap("_title", fx.TITLE_PAREN, "")))
    status = F.when(name.isNull(), "failed:parse:no_title").when(F.col("benefits_text") == "", "failed:parse:no_description").otherwise("ok")
    return d.select(*keys, F.col("_title").alias("title_raw"), name.alias("museum_name"), "address", grab(html, fx.DETAIL_WEBSITE, 1, "").alias("website"),
                    "benefits_text", F.col("_kind.pass_type").alias("pass_type"), F.col("_kind.raw").alias("pass_type_raw"),
                    F.regexp_extract(h, fx.DETAIL_MUSEUM_ID, 1).alias("museum_hex"), F.col("_label.label").alias("label"),
                    F.col("_label.label_class").alias("label_class"), status.alias("status"))


def museum_id(html) -> Column:
    return grab(html, r"(?i)museum\s*:\s*['\"]([a-f0-9]{8,})['\"]", 1, "")


# ---------------------------------------------------------------- two-theme index
def clean_detail_text(block) -> Column:
    """Benefit of a detail block: leading address, phone and link text off, trailing call-to-action (repeated) off."""
    text = squeeze(unescape(swap(block, fx.TAG, " ")))
    text = F.trim(F.regexp_replace(text, fx.LEAD_ADDRESS, ""))
    text = F.trim(F.regexp_replace(text, fx.LEAD_VISIT, ""))
    return F.trim(F.regexp_replace(text, fx.TAIL_ACTION, ""))


def parse_two_theme_index(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """Museum buttons of either theme with the id before (first theme) or after (second theme) the name, and the benefit of that id."""
    h = F.col(html)
    number = lambda x: F.regexp_extract(x["hit"], fx.MUSEUM_ID, 1)
    def named(ids, pattern, place, step):
        """Every name with the id next to it. Ids and names are merged by position once; name j at merged place p has p - j ids before it."""
        def one(b):
            spot = lambda at, is_id: F.struct(at.alias("at"), F.lit(is_id).alias("is_id"))
            merged = F.sort_array(F.concat(F.transform(b["found"], lambda n: spot(place(n), 0)), F.transform(ids, lambda x: spot(x["at"], 1))))
            spots = F.filter(F.transform(merged, lambda m, p: F.struct(m["is_id"].alias("is_id"), p.alias("p"))), lambda m: m["is_id"] == 0)
            musid = lambda s, j: number(F.get(ids, F.get(s, j)["p"] - j + step))
            return let(spots, lambda s: F.transform(b["found"], lambda n, j: F.struct(F.regexp_extract(n["hit"], pattern, 1).alias("name"), musid(s, j).alias("musid"))))
        return bind(one, found=find_all(h, pattern, ""))
    names = lambda ids: F.when(h.rlike(fx.THEME1_NAME), named(ids, fx.THEME1_NAME, lambda n: n["at"], -1)).otherwise(
        named(ids, fx.THEME2_NAME, lambda n: n["at"] + F.length(n["hit"]), 0))
    blocks = F.map_from_entries(F.reverse(first_hits(F.reverse(F.arrays_zip(grab_all(html, fx.DETAIL_BLOCK, 1).alias("k"), grab_all(html, fx.DETAIL_BLOCK, 2).alias("v"))),
                                                     lambda e: e["k"])))
    def with_block(b):
        known = F.filter(names(b["ids"]), lambda n: F.length(n["musid"]) > 0)
        return F.transform(known, lambda n: F.struct(n["name"].alias("name"), n["musid"].alias("musid"), F.try_element_at(b["blocks"], n["musid"]).alias("block")))
    items = bind(with_block, ids=find_all(h, fx.MUSEUM_ID, ""), blocks=blocks)
    d = _rows(df, keys, items).withColumn("title", F.trim(unescape("name"))).filter(F.col("title") != "")
    d = d.withColumn("attraction_slug", slugify("title")).withColumn("benefit_text", F.coalesce(clean_detail_text("block"), F.lit("")))
    d = d.select(*keys, "pos", "title", "attraction_slug", "musid", F.concat(F.lit("?musID="), F.col("musid")).alias("reserve_query"), "benefit_text")
    return first_per(d, [*keys, "attraction_slug"], [F.col("pos")])


def parse_two_theme_detail(df: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """Pass type and label of a detail body."""
    return df.withColumn("_k", pass_type_from_body(html_text(body))).withColumn("_l", normalize_benefit(html_text(body))) \
        .select(*keys, F.col("_k.pass_type").alias("pass_type"), F.col("_k.raw").alias("pass_type_raw"), F.col("_l.label").alias("label"), F.col("_l.label_class").alias("label_class"))


# ---------------------------------------------------------------- listing blocks with JSON-LD
JSON_LD_SCHEMA = "name string, address string, telephone string, url string, description string"


def parse_listing_blocks(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """Listing page cut at each location header; structured data first, headings and anchors as fallback."""
    d = df.select(*keys, F.posexplode(segments(html, fx.LISTING_BLOCK)).alias("pos", "_b"))
    d = d.withColumn("_json", F.trim(unescape(F.regexp_extract("_b", fx.JSON_LD, 1))))
    d = d.withColumn("_ld", F.from_json("_json", JSON_LD_SCHEMA))
    d = d.withColumn("_desc", unescape(F.col("_ld.description"))).withColumn("_name", unescape(F.col("_ld.name")))
    d = d.withColumn("_head", unescape(F.coalesce(grab("_b", fx.H3, 1, ""), grab("_b", fx.H4, 1, ""))))
    d = d.withColumn("_raw_type", unescape(grab("_b", fx.INDEX_PASS_TYPE, 1, ""))).withColumn("_benefit", unescape(grab("_b", fx.LISTING_BENEFITS, 1, "")))
    cats = F.transform(grab_all(F.regexp_extract("_b", fx.LISTING_CATEGORIES, 1), fx.CATEGORY_ITEM, 1), lambda c: squeeze(c))
    kind = F.coalesce(*[F.when(F.lower(F.trim("_raw_type")).startswith(t), F.lit(k)) for t, k in fx.PASS_TYPE_TEXT.items()], F.lit("unknown"))
    out = d.select(*keys, "pos", F.regexp_extract("_b", fx.LISTING_BLOCK, 1).alias("slug"),
                   F.coalesce(text_or_null("_name"), strip_tags("_head")).alias("museum_name"), F.col("_ld.address").alias("address"), F.col("_ld.telephone").alias("phone"),
                   F.coalesce(text_or_null(F.col("_ld.url")), grab("_b", fx.LISTING_WEBSITE, 1, "")).alias("website"), strip_tags("_desc").alias("description"),
                   cats.alias("categories"), F.coalesce(strip_tags("_raw_type"), F.lit("")).alias("pass_type_raw"), kind.alias("pass_type"),
                   F.coalesce(strip_tags("_benefit"), F.lit("")).alias("benefits_text"))
    status = (F.when(F.col("museum_name").isNull(), "failed:parse:no_name")
              .when((F.col("benefits_text") == "") & (F.col("pass_type") == "unknown"), "failed:parse:empty_panel").otherwise("ok"))
    return out.withColumn("status", status)


# ---------------------------------------------------------------- branch rosters
ROSTER_SCHEMA = "entities struct<branches:map<string,struct<name:string,code:string>>>, branches struct<items:array<string>>"


def parse_roster_json(df: DataFrame, keys: Sequence[str], body: str, prefix: str, library: str) -> DataFrame:
    """Gateway response -> branches: listed codes in order (all entities when none are listed), own ones only, service desks out."""
    j = F.from_json(F.col(body), ROSTER_SCHEMA)
    ents = F.coalesce(j["entities"]["branches"], F.create_map().cast("map<string,struct<name:string,code:string>>"))
    listed = j["branches"]["items"]
    codes = F.when(F.size(listed) > 0, listed).otherwise(F.map_keys(ents))
    items = F.transform(codes, lambda c: F.struct(c.alias("item"), F.try_element_at(ents, c).alias("e")))
    d = _rows(df, keys, items).select(*keys, "pos", F.coalesce("e.code", "item").alias("code"), F.col("e.name").alias("_raw"))
    own = F.lower(F.ltrim("_raw")).startswith(prefix.lower())
    d = d.filter(F.col("_raw").isNotNull() & own).withColumn("name", F.trim(swap(F.trim("_raw"), rf"^{prefix}\s*-\s*", "", "i")))
    d = d.filter(~F.lower("name").contains("delivery desk")).withColumn("slug", slugify("name", ""))
    d = first_per(d, [*keys, "slug"], [F.col("pos")])
    return d.select(*keys, "pos", F.concat(F.lit(f"{library}-"), F.col("slug")).alias("id"), F.lit(library).alias("library_id"), "name", "code")


def _roster(df: DataFrame, keys: Sequence[str], names: Column, library: str) -> DataFrame:
    """Named headings -> branch rows, first per key."""
    d = _rows(df, keys, first_hits(F.filter(names, lambda n: n["slug"] != ""), lambda n: n["slug"]))
    return d.select(*keys, "pos", F.concat(F.lit(f"{library}-"), F.col("slug")).alias("id"), F.lit(library).alias("library_id"), "name")


def parse_roster_sections(df: DataFrame, keys: Sequence[str], html: str, library: str) -> DataFrame:
    """Main building from its <h2>, then every '<... Branch>' title heading of the location section."""
    scope = F.coalesce(grab(html, fx.SECTION_LIST, 1, ""), F.col(html))
    pair = lambda slug, name: F.struct(slug.alias("slug"), name.alias("name"))
    main = F.when(scope.rlike(fx.MAIN_H2), F.array(pair(F.lit("main"), F.lit("Main Library")))).otherwise(F.array().cast("array<struct<slug:string,name:string>>"))
    titles = F.filter(F.transform(grab_all(scope, fx.TITLE_H3, 1), lambda t: squeeze(t)), lambda t: F.lower(t).endswith("branch"))
    rest = F.transform(titles, lambda t: pair(slugify(F.regexp_replace(t, " [Bb]ranch$", ""), ""), t))
    return _roster(df, keys, F.concat(main, rest), library)


def parse_roster_headings(df: DataFrame, keys: Sequence[str], html: str, library: str, known: Sequence[str]) -> DataFrame:
    """Top headings that are on the list of known branch names."""
    names = F.filter(F.transform(grab_all(html, fx.H1, 1), lambda t: squeeze(F.regexp_replace(t, fx.TAG, ""))), lambda t: F.lower(t).isin(*known))
    return _roster(df, keys, F.transform(names, lambda t: F.struct(slugify(t, "").alias("slug"), t.alias("name"))), library)


def parse_roster_links(df: DataFrame, keys: Sequence[str], html: str, library: str) -> DataFrame:
    raw = F.arrays_zip(grab_all(html, fx.LOCATION_LINK, 1).alias("slug"), grab_all(html, fx.LOCATION_LINK, 2).alias("name"))
    return _roster(df, keys, F.transform(raw, lambda r: F.struct(r["slug"].alias("slug"), F.trim(r["name"]).alias("name"))), library)


# parser per page kind, for callers that dispatch on a platform column
CALENDAR_PARSERS = {"wizard": parse_calendar, "libcal": parse_fragment}
LISTING_PARSERS = {"wizard": parse_index_page, "libcal": parse_pass_links, "login": parse_two_theme_index}


def parse_calendars(df: DataFrame, keys: Sequence[str], platform: str, html: str) -> DataFrame:
    """Calendar pages of several platforms, each read by its own parser."""
    parts = [parse(df.filter(F.col(platform) == name), [*keys, platform], html) for name, parse in CALENDAR_PARSERS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def rebuild_rows(refs: DataFrame, url: str, raw: DataFrame, raw_key: str) -> tuple[DataFrame, DataFrame]:
    """Catalog URLs with a retained raw page (joined on the URL hash) and the ones without (skipped)."""
    d = refs.withColumn("_k", url_key(url))
    r = raw.withColumnRenamed(raw_key, "_k")
    return d.join(r, "_k", "inner").drop("_k"), d.join(r.select("_k").distinct(), "_k", "left_anti").drop("_k")
