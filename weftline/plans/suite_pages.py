"""Jobs and parsers over pages: the crawled pages themselves, and pages laid out from table columns."""

import uuid

from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions import core, html, text
from weftline.operators import page_jobs as J
from weftline.operators import page_parsers as P
from weftline.operators.layout import with_value
from weftline.plans.derived import spread, view
from weftline.plans.registry import query
from weftline.plans.suite_keys import UNESC
from weftline.session import checkpoint_dir
from weftline.sources import json_split, scans
from weftline.sources.scans import keyed_by_path

V = view
BIG = lambda c: c.cast("bigint")
S = lambda c: F.col(c).cast("string")

# ---------------------------------------------------------------- the crawled pages
TEXT_SQL = "trim(regexp_replace(" + UNESC.format(r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')") + r", '\s+', ' ', 'g'))"


@query("page_text", f"SELECT page_id, length(t) AS size, md5(t) AS digest FROM (SELECT page_id, {TEXT_SQL} AS t FROM {{pages}})")
def page_text(spark, sf):
    d = spread(spark, sf, "pages").withColumn("t", html.html_text("html"))
    return d.select("page_id", F.length("t").alias("size"), F.md5("t").alias("digest"))


PARAGRAPHS_SQL = r"""regexp_replace(regexp_replace(array_to_string(list_transform(string_split(""" + UNESC.format(
    r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<head\b.*?</head>', ' ', 'g'),
    '(?s)<!--.*?-->', ' ', 'g'), '(?i)</(p|div|section|li|h[1-6]|tr|article|header|footer|br)>', chr(10), 'g'), '<[^>]+>', ' ', 'g')""") + r""", chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x{00A0}]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query("page_paragraphs", "SELECT page_id, md5(" + PARAGRAPHS_SQL + ") AS digest FROM {pages}")
def page_paragraphs(spark, sf):
    d = with_value(spread(spark, sf, "pages"), body=html.paragraph_body("html"))  # stripped once: for the entities and for the text
    return d.select("page_id", F.md5(html.paragraphs_of("body")).alias("digest"))


@query("page_lines", r"""SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(""" + UNESC.format(
    r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', chr(10), 'g')") + r""", chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS digest FROM {pages}""")
def page_lines(spark, sf):
    d = with_value(spread(spark, sf, "pages"), body=html.line_body("html"))
    return d.select("page_id", F.md5(html.lines_of("body")).alias("digest"))


@query("page_metadata", r"SELECT page_id, trim(regexp_extract(html, '(?i)<title>([^<]+)</title>', 1)) AS title, CASE page_id % 3 WHEN 0 THEN concat('https://cdn.example/', page_id, '.jpg') WHEN 1 THEN concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), '/img/', page_id, '.jpg') END AS image FROM {pages}")
def page_metadata(spark, sf):
    k = F.col("page_id") % 3
    head = (F.when(k == 0, F.concat(F.lit('<meta property="og:image" name=x content="https://cdn.example/'), S("page_id"), F.lit('.jpg">')))
            .when(k == 1, F.concat(F.lit("<meta content='/img/"), S("page_id"), F.lit(".jpg' property='og:image'/>"))).otherwise(""))
    d = spread(spark, sf, "pages").withColumn("h", F.concat(head, "html"))
    return d.select("page_id", html.page_title("h").alias("title"), html.og_image("h", "url").alias("image"))


@query("source_marker", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'late' END AS source_url FROM {pages}")
def source_marker(spark, sf):
    body = F.concat(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<!-- source_url: "), "url", F.lit(" -->\n"))).otherwise(F.lit("." * 300)), F.when(F.col("page_id") % 2 == 1, F.lit("<!-- source_url: late -->")).otherwise(""), "html")
    return spread(spark, sf, "pages").select("page_id", text.source_marker(body).alias("source_url"))


LINKS = r"""(SELECT page_id, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), regexp_replace(href, '/+$', '')) AS link, concat(lower(t), ' ', lower(regexp_replace(href, '/+$', ''))) AS blob FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"#?]*)"[^>]*>(.*?)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="(/[^"#?]*)"[^>]*>(.*?)</a>', 2)) AS t FROM {pages}) WHERE href <> '/')"""
SCORE = "(" + " + ".join(f"CASE WHEN contains(blob, '{w}') THEN {n} ELSE 0 END" for w, n in fx.LINK_KEYWORDS.items()) + ")"


@query("page_links", rf"""SELECT page_id, link AS url, max(score) AS score FROM (SELECT page_id, link, {SCORE.replace('blob', "concat(blob, ' opening hours')")} AS score FROM {LINKS} l) WHERE score > 0 GROUP BY ALL""")
def page_links(spark, sf):
    d = spread(spark, sf, "pages").withColumn("html", F.regexp_replace("html", "</a>", " opening hours</a>"))
    return J.page_links(d, ["page_id"], "html", "url")


@query("top_links", rf"""SELECT page_id, url, score, link_no FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS link_no FROM (SELECT page_id, link AS url, max(score) AS score FROM (SELECT page_id, link, {SCORE.replace('blob', "concat(blob, ' visit')")} AS score FROM {LINKS} l) GROUP BY ALL)) WHERE link_no <= 3""")
def top_links(spark, sf):
    d = spread(spark, sf, "pages").withColumn("html", F.regexp_replace("html", "</a>", " visit</a>"))
    return J.top_links(J.page_links(d, ["page_id"], "html", "url"), ["page_id"])


@query("anchor_list", r"""SELECT page_id, unnest(range(len(h))) AS link_no, unnest(h) AS href, md5(unnest(t)) AS text_md5 FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]+)">(.*?)</a>', 1) AS h,
    regexp_extract_all(html, '<a href="([^"]+)">(.*?)</a>', 2) AS t FROM {pages})""")
def anchor_list(spark, sf):
    d = spread(spark, sf, "pages").select("page_id", F.posexplode(html.anchors("html")).alias("link_no", "_a"))
    return d.select("page_id", BIG(F.col("link_no")).alias("link_no"), "_a.href", F.md5("_a.inner").alias("text_md5"))


@query("document_segments", r"""SELECT page_id, unnest(range(len(p))) AS segment_no, md5(concat('<p>', unnest(p))) AS segment_md5 FROM (SELECT page_id, string_split(html, '<p>')[2:] AS p FROM {pages})""")
def document_segments(spark, sf):
    d = spread(spark, sf, "pages").select("page_id", F.posexplode(J.segments("html", "<p>")).alias("segment_no", "_s"))
    return d.select("page_id", BIG(F.col("segment_no")).alias("segment_no"), F.md5("_s").alias("segment_md5"))


@query("evidence_rows", r"""SELECT regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, CAST(page_id AS VARCHAR) AS page, url AS source_url,
    md5(concat('=== ', page_id, ' ===', chr(10), 'source_url: ', url, chr(10), chr(10), """ + PARAGRAPHS_SQL + ")) AS chunk_md5 FROM {pages}")
def evidence_rows(spark, sf):
    d = spread(spark, sf, "pages").withColumn("lang", core.grab("html", r'<html lang="([a-z]*)"', 1, "")).withColumn("page", S("page_id"))
    return J.evidence_rows(d, "lang", "page", "html", "url").select("lang", "page", "source_url", F.md5("chunk").alias("chunk_md5"))


@query("evidence_manifest", "SELECT s_suppkey, (SELECT count(*) FROM {pages} WHERE page_id % 100 + 1 = s_suppkey) AS pages_inspected FROM {supplier}")
def evidence_manifest(spark, sf):
    pages = V(spark, sf, "pages").select((F.col("page_id") % 100 + 1).alias("s_suppkey"))
    return J.evidence_manifest(V(spark, sf, "supplier").select("s_suppkey"), pages, "s_suppkey")


@query("body_slice", f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('About ', page_id) ELSE md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) END AS body FROM {{pages}}")
def body_slice(spark, sf):
    even = F.col("page_id") % 2 == 0
    h = F.when(even, F.concat("html", F.lit('<div class=x id="s-lc-pass-desc"> <b>About</b> '), S("page_id"), F.lit("</div>"))).otherwise(F.col("html"))
    d = spread(spark, sf, "pages").withColumn("h", h)
    return d.select("page_id", F.when(even, html.body_slice("h")).otherwise(F.md5(html.body_slice("h"))).alias("body"))


@query("json_map_rows", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS value, 'k' AS key, count(*) AS n FROM {events} GROUP BY 1")
def json_map_rows(spark, sf):
    d = scans.explode_map(V(spark, sf, "events").select("props"), "props", "bigint")
    return d.groupBy("value", "key").agg(F.count("*").alias("n"))


@query("tolerant_json", "SELECT user_id % 10 AS grp, count(*) FILTER (event_type <> 'error') AS good, count(*) FILTER (event_type = 'error') AS bad FROM {events} GROUP BY 1")
def tolerant_json(spark, sf):
    d = V(spark, sf, "events").select((F.col("user_id") % 10).alias("grp"), F.when(F.col("event_type") == "error", F.lit('{"k": ')).otherwise(F.col("props")).alias("raw"))
    good, bad = scans.parse_tolerant(d, "raw", "k bigint")
    both = good.select("grp", F.lit(1).alias("g")).unionByName(bad.select("grp", F.lit(0).alias("g")))
    return both.groupBy("grp").agg(BIG(F.sum("g")).alias("good"), BIG(F.sum(1 - F.col("g"))).alias("bad"))


@query("unknown_json_fields", "SELECT concat('x', user_id % 3) AS field, count(*) AS n FROM {events} GROUP BY 1")
def unknown_json_fields(spark, sf):
    raw = F.concat(F.lit('{"x'), (F.col("user_id") % 3).cast("string"), F.lit('": 1, "k": 2}'))
    return scans.unknown_fields(V(spark, sf, "events").select(raw.alias("raw")), "raw", "k bigint")


@query("variant_schema_lock", """SELECT path, n FROM (SELECT 'inner.y' AS path, count(*) FILTER (user_id % 3 = 0) AS n FROM {events} UNION ALL SELECT 'items[].z', count(*) FILTER (user_id % 5 = 0) FROM {events}
    UNION ALL SELECT concat('x', g), n FROM (SELECT event_id % 4 AS g, count(*) AS n FROM {events} GROUP BY 1)) WHERE n > 0""")
def variant_schema_lock(spark, sf):
    e = V(spark, sf, "events")
    inner = F.when(F.col("user_id") % 3 == 0, '"inner": {"a": 1, "y": {"deep": null}}, ').otherwise('"inner": {"a": 2}, ')
    items = F.when(F.col("user_id") % 5 == 0, '"items": [{"a": 1}, {"z": "q"}], ').otherwise('"items": [], ')
    raw = F.concat(F.lit('{"x'), (F.col("event_id") % 4).cast("string"), F.lit('": null, '), inner, items, F.lit('"k": '), S("event_id"), F.lit("}"))
    return scans.unknown_paths(e.select(raw.alias("raw")), "raw", "k bigint, inner struct<a:bigint>, items array<struct<a:bigint>>")


@query("override_records", """SELECT kind, id, field, status, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN concat('{"n":', id, '}') WHEN CAST(id AS BIGINT) % 3 = 1 THEN id ELSE value END AS value, 'desk' AS source FROM {d_override} o""")
def override_records(spark, sf):
    """Correction records as JSON, whose corrected value is an object, a number or a string."""
    d, no = V(spark, sf, "d_override"), F.col("id").cast("bigint") % 3
    value = F.when(no == 0, F.concat(F.lit('{"n":'), "id", F.lit("}"))).when(no == 1, F.col("id")).when(F.col("value").isNull(), "null").otherwise(F.concat(F.lit('"'), "value", F.lit('"')))
    raw = F.concat(F.lit('{"status": "'), "status", F.lit('", "source": "desk", "corrected_value": '), value, F.lit("}"))
    return scans.override_records(d.select("kind", "id", "field", raw.alias("raw")), "raw").select("kind", "id", "field", "status", "value", "source")


@query("seed_rows", """SELECT o_orderkey, unnest([concat('a', o_custkey), concat('b', o_custkey)]) AS id, unnest([o_orderpriority, NULL]) AS town FROM {orders} WHERE o_orderkey % 4 < 3""")
def seed_rows(spark, sf):
    """Seed lists, bare, wrapped or broken."""
    one = F.concat(F.lit('[{"id": "a'), S("o_custkey"), F.lit('", "town": "'), "o_orderpriority", F.lit('"}, {"id": "b'), S("o_custkey"), F.lit('"}]'))
    raw = F.when(F.col("o_orderkey") % 4 == 3, "{").when(F.col("o_orderkey") % 2 == 0, one).otherwise(F.concat(F.lit('{"libraries": '), one, F.lit("}")))
    return scans.seed_rows(V(spark, sf, "orders").select("o_orderkey", raw.alias("raw")), "raw", "id string, town string", "libraries")


@query("keyed_by_file_name", "SELECT concat('lib', o_custkey % 10) AS library_id, count(*) AS n, count(*) AS n_keyed FROM {orders} GROUP BY 1")
def keyed_by_file_name(spark, sf):
    """The key is cut out of a path such as .../<library>__<key>.json, as the keyed scan does."""
    path = F.concat(F.lit("/raw/x/lib"), (F.col("o_custkey") % 10).cast("string"), F.lit("__part-"), S("o_orderkey"), F.lit(".json"))
    d = keyed_by_path(V(spark, sf, "orders").select("o_orderkey", path.alias("_path")), r"([^/]+)__part-([^/]+)\.json$", ["library_id", "key"])
    return d.groupBy("library_id").agg(F.count("*").alias("n"), F.count_if(F.col("key") == S("o_orderkey")).alias("n_keyed"))


@query("rebuild_from_raw", "SELECT count(*) FILTER (url IN (SELECT url FROM {pages} WHERE url LIKE 'https:%')) AS rebuilt, count(*) FILTER (url NOT LIKE 'https:%') AS skipped FROM {pages}")
def rebuild_from_raw(spark, sf):
    p = spread(spark, sf, "pages")
    raw = p.filter("url LIKE 'https:%'").select(text.url_key("url").alias("k")).distinct()
    done, skipped = P.rebuild_rows(p.select("page_id", "url"), "url", raw, "k")
    one = done.select(F.lit(1).alias("r")).unionByName(skipped.select(F.lit(0).alias("r")))
    return one.agg(BIG(F.sum("r")).alias("rebuilt"), BIG(F.sum(1 - F.col("r"))).alias("skipped"))


# ---------------------------------------------------------------- venue pages laid out from the parts
def venue_pages(spark, sf):
    k = F.col("p_partkey") % 5
    size, key = S("p_size"), S("p_partkey")
    price = (F.when(k == 0, F.concat(F.lit("<p>Admission: Adults $"), size, F.lit(", Children (1-15) $2.</p>")))
             .when(k == 1, F.concat(F.lit("<p>Parking fee: $5 per vehicle for all guests who come by car to see us.</p><p>General entry on all days. Seniors pay $"), size, F.lit(".50</p>")))
             .when(k == 2, F.concat(F.lit("<ul><li>$"), size, F.lit(" &#8211; Students</li></ul><p>Become a member: membership is $99 a year.</p>")))
             .when(k == 3, F.concat(F.lit("<p>Pay it Forward: $40. Standard: $"), size, F.lit("</p>"))).otherwise("<p>Free entry.</p>"))
    return spread(spark, sf, "part").select("p_partkey", "p_size", F.lit(0).alias("page"), F.concat(F.lit("<html><script>var x = '$7 adults';</script>"), price, F.lit("<i>"), key, F.lit("</i></html>")).alias("html"))


@query("page_prices", """SELECT p_partkey, 'adult' AS audience, CAST(p_size AS DOUBLE) AS price, 1 AS age_min, 15 AS age_max FROM {part} WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'child', 2.0, 1, 15 FROM {part} WHERE p_partkey % 5 = 0
    UNION ALL SELECT p_partkey, 'senior', p_size + 0.5, NULL, NULL FROM {part} WHERE p_partkey % 5 = 1 UNION ALL SELECT p_partkey, 'student', p_size, NULL, NULL FROM {part} WHERE p_partkey % 5 = 2
    UNION ALL SELECT p_partkey, 'adult', p_size, NULL, NULL FROM {part} WHERE p_partkey % 5 = 3""")
def page_prices(spark, sf):
    d = J.extract_prices(venue_pages(spark, sf), "p_partkey", "page", "html")
    return d.select("p_partkey", "audience", "price", F.col("age_range.min").alias("age_min"), F.col("age_range.max").alias("age_max"))


@query("nearest_audience", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'senior' ELSE 'child' END AS label FROM {part}")
def nearest_audience(spark, sf):
    d = spread(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "adults enter for free but seniors $5 and kids later").otherwise("families are welcome any time: $5 kids, or seniors").alias("ctx"))
    return J.nearest_label(d.withColumn("at", F.position(F.lit("$"), F.col("ctx")) - 1), "ctx", "at").select("p_partkey", "label")


HOURS_SQL = {"monday": "CASE k WHEN 0 THEN 'closed' WHEN 1 THEN '10:00-17:00' WHEN 2 THEN '09:00-16:00' WHEN 3 THEN 'unknown' WHEN 4 THEN '09:00-17:00' WHEN 5 THEN '11:00-17:00' WHEN 6 THEN 'closed' ELSE 'unknown' END",
             "tuesday": "CASE k WHEN 0 THEN '09:00-17:00' WHEN 1 THEN '10:00-17:00' WHEN 2 THEN '09:00-16:00' WHEN 3 THEN 'unknown' WHEN 4 THEN '09:00-17:00' WHEN 5 THEN 'closed' WHEN 6 THEN 'closed' ELSE 'unknown' END",
             "friday": "CASE k WHEN 0 THEN '09:00-17:00' WHEN 1 THEN '10:00-17:00' WHEN 2 THEN '09:00-16:00' WHEN 3 THEN '09:00-17:00' WHEN 4 THEN '09:00-17:00' ELSE 'unknown' END",
             "sunday": "CASE k WHEN 0 THEN '09:00-17:00' WHEN 1 THEN '10:00-17:00' WHEN 2 THEN 'unknown' WHEN 3 THEN 'unknown' WHEN 4 THEN '13:00-17:00' WHEN 6 THEN 'closed' ELSE 'unknown' END"}


@query("page_hours", "SELECT p_partkey, " + ", ".join(f"{v} AS {d}" for d, v in HOURS_SQL.items()) + ", CASE WHEN k = 3 THEN 5 END AS start_month, CASE WHEN k = 3 THEN 10 END AS end_month FROM (SELECT p_partkey, p_partkey % 8 AS k FROM {part})")
def page_hours(spark, sf):
    k = F.col("p_partkey") % 8
    body = (F.when(k == 0, "Tuesday-Sunday 9:00-17:00. Closed Mondays.").when(k == 1, "Open daily from 10 a.m. to 5 p.m. Ship: Wednesday - Friday 9-5")
            .when(k == 2, "9am – 4pm | Monday – Friday").when(k == 3, "Open May - October. Friday and Saturday: 9 - 5").when(k == 4, "Weekdays: 9 - 5. Weekends: 1 - 5 pm")
            .when(k == 5, "Monday: 11:00am-5:00pm, Tuesday: Closed").when(k == 6, "Sunday - Tuesday: CLOSED").otherwise("Camp for ages, Friday 8 - 12 kids"))
    d = spread(spark, sf, "part").select("p_partkey", F.lit(0).alias("page"), F.concat(F.lit("<p>"), body, F.lit("</p><i>#</i>")).alias("html"))
    d = J.extract_hours(d, "p_partkey", "page", "html")
    return d.select("p_partkey", *HOURS_SQL, F.col("seasonal.start_month").alias("start_month"), F.col("seasonal.end_month").alias("end_month"))


@query("page_reservation", """SELECT p_partkey, CASE WHEN k = 0 THEN 'timed_entry' ELSE 'walk_in_ok' END AS required, CASE k WHEN 0 THEN concat('https://www.eventbrite.com/e/', p_partkey) WHEN 1 THEN '/tickets/now' END AS booking_url, CASE WHEN k <> 0 THEN 0 END AS lead_time_hours,
    CASE WHEN k = 2 THEN '/info/pass' END AS pass_holder_url, CASE k WHEN 0 THEN 'timed-entry cue found' WHEN 1 THEN 'walk-in welcome' ELSE 'no explicit reservation language; defaulted to walk_in_ok' END AS notes FROM (SELECT p_partkey, p_partkey % 4 AS k FROM {part})""")
def page_reservation(spark, sf):
    k = F.col("p_partkey") % 4
    body = (F.when(k == 0, F.concat(F.lit('<a href="mailto:book">x</a><p>Timed entry required.</p><a href="https://www.eventbrite.com/e/'), S("p_partkey"), F.lit('">Go</a>')))
            .when(k == 1, '<p>Walk-ins welcome!</p><a href="javascript:/book">no</a> <a class=b href="/tickets/now">Buy</a>').when(k == 2, '<a href="/info/pass">Library <b>Passes</b></a>').otherwise("<p>Hello</p>"))
    d = spread(spark, sf, "part").select("p_partkey", F.explode(F.array(F.struct(F.lit(1).alias("page"), F.lit("<p>About us</p>").alias("html")), F.struct(F.lit(0).alias("page"), body.alias("html")))).alias("x")).select("p_partkey", "x.*")
    return J.extract_reservation(d, "p_partkey", "page", "html").select("p_partkey", "required", "booking_url", "lead_time_hours", "pass_holder_url", "notes")


@query("page_visitor_eligibility", """SELECT p_partkey, CASE k WHEN 0 THEN 'ma_resident' WHEN 1 THEN 'none' ELSE 'unknown' END AS residency, CASE k WHEN 0 THEN 'MA' WHEN 1 THEN concat('Salem', p_size) END AS scope, k <= 1 AS locals_free,
    CASE k WHEN 0 THEN 'MA residents mentioned' WHEN 1 THEN concat('locals-free day mentioned for Salem', p_size) WHEN 2 THEN 'ambiguous residency mention, no free-admission association' ELSE 'no residency policy found on page' END AS note FROM (SELECT p_partkey, p_size, p_partkey % 5 AS k FROM {part})""".replace("concat('Salem', p_size)", "'Salem-Town'").replace("for Salem', p_size)", "for ', 'Salem-Town')"))
def page_visitor_eligibility(spark, sf):
    k = F.col("p_partkey") % 5
    body = (F.when(k == 0, "Free admission for Massachusetts residents on Sundays").when(k == 1, "On the first Monday admission is free for all our Salem-Town residents")
            .when(k == 2, "Many residents visit us each year").when(k == 3, "Vice President for life; our resident otter; Nevada residents see the notice").otherwise("Welcome"))
    d = spread(spark, sf, "part").select("p_partkey", F.lit(0).alias("page"), F.concat(F.lit("<p>"), body, F.lit("</p> # "), S("p_partkey")).alias("html"))
    return J.extract_visitor_eligibility(d, "p_partkey", "page", "html").select("p_partkey", "residency", "scope", "locals_free", "note")


def venue_site(spark, sf):
    """Four pages per part: prices, hours, reservations, residency."""
    k, key = F.col("p_partkey"), S("p_partkey")
    hours = F.when(k % 3 == 0, "Tuesday-Sunday 9:00-17:00. Closed Mondays.").when(k % 3 == 1, "Open daily from 10 a.m. to 5 p.m.").otherwise("Ask at the desk.")
    visit = F.when(k % 4 == 0, F.concat(F.lit('<p>Timed entry required.</p><a href="https://www.eventbrite.com/e/'), key, F.lit('">Go</a>'))).when(k % 4 == 1, "<p>Walk-ins welcome!</p>").otherwise("<p>Hello</p>")
    who = F.when(k % 5 == 0, "Free admission for Massachusetts residents on Sundays").when(k % 5 == 2, "Many residents visit us each year").otherwise("Welcome")
    price = venue_pages(spark, sf).select("p_partkey", "page", "html")
    rest = spread(spark, sf, "part").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(i).alias("page"), F.concat(F.lit("<div>"), body, F.lit("</div>")).alias("html")) for i, body in enumerate([hours, visit, who], 1)])).alias("x"))
    return price.unionByName(rest.select("p_partkey", "x.*"))


@query("page_facts", """SELECT p_partkey, 'price' AS kind, concat(audience, ' ', CAST(price * 100 AS BIGINT)) AS fact FROM (SELECT p_partkey, 'adult' AS audience, CAST(p_size AS DOUBLE) AS price FROM {part} WHERE p_partkey % 5 IN (0, 3) UNION ALL SELECT p_partkey, 'child', 2.0 FROM {part} WHERE p_partkey % 5 = 0
    UNION ALL SELECT p_partkey, 'senior', p_size + 0.5 FROM {part} WHERE p_partkey % 5 = 1 UNION ALL SELECT p_partkey, 'student', p_size FROM {part} WHERE p_partkey % 5 = 2)
    UNION ALL SELECT p_partkey, 'hours', CASE p_partkey % 3 WHEN 0 THEN 'closed 09:00-17:00' WHEN 1 THEN '10:00-17:00 10:00-17:00' ELSE 'unknown unknown' END FROM {part}
    UNION ALL SELECT p_partkey, 'reservation', CASE p_partkey % 4 WHEN 0 THEN concat('timed_entry https://www.eventbrite.com/e/', p_partkey) ELSE 'walk_in_ok -' END FROM {part}
    UNION ALL SELECT p_partkey, 'visitors', CASE p_partkey % 5 WHEN 0 THEN 'ma_resident MA' ELSE 'unknown -' END FROM {part}""")
def page_facts(spark, sf):
    """All facts of four pages per part from one pass over the pages, stored by kind, each kind folded from its own files."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/weftline-facts-{uuid.uuid4().hex}"
    facts = J.page_facts(venue_site(spark, sf), "p_partkey", "page", "html")
    facts.write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(facts.schema).parquet(path)
    of = lambda kind, fact: J.facts_of(stored, kind, "p_partkey", "page").select("p_partkey", F.lit(kind).alias("kind"), fact.alias("fact"))
    two = lambda a, b: F.concat_ws(" ", a, F.coalesce(b, F.lit("-")))
    return (of("price", two(F.col("audience"), F.round(F.col("price") * 100).cast("bigint").cast("string"))).unionByName(of("hours", two(F.col("monday"), F.col("sunday"))))
            .unionByName(of("reservation", two(F.col("required"), F.col("booking_url")))).unionByName(of("visitors", two(F.col("residency"), F.col("scope")))))


# ---------------------------------------------------------------- JSON files written from tables, read by the splitting readers
def _json_parts(spark, df, order, body, first, last):
    """One JSON document over all rows of a table, written by many tasks in the order of a key: texts between commas."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/weftline-json-{uuid.uuid4().hex}"
    lo, hi = (df.agg(f(order).alias(order)).withColumn(mark, F.lit(True)) for f, mark in ((F.min, "_lo"), (F.max, "_hi")))
    d = df.join(lo, order, "left").join(hi, order, "left")
    text = F.concat(F.when(F.col("_lo"), first).otherwise(""), body, F.when(F.col("_hi"), last).otherwise("\n"))
    d.select(order, text.alias("value")).repartitionByRange(order).sortWithinPartitions(order).select("value").write.option("lineSep", ",").text(path)
    return path


@query("big_json_map", """SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status, concat('a,b] "', o_orderpriority, '{') AS note, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS n_tags FROM {orders}""")
def big_json_map(spark, sf):
    """One map over all orders, its values with commas, brackets and quotes inside strings, in files cut anywhere at a comma."""
    tags = F.when(F.col("o_orderkey") % 3 == 0, '["x,y", {"z": [1, 2]}]').otherwise("[]")
    body = F.concat(F.lit('"'), S("o_orderkey"), F.lit('": {"status": "'), "o_orderstatus", F.lit('", "note": "a,b] \\"'), "o_orderpriority", F.lit('{", "tags": '), tags, F.lit("}"))
    path = _json_parts(spark, V(spark, sf, "orders"), "o_orderkey", body, "{", "}\n")
    d = json_split.scan_big_map(spark, path, "folder").withColumn("_v", F.from_json("value", "status string, note string, tags array<string>"))
    return d.select("pos", "key", "_v.status", "_v.note", F.size("_v.tags").alias("n_tags"))


@query("big_json_list", """SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS pos, c_custkey AS id, c_mktsegment AS town FROM {customer}""")
def big_json_list(spark, sf):
    body = F.concat(F.lit('{"id": '), S("c_custkey"), F.lit(', "town": "'), "c_mktsegment", F.lit('", "more": {"a": [1, 2]}}'))
    path = _json_parts(spark, V(spark, sf, "customer"), "c_custkey", body, "[\n", "]")
    return json_split.scan_big_list(spark, path, "id bigint, town string", "folder").select("pos", "id", "town")


@query("catalog_scan", """SELECT CAST(library_id AS VARCHAR) AS library_id, platform, CAST(row_number() OVER (PARTITION BY library_id ORDER BY attraction_rawslug) - 1 AS INTEGER) AS pos, attraction_rawslug AS slug, p_type AS kind FROM {d_catalog}""")
def catalog_scan(spark, sf):
    """Catalog documents, one per library in a folder per platform, written and read back by the catalog reader."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/weftline-catalog-{uuid.uuid4().hex}"
    d = V(spark, sf, "d_catalog").groupBy("platform", S("library_id").alias("library_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("attraction_rawslug").alias("slug"), F.col("p_type").alias("kind")))).alias("passes"))
    for platform in ("wizard", "libcal", "login"):
        d.filter(F.col("platform") == platform).select("library_id", "passes").write.json(f"{root}/{platform}/catalog")
    return scans.scan_exploded(spark, f"{root}/*/catalog/*.json", "library_id string, passes array<struct<slug:string,kind:string>>", "passes", lines=True)


# ---------------------------------------------------------------- listing pages laid out from the suppliers, nations and customers
@query("index_page", """SELECT p_partkey, pos, concat(kind, '-', p_partkey) AS attraction_slug, concat(upper(kind[1]), kind[2:], ' ', p_partkey) AS title, CASE WHEN kind = 'art' THEN concat('Admits ', p_size, ' people.', chr(10), 'Enjoy the day.') END AS benefit_text, CASE WHEN kind = 'art' THEN 'physical-circ' ELSE 'digital' END AS pass_type
    FROM {part}, (SELECT 'art' AS kind, 0 AS pos UNION ALL SELECT 'zoo', 1)""")
def index_page(spark, sf):
    key, n = S("p_partkey"), S("p_size")
    card = lambda kind, ptype, benefits: F.concat(F.lit(f'<div class="museum-pass-pass-type"><strong>Type:</strong> {ptype}</div><a href="https://l.example/museum-passes/by-museum/{kind}-'), key, F.lit('/">See</a>'), benefits)
    art = card("art", "Circulating Pass", F.concat(F.lit("<h5>Pass Benefits</h5><p>Admits "), n, F.lit(" people.</p><p>Hi</p><p>Enjoy <b>the</b> day.</p></div></div>")))
    zoo = card("zoo", "Printable/Digital Coupon Pass", F.lit("<p>none</p>"))
    again = F.concat(F.lit('<form action="/museum-passes/by-museum/art-'), key, F.lit('/"></form><a href="/museum-passes/by-museum/by-date/">d</a>'))
    d = spread(spark, sf, "part").select("p_partkey", F.concat(art, zoo, again).alias("html"))
    return P.parse_index_page(d, ["p_partkey"], "html").select("p_partkey", "pos", "attraction_slug", "title", "benefit_text", "pass_type")


@query("pass_link_list", """SELECT s_suppkey, concat('abc', s_suppkey, x) AS pass_id, concat('Zoo & Park ', s_suppkey, x) AS title, concat('zoo-park-', s_suppkey, lower(x)) AS attraction_slug, CASE WHEN x = 'A' THEN concat('https://h.example/passes/abc', s_suppkey, x) END AS detail_url FROM {supplier}, (SELECT unnest(['A', 'B']) AS x)""")
def pass_link_list(spark, sf):
    k = S("s_suppkey")
    link = lambda host, x, t: F.concat(F.lit(f'<a class="t" href="{host}/passes/abc'), k, F.lit(f'{x}" id=1>'), t, F.lit("</a>"))
    title = lambda x: F.concat(F.lit(" Zoo &amp; Park "), k, F.lit(x))
    h = F.concat(link("https://h.example", "A", F.lit("Book Now")), link("https://h.example", "A", title("A")), link("", "B", title("B")), link("", "B", F.lit("Again")), F.lit('<a href="/passes/passes">All</a>'))
    d = V(spark, sf, "supplier").select("s_suppkey", h.alias("html"))
    return P.parse_pass_links(d, ["s_suppkey"], "html").drop("pos")


@query("pass_detail_page", """SELECT s_suppkey, concat('Museum ', s_suppkey) AS museum_name, concat(s_suppkey, ' Main St, Boston') AS address, concat('https://m', s_suppkey, '.example') AS website, concat('Admits ', s_suppkey + 1, ' people at $5 per person. Must be returned.') AS benefits_text,
    'physical-circ' AS pass_type, '(physical)' AS pass_type_raw, 'ab12' AS museum_hex, '$5' AS label, 'price' AS label_class, 'ok' AS status FROM {supplier}""")
def pass_detail_page(spark, sf):
    k = S("s_suppkey")
    h = F.concat(F.lit("<script>springyPage = { a: 1, museum: 'ab12' }</script><p>before</p><h1 class=x id=\"s-lc-public-pt\"> <b>Museum "), k, F.lit(" (Physical)</b></h1><p class=\"s-lc-pass-address\">"), k, F.lit(" Main St, Boston</p><p>"), k,
                 F.lit(" Main St, Boston</p><a rel=1 href=\"https://m"), k, F.lit(".example\" class=\"s-lc-museum-link\">w</a><p>Directions to us</p><p>Admits "), (F.col("s_suppkey") + 1).cast("string"), F.lit(" people at $5 per&nbsp;person.</p><p>Must be returned.</p><footer><p>late</p></footer>"))
    d = P.parse_pass_detail(V(spark, sf, "supplier").select("s_suppkey", h.alias("html")), ["s_suppkey"], "html")
    return d.drop("title_raw")


@query("two_theme_index", """SELECT s_suppkey, pos, concat('Art House ', pos, ' ', s_suppkey) AS title, CAST(s_suppkey * 10 + pos AS VARCHAR) AS musid, CASE WHEN pos = 0 THEN concat('Admits ', s_suppkey, ' people.') ELSE '' END AS benefit_text FROM {supplier}, (SELECT unnest([0, 1]) AS pos)""")
def two_theme_index(spark, sf):
    k = S("s_suppkey")
    mid = lambda i: (F.col("s_suppkey") * 10 + i).cast("string")
    name = lambda i: F.concat(F.lit(f"Art House {i} "), k)
    old = lambda i: F.concat(F.lit('<a href="?musID='), mid(i), F.lit('"><span class="museumButtonName"> '), name(i), F.lit(" </span></a>"))
    new = lambda i: F.concat(F.lit('<div class="mk2ButtonName"><p> '), name(i), F.lit('</p></div><a href="?musID='), mid(i), F.lit('">Check Dates</a>'))
    detail = F.concat(F.lit('<div class="row collapse" id="detail'), mid(0), F.lit('"><p>308 Main Street Boston, MA (617) 426-6500 Get Directions</p><p>Admits '), k, F.lit(" people.</p> <a>Learn More</a> Check Dates <div class=\"page_header\"></div>"))
    h = F.when(F.col("s_suppkey") % 2 == 0, F.concat(old(0), old(1), detail)).otherwise(F.concat(new(0), new(1), detail))
    d = V(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("<body>"), h, F.lit("</body>")).alias("html"))
    return P.parse_two_theme_index(d, ["s_suppkey"], "html").select("s_suppkey", "pos", "title", "musid", "benefit_text")


@query("detail_body_class", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'physical-circ' WHEN 1 THEN 'physical-coupon' WHEN 2 THEN 'digital' ELSE 'unknown' END AS pass_type, CASE s_suppkey % 4 WHEN 1 THEN '25% off' ELSE '' END AS label FROM {supplier}")
def detail_body_class(spark, sf):
    body = F.expr("CASE s_suppkey % 4 WHEN 0 THEN '<p>Please return it to the library</p>' WHEN 1 THEN '<p>One-time use, 25% discount</p>' WHEN 2 THEN '<p>Emailed to you</p>' ELSE '<p>Hi</p>' END")
    return P.parse_two_theme_detail(V(spark, sf, "supplier").withColumn("b", F.concat(body, F.lit("<i>"), "s_name", F.lit("</i>"))), ["s_suppkey"], "b").select("s_suppkey", "pass_type", "label")


@query("listing_blocks", """SELECT s_suppkey, pos, concat('m', pos, '-', s_suppkey) AS slug, CASE WHEN pos = 0 THEN concat('Tom & Art ', s_suppkey) ELSE concat('Plain ', s_suppkey) END AS museum_name, CASE WHEN pos = 0 THEN '617' END AS phone, CASE WHEN pos = 0 THEN 'https://ld.example' ELSE 'https://a.example' END AS website,
    CASE WHEN pos = 0 THEN 'Art,Zoo' ELSE '' END AS categories, CASE WHEN pos = 0 THEN 'digital' ELSE 'unknown' END AS pass_type, CASE WHEN pos = 0 THEN 'Admits all .' ELSE '' END AS benefits_text, CASE WHEN pos = 0 THEN 'ok' ELSE 'failed:parse:empty_panel' END AS status FROM {supplier}, (SELECT unnest([0, 1]) AS pos)""")
def listing_blocks(spark, sf):
    k = S("s_suppkey")
    a = F.concat(F.lit('<div class="location museum museum-m0-'), k, F.lit('"><script type="application/ld+json">{"name": "Tom &amp; Art '), k, F.lit('", "telephone": "617", "url": "https://ld.example", "address": {"city": "Boston"}}</script><p class="museum-pass-categories"><strong>C:</strong> <a href=1>Art</a> <a href=2> Zoo</a></p>'
                 '<p class="museum-pass-pass-type"><strong>Type</strong> Printable/Digital Coupon Pass</p><h5>Pass Benefits</h5> <p>Admits <b>all</b>.</p><form id=1></div>'))
    b = F.concat(F.lit('<div class="location museum museum-m1-'), k, F.lit('"><h3>Plain '), k, F.lit('</h3><a href="https://a.example" rel=1 aria-label="Visit Plain website">w</a></div>'))
    d = V(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("<h1>All</h1>"), a, b).alias("html"))
    d = P.parse_listing_blocks(d, ["s_suppkey"], "html")
    return d.select("s_suppkey", "pos", "slug", "museum_name", "phone", "website", F.array_join("categories", ",").alias("categories"), "pass_type", "benefits_text", "status")


@query("branch_roster_json", """SELECT s_suppkey, concat('bpl-west-', s_suppkey) AS id, concat('West ', s_suppkey) AS name, 'w1' AS code FROM {supplier} UNION ALL SELECT s_suppkey, 'bpl-central', 'Central', 'c1' FROM {supplier}""")
def branch_roster_json(spark, sf):
    body = F.concat(F.lit('{"entities": {"branches": {"w1": {"name": "BPL- West '), S("s_suppkey"), F.lit('", "code": "w1"}, "c1": {"name": "BPL - Central", "code": "c1"}, "d1": {"name": "BPL- Central Delivery Desk"}, "x": {"name": "Malden"}}}, "branches": {"items": ["c1", "w1", "d1", "x", "zz"]}}'))
    d = P.parse_roster_json(V(spark, sf, "supplier").withColumn("b", body), ["s_suppkey"], "b", "BPL", "bpl")
    return d.select("s_suppkey", "id", "name", "code")


@query("branch_roster_headings", """SELECT s_suppkey, 'cambridge-main' AS id, 'Main Library' AS name FROM {supplier} UNION ALL SELECT s_suppkey, concat('cambridge-north-', s_suppkey), concat('North ', s_suppkey, ' Branch') FROM {supplier} UNION ALL SELECT s_suppkey, 'brookline-putterham', 'Putterham' FROM {supplier} UNION ALL SELECT s_suppkey, concat('x-b', s_suppkey), 'East' FROM {supplier}""")
def branch_roster_headings(spark, sf):
    k = S("s_suppkey")
    h = F.concat(F.lit('<h3 class="title">Stray Branch</h3><section class="a libraryLocationList"><h2> Main Library </h2><h3 class="b title"> North  '), k, F.lit(' Branch </h3><h3 class="title">Reading Room</h3></section><h1>Visiting</h1><h1><span>Putterham</span></h1><a href="/locations/b'), k, F.lit('/"> East </a>'))
    d = V(spark, sf, "supplier").select("s_suppkey", h.alias("html"))
    cols = ["s_suppkey", "id", "name"]
    a = P.parse_roster_sections(d, ["s_suppkey"], "html", "cambridge").select(cols)
    b = P.parse_roster_headings(d, ["s_suppkey"], "html", "brookline", ["brookline village", "coolidge corner", "putterham"]).select(cols)
    return a.unionByName(b).unionByName(P.parse_roster_links(d, ["s_suppkey"], "html", "x").select(cols))


@query("museum_id", "SELECT s_suppkey, concat('abcdef', s_suppkey + 10) AS museum_id FROM {supplier}")
def museum_id(spark, sf):
    h = F.concat(F.lit("<script>x = {museum : 'abcdef"), (F.col("s_suppkey") + 10).cast("string"), F.lit("'}</script>"))
    return V(spark, sf, "supplier").select("s_suppkey", P.museum_id(h).alias("museum_id"))


@query("grouped_pages_order", "SELECT page_id // 7 AS entity, page_id, row_number() OVER (PARTITION BY page_id // 7 ORDER BY CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END, CAST(page_id AS VARCHAR)) AS place FROM {pages}")
def grouped_pages_order(spark, sf):
    """Every page of every entity with its place."""
    from pyspark.sql import Window
    name = F.when(F.col("page_id") % 2 == 0, S("page_id")).otherwise(F.concat(F.lit("__"), S("page_id")))
    d = spread(spark, sf, "pages").select(F.expr("page_id div 7").alias("entity"), "page_id", name.alias("name"))
    return d.select("entity", "page_id", F.row_number().over(Window.partitionBy("entity").orderBy(J.page_order("name"))).alias("place"))
