"""Inputs beyond any former limit, and values that can't be read."""

import time

from pyspark.sql import functions as F

from weftline.functions import dates, html, text
from weftline.functions.core import find_all
from weftline.operators import page_jobs, page_parsers, quality


def test_marker_and_blocks_are_read_from_the_whole_text(spark):
    page = "x" * 5000 + "<!-- source_url: http://late.example/ -->" + "".join(f"<p>Paragraph number {i} of a long policy page.</p>" for i in range(80)) + "<p>" + "long " * 1200 + "</p>"
    r = spark.createDataFrame([(page,)], "h string").select(text.source_marker("h").alias("m"), F.size(F.split(html.policy_text("h"), "\n")).alias("n"), F.size(F.split(html.policy_text("h", blocks=3), "\n")).alias("three")).first()
    assert (r["m"], r["n"], r["three"]) == ("http://late.example/", 81, 3)


def test_unreadable_values_do_not_end_the_job(spark):
    days = spark.createDataFrame([(["2026-Jul-04", "07-04", "2026-12-25"],)], "v array<string>").select(dates.restriction_days("v").alias("d")).first()["d"]
    assert [(d["month"], d["day"]) for d in days] == [(None, 4), (7, 4), (12, 25)]
    page = spark.createDataFrame([("e", 1, "<p>Call (6175551234-5). Adults $20</p>")], "entity string, page int, h string")
    assert [r["price"] for r in page_jobs.extract_prices(page, "entity", "page", "h").collect()] == [20.0]
    stamps = spark.createDataFrame([("a", "2026-01-01T00:00:00Z"), ("b", "soon"), ("c", "2026-01-01T00:01:00Z")], "t string, at string")
    assert quality.stamp_skew(stamps, "t", "at").first()["skew_seconds"] == 60
    fragment = "".join(f'<td class="s-lc-pass-day" data-date="{d}">x</td>' for d in ("2026-13-45", "2026-02-31"))
    for parse in (page_parsers.parse_calendar, page_parsers.parse_fragment, page_parsers.parse_fragment_two_state, page_parsers.parse_calendar_limited):
        parse(spark.createDataFrame([("k", fragment + '<td class="day day-has-openings" id="day-2026-13-45">1</td>')], "k string, h string"), ["k"], "h").collect()


def test_search_cost_follows_the_hits(spark):
    def took(n):
        d = spark.createDataFrame([("price $5 and ",)], "t string").select(F.repeat("t", n).alias("t"))
        start = time.perf_counter()
        r = d.select(F.size(h := find_all("t", r"\$\d", before=4)).alias("n"), F.element_at(h, -1)["at"].alias("last"), F.element_at(h, -1)["pre"].alias("pre")).first()
        assert (r["n"], r["last"], r["pre"]) == (n, 13 * (n - 1) + 6, "ice ")
        return time.perf_counter() - start

    took(100)
    assert took(8000) < 8


def test_index_page_reads_long_cards_and_no_neighbours(spark):
    card = lambda key, kind, pad, paras: f'<div class="museum-pass-pass-type">{kind}</div>{pad}<a href="https://l.example/museum-passes/by-museum/{key}/">See</a>{pad}' + (f"<h5>Pass Benefits</h5>{''.join(f'<p>{p}</p>' for p in paras)}</div></div>" if paras else "")
    many = [f"Benefit number {i}" for i in range(9)] + ["long " * 1000 + "end"]
    menu = "".join(f'<a href="/museum-passes/by-museum/{k}/">m</a>' for k in ("art", "bee", "cat", "by-date"))
    page = menu + card("art", "Circulating Pass", "." * 7000, many) + card("bee", "Printable/Digital Coupon Pass", "", []) + '<a href="/museum-passes/by-museum/cat/">See</a><a href="/museum-passes/by-museum/cat/">again</a><h5>Pass Benefits</h5><p>Cats get in free</p></div></div>'
    d = spark.createDataFrame([("k", page)], "k string, h string")
    got = {r["attraction_slug"]: r for r in page_parsers.parse_index_page(d, ["k"], "h").collect()}
    assert list(got) == ["art", "bee", "cat"]
    assert got["art"]["benefit_text"] == "\n".join(many) and got["art"]["source_phrases"] == many and got["art"]["pass_type_text"] == "Circulating Pass"
    assert got["bee"]["benefit_text"] is None and got["bee"]["pass_type_text"] == "Printable/Digital Coupon Pass"
    assert got["cat"]["benefit_text"] == "Cats get in free" and got["cat"]["pass_type_text"] is None


def test_calendar_cells_of_any_length(spark):
    pad = "<i>x</i>" * 2000
    cell = lambda day, classes, body: f'<div class="day day-{{}} day-2026-05-{day:02d}{classes}">{body}'
    two = "".join(cell(d, "", f'<div class="n">{pad}<span class="s-lc-pass-{s}">5</span></div> </div>').format("Tue") for d, s in ((5, "available"), (6, "unavailable"), (7, "available")))
    two += cell(8, "", '<div class="n">').format("Tue") + cell(9, "", '<span class="s-lc-pass-available">5</span></div></div>').format("Tue")
    d = spark.createDataFrame([("k", two)], "k string, h string")
    got = {str(r["day"])[-2:]: r["status"] for r in page_parsers.parse_fragment_two_state(d, ["k"], "h").collect()}
    assert got == {"05": "available", "06": "booked", "07": "available", "08": "booked", "09": "available"}
    mark = '<i class="time-partially-available"></i></div>'
    old = "".join(cell(d, " day-has-openings", body).format("tue") for d, body in ((5, pad + mark), (6, "</div>"), (7, mark), (8, "</div>")))
    d = spark.createDataFrame([("k", old)], "k string, h string")
    got = {str(r["day"])[-2:]: r["status"] for r in page_parsers.parse_calendar_limited(d, ["k"], "h").collect()}
    assert got == {"05": "limited", "06": "available", "07": "limited", "08": "available"}


def test_cell_ends_and_strict_cells(spark):
    """A cell's body has at least one character; a loose cell that is no strict one gives no row; of several dates the strict one counts."""
    cell = lambda day, body, more="": f'<div class="day day-Mon day-2026-05-{day}{more}"{body}'
    h = cell("01", "</div></div>s-lc-pass-available</div></div>") + cell("02", "><i class=s-lc-pass-available></div> </div>s-lc-pass-unavailable") + cell("03", ">\u0001s-lc-pass-available")
    d = spark.createDataFrame([(1, h)], "k int, h string")
    assert [r["status"] for r in page_parsers.parse_fragment_two_state(d, ["k"], "h").orderBy("day").collect()] == ["available", "available", "available"]
    old = ('<div class="day day-wed day-2026-05-01 day-has-openings day-2026-06-01">time-partially-available</div><div class="day x day-2026-05-02 day-has-openings">'
           '</div><div class="day day-thu day-2026-05-03 day-has-openings">time-partially-available</div>')
    got = page_parsers.parse_calendar_limited(spark.createDataFrame([(1, old)], "k int, h string"), ["k"], "h").orderBy("day").collect()
    assert [(str(r["day"])[-2:], r["status"]) for r in got] == [("01", "available"), ("03", "limited")]
