"""Relational operators on small rows: precedence, ties, NULLs, gates and order."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import benefit, dates, labels, text, weekly
from weftline.operators import calendars as C
from weftline.operators import consensus, diff
from weftline.operators import keys as K
from weftline.operators import matching as M
from weftline.operators import overlay as O
from weftline.operators import quality as Q


def one_col(df):
    return sorted(r[0] for r in df.collect())


ALIASES = [("tin-harbor-lanterns", "tin-harbor-lanterns"), ("lantern-quay", "tin-harbor-lanterns"), ("harbor-islands-ferry", "harbor-ferry"), ("harbor-islands", "harbor-islands")]
SLUGS = [("tin-harbor-lanterns-e-coupon", "tin-harbor-lanterns"), ("copper-kite-loft-digital", "copper-kite-loft-digital"), ("harbor-islands-ferry", "harbor-ferry"), ("lantern-quay-digital-coupon-pass", "tin-harbor-lanterns"),
         ("harbor-islands", "harbor-islands"), ("-digital", "-digital")]


def test_canonical_key(spark):
    a = spark.createDataFrame(ALIASES, "raw string, canonical string")
    d = K.canonical_key(spark.createDataFrame(SLUGS, "slug string, want string"), "slug", a)
    assert d.count() == len(SLUGS) and d.filter("canonical <> want").count() == 0


def test_lookup_first_keeps_existing_record_with_nulls(spark):
    f = spark.createDataFrame([("a", "b")], "k1 string, k2 string")
    dim = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    assert K.lookup_first(f, dim, [["k1"], ["k2"]], ["k"], ["v"]).first()["v"] is None
    assert K.lookup_first(f.withColumn("k1", F.lit("zz")), dim, [["k1"], ["k2"]], ["k"], ["v"]).first()["v"] == "x"


def votes(spark, values):
    rows = [("m", f"l{i}", v) for i, v in enumerate(values)]
    return consensus.consensus(spark.createDataFrame(rows, "e string, voter string, v int"), "e", "voter", "v")


def test_consensus(spark):
    assert votes(spark, [2, 2, 2, 2, 2, 3]).first()["free_under_age"] == 3
    assert votes(spark, [2, 2]).count() == 0
    assert votes(spark, [1, 2, 3]).count() == 0
    assert votes(spark, [5, 5, 2, 2]).first()["free_under_age"] == 3  # tie: the smaller value
    d = spark.createDataFrame([("m", "a", 5), ("m", "a", 2), ("m", "b", 2), ("m", "c", 2)], "e string, voter string, v int")
    assert consensus.consensus(d, "e", "voter", "v").first()["n_voters"] == 3


def test_override_null_overwrites_and_notes_are_ignored(spark):
    d = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, s string, n int")
    o = spark.createDataFrame([("a", "s", "corrected", None), ("b", "s", "noted", "zz"), ("b", "n", "corrected", "7")], "id string, field string, status string, value string")
    r = {x["id"]: x for x in O.apply_overrides(d, "id", o, {"s": "string", "n": "int"}).collect()}
    assert (r["a"]["s"], r["a"]["n"], r["b"]["s"], r["b"]["n"]) == (None, 1, "y", 7)


def test_consolidated_source_wins(spark):
    cols = "kind string, id string, field string, status string, value string"
    a = spark.createDataFrame([("p", "1", "f", "corrected", "tree"), ("p", "2", "f", "corrected", "tree")], cols)
    b = spark.createDataFrame([("p", "1", "f", "verified_ok", None)], cols)
    r = {x["id"]: (x["status"], x["value"]) for x in O.effective_overrides(a, b).collect()}
    assert r == {"1": ("verified_ok", None), "2": ("corrected", "tree")}


def test_text_change_ignores_whitespace(spark):
    rows = lambda t, k: spark.createDataFrame([("f", "a", t), ("f", k, "z")], "file string, slug string, benefits_text string")
    d = diff.snapshot_diff(rows("Pass admits 4.  ", "new"), rows("Pass\nadmits\n4", "old"), ["file", "slug"], [], ["benefits_text"])
    assert sorted((r["slug"], r["change"]) for r in d.collect()) == [("new", "added"), ("old", "removed")]


def test_null_safe_field_change(spark):
    mk = lambda v: spark.createDataFrame([("f", "a", v)], "file string, slug string, label string")
    r = diff.snapshot_diff(mk(None), mk("x"), ["file", "slug"], ["label"]).first()
    assert (r["field"], r["from"], r["to"]) == ("label", "x", None)
    assert diff.snapshot_diff(mk(None), mk(None), ["file", "slug"], ["label"]).count() == 0


def test_merge_days_closed_is_weak(spark):
    d = spark.createDataFrame([("p", "d1", "available", 1), ("p", "d1", "closed", 2), ("p", "d2", "closed", 1), ("p", "d2", "booked", 0), ("p", "d3", "closed", 1)], "p string, day string, status string, page int")
    assert {r["day"]: r["status"] for r in C.merge_days(d, ["p", "day"], "status", "page").collect()} == {"d1": "available", "d2": "booked", "d3": "closed"}
    assert {r["day"]: r["status"] for r in C.merge_days(d, ["p", "day"], "status", "page", sticky=False).collect()}["d1"] == "closed"


def test_attempts(spark):
    late = [("c", day, "unknown") for day in range(1, 9)] + [("c", 9, "accepted")]
    d = spark.createDataFrame([("a", 1, "unknown"), ("a", 2, "accepted"), ("a", 3, "rejected_resident"), ("b", 1, "unknown"), ("b", 2, "format_error"), *late], "k string, day int, verdict string")
    r = {x["k"]: x for x in C.fold_attempts(d, ["k"], "day", "verdict").collect()}
    assert (r["a"]["verdict"], r["a"]["probed_at"], r["a"]["evidence"]) == ("accepted", 2, None)
    assert (r["c"]["verdict"], r["c"]["probed_at"], r["c"]["n_attempts"]) == ("accepted", 9, 9)
    assert (r["b"]["verdict"], r["b"]["evidence"]) == ("ambiguous", "attempts=format_error:1,unknown:1")


def test_compact_hours(spark):
    h = {"monday": "09:00-21:00", "tuesday": "09:00-21:00", "wednesday": "09:00-21:00", "thursday": "09:00-21:00", "friday": "09:00-17:00", "saturday": "09:00-17:00", "sunday": "closed"}
    r = spark.createDataFrame([(h,)], "h map<string,string>").select(weekly.compact_hours("h").alias("r")).first()["r"]
    assert [(x["days"], x["value"]) for x in r] == [("Mon–Thu", "9 AM – 9 PM"), ("Fri–Sat", "9 AM – 5 PM"), ("Sun", "Closed")]


CLOCKS = [("10", "5:00 pm", "10:00-17:00"), ("1", "5 pm", "13:00-17:00"), ("9:30", "4", "09:30-16:00"), ("Noon", "4pm", "12:00-16:00"), ("10 a.m.", "5 p.m.", "10:00-17:00"), ("25", "5", None), ("9", "17", "09:00-17:00"), ("8 pm", "midnight", "20:00-00:00")]


def test_clock_spans(spark):
    d = spark.createDataFrame(CLOCKS, "a string, b string, want string").withColumn("got", weekly.clock_span("a", "b"))
    for r in d.collect():
        assert r["got"] == r["want"], (r["a"], r["b"])


def test_holidays(spark):
    r = {(str(x["day"]), x["name"]) for x in C.holidays(spark, 2026, 2027).collect()}
    assert {("2026-07-04", "Independence Day"), ("2026-07-03", "Independence Day (observed)"), ("2026-11-26", "Thanksgiving"), ("2026-11-27", "Black Friday"), ("2026-05-25", "Memorial Day"), ("2027-01-18", "Martin Luther King Jr. Day")} <= r


def test_access_issues(spark):
    rows = [("Card rejected at desk", None, False, None, None, "probe_blocked_but_requires_own_card_false"), ("same-network card accepted", None, True, None, None, "probe_accepted_but_requires_own_card_true"),
            (None, "card accepted", False, "booking_probe_card_ownership", "yes", "booking_probe_card_ownership_must_not_assert_residency"), (None, None, True, None, None, None), ("card rejected", None, True, None, None, None)]
    d = spark.createDataFrame(rows, "own string, res string, req boolean, src string, restricted string, want string")
    assert d.filter(~Q.access_issue("own", "res", "req", "src", "restricted").eqNullSafe(F.col("want"))).count() == 0


def test_headline_prefers_adult_then_paid(spark):
    p = lambda a, f, v: (a, f, v, None, None, None)
    rows = [([p("Child", "free", 0.0), p("Single ticket", "percent-off", 50.0)], "50% off"), ([p("Child", "free", 0.0)], "FREE"), ([p("x", "dollar-off", 9.0), p("Adults", "per-person-price", 13.5)], "$13.5/person"), ([], "discount unspecified"),
            ([p("x", "bogo", None), p("y", "discount", None)], "discount")]
    d = spark.createDataFrame(rows, "p array<struct<audience:string,form:string,value:double,count:int,age_range:struct<min:int,max:int>,source_phrase:string>>, want string").withColumn("got", benefit.headline("p"))
    for r in d.collect():
        assert r["got"] == r["want"]


def test_matching_cards(spark):
    passes = spark.createDataFrame([("p1", "a", "network_open"), ("p2", "a", "own_card_only"), ("p3", "c", None)], "pid string, library_id string, verdict string")
    cards = spark.createDataFrame([("a", "1", True), ("b", "2", None), ("b", "3", False), ("c", None, True)], "library_id string, card_number string, enabled boolean")
    libs = spark.createDataFrame([("a", "N"), ("b", "N"), ("c", "M")], "library_id string, network string")
    assert sorted((r["pid"], r["n_exact"], r["n_network"]) for r in M.match_cards(passes, cards, libs).collect()) == [("p1", 1, 1), ("p2", 1, 0), ("p3", 0, 0)]


def test_matrix_keeps_empty_rows_and_any_width(spark):
    d = spark.createDataFrame([("r", "c", 1)], "r string, c string, v int")
    rows = spark.createDataFrame([("r",), ("s",)], "r string")
    got = {x["r"]: x.asDict() for x in M.matrix(d, "r", "c", ["c", *(f"x{i}" for i in range(600))], F.col("v"), rows).collect()}
    assert len(got["s"]) == 602 and got["r"]["c_c"] == 1 and got["s"]["c_c"] is None and got["r"]["c_x599"] is None


def test_matrix_grid(spark):
    facts = spark.createDataFrame([("r", "a", "physical_circ", "network_open", "no", None), ("r", "b", "digital_email", "ambiguous", "no", None)], "row string, lib string, pass_form string, verdict string, restricted string, scope string")
    audits = spark.createDataFrame([("r", "a", "approved"), ("r", "a", "corrected"), ("s", "a", "approved")], "row string, lib string, status string")
    rows = spark.createDataFrame([("r",), ("s",)], "row string")
    d = M.matrix_grid(rows, "row", [("a", None), ("a", "main"), ("b", None), ("b", "main")], facts, "lib", audits, M.cell_match(verdict="network_open"))
    got = {(x["row"], x["lib"], x["branch"]): tuple(x)[3:] for x in d.collect()}
    assert len(got) == 8 and got["r", "a", None] == got["r", "a", "main"] == ("physical_circ", "network_open", False, True, True)
    assert got["r", "b", None] == ("digital_email", "ambiguous", True, False, False) and got["r", "b", "main"] == got["s", "a", None] == (None, None, False, False, False)


def test_card_choice(spark):
    passes = spark.createDataFrame([("p1", "a", "network_open"), ("p2", "b", "ambiguous"), ("p3", "b", "own_card_only"), ("p4", "c", None)], "pid string, library_id string, verdict string")
    cards = spark.createDataFrame([(9, "a", "1", True), (7, "a", "2", None), (1, "a", "3", False)], "card_id int, library_id string, card_number string, enabled boolean")
    libs = spark.createDataFrame([("a", "N"), ("b", "N"), ("c", "M")], "library_id string, network string")
    got = {r["pid"]: (r["card_id"], r["card_library"], r["kind"]) for r in M.card_choice(passes, cards, libs).collect()}
    assert got == {"p1": (7, "a", "exact"), "p2": (7, "a", "network"), "p3": (None, None, None), "p4": (None, None, None)}



def test_deep_links(spark):
    rows = [("https://l.assabetinteractive.com/museum-passes/by-museum/mfa/", "2026-05-09", "https://l.assabetinteractive.com/museum-passes/by-date/2026-may/9/mfa/"), ("https://x.libcal.com/passes/1?a=1", "2026-05-09", "https://x.libcal.com/passes/1?a=1&date=2026-05-09"),
            ("https://o/x", "2026-05-09", "https://o/x"), (None, "2026-05-09", ""), ("https://x.libcal.com/p", None, "https://x.libcal.com/p")]
    d = spark.createDataFrame(rows, "u string, d string, want string").withColumn("got", dates.deep_link("u", F.to_date("d")))
    for r in d.collect():
        assert r["got"] == r["want"]


def test_labels(spark):
    d = spark.createDataFrame([(0, 2), (62, None), (None, 12), (None, None)], "a int, b int").select(F.struct(F.col("a").alias("min"), F.col("b").alias("max")).alias("r"))
    assert [x[0] for x in d.select(labels.age_label("r")).collect()] == ["0–2", "62+", "≤12", ""]
    assert spark.range(1).select(labels.policy_label(F.lit("per-pass-discount"), F.lit(5.0))).first()[0] == "per pass discount: 5"


def test_site_roots(spark):
    d = spark.createDataFrame([("example.org/x", "https://example.org/"), ("http://a.b/c?d", "http://a.b/")], "u string, want string")
    assert d.filter(text.site_root("u") != F.col("want")).count() == 0


def test_ties_do_not_hang_on_arrival(spark):
    from weftline.operators import overlay
    from weftline.streaming.stateful import keep_latest
    rows = [("k", "f", "id", "b", 1), ("k", "f", "id", "a", 1)]
    shape = "kind string, field string, id string, value string, seq int"
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, shape)
        assert overlay.effective_overrides(d).first()["value"] == "b" and keep_latest(d, ["id"], ["seq"]).first()["value"] == "b"
        assert [r["value"] for r in overlay.upsert(d.filter("value = 'a'"), d, ["id"]).collect()] == ["b"]
