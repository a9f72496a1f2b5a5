"""The built tables over small inputs: cascades, fallbacks, overlays, gates."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import quality as Q
from weftline.plans import gold, schemas

COUPON = ("struct<capacity:struct<kind:string,n:int>,audience_policies:array<struct<audience:string,form:string,value:double,count:int,age_range:struct<min:int,max:int>,source_phrase:string>>,"
          "summary:string,source_phrase_block:string>")
RULES = ("struct<blackout:array<struct<month:int,day:int>>,blackout_recurring:array<string>,weekdays_only:boolean,seasonal:string,advance_booking_required:boolean,"
         "booking_frequency_limit:string,late_return_penalty:string>")
POLICIES = "array<struct<audience:string,form:string,value:double,count:int,age_range:struct<min:int,max:int>,source_phrase:string>>"


def inputs(spark):
    f = spark.createDataFrame
    catalog = f([("wizard", "acton", "mfa-e-coupon", "http://x/abc123", None, None), ("libcal", "bpl", "zoo", "http://x/hex9/", "Paper pass. Pick up a paper pass.", "digital"),
                 ("wizard", "acton", "aquarium", None, None, "unknown"), ("wizard", "acton", "gone", None, None, None), ("login", "cohasset", "mystery-digital", None, None, None)],
                "platform string, library_id string, attraction_rawslug string, detail_url string, benefit_text string, pass_type string")
    index = f([("wizard", "acton", 0, "mfa", "physical-coupon", "abc123"), ("wizard", "acton", 1, "other", "digital", "zzz"), ("wizard", "acton", 2, "aquarium", "digital", None)],
              "platform string, library_id string, pos int, slug string, pass_type string, museum_hex string")
    old = f([("wizard", "acton", "aquarium", "ok", "physical_circ"), ("login", "cohasset", "mystery-digital", "failed", "physical_circ")], "platform string, library_id string, attraction_rawslug string, status string, pass_form string")
    old = old.withColumns({"coupon": F.expr(f"CAST(named_struct('capacity', null, 'audience_policies', null, 'summary', 'old', 'source_phrase_block', 'old text') AS {COUPON})"),
                           "restrictions": F.lit(None).cast(RULES), "residency": F.expr(f"CAST(named_struct('restricted', 'yes', 'scope', 'ma', 'source', 'catalog_text', 'evidence', 'e') AS {gold.RESIDENCY})")})
    auth = f([("acton", "mfa", "ok", "Emailed to you. Limited to Acton residents.", "people", 4, [("Adult", "percent-off", 50.0, None, None, None)], {"audience_policies[0].form": "half off"}, ["2026-07-04", "12-25"], False, None),
              ("bpl", "zoo", "failed", None, None, None, None, None, None, None, None)],
             f"library_id string, slug string, status string, raw string, capacity_kind string, capacity_n int, audience_policies {POLICIES}, source_phrases map<string,string>, blackout_dates array<string>, weekdays_only boolean, seasonal string")
    probes = f([("wizard", "acton", "mfa-e-coupon", "rejected_resident", "yes", "card blocked", "c1", "2026-05-01"), ("wizard", "acton", "aquarium", "booked_unexpectedly", None, "x", "c2", "d")],
               "platform string, library_id string, attraction_rawslug string, verdict string, restricted string, evidence string, prober_card string, probed_date string")
    days = f([("wizard", "acton", "aquarium", "2026-05-02", "booked"), ("wizard", "acton", "aquarium", "2026-05-01", "available")], "platform string, library_id string, attraction_rawslug string, day string, status string")
    lib = f([("bpl", None, "town", None, "sign"), ("acton", "yes", "town", "page", "sign2")], "library_id string, restricted string, scope string, source string, evidence string")
    over = f([("pass", "acton__gone", "__drop__", "removed", None), ("pass", "acton__aquarium", "pass_form", "corrected", "physical_coupon"), ("pass", "bpl__zoo", "pass_form", "noted", "digital_email"),
              ("pass", "acton__aquarium", "source_url", "corrected", None)], "kind string, id string, field string, status string, value string")
    aliases = f([("mfa", "mfa"), ("zoo", "zoo-new-england")], "raw string, canonical string")
    return catalog, index, old, auth, probes, days, lib, over, aliases


def test_passes(spark):
    args = inputs(spark)
    d = schemas.schema_lock(gold.build_passes(*args), schemas.PASS)
    with pytest.raises(ValueError, match="missing coupon; unknown extra"):
        schemas.schema_lock(d.drop("coupon").withColumn("extra", F.lit(1)), schemas.PASS)
    rows = {(r["library_id"], r["attraction_rawslug"]): r for r in d.collect()}
    assert set(rows) == {("acton", "mfa-e-coupon"), ("bpl", "zoo"), ("acton", "aquarium"), ("cohasset", "mystery-digital")}
    m = rows["acton", "mfa-e-coupon"]
    assert m["attraction_slug"] == "mfa" and m["pass_form"] == "digital_email"  # offer text beats the index code
    assert m["coupon"]["summary"] == "50% off" and m["coupon"]["audience_policies"][0]["source_phrase"] == "half off"
    assert [(x["month"], x["day"]) for x in m["restrictions"]["blackout"]] == [(7, 4), (12, 25)]
    assert m["residency_restriction"]["scope"] == "town" and m["residency_restriction"]["source"] == "coupon_source_phrase"
    assert m["requires_own_card"] and m["booking_access_probe"]["verdict"] == "own_card_only"
    z = rows["bpl", "zoo"]
    assert z["attraction_slug"] == "zoo-new-england" and z["pass_form"] == "physical_coupon"  # catalog text on the calendar platform; a note is no correction
    assert z["coupon"] is None and z["residency_restriction"]["source"] == "library_pass_policy" and z["residency_restriction"]["restricted"] == "yes"
    a = rows["acton", "aquarium"]
    assert a["pass_form"] == "physical_coupon" and a["source_url"] is None and a["coupon"]["summary"] == "old"
    assert a["availability"] == {"2026-05-01": "available", "2026-05-02": "booked"} and a["booking_access_probe"]["verdict"] == "not_verified"
    assert a["residency_restriction"]["scope"] == "ma"  # stated old value is stronger than the library-wide policy
    c = rows["cohasset", "mystery-digital"]
    assert c["attraction_slug"] == "mystery-digital" and c["coupon"] is None and c["residency_restriction"]["restricted"] == "unknown"
    assert gold.coverage_gaps(d, args[3]).count() == 0
    assert gold.coverage_gaps(d.withColumn("coupon", F.lit(None).cast(COUPON)), args[3]).select("attraction_rawslug").first()[0] == "mfa-e-coupon"


def test_integrity_gate(spark):
    f = spark.createDataFrame
    passes = f([("a", "x"), ("a", "x"), ("b", "y"), ("c", "x")], "library_id string, attraction_slug string")
    libs, attrs = f([("a",), ("b",)], "id string"), f([("x",)], "slug string")
    with pytest.raises(Q.IntegrityError, match="duplicate_pass_pair.*pass_unknown_attraction.*pass_unknown_library"):
        Q.gate(gold.integrity_report(passes, libs, attrs))
    Q.gate(gold.integrity_report(f([("a", "x")], "library_id string, attraction_slug string"), libs, attrs))


def test_stamps(spark):
    d = spark.createDataFrame([("a", "2026-05-20T10:00:00Z"), ("b", "2026-05-20T10:30:00+00:00")], "t string, at string")
    Q.check_stamps(d, "t", "at")
    with pytest.raises(Q.IntegrityError, match="b vs a|72.5"):
        Q.check_stamps(d.unionByName(spark.createDataFrame([("c", "2026-05-23T10:30:00Z")], "t string, at string")), "t", "at")


def test_libraries(spark):
    f = spark.createDataFrame
    addr, geo = "struct<street:string,city:string>", "struct<lat:double,lon:double>"
    seeds = f([("a", "A Lib", "Acton", "NOBLE", "wizard", None, None, ["X"], None, None), ("b", "B Lib", "Bedford", "MVLC", "libcal", "http://b", ["Y", "Z"], None, ("1 St", "Bedford"), None)],
              f"id string, name string, town string, network string, platform string, card_page string, card_issuance_groups array<string>, card_auth_groups array<string>, address {addr}, geo {geo}")
    zips, arch = f([("Acton", ["01720"])], "town string, zips array<string>"), f([("a", ("2 St", "Acton"), (42.0, -71.0)), ("b", ("9 St", "Old"), (1.0, 2.0))], f"id string, address {addr}, geo {geo}")
    pol, over = f([("a", "ma_resident", None)], "id string, card_eligibility string, pass_pickup string"), f([("library", "b", "card_eligibility", "corrected", "network")], "kind string, id string, field string, status string, value string")
    ev = f([("a", "line 1\n\n  line 2", "p", "http://u"), ("b", None, None, None)], "id string, source_block string, source_phrase string, source_url string")
    r = {x["id"]: x for x in gold.build_libraries(seeds, zips, arch, pol, over, ev).collect()}
    assert r["a"]["card_issuance_groups"] == ["NOBLE"] and r["a"]["card_auth_groups"] == ["X"] and r["a"]["resident_zips"] == ["01720"] and r["b"]["resident_zips"] == []
    assert r["a"]["address"]["city"] == "Acton" and r["b"]["address"]["street"] == "1 St" and r["b"]["geo"]["lat"] == 1.0
    assert (r["a"]["card_eligibility"], r["a"]["pass_pickup_default"], r["b"]["card_eligibility"]) == ("ma_resident", "unknown", "network")
    assert r["a"]["card_evidence"]["block"] == "line 1\nline 2" and r["b"]["card_evidence"] is None


def test_attractions(spark):
    f = spark.createDataFrame
    price = "array<struct<audience:string,price:double,source_block:string,source_url:string>>"
    catalog = f([("mfa-e-coupon", "Museum", 0), ("mfa", "Museum of Fine Arts", 1), ("lone", " ", 2)], "attraction_slug string, title string, pos int")
    pages = f([("mfa", "http://mfa", "MFA | Boston", None), ("extra", None, "EXTRA PLACE", "http://img")], "slug string, url string, title string, og_image string")
    prices = f([("mfa", "ok", [("adult", 27.0, None, None)]), ("extra", "failed", [("adult", 1.0, None, None)])], f"slug string, status string, prices {price}")
    hours = f([("mfa", "ok", {"monday": "unknown"}), ("extra", "ok", {"monday": "closed"})], "slug string, status string, hours map<string,string>")
    arch = f([("mfa", None, "http://old", "617", "465 Huntington Ave, Boston, MA 02115", "d", ["Tours", "Crafts", "Lawn"], None, None, {"monday": "closed", "tuesday": "10:00-17:00"})],
             f"slug string, name string, website string, phone string, address string, description string, categories array<string>, hero_image string, prices {price}, hours map<string,string>")
    over = f([("attraction", "mfa", "hours", "corrected", '{"sunday": "closed"}')], "kind string, id string, field string, status string, value string")
    ev = f([("mfa", [("adult", "", None), ("adult", "Adults\n\n$27", "http://e")])], "slug string, prices array<struct<audience:string,source_block:string,source_url:string>>")
    al = f([("mfa", "mfa")], "raw string, canonical string")
    r = {x["slug"]: x for x in gold.build_attractions(catalog, pages, prices, hours, arch, over, ev, al).collect()}
    assert set(r) == {"mfa", "lone", "extra"}
    m = r["mfa"]
    assert m["name"] == "Museum of Fine Arts" and m["website"] == "http://mfa" and m["address"]["zip"] == "02115" and m["categories"] == ["History", "Art"]
    assert m["hours"] == {"sunday": "closed"} and m["closed_days"] == ["sunday"]  # corrected hours, closures recomputed
    assert m["prices"][0]["source_block"] == "Adults\n$27" and m["prices"][0]["source_url"] == "http://e"
    assert r["lone"]["name"] == "Lone" and r["extra"]["name"] == "Extra Place" and r["extra"]["prices"] is None and r["extra"]["closed_days"] == ["monday"]


def test_branches(spark):
    f = spark.createDataFrame
    rosters = f([("q-main", "q", "Main Library", None, None), ("q-north", "q", "North", None, None), ("q-far", "q", "Far", None, None)], "branch_id string, library_id string, name string, lat double, lon double")
    libs = f([("q", None, "Quincy", 42.25, -71.0)], "library_id string, town string, city string, lat double, lon double")
    hits = f([("q-north", 1, True, 10.0, 10.0), ("q-north", 2, True, 42.28, -71.02), ("q-far", 1, True, 10.0, 10.0), ("q-main", 1, False, None, None)], "branch_id string, attempt int, ok boolean, lat double, lon double")
    over = f([("branch", "q__far", "name", "corrected", "Faraway")], "kind string, id string, field string, status string, value string")
    r = {x["branch_id"]: x for x in gold.build_branches(rosters, libs, hits, over).collect()}
    assert (r["q-north"]["lat"], r["q-far"]["lat"], r["q-main"]["lat"]) == (42.28, None, 42.25) and r["q-far"]["name"] == "Faraway" and r["q-main"]["town"] == "Quincy"


def test_validation_report(spark):
    f = spark.createDataFrame
    libs = f([("unknown", "network"), ("network", "unknown"), ("network", "x")], "card_eligibility string, pass_pickup_default string")
    attrs = f([([("adult", 1.0)], {"monday": "unknown"}, ["Art"]), (None, {"monday": "closed"}, [])], "prices array<struct<audience:string,price:double>>, hours map<string,string>, categories array<string>")
    d = gold.build_passes(*inputs(spark))
    r = {(x["table"], x["metric"]): (x["n"], x["n_bad"], x["pct"]) for x in gold.validation_report(libs, attrs, d).collect()}
    assert r["libraries", "card_eligibility_unknown"] == (3, 1, 33.3) and r["attractions", "prices_missing"] == (2, 1, 50.0) and r["attractions", "hours_missing"] == (2, 1, 50.0)
    assert r["passes", "coupon_missing"][:2] == (4, 2)


def test_archive_enrichment(spark):
    rec = {"slug": "a", "museum_name": " Art House ", "address": "x", "hero_image": {"og_image_url": "http://i"}, "hours": {"regular_hours": {"mon": "10 AM – 5 PM", "tue": "Closed", "wed": "by chance"}},
           "original_price": {"age_pricing": {"adult": {"price": 20.0, "min_age": 18}, "child": {"price": None}}, "identity_pricing": {"student": {"price": 5.0}}, "family": {"price": 40.0}, "free_under_age": 6}}
    import json
    d = spark.createDataFrame([(json.dumps(rec),)], "j string").select(F.from_json("j", gold.ARCHIVE).alias("r")).select("r.*")
    r = gold.archive_attractions(d).first()
    assert r["name"] == "Art House" and r["hero_image"] == "http://i"
    assert (r["hours"]["monday"], r["hours"]["tuesday"], r["hours"]["wednesday"], r["hours"]["sunday"]) == ("10:00-17:00", "closed", "unknown", "unknown")
    assert [(p["audience"], p["price"], p["age_min"], p["age_max"]) for p in r["prices"]] == [("adult", 20.0, 18, None), ("student", 5.0, None, None), ("family", 40.0, None, None), ("child", 0.0, 0, 5)]


def test_laid_out_build_gives_the_same_passes(spark, monkeypatch):
    """Shuffles laid out by rows, texts read on the side they come from."""
    from weftline.functions import benefit
    from weftline.operators import layout
    monkeypatch.setattr(layout, "TASK_ROWS", 2)
    read = []
    real = benefit.residency_from_block
    monkeypatch.setattr(benefit, "residency_from_block", lambda c: read.append(str(c)) or real(c))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(gold.build_passes(*inputs(spark), rows=20)) == rows(gold.build_passes(*inputs(spark)))
    assert set(read) == {"raw", "Column<'coupon.source_phrase_block'>"}


def test_texts_without_residents_are_searched_once(spark):
    from weftline.functions import benefit
    texts = ["For Ashmere residents only", "for Aſhmere reſidents only", "MA RESIDENTS ONLY", "must be an Acton resident", "Enjoy.", "", None]
    got = [r[0] and r[0]["scope"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(benefit.residency_from_block("t")).collect()]
    assert got == ["town", "town", "ma", "town", None, None, None]


def test_sides_of_any_layout_give_the_same_passes(spark, monkeypatch):
    """Sides that come dealt by library stay where they are; sides of another layout are dealt again."""
    from weftline.operators import layout
    monkeypatch.setattr(layout, "TASK_ROWS", 2)
    rows = lambda df: sorted(map(str, df.collect()))
    catalog, index, old, auth, probes, days, lib, over, aliases = inputs(spark)
    want = rows(gold.build_passes(*inputs(spark)))
    for n in (20, 60):
        d = gold.build_passes(catalog, index, gold.by_library(old, 20), gold.by_library(auth, n), probes, gold.by_library(days, 20), lib, over, aliases, rows=20)
        assert rows(d) == want and d.columns == gold.build_passes(*inputs(spark)).columns
    assert rows(gold.build_passes(catalog, index, gold.by_library(old, 20), auth, gold.by_library(probes, 20), days, lib, over, aliases)) == want


@pytest.mark.parametrize("name", ["gold_passes", "gold_validation_report"])
def test_passes_are_shuffled_by_library_once(spark, tmp_path, monkeypatch, name):
    """After the passes are dealt by library, every lookup on a key that holds the library stays where they are."""
    import re
    from weftline.operators import layout
    from weftline.plans import catalog
    monkeypatch.setattr(layout, "TASK_ROWS", 200)
    (tmp_path / "t").symlink_to("/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, str(tmp_path / "t"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = re.findall(r"Exchange (\w+)\((.*)", plan)
    assert [keys for kind, keys in shuffles if kind == "hashpartitioning" and re.search(r"library_id|_target|_own|_lib\b", keys)] == []
    assert "shufflepartitionidpassthrough" in {kind for kind, _ in shuffles}


def test_corrections_reach_their_targets_where_these_are(spark):
    """Ids are matched as whole texts, whatever stands in the names or is missing."""
    from weftline.operators import overlay as O
    names = ["a", "a_", "_a", "a__b", "__", "_", "", "b", None]
    d = spark.createDataFrame([(x, y) for x in names for y in names], "library_id string, slug string").withColumn("t", O.target_key("library_id", "slug"))
    ids = [r["t"] for r in d.select("t").distinct().collect()] + ["zzz", "a__b__c", None]
    over = spark.createDataFrame([("pass", i, f, s, str(i)) for n, i in enumerate(ids) for f, s in (("x", "corrected"), *([("__drop__", "removed")] if n % 3 == 0 else []))],
                                 "kind string, id string, field string, status string, value string")
    want = O.drop_removed(d, "t", over).join(O.corrections_by_entity(over, ["x"], "t"), "t", "left").select("library_id", "slug", "_over_x")
    for rows in (None, 10):
        fixes = gold.by_library(O.with_owners(over, "_owner"), rows, "_owner").drop("_owner")
        dealt, at = gold.by_library(d, rows), gold.task_column(spark, rows)
        got = O.drop_removed(dealt, "t", fixes, within=[at]).join(O.corrections_by_entity(fixes, ["x"], "t", within=[at]), ["t", at], "left").select("library_id", "slug", "_over_x")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert 0 < want.count() < d.count()


def test_lookup_where_the_rows_are_equals_the_plain_one(spark):
    from weftline.operators import keys as K
    facts = spark.range(400).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 31).alias("b"),
                                    F.when(F.col("id") % 11 > 0, F.col("id") % 3).alias("library_id"))
    dim = spark.range(60).select((F.col("id") % 3).alias("library_id"), (F.col("id") % 40).cast("int").alias("k"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("v")).dropDuplicates(["library_id", "k"])
    dim = dim.unionByName(spark.createDataFrame([(None, 3, 5), (1, None, 6)], "library_id long, k int, v long"))
    tries = [["library_id", "a"], ["library_id", "b"]]
    want = sorted(map(str, K.lookup_first(facts, dim, tries, ["library_id", "k"], ["v"]).collect()))
    for rows in (None, 400):
        at = gold.task_column(spark, rows)
        got = K.lookup_first(gold.by_library(facts, rows), gold.by_library(dim, rows), tries, ["library_id", "k"], ["v"], within=[at])
        assert sorted(map(str, got.drop(at).collect())) == want
    twice = gold.by_library(dim.unionByName(dim), 400)
    assert sorted(map(str, K.lookup_first(gold.by_library(facts, 400), twice, tries, ["library_id", "k"], ["v"], within=[gold.task_column(spark, 400)]).drop(gold.task_column(spark, 400)).collect())) == want
