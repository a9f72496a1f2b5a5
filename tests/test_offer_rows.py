"""Expected readings of offer texts, one row per text, all read in one job."""

from pyspark.sql import functions as F

from weftline.functions import benefit

# text, platform, slug, status, summary, first form, first value, capacity kind, capacity n, pass form (None = not checked)
OFFERS = [
    ("Passes admit 4 people to the Tidewater Hall for 50% off the ticket price.", "wizard", "a", "ok", "50% off", "percent-off", 50.0, "people", 4, None),
    ("Pass admits up to 3 people, all at half price.", "wizard", "a", "ok", "50% off", "percent-off", 50.0, "people", 3, None),
    ("Pass admits up to 4 people and the gate asks for 1/2 price admission.", "wizard", "a", "ok", "50% off", "percent-off", 50.0, "people", 4, None),
    ("With it, up to 4 guests come in at $5-off each.", "wizard", "a", "ok", "$5 off", "dollar-off", 5.0, None, None, None),
    ("FREE admission for whoever shows it.", "wizard", "a", "ok", "FREE", "free", 0.0, None, None, None),
    ("Show it at any of the Lakeland State Parks for free general parking.", "wizard", "a", "ok", "FREE", "free", 0.0, "vehicle", 1, None),
    ("The tag gives its bearer free parking at nine beaches.", "libcal", "a", "ok", "FREE parking", "free", 0.0, None, None, None),
    ("Pass admits up to 4 people, who pay $5 per person.", "wizard", "a", "ok", "$5/person", "per-person-price", 5.0, "people", 4, None),
    ("Grown-ups bring $13 per adult, the young ones $4 per child. Pass admits 5 people.", "wizard", "a", "ok", "$13/person", "per-person-price", 13.0, "people", 5, None),
    ("On Fridays the playhouse offers: buy one get one free.", "wizard", "a", "ok", "BOGO", "bogo", None, None, None, None),
    ("Pass admits up to 6 people with discounted admission to the Mill.", "wizard", "a", "ok", "Discount", "discount", None, "people", 6, None),
    ("Two tickets to the Lanterns at the discounted rate of our readers.", "libcal", "tidewater-hall-e-coupon", "ok", "Discount", "discount", None, "ticket", 2, "digital_email"),
    ("Pass admits 2 people at half price. This pass must be returned to the library by closing time.", "wizard", "a", "ok", "50% off", "percent-off", 50.0, "people", 2, "physical_circ"),
    ("Click on a day of the month below and fill in the form.", "wizard", "a", "failed", None, None, None, None, None, None),
    ("", "wizard", "a", "failed", None, None, None, None, None, None),
    ("Fetch the slip at our desk. Three grown-ups and their toddlers fit on it.", "wizard", "a", "failed", None, None, None, None, None, None),
    ("Holders pay a discounted $14 per person at the turnstile. Toddlers of 3 and under come in free.", "wizard", "a", "ok", "$14/person", None, None, None, None, None),
    ("Free Evening Talks Pass. Take it along to the Coldbrook History Circle.", "wizard", "a", "ok", "FREE", "free", 0.0, None, None, None),
    ("7 Quarry Lane, Ashmere, MA, 01999\n(555) 010-0199\nThe Wheel Barn shows old carts and coaches. Fetch and return it at our desk. "
     "Pass benefits: Free admission for up to 4 visitors.", "libcal", "a", "ok", "FREE", "free", 0.0, "people", 4, None),
    ("The Harbor Barge lies at the old pier. Pass benefits: Admits up to 9 for free.", "libcal", "a", "ok", "FREE", "free", 0.0, None, None, None),
    ("Free Fernhill swing family admission (up to 4 riders), e-coupon.", "libcal", "fernhill-swing-e-coupon", "ok", "FREE", "free", 0.0, None, None, "digital_email"),
    ("Type this in at the till: it covers the cost of up to 7 tickets for a matinee.", "wizard", "a", "ok", "FREE", "free", 0.0, "ticket", 7, None),
    ("Your household pays the gate of each walled garden an entry at family membership rates.",
     "wizard", "a", "ok", None, "discount", None, None, None, None),
    ("Some halls ask nothing of you, others give free or reduced admission to one household. Shops and inns give no discounts.", "wizard", "a", "ok", None, "discount", None, None, None, None),
    ("Rowers: each visitor will be charged $3.00 by the boatman. Dogs are admitted free.", "libcal", "a", "ok", "$3/person", "per-person-price", 3.0, None, None, None),
    ("The yearly fair: 30$ off for a carload. Pass admits 3 people.", "libcal", "a", "ok", "$30 off", "dollar-off", 30.0, "people", 3, None),
    ("Climbers bring less than others: $8 per person. Babies ride free.", "wizard", "a", "ok", "$8/person", "per-person-price", 8.0, None, None, None),
    ("Hang the tag in your vehicle wherever Lakeland asks for daily parking fees. Not valid for camping.", "wizard", "a", "failed", None, None, None, None, None, None),
    ("Each pass admits 1 vehicle for free to the Lakeland shores.", "wizard", "a", "ok", "FREE", "free", 0.0, "vehicle", 1, None),
    ("Gardeners bring their toddlers along. Ask each plot for its prices.", "wizard", "a", "failed", None, None, None, None, None, None),
    ("Good for one boat rental at Mill Pond. Show a photo ID. Choose a single kayak (1 person) or a rowing boat (2 adults).", "wizard", "a", "failed", None, None, None, None, None, None),
]


def test_offers(spark):
    rows = [(i, *r[:3]) for i, r in enumerate(OFFERS)]
    d = benefit.extract_coupon(spark.createDataFrame(rows, "i int, body string, platform string, slug string"), "body", "slug", "platform")
    for g in d.select("i", "offer").collect():
        text, _, _, status, summary, form, value, kind, n, pass_form = OFFERS[g["i"]]
        o = g["offer"]
        assert o["status"] == status, text
        if status != "ok":
            assert o["audience_policies"] is None and o["error"]
            continue
        first = o["audience_policies"][0]
        if summary:
            assert o["summary"] == summary, text
        else:
            assert o["summary"].lower() == "discount" and o["capacity"]["kind"] != "vehicle"
        if form:
            assert (first["form"], first["value"]) == (form, value), text
        if kind:
            assert (o["capacity"]["kind"], o["capacity"]["n"]) == (kind, n), text
        if pass_form:
            assert o["pass_form"] == pass_form


def test_two_tier_prices(spark):
    d = spark.createDataFrame([("Grown-ups bring $13 per adult, the young ones $4 per child.", "wizard", "a")], "body string, platform string, slug string")
    ps = benefit.extract_coupon(d, "body", "slug", "platform").first()["offer"]["audience_policies"]
    assert [(p["audience"], p["value"]) for p in ps] == [("adults", 13.0), ("children", 4.0)]
    assert (ps[0]["age_range"]["min"], ps[0]["age_range"]["max"]) == (18, 200)


def test_source_phrases_replace_text(spark):
    d = spark.createDataFrame([("ignored", ["Pass &amp; ticket", "", " 20%  off "], "wizard", "a")], "body string, ph array<string>, platform string, slug string")
    o = benefit.extract_coupon(d, "body", "slug", "platform", "ph").first()["offer"]
    assert o["summary"] == "20% off" and o["source_phrase_block"] == "ignored"
    assert o["audience_policies"][0]["source_phrase"] == "Pass & ticket 20% off"


RESIDENCY = [
    ("Only Ashmere residents may reserve and use it.", "town"),
    ("At least one of your group must be a Massachusetts resident.", "ma"),
    ("Visitors must be Massachusetts residents for this offer.", "ma"),
    ("Young people and all residents of Fernhill, MA are admitted free.", None),
    ("Pass admits 4 people for 50% off the day ticket.", None),
]


def test_residency_requirement(spark):
    d = spark.createDataFrame(RESIDENCY, "t string, scope string").withColumn("r", benefit.extract_residency_restriction("t"))
    for r in d.collect():
        assert (r["r"]["scope"] if r["r"] else None) == r["scope"], r["t"]


def test_booking_and_late_rules(spark):
    rows = [("Good for 4. Limit one reservation per month for a family.", "per month", None), ("You may make 1 booking per month.", "1 booking per month", None),
            ("Lend it for a day. A late fee of $5 per day applies afterwards.", None, "$5"), ("Good for 4 people at 50% off.", None, None)]
    d = spark.createDataFrame(rows, "t string, f string, p string").withColumn("r", benefit.extract_restrictions("t"))
    for r in d.collect():
        got = r["r"]
        for want, field in ((r["f"], "booking_frequency_limit"), (r["p"], "late_return_penalty")):
            value = got[field] if got else None
            assert (want in value.lower()) if want else value is None


LABELS = [
    ("Free admission to the barn for up to 4.", "Free", "free"), ("Pass admits 5 people for free to the Mill.", "Free", "free"), ("Pass provides free parking at the shore", "Free", "free"),
    ("The gallery's admission is free to all who come.", "Free", "free"), ("It allows free admission for up to 9 people.", "Free", "free"),
    ("$2 admission for each of 4 visitors.", "$2", "price"), ("Admits 2 people, at $10.00 per person.", "$10", "price"), ("$12 admission per person to the Tidewater Hall", "$12", "price"),
    ("Bring $11 per adult, $3 per child, and a lamp.", "$11", "price"), ("Up to 4 adults come in for $5 each", "$5", "price"),
    ("Divers get a discounted rate of $16 per person", "$16", "price"), ("Babes in arms are admitted free. Divers get a discounted rate of $16 per person.", "$16", "price"),
    ("Pass admits up to four for half price.", "50% off", "half"), ("Four visitors at 50% admission per person", "50% off", "half"), ("Good for five (5) people at 50% off.", "50% off", "half"),
    ("Three visitors at 1/2 price admission", "50% off", "half"), ("50% off the ticket.", "50% off", "half"),
    ("A family of 4 gets a 25% discount on tickets.", "25% off", "percent-off"), ("30% off at the gate", "30% off", "percent-off"), ("Take $5 off your ticket.", "$5 off", "dollar-off"),
    ("Discount admission for our readers.", "Discount", "discount"), ("No more bookings, sorry.", "", "unknown"), ("", "", "unknown"), ("２５％ off &amp; more", "25% off", "percent-off"),
]


def test_short_labels(spark):
    d = spark.createDataFrame(LABELS, "t string, label string, cls string").withColumn("l", benefit.normalize_benefit("t"))
    for r in d.collect():
        assert (r["l"]["label"], r["l"]["label_class"]) == (r["label"], r["cls"]), r["t"]


FORMS = [("2-for-1 boat trips", "bogo"), ("buy one get one free on Mondays", "bogo"), ("free admission to the barn", "free"), ("50% off the ticket", "percent-off"), ("$5 off for each of you", "dollar-off"),
         ("admission $9 per person", "per-person-price"), ("discount at the gate", "discount"), ("", "discount")]


def test_form_classes(spark):
    d = spark.createDataFrame(FORMS, "t string, want string").withColumn("got", benefit.classify_coupon_form("t"))
    assert d.filter(F.col("got") != F.col("want")).count() == 0


DELIVERY = [("No physical pass to pick up, as it will be emailed", "digital_email"), ("An e-voucher for you", "digital_email"), ("A returnable pass", "physical_circ"), ("Paper pass; does not need to be returned", "physical_coupon"),
            ("printable code for the shop", None), ("", None)]


def test_delivery_cues(spark):
    d = spark.createDataFrame(DELIVERY, "t string, want string").withColumn("got", benefit.delivery_form("t"))
    assert d.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


BLOCKS = [("Made for Massachusetts residents only", "ma", 'coupon source phrase: "Massachusetts residents only"'), ("For Ashmere residents only", "town", 'coupon source phrase: "For Ashmere residents only"'),
          ("made only for library residents; restricted to Coldbrook residents", "town", 'coupon source phrase: "restricted to Coldbrook residents"'), ("for adult residents only", None, None)]


def test_residents_only_blocks(spark):
    d = spark.createDataFrame(BLOCKS, "t string, scope string, ev string").withColumn("r", benefit.residency_from_block("t"))
    for r in d.collect():
        got = (r["r"]["scope"], r["r"]["evidence"]) if r["r"] else (None, None)
        assert got == (r["scope"], r["ev"]), r["t"]
