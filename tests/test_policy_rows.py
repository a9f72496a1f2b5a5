"""Expected card and pickup policies, blackout phrases."""

from pyspark.sql import functions as F

from weftline.functions import dates, eligibility

CARD = [
    ("From Ashmere to the far coast: library cards are available to all Massachusetts residents over six.", "ma_resident"), ("Cards are available to Ashmere residents only; bring a lease or a bill.", "town_resident"),
    ("For people who live, work, or attend school in Coldbrook.", "town_or_works"), ("The reading room opens at ten and closes at eight. Come in!", "unknown"),
    ("Anyone is eligible for a library card here, given a passport and a recent letter.", "ma_resident"),
    ("Lost yours? Anyone can get a Fernhill library card at the front desk of each of our houses!", "ma_resident"),
    ("Any Massachusetts resident may register with us and borrow from the first day.", "ma_resident"),
    ("You do not have to be a resident of Ashmere for this, but you do have to be a resident of Massachusetts.", "ma_resident"),
    ("Before you get your library card: Massachusetts residency is required.", "ma_resident"),
    ("A library card is available to all East Coldbrook residents. Please carry a photo ID.", "town_resident"),
    ("Whoever sleeps in the Commonwealth of Massachusetts most nights counts: library cards are free to residents of Massachusetts.", "ma_resident"),
    ("Reading on a phone? Our eCard: any Massachusetts resident may fill in the form tonight. It is a library card.", "ma_resident"),
    ("Library cards are free, regardless of where you live in Massachusetts. Carry a letter with your address.", "ma_resident"),
    ("Library cards are available to anyone of school age who lives in Massachusetts or works in Fernhill.", "ma_resident"),
    ("Any Fernhill Resident is eligible to obtain a Fernhill Library Card. The form lies at the desk.", "town_resident"),
    ("It costs nothing, and anyone can get one! A library card needs only a photo ID.", "ma_resident"),
    ("The desk wants proof of local address before it prints a library card.", "town_resident"), ("Residents of Ashmere may register at the front desk.", "town_resident"),
    ("No card at home? Those who live anywhere in Massachusetts can ask for a library card by post.", "ma_resident"),
    ("If you live anywhere in Massachusetts, ask for a library card on this page.", "ma_resident"), ("If you have a Massachusetts address, a library card is yours.", "ma_resident"),
    ("Borrowers with a current Massachusetts address get their library card by mail.", "ma_resident"), ("Children pick the colour of their card themselves; the desk laminates it.", "unknown"),
    ("Summer guests from other states rent a borrower number by the week, for eleven dollars.", "unknown"),
    ("Film streaming is Now Available to Coldbrook Residents! Coldbrook card holders can watch at home.", "unknown"),
    ("Try to win our badge for young readers! Show your drawing in the hall.", "unknown"),
    ("Card Desk\nCard Forms\nPartner Cards\nShelves & Downloads", "unknown"),
]
PICKUP = [
    ("Ashmere residents may reserve passes on this page. Non-residents are welcome for same-day walk-in only.", "walkin_for_nonresidents"),
    ("These museum passes are reserved for patrons holding a Fernhill library card.", "town_cardholder_only"),
    ("Half of the ticket is paid by us. Visitors must be Massachusetts residents to use this pass.", "ma_resident"),
    ("Passes are available to Coldbrook residents only. Each home may reserve one.", "town_resident"),
    ("The Tidewater Hall is free to Massachusetts residents on the first Sunday of each month.", "unknown"),
]


def test_card_eligibility(spark):
    d = spark.createDataFrame(CARD, "t string, want string").select("*", eligibility.classify_card_eligibility("t").alias("got"), eligibility.eligibility_phrase("t").alias("phrase"))
    for r in d.collect():
        assert r["got"] == r["want"], r["t"]
        assert (r["phrase"] is None) == (r["want"] == "unknown"), r["t"]


def test_pickup(spark):
    d = spark.createDataFrame(PICKUP, "t string, want string").withColumn("got", eligibility.classify_pass_pickup("t"))
    for r in d.collect():
        assert r["got"] == r["want"], r["t"]


def test_blackout(spark):
    rows = [("Closed December 25, 2026", [(12, 25)], []), ("not valid July 4", [(7, 4)], []), ("Sundays only", [], ["sundays"])]
    d = spark.createDataFrame(rows, "t string, days array<struct<month:int,day:int>>, weekdays array<string>")
    for r in d.select("*", dates.blackout_days("t").alias("d"), dates.blackout_weekdays("t").alias("w")).collect():
        assert [(x["month"], x["day"]) for x in r["d"]] == [(x["month"], x["day"]) for x in r["days"]] and r["w"] == r["weekdays"]


def test_is_blackout(spark):
    rows = [("2027-12-25", True), ("2027-12-24", False), ("2026-05-24", True), ("2026-05-25", False)]
    days = F.array(F.struct(F.lit(12).alias("month"), F.lit(25).alias("day")))
    d = spark.createDataFrame(rows, "d string, want boolean").withColumn("got", dates.is_blackout(days, F.array(F.lit("sundays")), F.to_date("d")))
    assert d.filter("got <> want").count() == 0
