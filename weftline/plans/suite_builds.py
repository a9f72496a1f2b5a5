"""Queries that run the builds of the four tables whole, over inputs shaped from the driver tables."""

from pyspark.sql import functions as F

from weftline.operators import keys as K
from weftline.plans import gold
from weftline.plans.derived import pass_rows
from weftline.plans.derived import view as V
from weftline.plans.registry import query
from weftline.plans.suite_keys import aliases
from weftline.plans.suite_tables import _h

POLICIES = "array<struct<audience:string,form:string,value:double,count:int,age_range:struct<min:int,max:int>,source_phrase:string>>"
COUPON = f"struct<capacity:struct<kind:string,n:int>,audience_policies:{POLICIES},summary:string,source_phrase_block:string>"
RULES = ("struct<blackout:array<struct<month:int,day:int>>,blackout_recurring:array<string>,weekdays_only:boolean,seasonal:string,advance_booking_required:boolean,"
         "booking_frequency_limit:string,late_return_penalty:string>")


def _auth(spark, sf, rows):
    """``d_auth``, dealt by library: suppliers are met and offers grouped in place. The rows are those of its SQL."""
    key = V(spark, sf, "d_key").filter(F.col("p_type").isin("PROMO", "SMALL", "LARGE")).select(F.col("p_partkey").alias("attraction_id"), "p_size")
    canon = V(spark, sf, "d_canon").select(F.col("p_partkey").alias("attraction_id"), F.col("canonical").alias("slug"))
    task = gold.task_column(spark, rows)
    offers = gold.by_library(V(spark, sf, "d_pass").join(key, "attraction_id").join(canon, "attraction_id").select("library_id", "slug", "p_size"), rows)
    owners = gold.by_library(V(spark, sf, "supplier").select(F.col("s_suppkey").alias("library_id"), "s_acctbal"), rows)
    return offers.join(owners, ["library_id", task]).groupBy("library_id", "slug", task).agg(
        F.when(F.min("s_acctbal") < 0, "failed").otherwise("ok").alias("status"), F.max("p_size").alias("val"))


def passes(spark, sf):
    """Catalog, index, old extraction, offers, probes, days, library policies and corrections for every pass of the tables.

    Sides with the passes' own key are dealt by library while their rows are keys and numbers, before their texts stand in them."""
    rows = pass_rows(spark, sf)
    catalog = V(spark, sf, "d_catalog")
    own = ["platform", "library_id", "attraction_rawslug"]
    task = gold.task_column(spark, rows)
    held = [task, *own]
    dealt = lambda df: gold.by_library(df.select(*own, "attraction_id"), rows)
    index = catalog.select("platform", "library_id", F.col("attraction_id").alias("pos"), F.col("attraction_rawslug").alias("slug"),
                           F.expr("CASE p_type WHEN 'LARGE' THEN 'physical-circ' WHEN 'SMALL' THEN 'physical-coupon' ELSE 'digital' END").alias("pass_type"), F.lit(None).cast("string").alias("museum_hex"))
    old = dealt(catalog.filter("library_id % 4 = 0")).select(*held, F.when(F.col("attraction_id") % 2 == 0, "ok").otherwise("failed").alias("status"), F.lit("physical_circ").alias("pass_form"),
        F.expr(f"CAST(named_struct('capacity', null, 'audience_policies', null, 'summary', 'old', 'source_phrase_block', 'old text') AS {COUPON})").alias("coupon"), F.lit(None).cast(RULES).alias("restrictions"),
        F.expr(f"CAST(named_struct('restricted', 'yes', 'scope', 'ma', 'source', 'catalog_text', 'evidence', 'e') AS {gold.RESIDENCY})").alias("residency"))
    auth = _auth(spark, sf, rows).select(task, "library_id", "slug", "status", F.expr("CASE val % 3 WHEN 0 THEN 'Emailed to you.' WHEN 1 THEN 'For Ashmere residents only' ELSE 'Enjoy.' END").alias("raw"),
        F.lit("people").alias("capacity_kind"), F.lit(4).alias("capacity_n"), F.expr(f"CAST(array(named_struct('audience', 'Adult', 'form', 'percent-off', 'value', val, 'count', null, 'age_range', null, 'source_phrase', null)) AS {POLICIES})").alias("audience_policies"),
        F.lit(None).cast("map<string,string>").alias("source_phrases"), F.expr("CASE WHEN val % 4 = 0 THEN array('2026-07-04') END").alias("blackout_dates"), F.lit(False).alias("weekdays_only"), F.lit(None).cast("string").alias("seasonal"))
    known = dealt(catalog.filter("(library_id + attraction_id) % 3 < 2"))
    probes = known.select(*held, F.expr("CASE (library_id + attraction_id) % 4 WHEN 0 THEN 'rejected_resident' WHEN 1 THEN 'accepted' WHEN 2 THEN 'format_error' ELSE 'timed_out' END").alias("verdict"),
        F.expr("CASE WHEN (library_id + attraction_id) % 4 = 0 THEN 'yes' END").alias("restricted"), F.lit("seen").alias("evidence"), F.lit("c1").alias("prober_card"), F.lit("2026-05-01").alias("probed_date"))
    days = known.select(*held, F.lit("2026-05-02").alias("day"), F.when(F.col("attraction_id") % 2 == 0, "booked").otherwise("available").alias("status"))
    policy = V(spark, sf, "d_library").filter("library_id % 5 = 0").select("library_id", F.lit(None).cast("string").alias("restricted"), F.lit("town").alias("scope"), F.lit(None).cast("string").alias("source"), F.lit("sign").alias("evidence"))
    target = F.concat(F.col("library_id").cast("string"), F.lit("__"), F.col("attraction_rawslug")).alias("id")
    changed = catalog.filter("attraction_id % 50 < 2").select(F.lit("pass").alias("kind"), target, F.when(F.col("attraction_id") % 50 == 0, "__drop__").otherwise("pass_form").alias("field"),
        F.when(F.col("attraction_id") % 50 == 0, "removed").otherwise("corrected").alias("status"), F.when(F.col("attraction_id") % 50 == 1, "physical_coupon").alias("value"))
    shaped = catalog.select(*own, F.lit(None).cast("string").alias("detail_url"), F.lit(None).cast("string").alias("benefit_text"), F.when(F.col("p_size") > 40, "digital").alias("pass_type"))
    return gold.build_passes(shaped, index, old, auth, probes, days, policy, changed, aliases(spark, sf), rows=rows)


PASS_SQL = """SELECT c.library_id, c.attraction_rawslug, k.canonical AS attraction_slug, CASE WHEN c.attraction_id % 50 = 1 THEN 'physical_coupon' WHEN a.status = 'ok' AND a.val % 3 = 0 THEN 'digital_email'
        WHEN p_size > 40 THEN 'digital_email' WHEN p_type = 'LARGE' THEN 'physical_circ' WHEN p_type = 'SMALL' THEN 'physical_coupon' ELSE 'digital_email' END AS pass_form,
    CASE WHEN a.status = 'ok' THEN concat(a.val, '% off') WHEN c.library_id % 4 = 0 AND c.attraction_id % 2 = 0 THEN 'old' END AS summary, a.status = 'ok' AND a.val % 4 = 0 AS has_rules,
    CASE WHEN a.status = 'ok' AND a.val % 3 = 1 OR c.library_id % 4 = 0 AND c.attraction_id % 2 = 0 OR c.library_id % 5 = 0 THEN 'yes' ELSE 'unknown' END AS restricted,
    CASE WHEN a.status = 'ok' AND a.val % 3 = 1 THEN 'coupon_source_phrase' WHEN c.library_id % 4 = 0 AND c.attraction_id % 2 = 0 THEN 'catalog_text' WHEN c.library_id % 5 = 0 THEN 'library_pass_policy' END AS source,
    CASE WHEN g % 3 < 2 THEN CASE g % 4 WHEN 0 THEN 'own_card_only' WHEN 1 THEN 'network_open' WHEN 2 THEN 'ambiguous' ELSE 'not_verified' END ELSE 'not_verified' END AS verdict,
    g % 3 < 2 AND g % 4 = 0 AS own_card, CASE WHEN g % 3 < 2 THEN CASE WHEN c.attraction_id % 2 = 0 THEN 'booked' ELSE 'available' END END AS day_status
    FROM (SELECT *, library_id + attraction_id AS g FROM {d_catalog} x) c JOIN {d_canon} k ON k.p_partkey = c.attraction_id
    LEFT JOIN (SELECT library_id, slug, coalesce(status, '') AS status, val FROM {d_auth} y) a ON a.library_id = c.library_id AND a.slug = k.canonical WHERE c.attraction_id % 50 <> 0"""


@query("gold_passes", PASS_SQL.replace("a.status = 'ok' AND a.val % 4 = 0 AS has_rules", "coalesce(a.status = 'ok' AND a.val % 4 = 0, false) AS has_rules"))
def gold_passes(spark, sf):
    return passes(spark, sf).select("library_id", "attraction_rawslug", "attraction_slug", "pass_form", "coupon.summary", F.col("restrictions").isNotNull().alias("has_rules"),
        "residency_restriction.restricted", "residency_restriction.source", "booking_access_probe.verdict", F.col("requires_own_card").alias("own_card"), F.try_element_at("availability", F.lit("2026-05-02")).alias("day_status"))


def libraries(spark, sf):
    lib = V(spark, sf, "d_library").withColumn("id", F.col("library_id").cast("string"))
    addr, geo = "struct<street:string,city:string>", "struct<lat:double,lon:double>"
    seeds = lib.select("id", "name", F.col("area").alias("town"), "network", F.lit("wizard").alias("platform"), F.lit(None).cast("string").alias("card_page"),
        F.when(F.col("library_id") % 2 == 0, F.array(F.lit("X"), F.lit("Y"))).alias("card_issuance_groups"), F.array().cast("array<string>").alias("card_auth_groups"), F.lit(None).cast(addr).alias("address"), F.lit(None).cast(geo).alias("geo"))
    region = V(spark, sf, "region").filter("r_regionkey > 0")
    zips = region.select(F.col("r_name").alias("town"), F.array(F.format_string("%05d", F.col("r_regionkey").cast("int"))).alias("zips"))
    archive = lib.select("id", F.struct(F.concat(F.col("id"), F.lit(" Mill Lane")).alias("street"), F.col("area").alias("city")).alias("address"), F.when(F.col("lat").isNotNull(), F.struct("lat", "lon")).alias("geo"))
    policies = lib.filter("library_id % 3 = 0").select("id", F.lit("ma_resident").alias("card_eligibility"), F.lit(None).cast("string").alias("pass_pickup"))
    changed = lib.filter("library_id % 7 = 0").select(F.lit("library").alias("kind"), "id", F.lit("card_eligibility").alias("field"), F.lit("corrected").alias("status"), F.lit("network").alias("value"))
    evidence = lib.select("id", F.when(F.col("library_id") % 2 == 1, "line 1\n\n  line 2").alias("source_block"), F.lit("p").alias("source_phrase"), F.lit("u").alias("source_url"))
    return gold.build_libraries(seeds, zips, archive, policies, changed, evidence)


@query("gold_libraries", """SELECT CAST(library_id AS VARCHAR) AS id, name, area AS town, CASE WHEN library_id % 2 = 0 THEN 'X,Y' ELSE network END AS issuing, network AS auth,
    CASE area WHEN 'AFRICA' THEN '' ELSE (SELECT concat('0000', r_regionkey) FROM {region} WHERE r_name = area) END AS zips, concat(library_id, ' Mill Lane') AS street, lat,
    CASE WHEN library_id % 7 = 0 THEN 'network' WHEN library_id % 3 = 0 THEN 'ma_resident' ELSE 'unknown' END AS card_eligibility, 'unknown' AS pickup, CASE WHEN library_id % 2 = 1 THEN concat('line 1', chr(10), 'line 2') END AS block FROM {d_library} l""")
def gold_libraries(spark, sf):
    text = lambda c: F.array_join(c, ",")
    return libraries(spark, sf).select("id", "name", "town", text("card_issuance_groups").alias("issuing"), text("card_auth_groups").alias("auth"), text("resident_zips").alias("zips"),
                                       "address.street", "geo.lat", "card_eligibility", F.col("pass_pickup_default").alias("pickup"), F.col("card_evidence.block").alias("block"))


@query("gold_branches", f"""WITH b AS (SELECT b.*, l.lat AS la, l.lon AS lo, CASE WHEN segment = 'BUILDING' THEN 'Main' ELSE b.name END AS nm FROM {{d_branch}} b LEFT JOIN {{d_library}} l ON l.library_id = b.library_id),
    h AS (SELECT branch_id FROM b WHERE c_acctbal > 1000 AND (la IS NULL OR {_h('la', 'lo', 'lat + 0.1', 'lon')} <= 20))
    SELECT b.branch_id, b.library_id, CASE WHEN b.branch_id % 10 = 0 THEN 'Renamed' ELSE nm END AS name, round(CASE WHEN b.branch_id % 10 = 1 THEN 42.5 WHEN c_acctbal < 0 THEN b.lat WHEN h.branch_id IS NOT NULL THEN b.lat + 0.1 WHEN nm = 'Main' THEN la END, 4) AS lat
    FROM b LEFT JOIN h ON h.branch_id = b.branch_id""")
def gold_branches(spark, sf):
    b = V(spark, sf, "d_branch")
    rosters = b.select("branch_id", "library_id", F.when(F.col("segment") == "BUILDING", "Main").otherwise(F.col("name")).alias("name"), F.when(F.col("c_acctbal") < 0, F.col("lat")).alias("lat"), F.when(F.col("c_acctbal") < 0, F.col("lon")).alias("lon"))
    lib = V(spark, sf, "d_library").select("library_id", F.col("area").alias("town"), F.lit(None).cast("string").alias("city"), "lat", "lon")
    hits = b.filter("c_acctbal > 1000").select("branch_id", F.lit(1).alias("attempt"), F.lit(True).alias("ok"), (F.col("lat") + 0.1).alias("lat"), "lon")
    target = F.concat(F.col("library_id").cast("string"), F.lit("__"), F.col("branch_id").cast("string")).alias("id")
    rename = F.col("branch_id") % 10 == 0
    changed = b.filter("branch_id % 10 < 2").select(F.lit("branch").alias("kind"), target, F.when(rename, "name").otherwise("lat").alias("field"), F.lit("corrected").alias("status"), F.when(rename, "Renamed").otherwise("42.5").alias("value"))
    return gold.build_branches(rosters, lib, hits, changed).select("branch_id", "library_id", "name", F.round("lat", 4).alias("lat"))


def attractions(spark, sf):
    """Catalog titles, pages, prices, hours, archive, corrections and price evidence for every part, under its canonical key."""
    part = V(spark, sf, "part").join(V(spark, sf, "d_key").select("p_partkey", "raw"), "p_partkey").withColumn("no", F.col("p_partkey").cast("string"))
    none, k = F.lit(None).cast("string"), F.col("p_partkey")
    price = "array<struct<audience:string,price:double,source_block:string,source_url:string>>"
    catalog = part.select(F.col("raw").alias("attraction_slug"), F.when(k % 5 == 0, " ").otherwise(F.col("p_name")).alias("title"), k.alias("pos"))
    pages = part.filter(k % 3 == 0).select(F.col("raw").alias("slug"), F.when(k % 2 == 0, F.concat(F.lit("http://site/"), "no")).alias("url"), none.alias("title"), F.concat(F.lit("http://img/"), "no").alias("og_image"))
    prices = part.filter(k % 2 == 1).select(F.col("raw").alias("slug"), F.when(F.col("p_size") > 25, "ok").otherwise("failed").alias("status"),
        F.expr(f"CAST(array(named_struct('audience', 'adult', 'price', p_size, 'source_block', null, 'source_url', null)) AS {price})").alias("prices"))
    hours = part.filter(k % 4 == 0).select(F.col("raw").alias("slug"), F.lit("ok").alias("status"), F.expr("map('monday', 'closed', 'tuesday', '10:00-17:00')").alias("hours"))
    own = K.canonical_key(part, "raw", aliases(spark, sf), "slug").groupBy("slug").agg(F.min("p_partkey").alias("m")).withColumn("no", F.col("m").cast("string"))
    archive = own.filter(F.col("m") % 7 < 4).select("slug", F.when(F.col("m") % 2 == 0, F.concat(F.lit("Hall "), "no")).alias("name"), F.concat(F.lit("http://old/"), "no").alias("website"), F.lit("617").alias("phone"),
        F.concat("no", F.lit(" Mill Lane, Ashmere, MA 01999")).alias("address"), F.lit("old words").alias("description"), F.array(F.lit("Tours"), F.lit("Crafts"), F.lit("Lawn")).alias("categories"), none.alias("hero_image"),
        F.expr(f"CAST(null AS {price})").alias("prices"), F.expr("map('sunday', 'closed')").alias("hours"))
    changed = own.filter(F.col("m") % 11 == 0).select(F.lit("attraction").alias("kind"), F.col("slug").alias("id"), F.lit("phone").alias("field"), F.lit("corrected").alias("status"), F.concat(F.lit("555-"), "no").alias("value"))
    block = F.concat(F.lit("Adults\n\n  no "), "no")
    evidence = own.select("slug", F.array(F.struct(F.lit("adult").alias("audience"), F.lit("").alias("source_block"), F.lit("http://x").alias("source_url")),
                                          F.struct(F.lit("adult").alias("audience"), block.alias("source_block"), F.concat(F.lit("http://e/"), "no").alias("source_url"))).alias("prices"))
    return gold.build_attractions(catalog, pages, prices, hours, archive, changed, evidence, aliases(spark, sf))


ATTRACTION_SQL = """SELECT slug, coalesce(CASE WHEN old AND m % 2 = 0 THEN concat('Hall ', m) END, title, array_to_string(list_transform(string_split(slug, '-'), lambda w: concat(upper(w[1]), w[2:])), ' ')) AS name,
    coalesce(CASE WHEN pg % 2 = 0 THEN concat('http://site/', pg) END, CASE WHEN old THEN concat('http://old/', m) END) AS website, CASE WHEN m % 11 = 0 THEN concat('555-', m) WHEN old THEN '617' END AS phone,
    CASE WHEN old THEN '01999' END AS zip, CASE WHEN old THEN 'History,Art' ELSE '' END AS categories, CASE WHEN pg IS NOT NULL THEN concat('http://img/', pg) END AS hero_image, CAST(price AS DOUBLE) AS price,
    CASE WHEN price IS NOT NULL THEN concat('Adults', chr(10), 'no ', m) END AS block, CASE WHEN price IS NOT NULL THEN concat('http://e/', m) END AS price_url, CASE WHEN timed THEN 'monday' WHEN old THEN 'sunday' ELSE '' END AS closed
    FROM (SELECT canonical AS slug, min(k.p_partkey) AS m, min(k.p_partkey) % 7 < 4 AS old, arg_max(p_name, length(p_name) * 1000000000 - k.p_partkey) FILTER (k.p_partkey % 5 <> 0) AS title, arg_min(k.p_partkey, k.raw) FILTER (k.p_partkey % 3 = 0) AS pg,
        arg_min(p_size, k.raw) FILTER (k.p_partkey % 6 = 3 AND p_size > 25) AS price, coalesce(bool_or(k.p_partkey % 12 = 0), false) AS timed FROM {d_canon} k JOIN {part} p ON p.p_partkey = k.p_partkey GROUP BY canonical)"""


@query("gold_attractions", ATTRACTION_SQL)
def gold_attractions(spark, sf):
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    first = F.get("prices", F.lit(0))
    return attractions(spark, sf).select("slug", "name", "website", "phone", "address.zip", text("categories").alias("categories"), "hero_image", first["price"].alias("price"), first["source_block"].alias("block"),
                                         first["source_url"].alias("price_url"), text("closed_days").alias("closed"))


def _metric(table, metric, bad, rows):
    return f"""SELECT '{table}' AS "table", '{metric}' AS metric, count(*) AS n, count(*) FILTER ({bad}) AS n_bad, round(100.0 * count(*) FILTER ({bad}) / count(*), 1)::DOUBLE AS pct FROM {rows}"""


@query("gold_validation_report", " UNION ALL ".join([
    _metric("libraries", "card_eligibility_unknown", "s_suppkey % 7 <> 0 AND s_suppkey % 3 <> 0", "{supplier}"), _metric("libraries", "pass_pickup_unknown", "true", "{supplier}"),
    _metric("attractions", "prices_missing", "price IS NULL", f"({ATTRACTION_SQL}) a"), _metric("attractions", "hours_missing", "closed = ''", f"({ATTRACTION_SQL}) a"), _metric("attractions", "categories_empty", "categories = ''", f"({ATTRACTION_SQL}) a"),
    _metric("passes", "coupon_missing", "summary IS NULL", f"({PASS_SQL}) p"), _metric("passes", "residency_unknown", "restricted = 'unknown'", f"({PASS_SQL}) p"), _metric("passes", "duplicate_audience", "false", f"({PASS_SQL}) p")]))
def gold_validation_report(spark, sf):
    """The report over the three tables as they are built here."""
    return gold.validation_report(libraries(spark, sf), attractions(spark, sf), passes(spark, sf))
