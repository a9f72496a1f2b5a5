"""Offers, rules and policies read from text. Texts are built from table columns, so the SQL states the expected reading directly."""

from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions import benefit, core, eligibility, prices, text, weekly
from weftline.plans.derived import spread, view
from weftline.plans.registry import query

V = view
BIG = lambda c: c.cast("bigint")
MONEY = "CASE kind WHEN 0 THEN concat(pct, '% off') WHEN 1 THEN 'FREE' WHEN 2 THEN concat('$', d, ' off') WHEN 3 THEN concat('$', d, '/person') WHEN 4 THEN 'BOGO' WHEN 5 THEN 'discount' WHEN 7 THEN concat('$', d + 10, '/person')"
KIND = "CASE kind WHEN 0 THEN 'percent-off' WHEN 1 THEN 'free' WHEN 2 THEN 'dollar-off' WHEN 3 THEN 'per-person-price' WHEN 4 THEN 'bogo' WHEN 5 THEN 'discount' WHEN 7 THEN 'per-person-price' WHEN 8 THEN 'free' WHEN 9 THEN 'free' WHEN 10 THEN 'percent-off' END"


def offers(spark, sf):
    d = spread(spark, sf, "d_offer").withColumns({"slug": F.when(F.col("n") == 7, "zoo-e-coupon").otherwise("zoo"), "platform": F.when(F.col("d") % 2 == 0, "libcal").otherwise("wizard")})
    return benefit.extract_coupon(d, "body", "slug", "platform")


@query("offer_extraction", f"""SELECT p_partkey, CASE WHEN kind IN (6, 11) THEN 'failed' ELSE 'ok' END AS status, CASE kind WHEN 6 THEN 'no benefit text available' WHEN 11 THEN 'unparsed benefit' END AS error,
    CASE WHEN kind IN (6, 11) THEN NULL WHEN n = 7 THEN 'digital_email' ELSE 'physical_coupon' END AS pass_form, {MONEY} WHEN 8 THEN CASE WHEN d % 2 = 0 THEN 'FREE parking' ELSE 'FREE' END WHEN 9 THEN 'FREE' WHEN 10 THEN '50% off' END AS summary,
    CASE WHEN kind IN (6, 11) THEN NULL WHEN kind IN (0, 1, 10) THEN 'people' WHEN kind = 8 THEN 'vehicle' ELSE 'unspecified' END AS cap_kind, CASE WHEN kind IN (0, 1, 10) THEN n WHEN kind = 8 THEN 1 END AS cap_n FROM {{d_offer}} o""")
def offer_extraction(spark, sf):
    return offers(spark, sf).select("p_partkey", "offer.status", "offer.error", "offer.pass_form", "offer.summary", F.col("offer.capacity.kind").alias("cap_kind"), F.col("offer.capacity.n").alias("cap_n"))


@query("offer_policies", f"""SELECT p_partkey, CASE WHEN kind = 7 THEN 'adults' ELSE 'Everyone' END AS audience, {KIND} AS form, CAST(CASE kind WHEN 0 THEN pct WHEN 2 THEN d WHEN 3 THEN d WHEN 7 THEN d + 10 WHEN 10 THEN 50 WHEN 1 THEN 0 WHEN 8 THEN 0 WHEN 9 THEN 0 END AS DOUBLE) AS value,
    CASE WHEN kind IN (0, 1, 10) THEN n WHEN kind = 8 THEN 1 END AS cnt, CASE WHEN kind = 7 THEN 18 END AS age_min, body AS phrase FROM {{d_offer}} o WHERE kind NOT IN (6, 11)
    UNION ALL SELECT p_partkey, 'children', 'per-person-price', CAST(d AS DOUBLE), NULL, NULL, body FROM {{d_offer}} o WHERE kind = 7""")
def offer_policies(spark, sf):
    d = benefit.policy_rows(offers(spark, sf), ["p_partkey"])
    return d.select("p_partkey", "p.audience", "p.form", "p.value", F.col("p.count").alias("cnt"), F.col("p.age_range.min").alias("age_min"), F.col("p.source_phrase").alias("phrase"))


@query("offer_mix", f"SELECT {KIND} AS form, count(*) AS n, CAST(sum(CASE WHEN kind IN (0, 1, 10) THEN n WHEN kind = 8 THEN 1 END) AS BIGINT) AS people FROM {{d_pass}} p JOIN {{d_offer}} o ON o.p_partkey = p.attraction_id GROUP BY 1")
def offer_mix(spark, sf):
    """Each distinct text is read once; its passes are counted afterwards."""
    n = V(spark, sf, "d_pass").groupBy(F.col("attraction_id").alias("p_partkey")).agg(F.count("*").alias("w"))
    d = offers(spark, sf).join(n, "p_partkey")
    form = F.get("offer.audience_policies", F.lit(0))["form"]
    return d.groupBy(form.alias("form")).agg(F.sum("w").alias("n"), BIG(F.sum(F.col("offer.capacity.n") * F.col("w"))).alias("people"))


@query("offer_capacity", "SELECT p_partkey, CASE WHEN kind IN (0, 1, 10) THEN 'people' WHEN kind = 8 THEN 'vehicle' ELSE 'unspecified' END AS kind, CASE WHEN kind IN (0, 1, 10) THEN n WHEN kind = 8 THEN 1 END AS n FROM {d_offer} o")
def offer_capacity(spark, sf):
    return spread(spark, sf, "d_offer").withColumn("c", benefit.extract_capacity(benefit.clean_benefit("body"))).select("p_partkey", "c.kind", "c.n")


@query("negative_price_context", "SELECT p_partkey, CASE WHEN kind = 3 THEN concat('Visitors pay $', d, ' per person with this pass.  .') ELSE body END AS rest FROM {d_offer} o")
def negative_price_context(spark, sf):
    return spread(spark, sf, "d_offer").select("p_partkey", benefit.without_negative_prices("body").alias("rest"))


@query("source_text_window", "SELECT p_partkey, CASE WHEN kind % 2 = 0 THEN concat(trim(\"left\"(body, 20)), ' & more') ELSE body END AS src FROM {d_offer} o")
def source_text_window(spark, sf):
    phrases = F.when(F.col("kind") % 2 == 0, F.array(F.concat(F.lit("  "), F.left("body", F.lit(20))), F.lit(""), F.lit("&amp;  more"))).otherwise(F.array().cast("array<string>"))
    return spread(spark, sf, "d_offer").withColumn("phrases", phrases).select("p_partkey", benefit.joined_source("phrases", "body").alias("src"))


@query("stated_restrictions", """SELECT p_partkey, CASE WHEN kind = 0 THEN month_no END AS month, CASE WHEN kind < 4 THEN kind = 0 END AS weekdays_only, CASE WHEN kind < 4 THEN kind = 1 END AS advance, CASE WHEN kind = 2 THEN 'One booking per month' END AS frequency,
    CASE WHEN kind = 3 THEN concat('A late fee of $', d, ' applies') END AS penalty FROM {d_rule} r""")
def stated_restrictions(spark, sf):
    d = spread(spark, sf, "d_rule").withColumn("r", benefit.extract_restrictions("body"))
    return d.select("p_partkey", F.get("r.blackout", F.lit(0))["month"].alias("month"), "r.weekdays_only", F.col("r.advance_booking_required").alias("advance"), F.col("r.booking_frequency_limit").alias("frequency"), F.col("r.late_return_penalty").alias("penalty"))


@query("stated_residency", "SELECT p_partkey, CASE kind WHEN 4 THEN 'town' WHEN 5 THEN 'ma' END AS scope, CASE WHEN kind IN (4, 5) THEN body END AS evidence FROM {d_rule} r")
def stated_residency(spark, sf):
    d = spread(spark, sf, "d_rule").withColumn("r", benefit.extract_residency_restriction("body"))
    return d.select("p_partkey", "r.scope", "r.evidence")


@query("residents_only_text", """SELECT p_partkey, CASE k WHEN 0 THEN 'town' WHEN 1 THEN 'ma' WHEN 2 THEN 'town' END AS scope, CASE k WHEN 0 THEN concat('coupon source phrase: "for Town', p_size, ' residents only"') WHEN 1 THEN 'coupon source phrase: "MA residents only"'
    WHEN 2 THEN 'coupon source phrase: "limited to Salem residents"' END AS evidence FROM (SELECT p_partkey, p_size, p_partkey % 4 AS k FROM {part})""")
def residents_only_text(spark, sf):
    k = F.col("p_partkey") % 4
    body = (F.when(k == 0, F.concat(F.lit("This pass is for Town"), F.col("p_size").cast("string"), F.lit(" residents only."))).when(k == 1, "Open to MA residents only.")
            .when(k == 2, "Shown for adult residents only; use is limited to Salem residents.").otherwise("Open to all."))
    return spread(spark, sf, "part").withColumn("r", benefit.residency_from_block(body)).select("p_partkey", "r.scope", "r.evidence")


@query("delivery_form", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'digital_email' WHEN 1 THEN 'physical_circ' WHEN 2 THEN 'physical_coupon' WHEN 3 THEN 'digital_email' END AS form FROM {part}")
def delivery_form(spark, sf):
    k = F.col("p_partkey") % 5
    body = (F.when(k == 0, "This E-VOUCHER   needs no visit.").when(k == 1, "Physical pass. It must be   returned by 8pm.").when(k == 2, "Disposable pass, keep it.")
            .when(k == 3, "There is nothing to pick up; no paper pass must be returned.").otherwise("Ask at the desk."))
    return spread(spark, sf, "part").select("p_partkey", benefit.delivery_form(body).alias("form"))


@query("short_offer_label", f"""SELECT p_partkey, CASE kind WHEN 0 THEN concat(pct, '% off') WHEN 1 THEN 'Free' WHEN 2 THEN concat('$', d, ' off') WHEN 3 THEN concat('$', d) WHEN 5 THEN 'Discount' WHEN 8 THEN 'Free' WHEN 9 THEN 'Free' WHEN 10 THEN '50% off' ELSE '' END AS label,
    CASE kind WHEN 0 THEN CASE WHEN pct = 50 THEN 'half' ELSE 'percent-off' END WHEN 1 THEN 'free' WHEN 2 THEN 'dollar-off' WHEN 3 THEN 'price' WHEN 5 THEN 'discount' WHEN 8 THEN 'free' WHEN 9 THEN 'free' WHEN 10 THEN 'half' ELSE 'unknown' END AS label_class FROM {{d_offer}} o""")
def short_offer_label(spark, sf):
    return spread(spark, sf, "d_offer").withColumn("l", benefit.normalize_benefit("body")).select("p_partkey", "l.label", "l.label_class")


@query("offer_form_class", "SELECT p_partkey, CASE kind WHEN 0 THEN 'percent-off' WHEN 2 THEN 'dollar-off' WHEN 3 THEN 'per-person-price' WHEN 4 THEN 'bogo' ELSE 'discount' END AS form FROM {d_offer} o")
def offer_form_class(spark, sf):
    return spread(spark, sf, "d_offer").select("p_partkey", benefit.classify_coupon_form("body").alias("form"))


@query("pass_type_classes", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'physical-circ' WHEN 1 THEN 'physical-coupon' WHEN 2 THEN 'digital' WHEN 3 THEN 'digital' WHEN 4 THEN 'physical-circ' ELSE 'unknown' END AS by_detail,
    CASE p_partkey % 6 WHEN 2 THEN '(e-coupon)' WHEN 0 THEN '(physical)' WHEN 1 THEN '(physical)' WHEN 3 THEN '(body: digital)' WHEN 4 THEN '(body: returnable)' ELSE '' END AS raw,
    CASE p_partkey % 6 WHEN 0 THEN 'physical-circ' WHEN 1 THEN 'physical-coupon' WHEN 3 THEN 'digital' WHEN 4 THEN 'physical-circ' ELSE 'unknown' END AS by_body,
    CASE p_size % 4 WHEN 0 THEN 'physical-circ' WHEN 1 THEN 'physical-coupon' WHEN 2 THEN 'digital' ELSE 'unknown' END AS by_text FROM {part}""")
def pass_type_classes(spark, sf):
    k = F.col("p_partkey") % 6
    title = F.concat(F.col("p_name"), F.when(k.isin(0, 1), " (Physical Pass)").when(k == 2, " (e-coupon)").otherwise(""))
    body = (F.when(k.isin(0, 4), "Passes must be returned on time.").when(k == 1, "A disposable ticket.").when(k == 3, "Electronic pass, downloadable via email.").otherwise("Enjoy."))
    kind = F.expr("CASE p_size % 4 WHEN 0 THEN 'Circulating Pass (7 days)' WHEN 1 THEN 'Coupon Pass (must be picked up at the desk)' WHEN 2 THEN 'Printable/Digital Coupon Pass' ELSE 'Other' END")
    d = spread(spark, sf, "part").withColumn("t", benefit.pass_type_from_detail(title, body)).withColumn("b", benefit.pass_type_from_body(body))
    return d.select("p_partkey", F.col("t.pass_type").alias("by_detail"), F.col("t.raw").alias("raw"), F.col("b.pass_type").alias("by_body"), benefit.classify_pass_type_text(kind).alias("by_text"))


CARD = "CASE p_partkey % 7 WHEN 0 THEN concat('Any Massachusetts resident may apply at branch ', {k}, '.') WHEN 1 THEN 'You must live, work, or attend school in town.' WHEN 2 THEN 'Acton residents may register for a card.' WHEN 3 THEN 'Use your library card from Minuteman.' WHEN 4 THEN 'Anyone can get a library card.' WHEN 5 THEN 'I don''t live in Massachusetts.' ELSE 'Apply to be the next reading helper.' END"


@query("card_eligibility", f"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'ma_resident' WHEN 1 THEN 'town_or_works' WHEN 2 THEN 'town_resident' WHEN 3 THEN 'network' WHEN 4 THEN 'ma_resident' ELSE 'unknown' END AS eligibility,
    CASE WHEN p_partkey % 7 < 5 THEN {CARD.replace('{k}', 'p_size')} END AS phrase FROM {{part}}""")
def card_eligibility(spark, sf):
    d = spread(spark, sf, "part").withColumn("body", F.expr(CARD.replace("{k}", "CAST(p_size AS STRING)").replace("don''t", "don\\'t")))
    return d.select("p_partkey", eligibility.classify_card_eligibility("body").alias("eligibility"), eligibility.eligibility_phrase("body").alias("phrase"))


@query("pass_pickup_policy", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'walkin_for_nonresidents' WHEN 1 THEN 'town_cardholder_only' WHEN 2 THEN 'ma_resident' WHEN 3 THEN 'town_resident' WHEN 4 THEN 'network' ELSE 'unknown' END AS pickup FROM {part}""")
def pass_pickup_policy(spark, sf):
    body = F.expr("""CASE p_partkey % 6 WHEN 0 THEN 'Non-residents may use walk-in passes.' WHEN 1 THEN 'For Acton library cardholders.' WHEN 2 THEN 'Passes may be borrowed by Massachusetts residents.'
        WHEN 3 THEN 'Reserve a pass: Salem residents only.' WHEN 4 THEN 'Bring a NOBLE card.' ELSE 'Museum X is free to Massachusetts residents on Sunday.' END""")
    return spread(spark, sf, "part").select("p_partkey", eligibility.classify_pass_pickup(body).alias("pickup"))


@query("page_gates", """SELECT page_id, page_id % 5 = 0 AS bad, page_id % 5 IN (1, 2) AS cue FROM {pages}""")
def page_gates(spark, sf):
    k = F.col("page_id") % 5
    body = F.when(k == 0, "<h1>Page Not Found</h1> residents only").when(k == 1, "<p>Cards: residents only</p>").when(k == 2, "<p>Use your library card from Minuteman</p>").otherwise("<p>Welcome</p>")
    from weftline.functions.html import html_text
    d = spread(spark, sf, "pages").withColumn("h", F.concat(body, F.lit("<!-- "), F.col("url"), F.lit(" -->")))
    return d.select("page_id", text.is_bad_page("h").alias("bad"), eligibility.has_eligibility_cue("h", html_text("h")).alias("cue"))


@query("blackout_phrases", """SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(day(o_orderdate) AS BIGINT) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'mondays,sundays' ELSE '' END AS weekdays,
    true AS hit, o_orderkey % 2 = 0 AND dayofweek(CAST(o_orderdate AS DATE) + 40) IN (0, 1) AS later_hit FROM {orders}""")
def blackout_phrases(spark, sf):
    from weftline.functions import dates
    body = F.concat(F.lit("Closed "), F.date_format("o_orderdate", "MMMM d"), F.when(F.col("o_orderkey") % 2 == 0, " and on Mondays, Sundays.").otherwise("."))
    d = spread(spark, sf, "orders").withColumn("_d", dates.blackout_days(body)).withColumn("_w", dates.blackout_weekdays(body))
    one = F.get("_d", F.lit(0))
    return d.select("o_orderkey", BIG(one["month"]).alias("month"), BIG(one["day"]).alias("day"), F.array_join("_w", ",").alias("weekdays"), dates.is_blackout("_d", "_w", F.to_date("o_orderdate")).alias("hit"),
                    dates.is_blackout("_d", "_w", F.date_add(F.to_date("o_orderdate"), 40)).alias("later_hit"))


@query("blackout_test", """SELECT o_orderkey, (month(o_orderdate) = 7 AND day(o_orderdate) = 4) OR dayofweek(o_orderdate) = 1 AS blocked FROM {orders}""")
def blackout_test(spark, sf):
    from weftline.functions import dates
    days = F.array(F.struct(F.lit(7).alias("month"), F.lit(4).alias("day")))
    return spread(spark, sf, "orders").select("o_orderkey", dates.is_blackout(days, F.array(F.lit("mondays")), F.to_date("o_orderdate")).alias("blocked"))


@query("address_parts", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL WHEN c_custkey % 3 = 1 THEN concat(c_name, ' Wharf') ELSE concat(c_custkey, ' Main St, Suite 3') END AS street, CASE WHEN c_custkey % 3 = 0 THEN 'Boston' END AS city,
    CASE WHEN c_custkey % 3 = 0 THEN 'MA' END AS state, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') END AS zip FROM {customer}""")
def address_parts(spark, sf):
    k = F.col("c_custkey") % 3
    key = F.col("c_custkey").cast("string")
    raw = F.when(k == 0, F.concat(key, F.lit(" Main St, Suite 3,  Boston, MA "), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"), F.lit("-2104"))).when(k == 1, F.concat("c_name", F.lit(" Wharf"))).otherwise(" MA ")
    return spread(spark, sf, "customer").withColumn("a", text.address_struct(raw)).select("c_custkey", "a.street", "a.city", "a.state", "a.zip")


@query("old_hours_conversion", """SELECT s_suppkey, i, CASE v WHEN '09:00-17:00' THEN '09:00-17:00' WHEN '10:00-17:30' THEN '10:00-17:30' ELSE v END AS v FROM {d_hours} h WHERE s_suppkey IN (SELECT s_suppkey FROM {d_hours} x WHERE v <> 'unknown')""")
def old_hours_conversion(spark, sf):
    short = {"09:00-17:00": "9 AM – 5 PM", "10:00-17:30": "10 am - 5:30 p.m.", "closed": "Closed", "unknown": ""}
    vals = lambda i: core.map_codes(F.col(f"d{i}"), short)
    m = F.create_map(*[x for i, d in enumerate(fx.WEEK) for x in (F.lit(d[:3]), vals(i))])
    d = V(spark, sf, "d_week").select("s_suppkey", weekly.convert_hours(m).alias("h")).filter("h IS NOT NULL")
    return d.select("s_suppkey", F.posexplode(F.array(*[F.element_at("h", F.lit(w)) for w in fx.WEEK])).alias("i", "v"))


@query("old_price_unpivot", """SELECT p_partkey, audience, price, min_age, max_age FROM (SELECT p_partkey, 'adult' AS audience, CAST(p_size AS DOUBLE) AS price, 18 AS min_age, NULL AS max_age FROM {part} WHERE p_size % 2 = 0
    UNION ALL SELECT p_partkey, 'student', CAST(p_size % 9 AS DOUBLE), NULL, NULL FROM {part} UNION ALL SELECT p_partkey, 'child', 0.0, 0, p_size % 7 - 1 FROM {part} WHERE p_size % 7 > 0)""")
def old_price_unpivot(spark, sf):
    null = F.lit(None).cast("int")
    cols = {f"{a}_{x}": null for a in fx.AGE_AUDIENCES for x in ("price", "min", "max")} | {f"{a}_price": null for a in [*fx.IDENTITY_AUDIENCES, "family"]}
    cols |= {"adult_price": F.when(F.col("p_size") % 2 == 0, F.col("p_size")), "adult_min": F.lit(18), "student_price": F.col("p_size") % 9, "free_under_age": F.col("p_size") % 7}
    d = spread(spark, sf, "part").withColumns(cols).select("p_partkey", F.explode(prices.old_price_rows(F.col)).alias("r"))
    return d.select("p_partkey", "r.audience", "r.price", F.col("r.min").alias("min_age"), F.col("r.max").alias("max_age"))


@query("geocode_queries", """SELECT c_custkey, i, q FROM (SELECT c_custkey, unnest(qs) AS q, generate_subscripts(qs, 1) AS i FROM (SELECT c_custkey, [concat(c_custkey, '-9999 East Street, Suite 12, Boston'), concat(c_custkey, ' East Street, Boston'), concat(c_name, ' (Main)/Annex, MA'), concat(c_name, ' (Main)/Annex'),
    concat(c_name, ' , MA'), c_name] AS qs FROM {customer}))""".replace("concat(c_name, ' , MA')", "concat(c_name, ', MA')"))
def geocode_queries(spark, sf):
    addr = F.concat(F.col("c_custkey").cast("string"), F.lit("-9999 East Street, Suite 12, Boston"))
    d = spread(spark, sf, "customer").select("c_custkey", F.posexplode(text.geocode_queries(F.concat("c_name", F.lit(" (Main)/Annex")), addr, ", MA")).alias("p", "q"))
    return d.select("c_custkey", BIG(F.col("p") + 1).alias("i"), "q")


@query("library_mentions", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN concat('North', s_suppkey, ' Public Library|East Side Library') ELSE 'East Side Library' END AS names FROM {supplier}")
def library_mentions(spark, sf):
    first = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("  North"), F.col("s_suppkey").cast("string"), F.lit(" Public Library, open\n"))).otherwise("a small Library\n")
    body = F.concat(first, F.lit("East Side Library and more\nthe Old Library\nEast Side Library again\nX Library"))
    return V(spark, sf, "supplier").select("s_suppkey", F.array_join(text.library_mentions(body), "|").alias("names"))


@query("policy_text_blocks", r"""SELECT page_id, md5(coalesce(array_to_string(ds, chr(10)), '')) AS digest FROM (SELECT page_id, list_filter(list_transform(list_zip(ts, range(1, len(ts) + 1)), lambda z: CASE WHEN list_position(ts, z[1]) = z[2] THEN z[1] END), lambda x: x IS NOT NULL) AS ds
    FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<(?:p|li|div)[^>]*>(.*?)</(?:p|li|div)>', 1), lambda b: trim(regexp_replace(regexp_replace(b, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))), lambda t: length(t) > 20) AS ts FROM {pages}))""")
def policy_text_blocks(spark, sf):
    from weftline.functions.html import policy_text
    return spread(spark, sf, "pages").select("page_id", F.md5(policy_text("html")).alias("digest"))


@query("response_verdicts", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected_resident' WHEN 2 THEN 'format_error' WHEN 3 THEN 'booked_unexpectedly' ELSE 'unknown' END AS wizard,
    CASE o_orderkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected_invalid' WHEN 2 THEN 'format_error' WHEN 3 THEN 'booked_unexpectedly' ELSE 'rejected_resident' END AS calendar,
    CASE o_orderkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected_invalid' WHEN 2 THEN 'format_error' WHEN 3 THEN 'booked_unexpectedly' ELSE 'rejected_resident' END AS login,
    CASE o_orderkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected_resident' WHEN 2 THEN 'format_error' ELSE 'unknown' END AS retried FROM {orders}""")
def response_verdicts(spark, sf):
    from weftline.functions.html import response_verdict, retry_verdict
    body = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN '<legend> Reserver Information</legend><input name="booking_date"><a href="/ui/byMuseum/">' WHEN 1 THEN 'Invalid library card: it does not appear to be valid.'
        WHEN 2 THEN 'Please check the following: library card is a required field' WHEN 3 THEN 'Your reservation is complete. Confirmation number 7' ELSE 'Residents only, sorry' END""")
    d = spread(spark, sf, "orders").select("o_orderkey", F.concat(body, F.lit(" #"), F.col("o_custkey").cast("string")).alias("b"))
    return d.select("o_orderkey", *[response_verdict("b", k).alias(k) for k in ("wizard", "calendar", "login")], retry_verdict("b").alias("retried"))
