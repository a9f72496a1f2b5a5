"""Benefit text -> structured offer, as ranked rules on one text column.

``offer`` binds the shared text forms first, then the numbers, then the rule that
applies, then the values of that rule: every regex is written (and run) once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions.core import bind, code_map, col, contains_any, fmt_num, grab, has, let, map_codes, match_window, squeeze, swap, text_or_null, trim_zeros
from weftline.functions.text import decode_listed_entities, fold_width

POLICY = ("array<struct<audience:string,form:string,value:double,count:int,"
          "age_range:struct<min:int,max:int>,source_phrase:string>>")


def clean_benefit(c) -> Column:
    return squeeze(decode_listed_entities(F.coalesce(col(c), F.lit(""))))


def joined_source(phrases, text) -> Column:
    """Source phrases joined when there are any, else the benefit text; cleaned."""
    parts = F.filter(F.transform(col(phrases), clean_benefit), lambda p: p != "")
    return F.when(F.size(col(phrases)) > 0, F.array_join(parts, " ")).otherwise(clean_benefit(text))


def without_negative_prices(c) -> Column:
    """Drop 'regular admission $X' comparisons and fines before prices are read."""
    return reduce(lambda acc, p: swap(acc, p, " ", "iU"), fx.NEGATIVE_PRICE_CONTEXT, col(c))


def word_number(token) -> Column:
    low = F.lower(F.trim(col(token)))
    return F.when(low.rlike(r"^\d+$"), low.try_cast("int")).otherwise(F.try_element_at(code_map(fx.WORD_NUMBERS), low))


def is_navigation_only(c) -> Column:
    return reduce(lambda acc, p: acc | has(c, p), fx.NAVIGATION_ONLY, F.lit(False))


def extract_capacity(c) -> Column:
    """STRUCT<kind,n>: vehicle first (unless the hit is an exclusion clause), then three ranked people/ticket patterns."""
    t = col(c)
    hinted = f"({fx.VEHICLE_HINT})(?=(.{{0,6}}))"
    hit = grab(t, hinted, 1)
    around = F.lower(F.concat(F.coalesce(hit, F.lit("")), F.regexp_extract(t, f"(?iU){hinted}", 3)))
    vehicle = hit.isNotNull() & ~has(hit, fx.VEHICLE_EXCLUSION) & ~around.contains("kiosk")
    pair = lambda k, n: F.struct(k.alias("kind"), n.cast("int").alias("n"))
    kind = lambda p: F.when(F.lower(grab(t, p, 2)).contains("ticket"), F.lit("ticket")).otherwise(F.lit("people"))
    def counted_by(p):
        return let(word_number(grab(t, p, 1)), lambda n: F.when(n.isNotNull(), pair(kind(p), n)))
    counted = [counted_by(p) for p in fx.CAPACITY_PATTERNS]
    return F.coalesce(F.when(vehicle, pair(F.lit("vehicle"), F.lit(1))), *counted, pair(F.lit("unspecified"), F.lit(None)))


def classify_pass_form(text, slug) -> Column:
    return (F.when(contains_any(F.lower(F.coalesce(col(slug), F.lit(""))), fx.DIGITAL_SLUG_TOKENS), "digital_email")
            .when(has(text, fx.DIGITAL_TEXT), "digital_email").when(has(text, fx.CIRCULATING_TEXT), "physical_circ")
            .otherwise("physical_coupon"))


def extract_restrictions(c) -> Column:
    """Stated date and booking restrictions, NULL when the text states none."""
    t = col(c)
    month = F.array_position(F.array(*[F.lit(m) for m in fx.MONTHS]), F.lower(grab(t, fx.BLACKOUT_MONTH, 1)))
    days = F.when(month > 0, F.array(F.struct(month.cast("int").alias("month"), F.lit(None).cast("int").alias("day"))))
    weekdays, advance = has(t, fx.WEEKDAYS_ONLY), has(t, fx.ADVANCE_BOOKING)
    cap = F.trim(grab(t, fx.BOOKING_FREQUENCY, 0))
    late = F.trim(grab(t, fx.LATE_PENALTY, 0))
    empty_days = F.array().cast("array<struct<month:int,day:int>>")
    return F.when(days.isNotNull() | weekdays | advance | cap.isNotNull() | late.isNotNull(), F.struct(
        F.coalesce(days, empty_days).alias("blackout"), F.array().cast("array<string>").alias("blackout_recurring"),
        weekdays.alias("weekdays_only"), F.lit(None).cast("string").alias("seasonal"),
        advance.alias("advance_booking_required"), cap.alias("booking_frequency_limit"), late.alias("late_return_penalty")))


def extract_residency_restriction(c) -> Column:
    """STRUCT<restricted,scope,source,evidence> when the text ties residency to using the pass, else NULL."""
    def stated(pattern, scope, before, after):
        return F.when(has(c, pattern), F.struct(F.lit("yes").alias("restricted"), F.lit(scope).alias("scope"),
                      F.lit("catalog_text").alias("source"), F.trim(match_window(c, pattern, before, after)).alias("evidence")))
    return F.coalesce(*[stated(*rule) for rule in fx.STATED_RESIDENCY])


def residency_from_block(c) -> Column:
    """Residents-only language in an offer text: STRUCT<restricted,scope,source,evidence>, NULL when it is silent.

    A noise word in place of the town lets the next pattern try.
    """
    def stated(pattern: str, scope: str) -> Column:
        hit = grab(c, pattern, 0)
        quoted = F.concat(F.lit('coupon source phrase: "'), F.trim(hit), F.lit('"'))
        row = F.struct(F.lit("yes").alias("restricted"), F.lit(scope).alias("scope"), F.lit("coupon_source_phrase").alias("source"), quoted.alias("evidence"))
        if scope == "ma":
            return F.when(hit.isNotNull(), row)
        town = F.lower(F.trim(grab(c, pattern, 1)))
        return F.when(~town.isin(*fx.TOWN_NOISE), row)
    found = F.coalesce(stated(fx.STATE_RESIDENTS_ONLY, "ma"), *[stated(p, "town") for p in fx.TOWN_RESIDENTS])
    return F.when(has(c, "resident"), found)  # a word of every pattern: other texts are searched once


def delivery_form(c) -> Column:
    """Delivery form stated by the text; negated pickup wording reads as digital, so digital cues go first."""
    t = F.lower(squeeze(F.coalesce(col(c), F.lit(""))))
    return (F.when(contains_any(t, fx.DIGITAL_CUES), "digital_email").when(contains_any(t, fx.RETURN_CUES), "physical_circ")
            .when(contains_any(t, fx.PAPER_CUES), "physical_coupon"))


def classify_coupon_form(c) -> Column:
    out = F.lit(None).cast("string")
    for pattern, form in fx.FORM_RULES:
        out = F.coalesce(out, F.when(has(c, pattern), F.lit(form)))
    return F.coalesce(out, F.lit("discount"))


def classify_pass_type_text(c) -> Column:
    """Raw pass-type label -> physical-circ / physical-coupon / digital / unknown."""
    low = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    out = F.lit("unknown")
    for text, kind in reversed(fx.PASS_TYPE_TEXT.items()):
        out = F.when(low.contains(text), F.lit(kind)).otherwise(out)
    return out


def pass_type_from_detail(title, body) -> Column:
    """STRUCT<pass_type,raw>: the title suffix decides first, then the body."""
    kind = lambda k, raw: F.struct(F.lit(k).alias("pass_type"), (F.lit(raw) if isinstance(raw, str) else raw).alias("raw"))
    returnable, disposable = has(body, fx.BODY_RETURNABLE), has(body, fx.BODY_DISPOSABLE)
    digital = has(body, fx.BODY_EMAIL) | has(body, fx.BODY_DIGITAL)
    physical = has(body, fx.BODY_PICKUP) | returnable
    suffix = grab(title, fx.DIGITAL_TITLE, 1)
    tagged = has(title, fx.PHYSICAL_TITLE)
    return (F.when(tagged & disposable, kind("physical-coupon", "(physical)")).when(tagged, kind("physical-circ", "(physical)"))
            .when(suffix.isNotNull(), kind("digital", F.concat(F.lit("("), suffix, F.lit(")"))))
            .when(digital & ~physical, kind("digital", "(body: digital)"))
            .when(physical & ~digital & disposable, kind("physical-coupon", "(body: disposable)"))
            .when(physical & ~digital, kind("physical-circ", "(body: returnable)"))
            .otherwise(kind("unknown", "")))


def pass_type_from_body(body) -> Column:
    kind = lambda k, raw: F.struct(F.lit(k).alias("pass_type"), F.lit(raw).alias("raw"))
    disposable = has(body, fx.DETAIL_DISPOSABLE)
    return (F.when(has(body, fx.DETAIL_RETURNABLE) & ~disposable, kind("physical-circ", "(body: returnable)"))
            .when(disposable, kind("physical-coupon", "(body: coupon/disposable)"))
            .when(has(body, fx.DETAIL_DIGITAL), kind("digital", "(body: digital/email)")).otherwise(kind("unknown", "")))


def normalize_benefit(c) -> Column:
    """STRUCT<label,label_class>: short display label of a benefit text."""
    return let(F.lower(squeeze(fold_width(F.coalesce(col(c), F.lit(""))))), _label)


def _label(t: Column) -> Column:
    price = F.coalesce(*[grab(t, p, 1, "U") for p in fx.PERSON_PRICE])
    percent, off = grab(t, fx.LABEL_PERCENT, 1, "U"), grab(t, fx.LABEL_DOLLAR_OFF, 1, "U")
    pair = lambda label, cls: F.struct(label.alias("label"), F.lit(cls).alias("label_class"))
    return (F.when(price.isNotNull(), pair(F.concat(F.lit("$"), trim_zeros(price)), "price"))
            .when(has(t, fx.LABEL_FREE, "U"), pair(F.lit("Free"), "free"))
            .when(has(t, fx.LABEL_HALF, "U"), pair(F.lit("50% off"), "half"))
            .when(percent.isNotNull() & (percent != "50"), pair(F.concat(percent, F.lit("% off")), "percent-off"))
            .when(off.isNotNull(), pair(F.concat(F.lit("$"), trim_zeros(off), F.lit(" off")), "dollar-off"))
            .when(has(t, fx.LABEL_DISCOUNT, "U"), pair(F.lit("Discount"), "discount"))
            .otherwise(pair(F.lit(""), "unknown")))


def _free_headline(m: Column) -> Column:
    """'Free' appears within the first four sentences before any $ or percent figure."""
    def reading(lead):
        priced = lead.contains("$") | has(lead, fx.PERCENT) | has(lead, fx.HALF)
        return F.when(priced, F.lit(False)).when(has(lead, fx.FREE_HEADLINE) | has(lead, fx.FOR_FREE), F.lit(True))
    lead = lambda s, k: F.concat(F.lit(" "), F.array_join(F.slice(s, 1, k), " "))
    cut = F.split(F.regexp_replace(F.trim(m), r"(?<=[.!?])(?U:\s+)|\n+", "\u0001"), "\u0001", -1)
    first_decided = let(cut, lambda s: F.coalesce(*[let(lead(s, k), reading) for k in range(1, 5)], F.lit(False)))
    return has(m, r"free|charge|complimentary|cost|parking|membership|parkspass|general\s+admission|cars?\b|family|carload", "i") & first_decided


def _first_number(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[grab(c, p, 1).cast("double") for p in patterns])


def _any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, p: a | has(c, p), patterns, F.lit(False))


def offer(text, slug, platform, phrases=None) -> Column:
    """Benefit text -> STRUCT<status,error,pass_form,capacity,audience_policies,summary,source_phrase_block,restrictions,residency_restriction>.

    Ranked rules: two-for-one, free headline, family-rate equivalent, free clause,
    adult + child prices, percent, dollar-off, per person, generic discount, failed.
    """
    src = joined_source(phrases, text) if phrases is not None else clean_benefit(text)
    return bind(_with_match, text=clean_benefit(text), all=src, slug=F.coalesce(col(slug), F.lit("")), platform=col(platform))


def _with_match(b: Column) -> Column:
    return bind(_with_numbers, b=b, match=without_negative_prices(b["all"]), cap=extract_capacity(b["all"]))


def _with_numbers(x: Column) -> Column:
    m = x["match"]
    pct = F.coalesce(grab(m, fx.PERCENT, 1).cast("double"), F.when(has(m, fx.HALF), F.lit(50.0)))
    return bind(_with_rule, x=x, pct=pct, adult=_first_number(m, fx.ADULT_PRICE), child=_first_number(m, fx.CHILD_PRICE),
                off=_first_number(m, fx.DOLLAR_OFF), each=_first_number(m, fx.PER_PERSON))


def _with_rule(n: Column) -> Column:
    m, b = n["x"]["match"], n["x"]["b"]
    blocked = has(m, fx.FREE_OR_REDUCED) | n["pct"].isNotNull() | has(m, fx.DOLLAR_OFF[0]) | _any(m, fx.PER_PERSON[:4])
    rule = (F.when(b["text"] == "", "no benefit text")
            .when(is_navigation_only(b["text"]), "no benefit text available")
            .when(has(b["all"], fx.BOGO), "bogo")
            .when(_free_headline(m), "free")
            .when(has(m, fx.FAMILY_RATE), "discount")
            .when(has(m, fx.FREE_CLAUSE) & ~blocked, "free")
            .when(n["adult"].isNotNull() & n["child"].isNotNull(), "adult-child")
            .when(n["pct"].isNotNull(), "percent-off")
            .when(n["off"].isNotNull(), "dollar-off")
            .when(n["each"].isNotNull(), "per-person-price")
            .when(has(m, fx.GENERIC_DISCOUNT), "discount")
            .otherwise("unparsed benefit"))
    return bind(_offer_struct, n=n, rule=rule)


def _offer_struct(v: Column) -> Column:
    r, n = v["rule"], v["n"]
    b, cap = n["x"]["b"], n["x"]["cap"]
    ok = r.isin("bogo", "free", "discount", "adult-child", "percent-off", "dollar-off", "per-person-price")
    value = (F.when(r == "free", F.lit(0.0)).when(r == "percent-off", n["pct"]).when(r == "dollar-off", n["off"])
             .when(r == "per-person-price", n["each"]))
    window = b["all"]
    def policy(audience, form, val, count, low=None, high=None):
        ages = F.struct(F.lit(low).cast("int").alias("min"), F.lit(high).cast("int").alias("max")) if low is not None \
            else F.lit(None).cast("struct<min:int,max:int>")
        return F.struct(F.lit(audience).alias("audience"), form.alias("form"), val.cast("double").alias("value"),
                        count.cast("int").alias("count"), ages.alias("age_range"), window.alias("source_phrase"))
    none, per_head = F.lit(None), F.lit("per-person-price")
    main = policy("Everyone", r, value, cap["n"])
    child = policy("children", per_head, n["child"], none)
    policies = (F.when(r == "adult-child", F.array(policy("adults", per_head, n["adult"], none, 18, 200), child))
                .when((r == "percent-off") & n["child"].isNotNull(), F.array(main, child))
                .when(ok, F.array(main)))
    first = F.get(F.split(F.trim(b["all"]), r"(?<=[.!?])(?U:\s+)", 2), F.lit(0))
    parking = (b["platform"] == fx.CALENDAR_PLATFORM) & has(first, r"\bparking\b")
    money = lambda c: F.concat(F.lit("$"), fmt_num(c))
    summary = (F.when(r == "bogo", "BOGO").when((r == "free") & parking, "FREE parking").when(r == "free", "FREE")
               .when(r == "adult-child", F.concat(money(n["adult"]), F.lit("/person")))
               .when(r == "percent-off", F.concat(fmt_num(n["pct"]), F.lit("% off")))
               .when(r == "dollar-off", F.concat(money(n["off"]), F.lit(" off")))
               .when(r == "per-person-price", F.concat(money(n["each"]), F.lit("/person")))
               .when((r == "discount") & cap["n"].isNotNull(), "Discount").when(r == "discount", "discount"))
    return F.struct(
        F.when(ok, "ok").otherwise("failed").alias("status"), F.when(~ok, r).alias("error"),
        F.when(ok, classify_pass_form(b["all"], b["slug"])).alias("pass_form"), F.when(ok, cap).alias("capacity"),
        policies.alias("audience_policies"), summary.alias("summary"), F.when(ok, b["text"]).alias("source_phrase_block"),
        F.when(ok, extract_restrictions(b["all"])).alias("restrictions"),
        F.when(ok, extract_residency_restriction(b["all"])).alias("residency_restriction"))


def extract_coupon(df: DataFrame, text: str, slug: str, platform: str, phrases: str | None = None, out: str = "offer") -> DataFrame:
    """Append the offer STRUCT of every row."""
    return df.withColumn(out, offer(text, slug, platform, phrases))


def policy_rows(df: DataFrame, keys: list[str], offer_col: str = "offer") -> DataFrame:
    """One row per audience policy. An outer explode keeps the optimizer from testing (and so computing) the offer twice."""
    return df.select(*keys, F.explode_outer(f"{offer_col}.audience_policies").alias("p")).filter(F.col("p").isNotNull())


# ---- stored extraction records -------------------------------------------
def headline(policies) -> Column:
    """Short offer of the adult/everyone policy; else the strongest non-free one; first maximum wins."""
    p = col(policies)
    adult = F.get(F.filter(p, lambda x: F.lower(F.coalesce(x["audience"], F.lit(""))).isin(*fx.ADULT_AUDIENCES)), F.lit(0))
    paid = F.filter(p, lambda x: F.coalesce(x["form"] != "free", F.lit(True)))
    pool = F.when(F.size(paid) > 0, paid).otherwise(p)
    strength = lambda x: map_codes(x["form"], fx.FORM_STRENGTH, 0)
    best = lambda ps: F.array_max(F.transform(ps, strength))
    strongest = let(pool, lambda ps: let(best(ps), lambda top: F.get(F.filter(ps, lambda x: strength(x) == top), F.lit(0))))
    return bind(lambda b: _headline_text(b["x"], b["p"]), x=F.coalesce(adult, strongest), p=p)


def _headline_text(x: Column, p: Column) -> Column:
    form, value = x["form"], fmt_num(x["value"])
    say = lambda before, after, bare: F.when(value.isNotNull(), F.concat(F.lit(before), value, F.lit(after))).otherwise(F.lit(bare))
    return (F.when(p.isNull() | (F.size(p) == 0), F.lit("discount unspecified")).when(form == "free", F.lit("FREE"))
            .when(form == "percent-off", say("", "% off", "% off")).when(form == "dollar-off", say("$", " off", "$ off"))
            .when(form == "per-person-price", say("$", "/person", "$/person"))
            .when(form == "bogo", F.lit("buy one get one free")).otherwise(F.lit("discount")))


def with_source_phrases(policies, phrases) -> Column:
    """Fill missing policy phrases from a map keyed 'audience_policies[i].form' / '.value'."""
    def fill(x, i):
        path = lambda leaf: F.concat(F.lit("audience_policies["), i.cast("string"), F.lit(f"].{leaf}"))
        found = F.coalesce(text_or_null(F.try_element_at(col(phrases), path("form"))),
                           text_or_null(F.try_element_at(col(phrases), path("value"))))
        return x.withField("source_phrase", F.coalesce(x["source_phrase"], found))
    return F.transform(col(policies), fill)


def coupon_struct(capacity_kind, capacity_n, policies, phrases, raw) -> Column:
    """Stored extraction record -> offer STRUCT (capacity, audience_policies, summary, source_phrase_block)."""
    filled = with_source_phrases(policies, phrases)
    return F.struct(
        F.struct(F.coalesce(col(capacity_kind), F.lit("unspecified")).alias("kind"), col(capacity_n).alias("n")).alias("capacity"),
        filled.alias("audience_policies"), headline(policies).alias("summary"), col(raw).alias("source_phrase_block"))


def default_capacity(kind, n) -> Column:
    """STRUCT<kind,n> with 'unspecified' for a missing kind and one car per vehicle pass."""
    k = F.coalesce(col(kind), F.lit("unspecified"))
    return F.struct(k.alias("kind"), F.when((k == "vehicle") & col(n).isNull(), F.lit(1)).otherwise(col(n)).cast("int").alias("n"))


def restates_free_age(policy: Column, free_under_age: Column) -> Column:
    """The policy only repeats the venue's own free-under-N rule."""
    return F.coalesce(policy["audience"].isin(*fx.KID_AUDIENCES) & (policy["form"] == "free")
                      & (policy["age_range"]["max"] + 1 <= free_under_age), F.lit(False))


def drop_redundant(policies, free_under_age) -> Column:
    """Policies without those that restate the venue rule, unless nothing else would be left."""
    kept = F.filter(col(policies), lambda x: ~restates_free_age(x, col(free_under_age)))
    return F.when(F.size(kept) > 0, kept).otherwise(col(policies))
