"""Display labels derived from stored codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions.core import array_or_null, bind, code_map, col, fmt_num, let, map_codes, swap, text_or_null


def form_label(form) -> Column:
    return map_codes(form, fx.FORM_LABEL)


def form_icon(form) -> Column:
    return map_codes(form, fx.FORM_CELL_ICON)


def access_label(verdict, network, town) -> Column:
    """Card scope in words: the network's name, the town's name, or why it is not known."""
    return (F.when(col(verdict) == "network_open", F.coalesce(col(network), F.lit("Network")))
            .when(col(verdict) == "own_card_only", F.coalesce(col(town), F.lit("Own")))
            .when(col(verdict) == "ambiguous", "Ambiguous").otherwise("Not verified"))


def eligibility_label(value, network, town) -> Column:
    net, home = F.coalesce(col(network), F.lit("Network")), F.coalesce(col(town), F.lit("Town"))
    v = col(value)
    return (F.when(v == "ma_resident", "MA Resident").when(v == "town_resident", F.concat(home, F.lit(" Resident only")))
            .when(v == "town_or_works", F.concat(home, F.lit(" Resident or Worker")))
            .when(v == "network", F.concat(net, F.lit(" Network"))).when(v == "unknown", "Unknown"))


def residency_label(restricted, scope, town) -> Column:
    """Only a town restriction is shown; a state-wide one is the baseline."""
    yes = col(restricted) == "yes"
    return (F.when(yes & (col(scope) == "town"), F.concat(F.coalesce(col(town), F.lit("Town")), F.lit(" Resident")))
            .when(yes & (col(scope) == "ma"), "—").when(yes, "Restricted").otherwise("—"))


def audience_label(audience) -> Column:
    a = F.coalesce(col(audience), F.lit(""))
    plain = F.concat(F.upper(F.substring(a, 1, 1)), a.substr(F.lit(2), F.length(a)))
    return F.when(a == "", F.lit("")).otherwise(F.coalesce(map_codes(F.lower(a), fx.AUDIENCE_LABEL), plain))


def age_label(ages) -> Column:
    lo, hi = col(ages)["min"].cast("string"), col(ages)["max"].cast("string")
    return (F.when(lo.isNotNull() & hi.isNotNull(), F.concat(lo, F.lit("–"), hi)).when(lo.isNotNull(), F.concat(lo, F.lit("+")))
            .when(hi.isNotNull(), F.concat(F.lit("≤"), hi)).otherwise(""))


def policy_ages(ages) -> Column:
    lo, hi = col(ages)["min"], col(ages)["max"]
    s = lambda c: c.cast("string")
    return (F.when(lo.isNotNull() & hi.isNotNull(), F.concat(F.lit(" (ages "), s(lo), F.lit("–"), s(hi), F.lit(")")))
            .when(lo.isNotNull(), F.concat(F.lit(" (ages "), s(lo), F.lit("+)")))
            .when(hi.isNotNull(), F.concat(F.lit(" (under "), s(hi + 1), F.lit(")"))).otherwise(""))


def price_line(audience, price, ages) -> Column:
    """STRUCT<label,value,is_free> of one ticket price."""
    span = age_label(ages)
    label = F.when(span != "", F.concat_ws(" ", audience_label(audience), span)).otherwise(audience_label(audience))
    free = F.coalesce(col(price) == 0, F.lit(False))
    value = F.when(free, "Free").when(col(price).isNull(), "—").otherwise(F.concat(F.lit("$"), fmt_num(price)))
    return F.struct(label.alias("label"), value.alias("value"), free.alias("is_free"))


def policy_label(form, value) -> Column:
    f, v = F.lower(F.coalesce(col(form), F.lit(""))), fmt_num(value)
    say = lambda before, after, bare: F.when(v.isNotNull(), F.concat(F.lit(before), v, F.lit(after))).otherwise(F.lit(bare))
    words = F.replace(col(form), F.lit("-"), F.lit(" "))
    other = F.when(v.isNotNull(), F.concat(words, F.lit(": "), v)).otherwise(words)
    return (F.when(f == "percent-off", say("", "% off", "% off")).when(f == "free", "Free")
            .when(f.isin("dollars-off", "dollar-off"), say("$", " off", "$ off"))
            .when(f.isin("fixed-price", "per-person-price"), say("$", " / person", "Fixed price"))
            .when(f == "fixed-total", say("$", " total", "Fixed total")).when(f == "bogo", "Buy 1 get 1")
            .when(f != "", other).otherwise(F.coalesce(v, F.lit("—"))))


def short_summary(summary) -> Column:
    """Summary without its per-person tail; a bare 'discount' becomes DISC."""
    s = F.trim(swap(F.coalesce(text_or_null(summary), F.lit("—")), r"\s*/\s*(?:person|each\s+person|each|p|人)\b", "", "iU"))
    return F.when(F.lower(s) == "discount", F.lit("DISC")).otherwise(s)


def cell_discount(policies, summary) -> Column:
    """Compact offer of a matrix cell: everyone, else adult, else first policy."""
    p = col(policies)
    pick = lambda word: F.get(F.filter(p, lambda x: F.coalesce(F.lower(x["audience"]).contains(word), F.lit(False))), F.lit(0))
    chosen = F.coalesce(pick("everyone"), pick("adult"), F.get(p, F.lit(0)))
    return bind(lambda b: _cell_text(b["x"], b["p"], summary), x=chosen, p=p)


def _cell_text(x: Column, p: Column, summary) -> Column:
    form, v, bare = F.lower(F.coalesce(x["form"], F.lit(""))), fmt_num(x["value"]), short_summary(summary)
    say = lambda before, after: F.when(v.isNotNull(), F.concat(F.lit(before), v, F.lit(after))).otherwise(bare)
    return (F.when(array_or_null(p).isNull(), bare).when(form == "percent-off", say("-", "%")).when(form == "free", "FREE")
            .when(form.isin("dollars-off", "dollar-off"), say("-$", "")).when(form.isin("fixed-price", "fixed-total"), say("$", ""))
            .when(form == "bogo", "B1G1").otherwise(bare))


def capacity_parts(policies) -> Column:
    """'2 adults', '1 child' ... for the policies that carry a head count."""
    def part(x):
        raw = F.coalesce(x["audience"], F.lit(""))
        unit = F.coalesce(F.try_element_at(code_map(fx.AUDIENCE_UNIT), F.lower(raw)), raw)
        word = F.when(x["count"] == 1, unit).when(unit == "child", F.lit("children")).otherwise(F.concat(unit, F.lit("s")))
        return F.concat_ws(" ", x["count"].cast("string"), word)
    return F.transform(F.filter(col(policies), lambda x: F.coalesce(x["count"] > 0, F.lit(False))), part)


def needs_reservation(required) -> Column:
    r = F.coalesce(col(required), F.lit(""))
    return ~r.isin("", "walk_in_ok")


def adult_price(prices) -> Column:
    return F.get(F.filter(col(prices), lambda p: p["audience"] == "adult"), F.lit(0))["price"]


def canonical_labels(labels, mapping: dict | None = None, order: list | None = None) -> Column:
    """Raw labels -> canonical ones, unknown dropped, distinct, in the fixed order."""
    mapping, order = mapping or fx.CATEGORY_MAP, order or fx.CATEGORY_ORDER
    mapped = F.transform(F.coalesce(col(labels), F.array().cast("array<string>")), lambda x: F.try_element_at(code_map(mapping), x))
    return let(mapped, lambda ms: F.filter(F.array(*[F.lit(o) for o in order]), lambda o: F.exists(ms, lambda m: F.coalesce(m == o, F.lit(False)))))
