"""Seven-day opening hours held as MAP<day, value>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions.core import bind, col, grab, let


def week_array() -> Column:
    return F.array(*[F.lit(d) for d in fx.WEEK])


def closed_days(hours) -> Column:
    """Days whose value is 'closed', in week order; keys that are no weekday come last."""
    h = col(hours)
    shut = lambda d: F.coalesce(F.lower(F.trim(F.try_element_at(h, d))) == "closed", F.lit(False))
    extra = F.filter(F.map_keys(h), lambda d: ~d.isin(*fx.WEEK) & shut(d))
    return F.when(h.isNull(), F.array().cast("array<string>")).otherwise(F.concat(F.filter(week_array(), shut), extra))


def known_days(hours) -> Column:
    return F.when(col(hours).isNull(), F.lit(0)).otherwise(
        F.size(F.filter(F.map_values(col(hours)), lambda v: v != "unknown")))


def any_known(hours) -> Column:
    return F.coalesce(F.exists(F.map_values(col(hours)), lambda v: (v != "") & (v != "unknown")), F.lit(False))


def pick_hours(new, old) -> Column:
    """The new week if it knows any day, else the old one, else the new one."""
    old_or_null = F.when(F.size(col(old)) > 0, col(old))
    return F.when(any_known(new), col(new)).otherwise(F.coalesce(old_or_null, col(new)))


def hour_label(hhmm) -> Column:
    """'09:00' -> '9 AM', '17:30' -> '5:30 PM'."""
    h = F.split_part(hhmm, F.lit(":"), F.lit(1)).cast("int")
    m = F.split_part(hhmm, F.lit(":"), F.lit(2))
    shown = ((h + 11) % 12 + 1).cast("string")
    half = F.when(h >= 12, F.lit("PM")).otherwise(F.lit("AM"))
    return F.when(m == "00", F.concat_ws(" ", shown, half)).otherwise(F.concat(shown, F.lit(":"), m, F.lit(" "), half))


def hours_label(value) -> Column:
    pattern = r"^(\d{1,2}:\d{2})\s*[-–]\s*(\d{1,2}:\d{2})$"
    def label(raw):
        v = F.lower(F.trim(raw))
        side = lambda g: let(F.regexp_extract(v, pattern, g), hour_label)
        return (F.when(v.isin("", "—", "unknown"), F.lit("—")).when(v == "closed", F.lit("Closed"))
                .when(v.rlike(pattern), F.concat(side(1), F.lit(" – "), side(2))).otherwise(raw))
    return let(F.coalesce(col(value), F.lit("")), label)


def compact_hours(hours) -> Column:
    """Runs of equal consecutive days: ARRAY<STRUCT<days,value,first,last>>, built inside the row (no shuffle)."""
    h = col(hours)
    abbr = F.array(*[F.lit(a) for a in fx.WEEK_ABBR])
    def runs(labels):
        starts = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: (i == 0) | (F.get(labels, i) != F.get(labels, i - 1)))
        def all_runs(first):
            def run(start, k):
                last = F.coalesce(F.get(first, k + 1), F.lit(7)) - 1
                name = F.when(last == start, F.get(abbr, start)).otherwise(F.concat(F.get(abbr, start), F.lit("–"), F.get(abbr, last)))
                return F.struct(name.alias("days"), F.get(labels, start).alias("value"), start.alias("first"), last.alias("last"))
            return F.transform(first, run)
        return let(starts, all_runs)
    labels = F.transform(week_array(), lambda d: hours_label(F.trim(F.coalesce(F.try_element_at(h, d), F.lit("")))))
    return F.when(h.isNotNull(), let(labels, runs))


# ---- clock reading -------------------------------------------------------
_CLOCK = r"^\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm|noon|midnight)?\s*$"


def clock(raw) -> Column:
    """'10am', '5:00 p.m.', '14:30', 'Noon' -> 'HH:MM', NULL when it is no clock time."""
    low = F.lower(F.trim(col(raw)))
    return bind(_clock, low=low, norm=F.regexp_replace(low, r"([ap])\.?\s*m\.?", "$1m"))


def _clock(b: Column) -> Column:
    low, norm = b["low"], b["norm"]
    hour = F.nullif(F.regexp_extract(norm, _CLOCK, 1), F.lit("")).cast("int")
    minute = F.coalesce(F.nullif(F.regexp_extract(norm, _CLOCK, 2), F.lit("")).cast("int"), F.lit(0))
    half = F.regexp_extract(norm, _CLOCK, 3)
    h24 = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), F.lit(0)).otherwise(hour)
    text = F.concat(F.lpad(h24.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))
    return (F.when(low.isin("noon", "12 noon", "12noon"), F.lit("12:00")).when(low == "midnight", F.lit("00:00"))
            .when(half == "noon", F.lit("12:00")).when(half == "midnight", F.lit("00:00"))
            .when(norm.rlike(_CLOCK) & (h24 <= 23) & (minute <= 59), text))


def has_half_day(raw) -> Column:
    low = F.lower(F.trim(col(raw)))
    return low.rlike(r"[ap]\.?\s*m") | low.isin("noon", "midnight")


def clock_span(raw1, raw2) -> Column:
    """Opening span with the missing am/pm inferred so that the day reads forward; NULL if a side is unreadable."""
    end_pm = F.lower(col(raw2)).rlike(r"p\.?\s*m")
    borrowed = clock(F.concat(F.trim(col(raw1)), F.when(end_pm, F.lit(" pm")).otherwise(F.lit(" am"))))
    return bind(_span, t1=clock(raw1), t2=clock(raw2), has1=has_half_day(raw1), has2=has_half_day(raw2), end_pm=end_pm, borrowed=borrowed)


def _span(b: Column) -> Column:
    t1, t2, has1, has2, end_pm, borrowed = (b[n] for n in ("t1", "t2", "has1", "has2", "end_pm", "borrowed"))
    early = end_pm & (F.substring(t1, 1, 2).cast("int") < 7)
    usable = F.coalesce(borrowed < t2, F.lit(False))
    start = F.when(~has1 & has2 & usable & (~(t1 < t2) | early), borrowed).otherwise(t1)
    end_hour = F.substring(t2, 1, 2).cast("int")
    afternoon = F.concat(F.lpad((end_hour + 12).cast("string"), 2, "0"), F.lit(":"), F.substring(t2, 4, 2))
    bump = ~(~has1 & has2) & ~has2 & (t2 <= t1) & end_hour.between(1, 11) & (afternoon > t1)
    end = F.when(bump, afternoon).otherwise(t2)
    return F.when(t1.isNotNull() & t2.isNotNull(), F.concat(start, F.lit("-"), end))


def clock_12h(raw) -> Column:
    """'10 AM' -> '10:00', 'noon' -> '12:00'; needs an am/pm mark."""
    return let(F.lower(F.trim(col(raw))), _clock_12h)


def _clock_12h(low: Column) -> Column:
    hour = grab(low, fx.CLOCK_12H, 1).cast("int") % 12
    minute = F.coalesce(grab(low, fx.CLOCK_12H, 2).cast("int"), F.lit(0))
    h24 = F.when(grab(low, fx.CLOCK_12H, 3) == "p", hour + 12).otherwise(hour)
    return (F.when(low.isin("noon", "12 noon"), F.lit("12:00")).when(low == "midnight", F.lit("00:00"))
            .when(hour.isNotNull(), F.concat(F.lpad(h24.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))))


def day_value_12h(raw) -> Column:
    """One day of the old hours form ('10 AM – 5 PM', 'Closed', '') in the new form."""
    def read(v):
        parts = F.split(v, r"\s*[–-]\s*", 2)
        span = F.concat(clock_12h(F.get(parts, F.lit(0))), F.lit("-"), clock_12h(F.get(parts, F.lit(1))))
        return (F.when(v == "", F.lit("unknown")).when(F.lower(v).isin("closed", "close"), F.lit("closed"))
                .when(F.size(parts) == 2, F.coalesce(span, F.lit("unknown"))).otherwise(F.lit("unknown")))
    return let(F.trim(F.coalesce(col(raw), F.lit(""))), read)


def convert_hours(short) -> Column:
    """MAP keyed mon..sun with 12-hour text -> MAP keyed monday..sunday; NULL when no day is known."""
    values = F.transform(week_array(), lambda day: day_value_12h(F.try_element_at(col(short), F.substring(day, 1, 3))))
    return F.when(col(short).isNotNull(), let(F.map_from_arrays(week_array(), values), lambda week: F.when(known_days(week) > 0, week)))
