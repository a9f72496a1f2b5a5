"""Calendar helpers: blackout dates, weekday arithmetic, month pages, deep links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions.core import code_map, col, grab, grab_all, text_or_null


def nth_weekday(first_of_month, weekday: int, n: int) -> Column:
    """n-th weekday (Monday=0) of a month; n=-1 is the last one."""
    first = col(first_of_month)
    if n == -1:
        last = F.last_day(first)
        return F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7)))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + (n - 1) * 7)


def observed(day) -> Column:
    """Saturday -> Friday before, Sunday -> Monday after."""
    d = col(day)
    return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def blackout_days(text) -> Column:
    """'July 4, Dec 25' -> ARRAY<STRUCT<month,day>>."""
    names = "|".join(fx.BLACKOUT_MONTH_NUMBERS)
    pattern = rf"\b({names})\s+(\d{{1,2}})"
    pairs = F.arrays_zip(grab_all(text, pattern, 1, "iU").alias("m"), grab_all(text, pattern, 2, "iU").alias("d"))
    months = code_map(fx.BLACKOUT_MONTH_NUMBERS)
    return F.transform(pairs, lambda p: F.struct(
        F.element_at(months, F.lower(p["m"])).alias("month"), p["d"].cast("int").alias("day")))


def blackout_weekdays(text) -> Column:
    """Plural weekday names in the text, in week order."""
    week = F.array(*[F.lit(w) for w in fx.PLURAL_WEEKDAYS])
    low = F.lower(col(text))
    return F.filter(week, lambda w: F.regexp_like(low, F.concat(F.lit(r"\b"), w, F.lit(r"\b"))))


def is_blackout(days, weekdays, target) -> Column:
    """Month/day hit, or the target falls on a recurring weekday."""
    t = col(target)
    week = F.array(*[F.lit(w) for w in fx.PLURAL_WEEKDAYS])
    day_hit = F.exists(col(days), lambda x: (x["month"] == F.month(t)) & (x["day"] == F.dayofmonth(t)))
    week_hit = F.array_contains(col(weekdays), F.element_at(week, F.weekday(t) + 1))
    return F.coalesce(day_hit, F.lit(False)) | F.coalesce(week_hit, F.lit(False))


def month_starts(start, months_ahead: int) -> Column:
    """The start date followed by the first day of each of the next months."""
    first = F.trunc(col(start), "month")
    return F.concat(F.array(col(start)), F.transform(F.sequence(F.lit(1), F.lit(months_ahead)), lambda i: F.add_months(first, i))) \
        if months_ahead else F.array(col(start))


def month_word(day) -> Column:
    return F.lower(F.date_format(col(day), "MMMM"))


def month_page(url, day) -> Column:
    """Page of one month below a pass URL: <url>/<year>-<month name>/."""
    return F.concat(F.regexp_replace(col(url), "/+$", ""), F.lit("/"), F.date_format(col(day), "yyyy"), F.lit("-"), month_word(day), F.lit("/"))


def by_date_page(base, key, day) -> Column:
    """<base>/museum-passes/by-date/<year>-<month name>/<day>/<key>/."""
    return F.concat(F.regexp_replace(col(base), "/+$", ""), F.lit("/museum-passes/by-date/"), F.date_format(col(day), "yyyy"),
                    F.lit("-"), month_word(day), F.lit("/"), F.dayofmonth(col(day)).cast("string"), F.lit("/"), col(key), F.lit("/"))


def deep_link(url, day) -> Column:
    """Booking link for one day; which form applies depends on the host and path."""
    u = F.coalesce(col(url), F.lit(""))
    key = grab(u, fx.WIZARD_PASS_PATH, 1, "")
    base = F.split_part(u, F.lit("/museum-passes/"), F.lit(1))
    wizard = F.when(u.contains(fx.WIZARD_HOST) & key.isNotNull(), by_date_page(base, key, day))
    joiner = F.when(u.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    calendar = F.when(u.contains(fx.CALENDAR_HOST), F.concat(u, joiner, F.lit("date="), col(day).cast("string")))
    return F.when((F.length(u) == 0) | col(day).isNull(), u).otherwise(F.coalesce(wizard, calendar, u))


def calendar_fragment_url(subdomain, pass_id, day) -> Column:
    return F.concat(F.lit("https://"), col(subdomain), F.lit(f".{fx.CALENDAR_HOST}/pass/availability/institution?museum="),
                    col(pass_id), F.lit("&date="), col(day).cast("string"))


def calendar_months(day_map, today, ahead: int = 3) -> Column:
    """Months ('yyyy-MM') the calendar offers: those with known days plus the next ``ahead`` ones, sorted."""
    known = F.transform(F.map_keys(col(day_map)), lambda d: F.substring(d, 1, 7))
    coming = F.transform(F.sequence(F.lit(0), F.lit(ahead - 1)), lambda i: F.date_format(F.add_months(F.trunc(col(today), "month"), i), "yyyy-MM"))
    return F.array_sort(F.array_union(known, coming))


def month_cells(month_first, day_map) -> Column:
    """Month grid: NULL cells up to the first weekday (Sunday first), then one cell per day, status 'none' when unknown."""
    first = col(month_first)
    cell = lambda d, label, status: F.struct(d.alias("day"), label.alias("label"), status.alias("status"))
    blanks = F.transform(F.array_repeat(F.lit(0), F.dayofweek(first) - 1),
                         lambda _: cell(F.lit(None).cast("date"), F.lit(None).cast("int"), F.lit("none")))
    days = F.transform(F.sequence(first, F.last_day(first)), lambda d: cell(
        d, F.dayofmonth(d), F.coalesce(F.try_element_at(col(day_map), d.cast("string")), F.lit("none"))))
    return F.concat(blanks, days)


def restriction_days(values) -> Column:
    """'YYYY-MM-DD' / 'MM-DD' strings -> year-less ARRAY<STRUCT<month,day>>; other shapes are dropped, unreadable numbers are null."""
    def one(v):
        p = F.split(v, "-")
        full = F.struct(F.try_element_at(p, F.lit(2)).try_cast("int").alias("month"), F.try_element_at(p, F.lit(3)).try_cast("int").alias("day"))
        short = F.struct(F.try_element_at(p, F.lit(1)).try_cast("int").alias("month"), F.try_element_at(p, F.lit(2)).try_cast("int").alias("day"))
        return F.when(F.size(p) == 3, full).when(F.size(p) == 2, short)
    return F.array_compact(F.transform(F.coalesce(col(values), F.array().cast("array<string>")), one))


def restrictions_struct(blackout_dates, weekdays_only, seasonal) -> Column:
    """Stored restriction record, NULL when it restricts nothing."""
    days = restriction_days(blackout_dates)
    weekly = F.coalesce(col(weekdays_only), F.lit(False))
    return F.when((F.size(days) > 0) | weekly | text_or_null(seasonal).isNotNull(), F.struct(
        days.alias("blackout"), F.array().cast("array<string>").alias("blackout_recurring"), weekly.alias("weekdays_only"),
        col(seasonal).alias("seasonal"), F.lit(False).alias("advance_booking_required"),
        F.lit(None).cast("string").alias("booking_frequency_limit"), F.lit(None).cast("string").alias("late_return_penalty")))
