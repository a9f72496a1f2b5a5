"""Availability calendars: merge, fold, look ahead, lay out; holiday dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions.dates import month_cells, nth_weekday, observed
from weftline.operators.keys import ranked_top, top_per


def merge_days(df: DataFrame, keys: Sequence[str], status: str, ordinal: str, sticky: bool = True) -> DataFrame:
    """One status per (keys): the later page wins; with ``sticky`` a 'closed' never replaces another value.

    A ``max_by`` aggregate: combined in the map tasks, whatever share of the rows one key holds.
    """
    rank = F.struct(F.col(status) != "closed", F.col(ordinal), F.col(status)) if sticky else F.struct(F.col(ordinal), F.col(status))
    return df.groupBy(*keys).agg(F.max_by(status, rank).alias(status))


def to_day_map(days: DataFrame, keys: Sequence[str], day: str, status: str, out: str = "availability") -> DataFrame:
    """MAP<day,status> per pass from rows that are unique per (pass, day): at most one entry per calendar day."""
    entry = F.struct(F.col(day).cast("string").alias("k"), F.col(status).alias("v"))
    return days.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(out))


def day_runs(days: DataFrame, keys: Sequence[str], day: str, status: str) -> DataFrame:
    """Runs of consecutive days with one status: keys, status, first, last, n; ``days`` is unique per (keys, day), histories have any length.

    Runs are cut at month borders first, so the window of a hot pass is one month of it. Only runs that touch a border, two per month at
    most, are then joined across borders; all others are final.
    """
    month = F.trunc(day, "MM")
    inside = Window.partitionBy(*keys, "_month").orderBy(day)
    d = days.filter(F.col(day).isNotNull()).select(*keys, F.to_date(day).alias(day), F.col(status).alias("status")).withColumn("_month", month)
    goes_on = lambda w, start, end: F.lag("status").over(w).eqNullSafe(F.col("status")) & (F.datediff(F.col(start), F.lag(end).over(w)) == 1)
    begun = F.when(goes_on(inside, day, day), 0).otherwise(1)
    runs = d.withColumn("_new", begun).withColumn("_run", F.sum("_new").over(inside)).groupBy(*keys, "_month", "_run").agg(
        F.any_value("status").alias("status"), F.min(day).alias("first"), F.max(day).alias("last"))
    border = (F.col("first") == F.col("_month")) | (F.col("last") == F.last_day("_month"))
    across = Window.partitionBy(*keys).orderBy("first")
    met = runs.filter(border).withColumn("_new", F.when(goes_on(across, "first", "last"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(across))
    met = met.groupBy(*keys, "_run").agg(F.any_value("status").alias("status"), F.min("first").alias("first"), F.max("last").alias("last"))
    out = runs.filter(~border).select(*keys, "status", "first", "last").unionByName(met.select(*keys, "status", "first", "last"))
    return out.withColumn("n", (F.datediff("last", "first") + 1).cast("bigint"))


def next_dates(days: DataFrame, keys: Sequence[str], day: str, status: str, since, n: int = 4) -> DataFrame:
    """Earliest n available dates per pass from ``since`` on."""
    return ranked_top(days.filter((F.col(day) >= since) & (F.col(status) == "available")), keys, [F.col(day)], n, "nth")


def month_grid(passes: DataFrame, month_first: str, day_map: str) -> DataFrame:
    """Calendar cells of one month per row, looked up in the row's own day map (no join)."""
    cells = F.posexplode(month_cells(month_first, day_map))
    rest = [c for c in passes.columns if c != day_map]
    return passes.select(*rest, cells).select(*rest, F.col("pos").alias("cell"), "col.day", "col.label", "col.status")


def fold_attempts(df: DataFrame, key: Sequence[str], ordinal: str, verdict: str) -> DataFrame:
    """One result per probed pass from all its dated attempts: first conclusive verdict, else ambiguous with the number of attempts per verdict.

    Attempts are counted per verdict first, so a pass with any number of them is a handful of rows and nothing grows in one row.
    """
    each = df.groupBy(*key, verdict).agg(F.count("*").alias("_n"), F.min(ordinal).alias("_at"))
    good = F.col(verdict).isin(*fx.CONCLUSIVE_VERDICTS)
    counted = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(verdict), F.lit("none")).alias("v"), "_n"))), lambda a: F.concat(a["v"], F.lit(":"), a["_n"].cast("string"))), ",")
    g = each.groupBy(*key).agg(
        F.min_by(verdict, F.when(good, F.struct("_at", verdict))).alias("_v"), F.min(F.when(good, F.col("_at"))).alias("probed_at"),
        counted.alias("attempts"), F.sum("_n").alias("n_attempts"))
    decided = F.col("probed_at").isNotNull()
    return g.select(*key, F.when(decided, F.col("_v")).otherwise("ambiguous").alias("verdict"), "probed_at", "n_attempts",
                    F.when(~decided, F.concat(F.lit("attempts="), F.col("attempts"))).alias("evidence"))


def run_summary(df: DataFrame, outcome: str, outcomes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counter per declared outcome, one column each."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count("*").alias("n"), *[F.count_if(F.col(outcome) == o).alias(f"n_{o}") for o in outcomes])


def expected_verdict(requires_own: Column, restricted: Column, scope: Column) -> Column:
    return (F.when(requires_own, "rejected_resident").when((restricted == "yes") & (scope == "town"), "rejected_resident")
            .when(restricted == "no", "accepted").when((restricted == "yes") & (scope == "ma"), "accepted"))


def holidays_of(years: DataFrame, year: str = "year") -> DataFrame:
    """Holiday rows (day, name, type, observed_for) for a table of years; every rule is an expression on the year."""
    y = F.col(year)
    day = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    none = F.lit(None).cast("date")
    row = lambda d, name, kind="federal", seen=none: F.struct(d.alias("day"), F.lit(name).alias("name"), F.lit(kind).alias("type"), seen.alias("observed_for"))
    cells = []
    for m, d, name in fx.FIXED_HOLIDAYS:
        actual = day(m, d)
        cells += [row(actual, name), F.when(observed(actual) != actual, row(observed(actual), f"{name} (observed)", "federal", actual))]
    for m, weekday, n, name in fx.FLOATING_HOLIDAYS:
        cells.append(row(nth_weekday(day(m, 1), weekday, n), name))
    after, kind = fx.DAY_AFTER_THANKSGIVING
    cells.append(row(F.date_add(nth_weekday(day(11, 1), 3, 4), 1), after, kind))
    cells += [row(day(m, d), name, k) for m, d, name, k in fx.CUSTOM_CLOSURES]
    return years.select(y.alias("year"), F.explode(F.array_compact(F.array(*cells))).alias("h")).select("year", "h.*")


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    return holidays_of(spark.range(first, last + 1).select(F.col("id").cast("int").alias("year")))
