"""Snapshot comparison.

Both snapshots are stacked and reduced per key: one shuffle with map-side combining and no outer join, so the cost does not
depend on how keys are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import same_text


def pair_up(today: DataFrame, prior: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per key with STRUCT today ``t`` and prior ``p`` (NULL when absent)."""
    kind = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in today.select(*fields).schema)
    none = F.lit(None).cast(f"struct<{kind}>")
    t = today.select(*keys, F.struct(*fields).alias("t"), none.alias("p"))
    p = prior.select(*keys, none.alias("t"), F.struct(*fields).alias("p"))
    return t.unionByName(p).groupBy(*keys).agg(F.max("t").alias("t"), F.max("p").alias("p"))


def snapshot_diff(today: DataFrame, prior: DataFrame, keys: Sequence[str], exact: Sequence[str], text: Sequence[str] = (), paired=pair_up) -> DataFrame:
    """Change rows: key, change (added/removed/changed), field, from, to. ``paired`` brings the two sides together.

    ``exact`` fields compare null-safe; ``text`` fields ignore whitespace and a trailing run of dots and carry no values.
    """
    d = paired(today, prior, keys, [*exact, *text])
    none = F.lit(None).cast("string")
    row = lambda change, field, a, b: F.struct(F.lit(change).alias("change"), (F.lit(field) if field else none).alias("field"), a.alias("from"), b.alias("to"))
    both = F.col("t").isNotNull() & F.col("p").isNotNull()
    cells = [F.when(F.col("p").isNull(), row("added", None, none, none)), F.when(F.col("t").isNull(), row("removed", None, none, none))]
    for f in exact:
        a, b = F.col(f"p.{f}").cast("string"), F.col(f"t.{f}").cast("string")
        cells.append(F.when(both & ~a.eqNullSafe(b), row("changed", f, a, b)))
    for f in text:
        cells.append(F.when(both & (same_text(F.col(f"p.{f}")) != same_text(F.col(f"t.{f}"))), row("changed", f, none, none)))
    return d.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("c")).select(*keys, "c.*")


def diff_summary(today: DataFrame, prior: DataFrame, diff: DataFrame, by: str) -> DataFrame:
    """Per file: totals on both sides, added, removed, changed fields, and whether the file is missing on a side.

    Only files with a difference are listed. Each input is counted per file before the counts are combined.
    """
    zero = lambda *names: [F.lit(0).cast("bigint").alias(n) for n in names]
    t = today.groupBy(by).agg(F.count("*").alias("today_total")).select(by, "today_total", *zero("prior_total", "added", "removed", "changed"))
    p = prior.groupBy(by).agg(F.count("*").alias("prior_total")).select(by, *zero("today_total"), "prior_total", *zero("added", "removed", "changed"))
    count = lambda k: F.count_if(F.col("change") == k).alias(k)
    c = diff.groupBy(by).agg(count("added"), count("removed"), count("changed")).select(by, *zero("today_total", "prior_total"), "added", "removed", "changed")
    out = t.unionByName(p).unionByName(c).groupBy(by).agg(*[F.sum(n).alias(n) for n in ("today_total", "prior_total", "added", "removed", "changed")])
    return out.filter(F.col("added") + F.col("removed") + F.col("changed") > 0).withColumns({
        "missing_today": F.col("today_total") == 0, "missing_prior": F.col("prior_total") == 0})


def latest_prior(df: DataFrame, date_col: str, today) -> DataFrame:
    """Newest snapshot date strictly before ``today`` (one row; NULL when there is none)."""
    return df.filter(F.col(date_col) < F.lit(today)).agg(F.max(date_col).alias("prior_date"))


def prior_per_snapshot(df: DataFrame, table: str, date_col: str) -> DataFrame:
    """Previous snapshot date of every (table, date); dates are deduplicated first."""
    from pyspark.sql import Window
    w = Window.partitionBy(table).orderBy(date_col)
    return df.select(table, date_col).distinct().withColumn("prior_date", F.lag(date_col).over(w))


def added_keys(today: DataFrame, prior: DataFrame) -> DataFrame:
    return today.distinct().subtract(prior)


def removed_keys(today: DataFrame, prior: DataFrame) -> DataFrame:
    return prior.distinct().subtract(today)


def common_keys(today: DataFrame, prior: DataFrame) -> DataFrame:
    return today.intersect(prior)
