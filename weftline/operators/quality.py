"""Integrity, accepted values, coverage and report operators. Every check is an aggregate or a join; nothing is collected
except the final (tiny) list of failed check names when a gate has to raise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.core import col, pct
from weftline.operators.keys import lookup_first, ranked_top


class IntegrityError(ValueError):
    """A gate found rows that must never ship."""


def orphans(df: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Distinct key values without a dimension row, with the number of rows that carry them.

    Keys are counted before the anti join, so a hot key is one row by then. NULL keys are orphans too.
    """
    seen = df.groupBy(key).agg(F.count("*").alias("n_rows"))
    return seen.join(dim.select(F.col(dim_key).alias(key)).distinct(), key, "left_anti")


def orphan_items(df: DataFrame, array: str, dim: DataFrame, dim_key: str, out: str = "item") -> DataFrame:
    return orphans(df.select(F.explode(array).alias(out)), out, dim, dim_key)


def unreachable(files: DataFrame, key: str, refs: DataFrame, ref_keys: Sequence[str]) -> DataFrame:
    """Records no reference reaches through any of its key forms."""
    known = reduce(lambda a, b: a.union(b), [refs.select(F.col(k).alias(key)) for k in ref_keys]).distinct()
    return files.join(known, key, "left_anti")


def silent_drops(df: DataFrame, value: str, auth: DataFrame, keys: Sequence[Sequence[str]], auth_keys: Sequence[str],
                 status: str = "status", rows: int | None = None) -> DataFrame:
    """Rows that ship an empty value although an authoritative ok record exists under any of their keys (one probe, see ``lookup_first``)."""
    ok = auth.filter(F.col(status) == "ok").select(*auth_keys).distinct().withColumn("_ok", F.lit(True))
    return lookup_first(df.filter(F.col(value).isNull()), ok, keys, auth_keys, ["_ok"], "_hit", rows=rows).filter("_hit_ok").drop("_hit_ok")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def nested_duplicates(df: DataFrame, array: str, fields: Sequence[str]) -> DataFrame:
    """Rows whose array repeats the same field tuple."""
    keys = F.transform(F.col(array), lambda x: F.to_json(F.struct(*[x[f].alias(f) for f in fields])))
    return df.filter(F.size(keys) != F.size(F.array_distinct(keys)))


def coverage(df: DataFrame, metrics: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """n rows, matching rows and percentage of every predicate, in one pass."""
    aggs = [F.count("*").alias("n")] + [F.count_if(F.coalesce(p, F.lit(False))).alias(f"n_{m}") for m, p in metrics.items()]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return g.withColumns({f"pct_{m}": pct(f"n_{m}", "n") for m in metrics})


def stamp_skew(df: DataFrame, table: str, ts: str) -> DataFrame:
    """Seconds between the newest and the oldest build stamp and which tables they belong to."""
    t = F.try_to_timestamp(F.replace(F.col(ts).cast("string"), F.lit("Z"), F.lit("+00:00")))
    s = df.select(F.col(table).alias("t"), t.alias("at")).filter(F.col("at").isNotNull())
    return s.agg(F.count("*").alias("n"), (F.max(F.unix_timestamp("at")) - F.min(F.unix_timestamp("at"))).alias("skew_seconds"),
                 F.max_by("t", F.struct("at", "t")).alias("newest"), F.min_by("t", F.struct("at", "t")).alias("oldest"))


def check_stamps(df: DataFrame, table: str, ts: str, max_seconds: int = 3600) -> None:
    row = stamp_skew(df, table, ts).first()
    if row["n"] >= 2 and row["skew_seconds"] > max_seconds:
        raise IntegrityError(f"tables built {row['skew_seconds'] / 3600:.1f}h apart: {row['newest']} vs {row['oldest']}")


def status_summary(df: DataFrame, status: str, by: Sequence[str] = ()) -> DataFrame:
    """ok / empty / failed counts, total and ok ratio; statuses outside the vocabulary are not counted."""
    from weftline.functions.text import status_kind
    k = status_kind(status)
    g = df.groupBy(*by) if by else df.groupBy()
    out = g.agg(F.count_if(k == "ok").alias("ok"), F.count_if(k == "empty").alias("empty"),
                F.count_if(k == "failed").alias("failed"), F.count_if(k.isNotNull()).alias("total"))
    return out.withColumn("ok_ratio", F.when(F.col("total") > 0, F.bround(F.col("ok") / F.col("total"), 3)).otherwise(F.lit(0.0)))


def failure_reasons(df: DataFrame, status: str, by: Sequence[str] = ()) -> DataFrame:
    from weftline.functions.text import status_reason
    return df.withColumn("reason", status_reason(status)).filter(F.col("reason").isNotNull()) \
        .groupBy(*by, "reason").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(value).cast("string"), F.lit("None")).alias(value)).agg(F.count("*").alias("n"))


def contradictions(df: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """Keys for which both statements hold somewhere."""
    g = df.groupBy(key).agg(F.bool_or(F.coalesce(a, F.lit(False))).alias("a"), F.bool_or(F.coalesce(b, F.lit(False))).alias("b"))
    return g.filter(F.col("a") & F.col("b")).select(key)


def accepted_values(df: DataFrame, rules: Mapping[str, Sequence], allow_null: bool = False) -> DataFrame:
    """One row per (check, offending value) with its count; a NULL is an offence unless allowed."""
    cells = []
    for name, allowed in rules.items():
        ok = F.col(name).isin(*allowed)
        bad = ~F.coalesce(ok, F.lit(allow_null))
        cells.append(F.when(bad, F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("value"))))
    bad = df.select(F.explode(F.array_compact(F.array(*cells))).alias("_b"))
    return bad.groupBy(F.col("_b.field").alias("field"), F.col("_b.value").alias("value")).agg(F.count("*").alias("n_bad"))


def accepted_items(df: DataFrame, array: str, field: str, allowed: Sequence) -> DataFrame:
    """Rows whose array holds an element with a value outside the list."""
    return df.filter(F.exists(F.col(array), lambda x: ~F.coalesce(x[field].isin(*allowed), F.lit(False))))


def expectations(df: DataFrame, checks: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Row-level checks in one pass: (check, level, n_bad). A NULL outcome counts as bad."""
    names = list(checks)
    one = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, (_, ok) in checks.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.lit(checks[n][0]).alias("level"), F.col(n).alias("n_bad")) for n in names]))
    return one.select(rows.alias("r")).select("r.*")


def table_check(df: DataFrame, name: str, level: str, ok: Column) -> DataFrame:
    """Whole-table check on aggregates, as one (check, level, n_bad) row."""
    return df.agg(F.when(ok, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("n_bad")).select(F.lit(name).alias("check"), F.lit(level).alias("level"), "n_bad")


def rows_check(bad: DataFrame, name: str, level: str = "FAIL") -> DataFrame:
    """Number of offending rows as one (check, level, n_bad) row."""
    return bad.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check"), F.lit(level).alias("level"), "n_bad")


def run_checks(*checks: DataFrame) -> DataFrame:
    """Severity report: PASS where nothing is bad, else the level of the check."""
    both = reduce(lambda a, b: a.unionByName(b), checks)
    return both.withColumn("result", F.when(F.col("n_bad") == 0, F.lit("PASS")).otherwise(F.col("level")))


def gate(report: DataFrame) -> None:
    """Raise once with every failed check; WARN rows pass."""
    bad = report.filter(F.col("result") == "FAIL").orderBy("check").collect()  # one row per declared check
    if bad:
        raise IntegrityError("integrity failed: " + "; ".join(f"{r['check']} ({r['n_bad']})" for r in bad))


def required_if(df: DataFrame, condition: Column, required: str) -> DataFrame:
    return df.filter(condition & F.col(required).isNull())


def conflicts(actual: DataFrame, expected: DataFrame, keys: Sequence[str], actual_col: str, expected_col: str) -> DataFrame:
    """Rows present on both sides whose values are known and differ."""
    j = actual.join(expected, list(keys), "inner")
    return j.filter(F.col(expected_col).isNotNull() & F.col(actual_col).isNotNull() & (F.col(expected_col) != F.col(actual_col)))


def access_issue(own_evidence, residency_evidence, requires_own, residency_source, restricted) -> Column:
    """First contradiction between the recorded evidence and the stored flags, NULL when they agree."""
    said = F.lower(F.concat_ws(" ", col(own_evidence), col(residency_evidence)))
    own = F.coalesce(col(requires_own), F.lit(False))
    blocked = said.contains("blocked at card-validation") | said.contains("card rejected")
    accepted = said.contains("same-network card accepted") | said.contains("card accepted")
    overreach = (col(residency_source) == "booking_probe_card_ownership") & (F.coalesce(col(restricted), F.lit("")) != "unknown")
    return F.when(said != "", F.when(overreach, "booking_probe_card_ownership_must_not_assert_residency")
                  .when(blocked & ~own, "probe_blocked_but_requires_own_card_false")
                  .when(~blocked & accepted & own, "probe_accepted_but_requires_own_card_true"))


def issue_text(*issues: Column) -> Column:
    """Independent findings joined into one text; empty when there are none."""
    return F.array_join(F.array_compact(F.array(*issues)), " ")


def verdict_issue(status, expected, actual) -> Column:
    conclusive = col(status) == "conclusive"
    differs = conclusive & col(expected).isNotNull() & col(actual).isNotNull() & (col(expected) != col(actual))
    return (F.when(differs, F.concat(F.lit("Structured data expects "), col(expected), F.lit(", but live card validation returned "), col(actual), F.lit(".")))
            .when(~conclusive, F.lit("Could not reach a conclusive card-validation result on a future available date.")))


def url_health(df: DataFrame, url: str, statuses: DataFrame, status: str = "status") -> DataFrame:
    """Rows whose URL is known to be dead (status 400 or more); an unknown status is not dead.

    The status side is unique per URL and already filtered to dead ones, so it is the small side whatever the table holds.
    """
    dead = statuses.filter(F.col(status) >= 400).groupBy(F.col("url").alias(url)).agg(F.max(status).alias(status))
    return df.filter(F.length(url) > 0).join(dead, url, "inner")


def ratio_gate(df: DataFrame, status: str, minimum: float = 0.80) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(status) == "ok").alias("ok")).withColumn(
        "passed", F.coalesce(F.col("ok") >= F.lit(minimum) * F.col("total"), F.lit(False)) & (F.col("total") > 0))


def sample(df: DataFrame, by: Sequence[str], order: Sequence, n: int = 8) -> DataFrame:
    """First n offenders per check."""
    return ranked_top(df, by, order, n, "sample_no")


def cell_contract(facts: DataFrame, joined: DataFrame) -> DataFrame:
    """Every fact must survive the dimension joins exactly once."""
    both = facts.select(F.lit(True).alias("fact")).unionByName(joined.select(F.lit(False).alias("fact")))
    one = both.agg(F.count_if(F.col("fact")).alias("n_facts"), F.count_if(~F.col("fact")).alias("n_cells"))
    return one.withColumn("holds", F.col("n_facts") == F.col("n_cells"))


def suspects(df: DataFrame, price_cols: Sequence[str], claims: Column, key: str, allow: DataFrame, page: str) -> DataFrame:
    """Rows with no price at all that claim to be free, not on the allow list, with the number of dollar amounts on the page."""
    from weftline import fixed_values as fx
    free = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(0)) == 0 for c in price_cols])
    return df.filter(free & claims).join(allow.select(key).distinct(), key, "left_anti") \
        .withColumn("dollar_hits", F.regexp_count(F.coalesce(F.col(page), F.lit("")), F.lit(fx.DOLLAR_HIT)))
