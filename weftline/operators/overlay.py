"""Human corrections laid over built tables, and related re-derivation rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.core import col


def target_key(*parts) -> Column:
    return F.concat_ws("__", *[col(p) for p in parts])


def branch_target(library, branch) -> Column:
    """library__branch with the library's own prefix taken off the branch id."""
    return target_key(library, F.replace(col(branch), F.concat(col(library), F.lit("-")), F.lit("")))


def effective_overrides(*sources: DataFrame) -> DataFrame:
    """One record per (kind, id, field); later sources beat earlier ones, then the later record (column ``seq``), then the larger content,
    so that the choice does not hang on the order of arrival."""
    tagged = [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("kind", "id", "field", "_p")]
    best = F.max_by(F.struct(*rest), F.struct("_p", *([F.col("seq")] if "seq" in rest else []), *rest))
    return both.groupBy("kind", "id", "field").agg(best.alias("_r")).select("kind", "id", "field", *[F.col(f"_r.{c}").alias(c) for c in rest])


def with_owners(overrides: DataFrame, out: str) -> DataFrame:
    """Overrides of targets built by ``target_key(owner, entity)``, once per owner that the id can stand for (text in ``out``), so that they
    can be dealt by owner: what stands before any of its separators, the whole id (no entity) and the empty text (no owner)."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length("id"), F.lit(1))), lambda i: F.substr(F.col("id"), i, F.lit(2)) == "__")
    before = F.transform(at, lambda i: F.substr(F.col("id"), F.lit(1), i - 1))
    return overrides.withColumn(out, F.explode(F.array_distinct(F.concat(before, F.array(F.col("id"), F.lit(""))))))


def corrections_by_entity(overrides: DataFrame, fields: Sequence[str], key: str, within: Sequence[str] = ()) -> DataFrame:
    """One row per entity with one STRUCT<set,value> per corrected field (NULL struct = no correction).

    Plain conditional aggregates: nothing is collected, and a corrected NULL stays visible. ``within``: columns of the overrides by which
    they are dealt; an entity then has a row for each of their values.
    """
    fixed = overrides.filter((F.col("status") == "corrected") & F.col("field").isin(*fields))
    cells = [F.max(F.when(F.col("field") == f, F.struct(F.lit(True).alias("set"), F.col("value")))).alias(f"_over_{f}") for f in fields]
    return fixed.groupBy(F.col("id").alias(key), *within).agg(*cells)


def apply_overrides(df: DataFrame, key: str, overrides: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Lay corrected values over ``df``. A corrected NULL overwrites; other statuses are ignored.

    ``fields`` maps column -> type; text values are cast, structured types are parsed from JSON.
    """
    return lay_over(df.join(corrections_by_entity(overrides, list(fields), key), key, "left"), fields)


def lay_over(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """The second half of ``apply_overrides``, for rows that already carry the columns of ``corrections_by_entity``."""
    cols = {}
    for name, kind in fields.items():
        raw = F.col(f"_over_{name}.value")
        value = F.from_json(raw, kind) if kind.startswith(("struct", "array", "map")) else raw.try_cast(kind)
        cols[name] = F.when(F.col(f"_over_{name}.set"), value).otherwise(F.col(name))
    return df.withColumns(cols).drop(*[f"_over_{f}" for f in fields])


def drop_removed(df: DataFrame, key: str, overrides: DataFrame, marker: str = "__drop__", within: Sequence[str] = ()) -> DataFrame:
    """``within``: columns by which both sides are dealt (see ``with_owners``)."""
    gone = overrides.filter((F.col("field") == marker) & (F.col("status") == "removed")).select(F.col("id").alias(key), *within).distinct()
    return df.join(gone, [key, *within], "left_anti")


def upsert(store: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records replace stored rows with the same key; of several records with one key the one with the largest content stays."""
    rest = [c for c in records.columns if c not in keys]
    one = records.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else records.distinct()
    return store.join(one.select(*keys), list(keys), "left_anti").unionByName(one)


def revoke(store: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return store.join(targets.select(*keys).distinct(), list(keys), "left_anti")


def rederive(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Recompute columns from stored text and flag the rows that changed."""
    changed = F.lit(False)
    for name, e in exprs.items():
        changed = changed | ~F.col(name).eqNullSafe(e)
    return df.withColumn("changed", changed).withColumns(dict(exprs))


def monotone_replace(old: DataFrame, new: DataFrame, key: str, value: str, score) -> DataFrame:
    """Keep the new version only where it scores higher; report known counts and the decision."""
    o = old.select(key, F.struct(F.col(value).alias("v")).alias("_o"))
    n = new.select(key, F.struct(F.col(value).alias("v")).alias("_n"))
    d = o.join(n, key, "left").withColumns({"known_before": score(F.col("_o.v")), "known_after": F.when(F.col("_n").isNotNull(), score(F.col("_n.v")))})
    better = F.coalesce(F.col("known_after") > F.col("known_before"), F.lit(False))
    return d.select(key, F.when(better, F.col("_n.v")).otherwise(F.col("_o.v")).alias(value), "known_before", "known_after",
                    F.when(F.col("_n").isNull(), "fetch_failed").when(better, "improved").otherwise("no_gain").alias("status"))


def merge_evidence(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Evidence per (entity, field): an override replaces source and evidence, the built block survives.

    Both sides are stacked and reduced per key, which needs one shuffle and no outer join.
    """
    usable = over.filter(F.col("source").isNotNull() | F.col("evidence").isNotNull())
    b = base.select(key, "field", F.struct("source", "evidence", "block").alias("b"), F.lit(None).cast("struct<source:string,evidence:string>").alias("o"))
    o = usable.select(key, "field", F.lit(None).cast("struct<source:string,evidence:string,block:string>").alias("b"), F.struct("source", "evidence").alias("o"))
    m = b.unionByName(o).groupBy(key, "field").agg(F.max("b").alias("b"), F.max("o").alias("o"))
    pick = lambda c: F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"b.{c}"))
    return m.select(key, "field", pick("source").alias("source"), pick("evidence").alias("evidence"), F.col("b.block").alias("block"))


def overlay_prices(prices, evidence) -> Column:
    """Attach the first evidence entry with a block to each price of the same audience."""
    from weftline.functions.text import tighten
    def attach(p):
        hit = F.get(F.filter(col(evidence), lambda e: (e["audience"] == p["audience"]) & (F.length(e["source_block"]) > 0)), F.lit(0))
        return (p.withField("source_block", F.coalesce(tighten(hit["source_block"]), p["source_block"]))
                .withField("source_url", F.when(hit.isNotNull(), hit["source_url"]).otherwise(p["source_url"])))
    return F.transform(col(prices), attach)
