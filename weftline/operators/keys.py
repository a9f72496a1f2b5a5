"""Canonical keys, prioritised lookups and key-wise reductions.

Reductions are aggregates or rank-limited windows: both shrink a hot key inside
each map task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions.core import col
from weftline.operators.layout import in_tasks


GROUP_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold
SLICES = 64


def top_per(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """First k rows per key."""
    return ranked_top(df, by, order, k, "_rank").drop("_rank")


def ranked_top(df: DataFrame, by: Sequence[str], order: Sequence, k: int, out: str = "rank") -> DataFrame:
    """First k rows per key with their rank.

    Up to Spark's threshold the rank filter becomes a per-task group limit before the shuffle, so a key that holds a large share
    of the rows sends at most k rows per task. Larger k are ranked in slices of each key first; both ways are exact.
    """
    if k > GROUP_LIMIT:
        slices = Window.partitionBy(*by, "_slice").orderBy(*order)
        df = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(SLICES)))
        df = df.withColumn("_n", F.row_number().over(slices)).filter(F.col("_n") <= k).drop("_n", "_slice")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def salted_lookup(facts: DataFrame, dim: DataFrame, on: Sequence[str], salts: int, how: str = "left", row_key: Sequence[str] | None = None) -> DataFrame:
    """Lookup join with every fact key spread over ``salts`` partitions and the (unique) dim side repeated per salt.

    For clusters without runtime skew handling; with adaptive execution the plain join splits hot partitions itself. The salt is
    a hash of the row (``row_key`` or all columns), not a random number: a task that is run again after an executor loss deals
    every row to the same partition. Give a ``row_key`` that tells copies apart where many rows are equal.
    """
    spread = facts.withColumn("_salt", F.pmod(F.xxhash64(*(row_key or facts.columns)), F.lit(salts)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def lookup(facts: DataFrame, dim: DataFrame, on: Sequence[str], take: Sequence[str], salts: int | None = None) -> DataFrame:
    """Left join to a key-unique side, keeping only the columns asked for."""
    side = dim.select(*on, *take)
    return salted_lookup(facts, side, on, salts) if salts else facts.join(side, list(on), "left")


def lookup_first(facts: DataFrame, dim: DataFrame, attempts: Sequence[Sequence[str]], dim_keys: Sequence[str],
                 take: Sequence[str], prefix: str = "", salts: int | None = None, rows: int | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Try several key tuples in order and keep the first *existing* record as a whole (even if its values are NULL).

    One probe for any number of attempts: the distinct key values of the rows become candidates (attempt, key), candidates meet ``dim``
    (unique on its keys) in one join, and the least attempt per key values decides. Rows then look up their key values, so a hot key is
    resolved once and rows never multiply. An attempt with a NULL key finds nothing. Where the number of facts is known and no key
    values are hot, ``rows`` lays the shuffles out for it: tasks hold a fixed number of rows, and groups are sorted once instead of twice.
    ``within``: columns by which both sides are dealt already (see ``layout.dealt``), equal wherever the keys are. Nothing is shuffled then,
    so that rows meet the records in a join per attempt, where they are.
    """
    if within:
        return _lookup_in_place(facts, dim, attempts, dim_keys, take, prefix, within)
    keys = list(dict.fromkeys(k for a in attempts for k in a))
    laid = (lambda df, *by: in_tasks(df, rows, *by)) if rows is not None else (lambda df, *by: df)
    own = F.struct(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).alias("_own")  # equal where NULLs stand at the same places
    values = laid(facts.select(own), "_own").distinct()
    tried = [[F.col("_own")[f"_k{keys.index(k)}"] for k in a] for a in attempts]
    found = laid(attempt_hits(values, dim, tried, dim_keys, take, ["_own"], rows), "_own").groupBy("_own").agg(F.min_by("_hit", "_attempt").alias("_hit"))
    asked = facts.withColumn("_own", own)
    out = salted_lookup(asked, found, ["_own"], salts) if salts else laid(asked, "_own").join(found, "_own", "left")
    return out.select(*facts.columns, *[F.col("_hit")[t].alias(f"{prefix}{t}") for t in take])


def _lookup_in_place(facts: DataFrame, dim: DataFrame, attempts: Sequence[Sequence[str]], dim_keys: Sequence[str], take: Sequence[str], prefix: str,
                     within: Sequence[str]) -> DataFrame:
    kinds = {d: dim.schema[d].dataType for d in dim_keys}
    one = dim.groupBy(*dim_keys, *within).agg(F.first(F.struct(*take)).alias("_hit"))  # rows never multiply
    out, hits = facts, []
    for i, attempt in enumerate(attempts):
        side = one.select(*[F.col(c).alias(f"_d{i}_{c}") for c in [*dim_keys, *within]], F.col("_hit").alias(f"_hit{i}"))
        meets = [F.col(k).cast(kinds[d]) == F.col(f"_d{i}_{d}") for k, d in zip(attempt, dim_keys)] + [F.col(w) == F.col(f"_d{i}_{w}") for w in within]
        hits.append(F.col(f"_hit{i}"))
        out = out.join(side, reduce(lambda a, b: a & b, meets), "left")
    return out.select(*facts.columns, F.coalesce(*hits).alias("_hit")).select(*facts.columns, *[F.col("_hit")[t].alias(f"{prefix}{t}") for t in take])


def attempt_hits(facts: DataFrame, dim: DataFrame, attempts: Sequence[Sequence], dim_keys: Sequence[str], take: Sequence[str],
                 row_key: Sequence[str], rows: int | None = None) -> DataFrame:
    """Every attempt that finds a record: (row_key, _attempt, _hit), where _hit holds the columns of ``take``.

    The probe of ``lookup_first`` for callers whose facts have a narrow ``row_key``: only that key travels with the candidates, and
    the hits may meet the facts together with other sides (see ``stacked``). The least attempt is the first existing record.
    """
    kinds = {d: dim.schema[d].dataType for d in dim_keys}
    tries = [F.struct(*[col(k).cast(kinds[d]).alias(d) for k, d in zip(a, dim_keys)]) for a in attempts]
    tried = facts.select(*row_key, F.posexplode(F.array(*tries)).alias("_attempt", "_try"))
    candidates = tried.select(*row_key, "_attempt", *[F.col("_try")[d].alias(f"_d{i}") for i, d in enumerate(dim_keys)])
    names = [f"_d{i}" for i in range(len(dim_keys))]
    side = dim.select(*[F.col(d).alias(n) for d, n in zip(dim_keys, names)], F.struct(*take).alias("_hit"))
    laid = in_tasks(candidates, rows, *names) if rows is not None else candidates
    return laid.join(side, names).drop(*names)


def stacked(sides: Mapping[str, tuple[DataFrame, Column, Callable[[Column], Column]]], keys: Sequence[str], rows: int | None = None,
            by: Sequence[str] | None = None) -> DataFrame:
    """Sides that share ``keys`` meet in one shuffle instead of a join each: a row per key of any side, with one column per side.

    ``sides[name]`` is (rows, value, reduction of the values of a key, which skips NULLs). ``by``, some of the keys, lays the shuffle
    out for a later join on them.
    """
    parts = {n: df.select(*keys, value.alias(n)) for n, (df, value, _) in sides.items()}
    kinds = {n: p.schema[n].dataType for n, p in parts.items()}
    both = reduce(DataFrame.unionByName, [p.select(*keys, *[(F.col(n) if n == name else F.lit(None).cast(kinds[n])).alias(n) for n in kinds]) for name, p in parts.items()])
    laid = in_tasks(both, rows, *(by or keys)) if rows is not None else both
    return laid.groupBy(*keys).agg(*[fold(F.col(n)).alias(n) for n, (_, _, fold) in sides.items()])


def alias_table(hand: DataFrame, archive: DataFrame) -> DataFrame:
    """raw -> canonical with the hand-kept map winning over the archive."""
    both = hand.select("raw", "canonical", F.lit(0).alias("_p")).unionByName(archive.select("raw", "canonical", F.lit(1).alias("_p")))
    return both.groupBy("raw").agg(F.min_by("canonical", F.struct("_p", "canonical")).alias("canonical"))


def archive_aliases(df: DataFrame, canonical: str, variants: str) -> DataFrame:
    """Archive records (canonical, ARRAY of older keys) -> raw/canonical rows; a canonical key also maps to itself."""
    own = df.select(F.col(canonical).alias("raw"), F.col(canonical).alias("canonical"), F.lit(0).alias("_p"))
    old = df.select(F.explode(variants).alias("raw"), F.col(canonical).alias("canonical"), F.lit(1).alias("_p"))
    return own.unionByName(old).groupBy("raw").agg(F.min_by("canonical", F.struct("_p", "canonical")).alias("canonical"))


def strip_suffix(raw, suffixes: Sequence[str] | None = None) -> Column:
    names = suffixes or fx.VARIANT_SUFFIXES
    return F.regexp_replace(col(raw), "(" + "|".join(names) + ")$", "")


def canonical_key(df: DataFrame, raw: str, aliases: DataFrame, out: str = "canonical",
                  suffixes: Sequence[str] | None = None) -> DataFrame:
    """Exact alias, else the alias of the suffix-stripped key (only when that resolves), else the key itself.

    ``aliases`` is unique on ``raw``. Two left joins: without a shuffle while the alias table is measured small enough to
    broadcast, otherwise sort-merge joins whose hot partitions adaptive execution splits.
    """
    direct = aliases.select(F.col("raw").alias(raw), F.col("canonical").alias("_direct"))
    stripped = aliases.select(F.col("raw").alias("_base"), F.col("canonical").alias("_stripped"))
    d = df.withColumn("_base", strip_suffix(raw, suffixes)).join(direct, raw, "left").join(stripped, "_base", "left")
    return d.withColumn(out, F.coalesce("_direct", F.when(F.col("_base") != "", F.col("_stripped")), raw)).drop("_base", "_direct", "_stripped")


def resolve_by_platform(df: DataFrame, platform: str, rules: dict[str, Sequence[tuple[str, str]]], maps: DataFrame, out: str = "canonical",
                        ) -> DataFrame:
    """Platform-specific key resolution.

    ``rules[platform]`` lists (map name, key column) attempts in order; the map name ``'='`` takes the column as is.
    ``maps`` holds (map, raw, canonical) rows, unique on (map, raw). Unresolved rows get NULL.
    """
    tries = []
    depth = max(len(r) for r in rules.values())
    d = df
    for i in range(depth):
        name, key, same = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
        for p, attempts in rules.items():
            if i >= len(attempts):
                continue
            here = F.col(platform) == p
            m, k = attempts[i]
            if m == "=":
                same = F.when(here, col(k)).otherwise(same)
            else:
                name, key = F.when(here, F.lit(m)).otherwise(name), F.when(here, col(k)).otherwise(key)
        side = maps.select(F.col("map").alias(f"_m{i}"), F.col("raw").alias(f"_k{i}"), F.col("canonical").alias(f"_c{i}"))
        d = d.withColumn(f"_m{i}", name).withColumn(f"_k{i}", key).withColumn(f"_s{i}", same).join(side, [f"_m{i}", f"_k{i}"], "left")
        tries += [F.col(f"_s{i}"), F.col(f"_c{i}")]
    drop = [f"_{x}{i}" for i in range(depth) for x in "mksc"]
    return d.withColumn(out, F.coalesce(*tries)).drop(*drop)


def invert_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """Swap key and value; on duplicate values the smallest key wins."""
    return df.groupBy(F.col(value).alias(key)).agg(F.min(key).alias(value))


def key_universe(*frames: DataFrame) -> DataFrame:
    """Distinct union of one-column key sets."""
    return reduce(lambda a, b: a.union(b), frames).distinct()


def best_by(df: DataFrame, key: str, value: str, score: Column, ordinal: str, out: str) -> DataFrame:
    """Value with the highest score per key; the earliest row wins a tie."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(score, -F.col(ordinal))).alias(out))


def variants(df: DataFrame, key: str, raw: str) -> DataFrame:
    """Distinct (key, spelling) rows; kept long so that a key with many spellings never becomes one row."""
    return df.select(key, raw).distinct()


def first_ok(df: DataFrame, key: str, variant: str, status: str, take: Sequence[str]) -> DataFrame:
    """Record of the first variant (in key order) whose status is ok."""
    best = F.min_by(F.struct(*take), F.struct(variant))
    return df.filter(F.col(status) == "ok").groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.{t}").alias(t) for t in take])


def first_per(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """First occurrence per key in document order."""
    return top_per(df, by, order, 1)


def merge_entities(df: DataFrame, key: str, ordinal: str, scalars: Sequence[str]) -> DataFrame:
    """First non-empty value per field and key, in row order. Blank strings count as missing."""
    aggs = []
    for s in scalars:
        filled = F.length(F.col(s).cast("string")) > 0
        aggs.append(F.min_by(F.when(filled, F.col(s)), F.when(filled, F.col(ordinal))).alias(s))
    return df.groupBy(key).agg(*aggs)


def merge_values(df: DataFrame, key: str, ordinal: str, array: str, out: str) -> DataFrame:
    """Ordered distinct union of an array column per key, as rows (key, value, first position)."""
    items = df.select(key, F.col(ordinal).alias("_row"), F.posexplode(array).alias("_pos", out))
    return items.groupBy(key, out).agg(F.min(F.struct("_row", "_pos")).alias("_at")) \
        .select(key, out, F.col("_at._row").alias("first_row"), F.col("_at._pos").alias("first_pos"))


def pending(df: DataFrame, done: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Rows still to process: no finished result with status ok."""
    return df.join(done.filter(F.col(status) == "ok").select(*keys).distinct(), list(keys), "left_anti")
