"""Snapshots that can be compared without reading all of them: digest trees over key ranges, and tables bucketed by key.

A range is the beginning of the key's SHA-256 in hex digits, so both sides of a comparison cut the same ranges and a hot prefix of keys
makes no large range. The digest of a range depends on its rows, not on their order; sixteen neighbours make one node of the next level.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.diff import snapshot_diff

RANGE = "_range"
FAN = 16


def row_digest(fields: Sequence[str]) -> Column:
    """SHA-256 of a row's fields as JSON, in order of their names and with nulls."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def fold_digest(digest: str) -> Column:
    """Aggregate: SHA-256 over the number of rows and the sums of the four 60-bit parts of their digests, whatever their order.

    Sums instead of exclusive ors, so that equal rows don't cancel out. Map tasks combine them.
    """
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[part(i) for i in range(4)]), 256)


def key_range(keys: Sequence[str], depth: int) -> Column:
    """Number of the key's range, from 0 to 16**depth - 1."""
    whole = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    return F.conv(F.substring(F.sha2(whole, 256), 1, depth), 16, 10).cast("int")


def digest_tree(df: DataFrame, fields: Sequence[str], depth: int) -> DataFrame:
    """(level, node, n, digest) of every range that has rows (level ``depth``) and of the nodes above, up to the root at level 0."""
    level = df.select(F.col(RANGE).alias("node"), row_digest(fields).alias("_d")).groupBy("node").agg(F.count("*").alias("n"), fold_digest("_d").alias("digest"))
    out = level.withColumn("level", F.lit(depth))
    for k in range(depth - 1, -1, -1):
        child = F.concat_ws(":", F.col("node").cast("string"), "digest")
        named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", child.alias("c")))), lambda x: x["c"]), ",")  # sixteen at most
        level = level.groupBy(F.expr(f"node div {FAN}").cast("int").alias("node")).agg(F.sum("n").alias("n"), F.sha2(named, 256).alias("digest"))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.select("level", "node", "n", "digest")


def write_ranged(df: DataFrame, path: str, keys: Sequence[str], depth: int = 2) -> None:
    """A snapshot in folders per key range, its digest tree beside it; fails when the snapshot exists."""
    spread = df.withColumn(RANGE, key_range(keys, depth)).repartition(RANGE)
    spread.write.mode("errorifexists").partitionBy(RANGE).parquet(path)
    rows = df.sparkSession.read.parquet(path)
    digest_tree(rows, df.columns, depth).write.parquet(f"{path}/_tree")


def tree_changes(now: DataFrame, before: DataFrame, depth: int) -> DataFrame:
    """(level, node, now, before) where digests differ, found from the root: a node is looked at only if the one above it differs."""
    out = None
    for k in range(depth + 1):
        a = now.filter(F.col("level") == k).select("node", F.col("digest").alias("now"))
        b = before.filter(F.col("level") == k).select("node", F.col("digest").alias("before"))
        if out is not None:
            above = found.select(F.col("node").alias("_up")).distinct()
            a, b = (x.join(above, F.expr(f"node div {FAN}") == F.col("_up"), "left_semi") for x in (a, b))
        found = a.join(b, "node", "full").filter(~F.col("now").eqNullSafe(F.col("before"))).select(F.lit(k).alias("level"), "node", "now", "before")
        out = found if out is None else out.unionByName(found)
    return out


def ranged_diff(spark: SparkSession, now: str, before: str, keys: Sequence[str], exact: Sequence[str], text: Sequence[str] = (), depth: int = 2) -> DataFrame:
    """``diff.snapshot_diff`` of two written snapshots that reads only the ranges whose digests differ (16**depth numbers at most)."""
    changed = tree_changes(spark.read.parquet(f"{now}/_tree"), spark.read.parquet(f"{before}/_tree"), depth).filter(F.col("level") == depth)
    ranges = sorted(r["node"] for r in changed.select("node").collect())
    side = lambda path: spark.read.parquet(path).filter(F.col(RANGE).isin(ranges)).drop(RANGE)
    return snapshot_diff(side(now), side(before), keys, exact, text)


def write_bucketed(df: DataFrame, root: str, keys: Sequence[str], buckets: int) -> str:
    """A snapshot bucketed and sorted by its keys, under a new table name that is returned."""
    name = f"weft_snapshot_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{root}/{name}").saveAsTable(name)
    return name


def bucketed_diff(spark: SparkSession, now: str, before: str, keys: Sequence[str], exact: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """``diff.snapshot_diff`` of two tables of ``write_bucketed``: buckets meet their like, and neither side is exchanged."""
    return snapshot_diff(spark.table(now), spark.table(before), keys, exact, text, paired=joined_up)


def joined_up(today: DataFrame, prior: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Like ``diff.pair_up`` for sides unique on their keys and laid out by them: a sort-merge join without an exchange."""
    t = today.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.struct(*fields).alias("t"))
    p = prior.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.struct(*fields).alias("p"))
    same = None
    for k in keys:
        one = F.col(f"_t_{k}") == F.col(f"_p_{k}")
        same = one if same is None else same & one
    return t.hint("merge").join(p, same, "full").select(*[F.coalesce(f"_t_{k}", f"_p_{k}").alias(k) for k in keys], "t", "p")
