"""Incremental operators. Each has a batch twin, and a replayed batch leaves the store unchanged (exactly-once by key)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.calendars import merge_days


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write per key, as a combinable aggregate; writes with equal order are decided by their content (columns without maps)."""
    rest = [c for c in df.columns if c not in keys]
    ties = [c for c in rest if c not in order and "map<" not in dict(df.dtypes)[c]]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *ties)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def override_log(df: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """State after a log of upserts and revokes: the last operation per target decides."""
    return keep_latest(df, keys, order).filter(F.col(op) != "revoke").drop(op)


def overlay_days(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], status: str, order: str) -> DataFrame:
    """Incoming day statuses over the stored ones; 'closed' never replaces a value."""
    return merge_days(stored.unionByName(incoming), keys, status, order)


def log_sink(root: str, reduce: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: the reduced batch goes to its own folder ``batch=<id>`` of an append-only log.

    Work per batch follows the batch, not the store. A replayed batch overwrites its own folder, so nothing is counted twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    return write


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).drop("batch")


def _start(stream: DataFrame, root: str, checkpoint: str, reduce: Callable[[DataFrame], DataFrame]):
    return stream.writeStream.foreachBatch(log_sink(root, reduce)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reduce_days(df: DataFrame, keys: Sequence[str], status: str, order: str) -> DataFrame:
    """Strongest statement per (keys) with its order column, so that reduced batches can be reduced again."""
    rank = F.struct(F.col(status) != "closed", F.col(order), F.col(status))
    return df.groupBy(*keys).agg(F.max_by(F.struct(status, order), rank).alias("_r")).select(*keys, f"_r.{status}", f"_r.{order}")


def stream_days(stream: DataFrame, root: str, checkpoint: str, keys: Sequence[str], status: str, order: str):
    """Availability statements -> log; ``read_days`` gives the latest status per (keys)."""
    return _start(stream, root, checkpoint, lambda b: reduce_days(b, keys, status, order))


def read_days(spark: SparkSession, root: str, keys: Sequence[str], status: str, order: str) -> DataFrame:
    return reduce_days(read_log(spark, root), keys, status, order)


def stream_upsert(stream: DataFrame, root: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]):
    """Override operations -> log, last operation per target and batch; revokes are kept, so a late upsert cannot revive a target."""
    return _start(stream, root, checkpoint, lambda b: keep_latest(b, keys, order))


def read_overrides(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    return override_log(read_log(spark, root), keys, order, op)


def compact(spark: SparkSession, root: str, target: str, reduce: Callable[[DataFrame], DataFrame]) -> None:
    """Write the reduced log as batch -1 of a new log; later batches are added next to it."""
    reduce(read_log(spark, root)).write.mode("errorifexists").parquet(f"{target}/batch=-1")


def fresh(cache: DataFrame, ttl_seconds: int, now: Column) -> DataFrame:
    """Cached statuses young enough to reuse; a missing status is never reused."""
    age = F.unix_timestamp(now) - F.unix_timestamp("checked_at")
    return cache.filter(F.col("status").isNotNull() & (age <= ttl_seconds))


def stale(urls: DataFrame, cache: DataFrame, ttl_seconds: int, now: Column, keys: Sequence[str] = ("url",)) -> DataFrame:
    """Distinct URLs that have to be looked up again. ``keys`` identify a lookup: by default its URL, else say the page that asks for it."""
    known = fresh(cache, ttl_seconds, now).select(*keys).distinct()
    asked = urls.select(*dict.fromkeys(["url", *keys])).filter(F.length("url") > 0)
    return asked.join(known, list(keys), "left_anti").select("url").distinct()


def store_status(cache: DataFrame, fetched: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """Cache after a lookup round: fetched statuses replace old ones of the same ``keys``, unknown results are not stored."""
    new = fetched.filter(F.col("status").isNotNull())
    return keep_latest(cache.unionByName(new), list(keys), ["checked_at"])
