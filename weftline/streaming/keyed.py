"""Keyed stream state: the latest statement per key lives in the state store and is read back as a table.

State is kept in the stream's checkpoint folder, changes with every batch and survives lost executors and restarts; a replayed batch
finds the state of the batch before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_statements(stream: DataFrame, sticky: str | None = None) -> DataFrame:
    """(key, status, ordinal) stream -> the keys a batch speaks of with their latest statement. Rows without a key or an ordinal say nothing.

    ``sticky`` names a status that never replaces another one. A maximum per key: combined in the map tasks, then with one state row per
    key, without a call to Python per key.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # state on disk: it may outgrow the memory
    rows = stream.filter(F.col("key").isNotNull() & F.col("ordinal").isNotNull())
    firm = F.col("status").isNotNull() & ~F.col("status").eqNullSafe(F.lit(sticky))
    rank = F.struct(firm.alias("firm"), F.col("ordinal").cast("long").alias("ordinal"), F.coalesce("status", F.lit("")).alias("word"), F.col("status"))
    return rows.groupBy("key").agg(F.max(rank).alias("latest")).select("key", "latest.status", "latest.ordinal")


def run_latest(stream: DataFrame, root: str, sticky: str | None = None) -> None:
    """Take in all files that are there (available now); changes go to ``root``/changes/batch=N, state to ``root``/checkpoint."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={number}")

    changed = latest_statements(stream, sticky).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint")
    changed.trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The state after the last batch, as a table."""
    state = spark.read.format("statestore").option("path", f"{root}/checkpoint").load()
    return state.select("key.key", "value.max.status", "value.max.ordinal")
