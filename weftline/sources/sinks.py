"""Writers: table with metadata, manifest, snapshot, exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftline.functions.core import pct
from weftline.operators.quality import coverage
from weftline.sources.snapshots import fold_digest


def table_meta(df: DataFrame, name: str, metrics: Mapping[str, Column] | None = None) -> DataFrame:
    """One row: table, build time, row count and coverage percentages."""
    return coverage(df, metrics or {}).select(F.lit(name).alias("table"), F.current_timestamp().alias("built_at"), "*")


def write_table(df: DataFrame, root: str, name: str, metrics: Mapping[str, Column] | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write the table; its row count and coverage come from the same pass over the rows (an observation), as `table_meta` would give them."""
    spark, metrics, seen = df.sparkSession, metrics or {}, Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(p, F.lit(False))).alias(f"n_{m}") for m, p in metrics.items()])
    watched.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/{name}")
    counts = seen.get
    meta = spark.range(1).select(F.lit(name).alias("table"), F.current_timestamp().alias("built_at"), *[F.lit(counts[c]).cast("bigint").alias(c) for c in ("n", *(f"n_{m}" for m in metrics))])
    meta.withColumns({f"pct_{m}": pct(f"n_{m}", "n") for m in metrics}).write.mode("overwrite").parquet(f"{root}/_meta_{name}")
    return spark.read.schema(df.schema).parquet(f"{root}/{name}")


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, serialized bytes, and an order-insensitive content hash (see ``snapshots.fold_digest``)."""
    parts = []
    for name, df in tables.items():
        body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        d = df.select(body.alias("_b")).select(F.octet_length("_b").cast("bigint").alias("n"), F.sha2("_b", 256).alias("h"))
        parts.append(d.agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"), F.substring(fold_digest("h"), 1, 16).alias("digest"))
                     .select(F.lit(name).alias("table"), "rows", "bytes", "digest"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_snapshot(df: DataFrame, root: str, day: str) -> str:
    """Immutable dated snapshot; fails when the date exists already."""
    path = f"{root}/snapshot_date={day}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_snapshots(spark, root: str) -> DataFrame:
    return spark.read.parquet(root).withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


def export_with_evidence(entities: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Entities with their evidence fields as MAP<field, STRUCT<source,evidence,block>>.

    ``evidence`` is unique per (key, field), so a map never holds more entries than the table has fields.
    """
    maps = evidence.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("source", "evidence", "block")))).alias("_evidence"))
    return entities.join(maps, key, "left")
