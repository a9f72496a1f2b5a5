"""Physical layout helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def with_value(df: DataFrame, **values: Column) -> DataFrame:
    """Append costly columns behind an outer explode of one element, which later filters on them cannot be pushed through.

    A plain ``withColumn`` followed by ``filter`` makes the optimizer compute the expression twice: in the filter and in the projection.
    """
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    return df.select("*", F.explode_outer(F.array(row)).alias("_row")).select(*df.columns, *[F.col(f"_row.{n}").alias(n) for n in values])


def spread_scan(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt out over all cores before CPU-heavy text work, only if the files give fewer tasks than cores.

    A large table already has many splits and is returned as it is (no shuffle).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def deal(df: DataFrame, share: int = 4) -> DataFrame:
    """Narrow rows dealt out evenly before costly work per row: ``share`` tasks per core or per input split, whichever is more.

    Splits are as uneven as a file's row groups, and one task per core grows with the table; these tasks stay a fraction of a split.
    """
    return df.repartition(share * max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


TASK_ROWS = 250_000


def task_count(spark: SparkSession, rows: int) -> int:
    """Tasks of about ``TASK_ROWS`` rows each, at least one per core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def in_tasks(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Narrow rows shuffled by keys into tasks of about ``TASK_ROWS`` rows each, at least one per core; ``rows`` is their number.

    Adaptive execution merges partitions up to a size in compressed bytes, which is millions of narrow rows; aggregates and sorts over
    them take gigabytes in one task. A number given here stays, so that the memory of a task doesn't depend on the size of the table.
    """
    return df.repartition(task_count(df.sparkSession, rows), *keys)


def dealt(df: DataFrame, key: Column, out: str, rows: int | None) -> DataFrame:
    """Rows dealt by ``key`` into tasks laid out for ``rows`` rows (see ``in_tasks``), with the number of their task as column ``out``.

    Sides dealt with the same ``rows`` meet where they are in joins on ``out`` and any more columns that determine the key: a join on
    several columns stays in place after ``repartitionById``, but not after ``repartition`` by some of them. Null keys share a task.
    Without ``rows`` nothing moves and only the column is added.
    """
    if rows is None:
        return df.withColumn(out, F.hash(key))
    n = task_count(df.sparkSession, rows)
    return df.withColumn(out, F.pmod(F.hash(key), F.lit(n))).repartitionById(n, out)
