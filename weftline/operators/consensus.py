"""Votes across sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consensus(df: DataFrame, entity: str, voter: str, value: str, min_voters: int = 3, min_share: float = 0.5) -> DataFrame:
    """Entity value backed by enough voters: lowest value per voter, then the modal value (ties: smallest), output value + 1.

    Three combinable aggregates: (entity, voter) -> (entity, value) -> entity. The last one sees one row per distinct value.
    """
    votes = df.filter(F.col(value).isNotNull()).groupBy(entity, voter).agg(F.min(value).alias("_v"))
    tally = votes.groupBy(entity, "_v").agg(F.count("*").alias("_n"))
    top = tally.groupBy(entity).agg(F.sum("_n").alias("n_voters"), F.max("_n").alias("n_backing"),
                                    F.max_by("_v", F.struct("_n", -F.col("_v"))).alias("_v"))
    kept = top.filter((F.col("n_voters") >= min_voters) & (F.col("n_backing") >= F.col("n_voters") * F.lit(min_share)))
    return kept.select(entity, (F.col("_v") + 1).alias("free_under_age"), "n_voters", "n_backing")


def nearest_marker(df: DataFrame, key: str, pos: str, marker: str, bucket: str, direction: str = "preceding",
                   out: str = "nearest") -> DataFrame:
    """Last marker at or before each row (or first at or after), per key in ``pos`` order.

    ``bucket`` must grow with ``pos``. Rows are windowed inside (key, bucket) only; what earlier buckets carry over comes
    from one aggregated row per bucket, so no task ever holds a whole hot key.
    """
    back = direction == "preceding"
    order = F.col(pos) if back else F.col(pos).desc()
    inner = Window.partitionBy(key, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = F.last(marker, ignorenulls=True).over(inner)
    edge = (F.max_by if back else F.min_by)(marker, F.when(F.col(marker).isNotNull(), F.col(pos)))
    carry = df.groupBy(key, bucket).agg(edge.alias("_edge"))
    across = Window.partitionBy(key).orderBy(F.col(bucket) if back else F.col(bucket).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(key, bucket, F.last("_edge", ignorenulls=True).over(across).alias("_carry"))
    return df.withColumn("_local", local).join(carry, [key, bucket], "left") \
        .withColumn(out, F.coalesce("_local", "_carry")).drop("_local", "_carry")
