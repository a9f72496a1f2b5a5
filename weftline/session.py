"""Session settings the operators rely on when they run on a cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def recommended_conf() -> dict[str, str]:
    """SQL settings that keep the plans safe with hot keys and large inputs.

    The adaptive settings split a hot join partition at run time even when the
    split costs one more exchange; the rest are correctness settings (UTC, ANSI).
    """
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }


def build_session(app: str = "weftline", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**recommended_conf(), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private one only where none is set (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix="weftline-")


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss); never a local one."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)
