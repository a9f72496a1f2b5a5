"""Connected components as Spark jobs: smallest labels travel along the links, and labels jump to the labels of their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, label), the smallest node of each component; nodes without links don't occur.

    Every round is one join along the links, one aggregate that map tasks combine, and one jump; it is written, and the loop ends when no
    label changes. Links and labels stay in tables; the driver sees one number per round.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        least = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = written(least.join(jump, "label").select("node", F.least("label", "beyond").alias("label"), (F.least("label", "beyond") < F.col("old")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
