"""Snapshots compared by digest tree and by bucket, runs of days, and keyed stream state."""

import uuid

from pyspark.sql import functions as F

from weftline.operators import calendars as C
from weftline.plans.derived import view as V
from weftline.plans.registry import query
from weftline.plans.suite_tables import DIFF, folded
from weftline.session import checkpoint_dir
from weftline.sources import snapshots as S
from weftline.streaming import keyed

FIELDS = ["file", "slug", "pass_type", "label", "benefits_text"]
DEPTH = 2


def folder(spark, tag):
    return f"{checkpoint_dir(spark).rstrip('/')}/weftline-{tag}-{uuid.uuid4().hex}"


def two_snapshots(spark, sf):
    """The prior snapshot, and one in which the orders of every 500th customer have another label."""
    prior = V(spark, sf, "d_prior").select(*FIELDS)
    now = prior.withColumn("label", F.when(F.col("file") % 500 == 0, "moved").otherwise(F.col("label")))
    paths = folder(spark, "now"), folder(spark, "before")
    for df, path in zip((now, prior), paths):
        S.write_ranged(df, path, ["slug"], DEPTH)
    return paths


_JSON = """concat('{"benefits_text":"', benefits_text, '","file":', file, ',"label":', coalesce('"' || label || '"', 'null'), ',"pass_type":"', pass_type, '","slug":"', slug, '"}')"""
_TREE = f"""r AS (SELECT *, CAST('0x' || substr(sha256(concat('{{"slug":"', slug, '"}}')), 1, 2) AS INT) AS node, sha256({_JSON}) AS h FROM s),
    l2 AS (SELECT side, node, {folded('h')} AS digest FROM r GROUP BY side, node),
    l1 AS (SELECT side, node // 16 AS node, sha256(string_agg(concat(node, ':', digest), ',' ORDER BY node)) AS digest FROM l2 GROUP BY 1, 2),
    l0 AS (SELECT side, node // 16 AS node, sha256(string_agg(concat(node, ':', digest), ',' ORDER BY node)) AS digest FROM l1 GROUP BY 1, 2),
    a AS (SELECT 2 AS level, * FROM l2 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l0)"""


@query("manifest_diff", "WITH p AS (SELECT * FROM {d_prior} x), s AS (SELECT 'before' AS side, * FROM p UNION ALL SELECT 'now', file, slug, pass_type, CASE WHEN file % 500 = 0 THEN 'moved' ELSE label END, benefits_text FROM p), "
       + _TREE + """ SELECT n.level, n.node, n.digest AS now, b.digest AS "before" FROM a n JOIN a b ON n.side = 'now' AND b.side = 'before' AND n.level = b.level AND n.node = b.node WHERE n.digest <> b.digest""")
def manifest_diff(spark, sf):
    now, before = two_snapshots(spark, sf)
    tree = lambda path: spark.read.parquet(f"{path}/_tree")
    return S.tree_changes(tree(now), tree(before), DEPTH)


@query("ranged_snapshot_diff", """SELECT file, slug, 'changed' AS change, 'label' AS field, label AS "from", 'moved' AS "to" FROM {d_prior} x WHERE file % 500 = 0""")
def ranged_snapshot_diff(spark, sf):
    return S.ranged_diff(spark, *two_snapshots(spark, sf), ["file", "slug"], ["pass_type", "label"], ["benefits_text"], DEPTH)


@query("snapshot_diff_bucketed", DIFF + "SELECT * FROM d")
def snapshot_diff_bucketed(spark, sf):
    root = folder(spark, "buckets")
    now, before = (S.write_bucketed(V(spark, sf, name).select(*FIELDS), root, ["slug"], 8) for name in ("d_today", "d_prior"))
    return S.bucketed_diff(spark, now, before, ["slug"], ["pass_type", "label"], ["benefits_text"]).join(orders(spark, sf), "slug").select("file", "slug", "change", "field", "from", "to")


def orders(spark, sf):
    return V(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("slug"), F.col("o_custkey").alias("file"))


@query("availability_runs", """WITH s AS (SELECT pass_id, day, arg_max(status, (status <> 'closed', page_no, status)) AS status FROM {d_day} d GROUP BY ALL),
    n AS (SELECT *, CASE WHEN lag(status) OVER w = status AND day - lag(day) OVER w = 1 THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY pass_id ORDER BY day)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY pass_id ORDER BY day) AS run FROM n)
    SELECT pass_id, any_value(status) AS status, min(day) AS "first", max(day) AS "last", count(*) AS n FROM r GROUP BY pass_id, run""")
def availability_runs(spark, sf):
    return C.day_runs(C.merge_days(V(spark, sf, "d_day"), ["pass_id", "day"], "status", "page_no"), ["pass_id"], "day", "status")


# ---------------------------------------------------------------- keyed stream state
def event_stream(spark, sf):
    """The events as a stream of files, as statements about days (see the view d_day)."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    d = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    status = F.expr("CASE event_type WHEN 'signup' THEN 'available' WHEN 'purchase' THEN 'booked' WHEN 'error' THEN 'closed' ELSE 'unavailable' END")
    return d.select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("key"), status.alias("status"), F.col("event_id").alias("ordinal"))


@query("availability_stream", """SELECT concat_ws('/', pass_id, day) AS key, arg_max(status, (status <> 'closed', page_no, status)) AS status FROM {d_day} d GROUP BY ALL""")
def availability_stream(spark, sf):
    root = folder(spark, "stream")
    keyed.run_latest(event_stream(spark, sf), root, sticky="closed")
    return keyed.read_state(spark, root).select("key", "status")
