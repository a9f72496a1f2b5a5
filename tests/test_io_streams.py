"""Readers and writers over temporary folders, and the incremental operators as streams against their batch twins."""

import json
import os

import pytest
from pyspark.sql import functions as F

from weftline.sources import scans, sinks
from weftline.streaming import stateful as S


def put(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj, indent=1))


def test_catalog_scan(spark, tmp_path):
    put(f"{tmp_path}/wizard/catalog/a.json", {"library_id": "a", "passes": [{"attraction_slug": "x"}, {"attraction_slug": "y"}]})
    put(f"{tmp_path}/libcal/catalog/b.json", {"library_id": "b", "passes": [{"attraction_slug": "z"}]})
    d = scans.scan_exploded(spark, f"{tmp_path}/*/catalog/*.json", "library_id string, passes array<struct<attraction_slug:string>>", "passes")
    assert sorted((r["platform"], r["library_id"], r["pos"], r["attraction_slug"]) for r in d.collect()) == [("libcal", "b", 0, "z"), ("wizard", "a", 0, "x"), ("wizard", "a", 1, "y")]


def test_keyed_scan(spark, tmp_path):
    put(f"{tmp_path}/coupons/acton__mfa-e.json", {"status": "ok"})
    d = scans.scan_keyed(spark, f"{tmp_path}/coupons/*.json", "status string", r"([^/]+)__([^/]+)\.json$", ["library_id", "slug"])
    assert d.collect()[0].asDict() == {"library_id": "acton", "slug": "mfa-e", "status": "ok"}


def test_override_scan(spark, tmp_path):
    put(f"{tmp_path}/libraries/a/hours.json", {"status": "corrected", "corrected_value": {"monday": "closed"}})
    put(f"{tmp_path}/passes/a__x/pass_form.json", {"status": "corrected", "corrected_value": "digital_email", "source": "s"})
    put(f"{tmp_path}/passes/a__x/note.json", {"status": "corrected", "corrected_value": None})
    put(f"{tmp_path}/audit_overrides.json", {"pass:a__x:pass_form": {"status": "corrected", "corrected_value": "physical_circ"}})
    d = scans.scan_overrides(spark, str(tmp_path), f"{tmp_path}/audit_overrides.json")
    r = {(x["kind"], x["id"], x["field"]): x for x in d.collect()}
    assert json.loads(r["library", "a", "hours"]["value"]) == {"monday": "closed"}
    assert r["pass", "a__x", "pass_form"]["value"] == "physical_circ" and r["pass", "a__x", "note"]["value"] is None and r["pass", "a__x", "note"]["status"] == "corrected"


def test_seed_shapes(spark, tmp_path):
    put(f"{tmp_path}/list.json", [{"id": "a", "town": "A"}, {"id": "b", "town": "B"}])
    put(f"{tmp_path}/wrapped.json", {"libraries": [{"id": "a", "town": "A"}, {"id": "b", "town": "B"}]})
    for name in ("list", "wrapped"):
        d = scans.scan_seeds(spark, f"{tmp_path}/{name}.json", "id string, town string", "libraries")
        assert sorted((r["id"], r["town"]) for r in d.collect()) == [("a", "A"), ("b", "B")]


def test_map_config(spark, tmp_path):
    put(f"{tmp_path}/zips.json", {"towns": {"Acton": ["01720"], "_note": ["x"]}})
    d = scans.scan_map(spark, f"{tmp_path}/zips.json", "array<string>", "towns")
    assert [(r["key"], r["value"]) for r in d.collect()] == [("Acton", ["01720"])]


def test_tolerant_and_locked_scans(spark, tmp_path):
    put(f"{tmp_path}/x/a.json", '{"id": 1}\n{"id": \n{"id": 3}')
    good, bad = scans.scan_tolerant(spark, f"{tmp_path}/x/*.json", "id int")
    assert sorted(r["id"] for r in good.collect()) == [1, 3] and bad.count() == 1
    put(f"{tmp_path}/y/a.json", '{"id": 1, "extra": 2}')
    with pytest.raises(ValueError, match="extra"):
        scans.scan_locked(spark, f"{tmp_path}/y/a.json", "id int")
    assert scans.scan_locked(spark, f"{tmp_path}/y/a.json", "id int, extra int").first()["extra"] == 2


def test_page_scan(spark, tmp_path):
    put(f"{tmp_path}/mfa.html", "<!-- source_url: http://mfa/ -->\n<p>x</p>")
    put(f"{tmp_path}/mfa__visit.html", "<p>y</p>")
    r = {x["page"]: x for x in scans.scan_pages(spark, f"{tmp_path}/*.html").collect()}
    assert r["mfa"]["source_url"] == "http://mfa/" and r["mfa__visit"]["entity"] == "mfa" and r["mfa__visit"]["source_url"] is None


def test_index_type_lookups(spark):
    d = spark.createDataFrame([("p", "l", 0, "a-digital", "a", "digital", "h1"), ("p", "l", 1, "a", "a", "unknown", "h1")], "platform string, library_id string, pos int, slug string, canonical string, pass_type string, museum_hex string")
    by_slug, by_id = scans.index_types(d)
    assert {r["key"]: r["pass_type"] for r in by_slug.collect()} == {"a-digital": "digital", "a": "unknown"} and by_id.first()["pass_type"] == "unknown"


def test_seed_rosters(spark):
    d = scans.seed_rosters(spark, {"q": [{"slug": "main", "name": "Main"}, {"slug": "n", "name": "North", "phone": "1"}]})
    assert d.groupBy("library_id").count().first()["count"] == 2 and d.filter("id = 'q-n'").first()["phone"] == "1"


def test_table_with_metadata(spark, tmp_path):
    d = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, coupon string")
    sinks.write_table(d, str(tmp_path), "passes", {"coupon": F.col("coupon").isNotNull()})
    m = spark.read.parquet(f"{tmp_path}/_meta_passes").first()
    assert (m["n"], m["n_coupon"], m["pct_coupon"]) == (3, 2, 66.7) and m["built_at"] is not None


def test_manifest_ignores_row_order_but_not_content(spark):
    a = spark.range(100).withColumn("x", F.lit("é"))
    r = {x["table"]: x for x in sinks.manifest({"a": a, "b": a.repartition(7), "c": a.filter("id < 99"), "d": a.union(a.limit(1))}).collect()}
    assert r["a"]["digest"] == r["b"]["digest"] != r["c"]["digest"] and r["a"]["digest"] != r["d"]["digest"]
    assert r["a"]["rows"] == 100 and len(r["a"]["digest"]) == 16 and r["a"]["bytes"] == sum(len(('{"id":%d,"x":"é"}' % i).encode()) for i in range(100))


def test_snapshot_is_immutable(spark, tmp_path):
    d = spark.range(3)
    sinks.write_snapshot(d, str(tmp_path), "2026-05-01")
    sinks.write_snapshot(d, str(tmp_path), "2026-05-02")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_snapshot(d, str(tmp_path), "2026-05-01")
    assert sinks.read_snapshots(spark, str(tmp_path)).select("snapshot_date").distinct().count() == 2


def test_results_sink(spark, tmp_path):
    d = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, t string")
    sinks.write_results(d, str(tmp_path))
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert sorted(r["id"] for r in back.collect()) == ["1", "2"] and spark.read.json(f"{tmp_path}/json").filter("t = 'a,b'").count() == 1


def test_day_stream_equals_batch(spark, tmp_path):
    """Three micro-batches must leave the same table as one merge over everything; a second run adds nothing."""
    cols = "p string, day string, status string, page int"
    parts = [[("p", "d1", "available", 1), ("p", "d2", "closed", 1)], [("p", "d1", "closed", 2), ("p", "d2", "booked", 0)], [("q", "d1", "booked", 5), ("p", "d1", "booked", 3)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):
        S.stream_days(stream(), f"{tmp_path}/store", f"{tmp_path}/cp", ["p", "day"], "status", "page").awaitTermination()
    everything = spark.createDataFrame([r for p in parts for r in p], cols)
    want = {(r["p"], r["day"], r["status"]) for r in S.overlay_days(everything.limit(0), everything, ["p", "day"], "status", "page").collect()}
    got = S.read_days(spark, f"{tmp_path}/store", ["p", "day"], "status", "page")
    assert {(r["p"], r["day"], r["status"]) for r in got.collect()} == want == {("p", "d1", "booked"), ("p", "d2", "booked"), ("q", "d1", "booked")}
    S.compact(spark, f"{tmp_path}/store", f"{tmp_path}/store2", lambda d: S.reduce_days(d, ["p", "day"], "status", "page"))
    again = S.read_days(spark, f"{tmp_path}/store2", ["p", "day"], "status", "page")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect())) and S.read_log(spark, f"{tmp_path}/store2").count() == 3


def test_replayed_batch_changes_nothing(spark, tmp_path):
    sink = S.log_sink(f"{tmp_path}/s", lambda d: S.keep_latest(d, ["k"], ["seq"]))
    state = lambda: sorted(map(tuple, S.keep_latest(S.read_log(spark, f"{tmp_path}/s"), ["k"], ["seq"]).collect()))
    a = spark.createDataFrame([("x", 1, "a"), ("y", 1, "b")], "k string, seq int, v string")
    b = spark.createDataFrame([("x", 2, "c")], "k string, seq int, v string")
    sink(a, 0), sink(b, 1)
    first = state()
    sink(b, 1)
    assert state() == first == [("x", 2, "c"), ("y", 1, "b")]


def test_override_stream_keeps_tombstones(spark, tmp_path):
    cols = "target string, seq int, op string, value string"
    for rows in ([("t1", 1, "upsert", "a"), ("t2", 1, "upsert", "b")], [("t1", 3, "revoke", None)], [("t1", 2, "upsert", "late"), ("t2", 5, "upsert", "c")]):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    S.stream_upsert(s, f"{tmp_path}/store", f"{tmp_path}/cp", ["target"], ["seq"]).awaitTermination()
    live = S.read_overrides(spark, f"{tmp_path}/store", ["target"], ["seq"])
    assert [(r["target"], r["value"]) for r in live.collect()] == [("t2", "c")]
    batch = S.override_log(spark.read.schema(cols).parquet(f"{tmp_path}/in"), ["target"], ["seq"])
    assert [(r["target"], r["value"]) for r in batch.collect()] == [("t2", "c")]


def test_ttl(spark):
    now = F.lit("2026-05-10 00:00:00").cast("timestamp")
    cache = spark.createDataFrame([("a", 200, "2026-05-09 23:00:00"), ("b", 404, "2026-05-01 00:00:00"), ("c", None, "2026-05-09 23:00:00")], "url string, status int, at string").withColumn("checked_at", F.to_timestamp("at")).drop("at")
    urls = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",), ("",)], "url string")
    assert sorted(r["url"] for r in S.stale(urls, cache, 72 * 3600, now).collect()) == ["b", "c", "d"]
    fetched = spark.createDataFrame([("b", 200), ("d", None)], "url string, status int").withColumn("checked_at", now)
    assert {r["url"]: r["status"] for r in S.store_status(cache.filter("status IS NOT NULL"), fetched).collect()} == {"a": 200, "b": 200}


def test_unknown_paths_of_any_depth(spark):
    """Lists, odd names, fields of another kind than the schema's, malformed and empty texts."""
    texts = ['{"a": 1, "b": {"c": 2, "d": null}, "l": [{"x": 1}, {"y": {"z": 1}}, {"y": 2}, 7]}', '{"a": {"k": 1}, "b": {"c": 3}, "l": [], "it\'s": 1, "": 4, "p.q": 5}',
             '{"b": "text", "l": {"x": 1}, "new": [{"q": 1}]}', '{"b": null, "l": [{"y": 2}]}', '{"a": ', None, "", "[1]", "3"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    schema = "a bigint, b struct<c:bigint>, l array<struct<x:bigint>>"
    assert {r["path"]: r["n"] for r in scans.unknown_paths(d, "t", schema).collect()} == {"b.d": 1, "l[].y": 2, "it's": 1, "": 1, "p.q": 1, "new": 1}
    wide = "a bigint, b struct<c:bigint, d:string>, l array<struct<x:bigint, y:struct<w:int>>>, `it's` int, new array<struct<q:int>>, extra int"
    assert {r["path"]: r["n"] for r in scans.unknown_paths(d, "t", wide).collect()} == {"l[].y.z": 1, "": 1, "p.q": 1}
    assert scans.unknown_paths(d.limit(0), "t", schema).count() == 0


def test_pages_that_share_a_url(spark, tmp_path):
    """One lookup per page: a fresh status of one page says nothing about another page of the same URL, and both are stored."""
    import duckdb

    from weftline.plans.catalog import ORACLES, QUERIES
    rows = [(0, "u", ""), (4, "u", ""), (73, "v", ""), (1, "v", ""), (6, "w", ""), (8, "w", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("stale_urls", "url_cache_update"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLES[name]).fetchall()), name
