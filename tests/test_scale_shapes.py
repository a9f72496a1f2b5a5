"""Plan shapes and hot keys: what must hold when one key owns a large share of the rows."""

import hashlib
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import consensus
from weftline.operators import keys as K
from weftline.operators import matching as M
from weftline.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n=20000):
    """A third of the rows share key 0."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97 + 1).alias("k"), (F.col("id") * 7919 % 1009).alias("v"))


def test_rank_limit_runs_before_the_shuffle(spark):
    p = plan(K.top_per(hot(spark), ["k"], [F.col("v"), F.col("id")], 3))
    assert p.count("WindowGroupLimit") == 2 and p.index("Final") < p.index("Partial")


def test_top_per_equals_brute_force(spark):
    rows = [(r["k"], r["v"], r["id"]) for r in hot(spark).collect()]
    want = {}
    for k, v, i in sorted(rows):
        want.setdefault(k, [])
        if len(want[k]) < 3:
            want[k].append((v, i))
    got = {}
    for r in K.top_per(hot(spark), ["k"], [F.col("v"), F.col("id")], 3).collect():
        got.setdefault(r["k"], []).append((r["v"], r["id"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_large_k_is_ranked_in_slices(spark):
    d = hot(spark, 9000)
    want = {(r["k"], r["id"]) for r in d.filter("k <> 0").collect()}
    top = [r["id"] for r in d.filter("k = 0").orderBy("v", "id").limit(1200).collect()]
    got = K.top_per(d, ["k"], [F.col("v"), F.col("id")], 1200)
    assert {(r["k"], r["id"]) for r in got.collect()} == want | {(0, i) for i in top}


def test_checkpoint_goes_to_the_configured_folder(spark):
    from weftline.session import checkpoint_dir, cut_lineage
    d = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    folder = pathlib.Path(checkpoint_dir(spark).removeprefix("file:"))
    assert str(folder) == spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    assert d.count() == 10 and any(folder.rglob("part-*"))


@pytest.mark.parametrize("direction", ["preceding", "following"])
def test_nearest_marker_equals_brute_force(spark, direction):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 1, 2]), i, i if rng.random() < 0.05 else None) for i in range(3000)]
    d = spark.createDataFrame(rows, "k int, pos int, m int").withColumn("b", F.expr("pos div 100"))
    got = {r["pos"]: r["nearest"] for r in consensus.nearest_marker(d, "k", "pos", "m", "b", direction).collect()}
    last, want = {}, {}
    for k, pos, m in (rows if direction == "preceding" else reversed(rows)):
        if m is not None:
            last[k] = m
        want[pos] = last.get(k)
    assert got == want


def test_salted_lookup_equals_plain(spark):
    dim = spark.range(0, 60).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    a = K.lookup(hot(spark), dim, ["k"], ["name"]).groupBy("name").count()
    b = K.lookup(hot(spark), dim, ["k"], ["name"], salts=8).groupBy("name").count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_seeded_pools_are_disjoint_and_stable(spark):
    d = spark.range(500).select(F.col("id").alias("key"))
    pools = {"even": (F.col("key") % 2 == 0, 10), "low": (F.col("key") < 40, 15), "any": (F.lit(True), 20)}
    a = [(r["pool"], r["key"]) for r in M.seeded_pools(d, ["key"], pools, "s").collect()]
    b = [(r["pool"], r["key"]) for r in M.seeded_pools(d.repartition(7), ["key"], pools, "s").collect()]
    assert sorted(a) == sorted(b) and len({k for _, k in a}) == len(a) == 45
    scans = [plan(M.seeded_pools(d, ["key"], {f"p{i}": (F.col("key") % (i + 2) == 0, 3) for i in range(n)}, "s")).count("Range") for n in (2, 10)]
    assert scans[0] == scans[1]


def test_seeded_pools_of_any_size_pick_as_dealt_one_by_one(spark):
    """Takes beyond any one task's list, and beyond what a pool holds, against a plain deal."""
    n = 260_000
    d = spark.range(n).select(F.col("id").alias("key"))
    pools = {"third": (F.col("key") % 3 == 0, 50_000), "few": (F.col("key") < 900, 5_000), "any": (F.lit(True), 100_000)}
    got = {(r["pool"], r["pick_no"]): r["key"] for r in M.seeded_pools(d, ["key"], pools, "s").toLocalIterator()}
    taken, want = set(), {}
    for pool, (member, take) in {"third": (lambda k: k % 3 == 0, 50_000), "few": (lambda k: k < 900, 5_000), "any": (lambda k: True, 100_000)}.items():
        free = sorted((hashlib.sha256(f"s:{pool}:{k}".encode()).hexdigest(), k) for k in range(n) if member(k) and k not in taken)[:take]
        want.update({(pool, i + 1): k for i, (_, k) in enumerate(free)})
        taken |= {k for _, k in free}
    assert got == want
    assert M.seeded_pools(d.limit(0), ["key"], pools, "s").count() == 0


def test_no_query_plans_a_cross_join(spark, sf):
    """No registered query may fall back to a product of tables."""
    bad = []
    for name, fn in catalog.QUERIES.items():
        p = plan(fn(spark, sf))
        if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p:
            bad.append(name)
    assert bad == []


def test_scan_reads_only_needed_columns(spark, sf):
    p = plan(catalog.QUERIES["duplicate_keys"](spark, sf))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in p
    p = plan(catalog.QUERIES["cell_filter"](spark, sf))
    assert "l_partkey" in p and "l_extendedprice" not in p


def test_filter_reaches_the_scan(spark, sf):
    p = plan(catalog.QUERIES["nearest_preceding_marker"](spark, sf))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in p
    p = plan(catalog.QUERIES["orphan_keys"](spark, sf))
    assert "GreaterThanOrEqual(s_acctbal,0.0)" in p


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_orders_pages_are_dealt_in_small_shares(spark, sf):
    from weftline.plans.suite_calendar import order_cells
    assert order_cells(spark, sf).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_stream_state_needs_no_python(spark, tmp_path):
    from weftline.streaming import keyed
    stream = spark.readStream.schema("key string, status string, ordinal long").parquet(str(tmp_path))
    plan = keyed.latest_statements(stream, "closed")._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan


def test_python_sees_entities_only(spark, monkeypatch):
    """Odd and unfinished entities, the cut character and wide characters, as html.unescape reads them; texts stay in the JVM."""
    import html as std
    import random

    from weftline.functions import text
    r = random.Random(3)
    bits = ["&", "&amp;", "&#8211;", "&#x41", "&notit;", "&lt", "\u0001", "é", "😀", "<", " ", "\n", "abc", ";", "&#0;", "&#128;", "&nbsp;", "$1", "\\", "\x85"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(500)] + [None, "", "&"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.unescape_page("t").alias("u"))
    assert [(texts[x["i"]], x["u"]) for x in d.collect() if x["u"] != (texts[x["i"]] and std.unescape(texts[x["i"]]))] == []
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "_unescape_each" in plan and "_unescape(" not in plan


def small_copy(tmp_path):
    """The smallest tables under a path of their own, as views are kept by path."""
    (tmp_path / "t").symlink_to("/root/testdata/sf0.001")
    return str(tmp_path / "t")


@pytest.mark.parametrize("name", ["d_pass", "d_catalog", "d_access"])
def test_passes_are_dealt_into_tasks_of_bounded_rows(spark, tmp_path, monkeypatch, name):
    from weftline.operators import layout
    from weftline.plans.derived import pass_rows, view
    monkeypatch.setattr(layout, "TASK_ROWS", 200)
    sf = small_copy(tmp_path)
    assert view(spark, sf, name).rdd.getNumPartitions() == -(-pass_rows(spark, sf) // 200)


@pytest.mark.parametrize("name", ["canonical_key", "prioritized_lookup", "silent_drops"])
def test_keys_are_resolved_before_the_passes_meet_them(spark, tmp_path, monkeypatch, name):
    """The alias operator sees one row per attraction."""
    seen = []
    real = K.canonical_key
    monkeypatch.setattr(K, "canonical_key", lambda df, *a, **k: seen.append(df.columns) or real(df, *a, **k))
    catalog.QUERIES[name](spark, small_copy(tmp_path))
    assert seen and not any("library_id" in c for c in seen)


def test_text_conflicts_read_a_text_once_per_attraction(spark, tmp_path, monkeypatch):
    from weftline.operators import quality
    seen = []
    real = quality.conflicts
    monkeypatch.setattr(quality, "conflicts", lambda a, e, *r: seen.append(e) or real(a, e, *r))
    sf = small_copy(tmp_path)
    catalog.QUERIES["text_conflicts"](spark, sf)
    assert seen[0].count() == spark.read.parquet(f"{sf}/part.parquet").count()


def test_row_template_counts_in_one_pass(spark, tmp_path):
    assert "Join" not in plan(catalog.QUERIES["row_template"](spark, small_copy(tmp_path)).select("library_id", "n_parts")).replace("BroadcastHashJoin", "", 1)


def test_platform_keys_are_joined_once_per_key(spark, tmp_path, monkeypatch):
    seen = []
    real = K.resolve_by_platform
    monkeypatch.setattr(K, "resolve_by_platform", lambda df, *a: seen.append(df.columns) or real(df, *a))
    catalog.QUERIES["platform_key_resolution"](spark, small_copy(tmp_path))
    assert seen == [["platform", "attraction_rawslug", "base", "n"]]


def test_laid_out_lookup_equals_the_plain_one(spark, monkeypatch):
    from weftline.operators import layout
    monkeypatch.setattr(layout, "TASK_ROWS", 40)
    facts = spark.range(400).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 31).alias("b"), (F.col("id") % 3).alias("g"))
    dim = spark.range(60).select((F.col("id") % 3).alias("g"), (F.col("id") % 40).alias("k"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("v")).dropDuplicates(["g", "k"])
    find = lambda **o: K.lookup_first(facts, dim, [["g", "a"], ["g", "b"]], ["g", "k"], ["v"], **o)
    laid = find(rows=400)
    assert sorted(map(str, laid.collect())) == sorted(map(str, find().collect()))
    assert laid.rdd.getNumPartitions() == 10


def test_hits_stacked_on_a_row_key_equal_the_lookup(spark, monkeypatch):
    from weftline.operators import layout
    monkeypatch.setattr(layout, "TASK_ROWS", 40)
    facts = spark.range(400).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 31).alias("b"), (F.col("id") % 3).alias("g"))
    dim = spark.range(60).select((F.col("id") % 3).alias("g"), (F.col("id") % 40).alias("k"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("v")).dropDuplicates(["g", "k"])
    tries = [["g", "a"], ["g", "b"]]
    want = {r["id"]: r["v"] for r in K.lookup_first(facts, dim, tries, ["g", "k"], ["v"]).collect()}
    hits = K.attempt_hits(facts, dim.hint("shuffle_hash"), tries, ["g", "k"], ["v"], ["id", "g"], rows=400)
    more = spark.createDataFrame([(1, 1, 5), (1, 1, 9), (None, 2, 3), (None, 2, None)], "id long, g long, x long")
    for o in ({}, {"rows": 400}, {"rows": 400, "by": ["id"]}):
        got = K.stacked({"own": (facts, F.lit(True), F.max), "hit": (hits, F.struct("_attempt", "_hit"), F.min), "x": (more, F.col("x"), F.max)}, ["id", "g"], **o)
        rows = got.select("id", "g", "own", F.col("hit._hit.v").alias("v"), "x").collect()
        assert len(rows) == 401 and {r["id"]: r["v"] for r in rows if r["own"]} == want
        assert {(r["id"], r["g"], r["own"]): r["x"] for r in rows if r["x"]} == {(1, 1, True): 9, (None, 2, None): 3}
    assert got.rdd.getNumPartitions() == 10


def test_coverage_meets_offers_and_corrections_in_one_shuffle(spark, tmp_path):
    p = plan(catalog.QUERIES["offer_coverage_by_network"](spark, small_copy(tmp_path)))
    assert p.count("FileScan parquet") <= 24
