"""Snapshots compared by digest tree and bucket, runs of days, observed writes, keyed stream state, one-probe lookups."""

import datetime
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import calendars as C
from weftline.operators import diff as D
from weftline.operators import keys as K
from weftline.operators import quality as Q
from weftline.sources import sinks
from weftline.sources import snapshots as S
from weftline.streaming import keyed

ROWS = "k long, a string, n long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sides(spark, changed=()):
    rows = [(i, None if i % 7 == 0 else f"v{i % 11}", i) for i in range(3000)] + [(None, "x", 1)]
    other = [(k, "new" if k in changed else a, n) for k, a, n in rows if k != 5] + [(9999, "late", 0)]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(other, ROWS)


def test_only_differing_ranges_are_read(spark, tmp_path):
    before, now = sides(spark, {17})
    S.write_ranged(before, f"{tmp_path}/b", ["k"], 1)
    S.write_ranged(now, f"{tmp_path}/n", ["k"], 1)
    got = S.ranged_diff(spark, f"{tmp_path}/n", f"{tmp_path}/b", ["k"], ["a", "n"], depth=1)
    read = {x for ranges in re.findall(r"PartitionFilters: \[_range#\d+L? IN \(([\d,]+)\)", plan(got)) for x in ranges.split(",")}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, D.snapshot_diff(now, before, ["k"], ["a", "n"]).collect())) and got.count() == 3
    trees = [spark.read.parquet(f"{tmp_path}/{x}/_tree") for x in "nb"]
    changes = S.tree_changes(*trees, 1).collect()
    assert 1 <= len(read) <= 3 and read == {str(r["node"]) for r in changes if r["level"] == 1} and sum(r["level"] == 0 for r in changes) == 1
    assert S.tree_changes(trees[0], trees[0], 1).count() == 0


def test_a_digest_knows_copies_but_not_order(spark, tmp_path):
    rows = [(i % 5, "x", i % 3) for i in range(40)]
    tree = lambda r: {tuple(x) for x in S.digest_tree(spark.createDataFrame(r, ROWS).withColumn(S.RANGE, S.key_range(["k"], 1)), ["k", "a", "n"], 1).collect()}
    assert tree(rows) == tree(rows[::-1]) and tree(rows) != tree(rows + rows[:1]) and tree(rows) != tree(rows[2:] + rows[:1] * 2)
    assert tree([]) == set()
    S.write_ranged(spark.createDataFrame(rows, ROWS), f"{tmp_path}/x", ["k"], 1)
    with pytest.raises(Exception, match="(?i)exists"):
        S.write_ranged(spark.createDataFrame(rows, ROWS), f"{tmp_path}/x", ["k"], 1)


def test_buckets_meet_without_an_exchange(spark, tmp_path):
    before, now = (x.filter("k is not null") for x in sides(spark, {3}))
    names = [S.write_bucketed(x, str(tmp_path), ["k"], 4) for x in (now, before)]
    got = S.bucketed_diff(spark, *names, ["k"], ["a", "n"])
    assert "Exchange" not in plan(got) and "SortMergeJoin" in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, D.snapshot_diff(now, before, ["k"], ["a", "n"]).collect()))


def test_day_runs_against_a_walk(spark):
    rng = random.Random(4)
    start, rows = datetime.date(2023, 11, 20), []
    for p in range(12):
        day = start + datetime.timedelta(rng.randrange(40))
        for _ in range(rng.choice([1, 3, 400])):
            rows.append((p, day, rng.choice(["a", "a", "a", "a", "b", None])))
            day += datetime.timedelta(1 if rng.random() < 0.97 else rng.randrange(2, 40))
    want = set()
    for p, group in itertools.groupby(rows, lambda r: r[0]):
        run = None
        for _, day, status in group:
            if run and run[2] == status and (day - run[1]).days == 1:
                run[1] = day
            else:
                if run:
                    want.add((p, run[2], run[0], run[1], (run[1] - run[0]).days + 1))
                run = [day, day, status]
        want.add((p, run[2], run[0], run[1], (run[1] - run[0]).days + 1))
    got = C.day_runs(spark.createDataFrame(rows, "p int, day date, status string"), ["p"], "day", "status")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert C.day_runs(spark.createDataFrame([], "p int, day date, status string"), ["p"], "day", "status").count() == 0


def test_a_table_and_its_metadata_are_one_pass(spark, tmp_path):
    d = spark.range(1000).withColumn("v", F.when(F.col("id") % 4 == 0, F.col("id")))
    metrics = {"filled": F.col("v").isNotNull(), "never": F.lit(None).cast("boolean")}
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    written = sinks.write_table(d.mapInArrow(seen, d.schema), str(tmp_path), "t", metrics)
    assert calls.value == 1000  # the rows were made once: written and counted
    meta = spark.read.parquet(f"{tmp_path}/_meta_t").drop("built_at")
    assert meta.collect() == sinks.table_meta(written, "t", metrics).drop("built_at").collect() and meta.first()["n_filled"] == 250


def statements(spark, path, rows):
    spark.createDataFrame(rows, "key string, status string, ordinal long").coalesce(1).write.mode("append").parquet(path)


def test_stream_state_keeps_the_latest(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"
    rng = random.Random(1)
    every = [(f"k{rng.randrange(20)}", rng.choice(["open", "closed", "booked", None]), i) for i in range(300)] + [(None, "open", 1), ("k1", "open", None)]
    for part in (every[:100], every[100:200], every[200:]):
        statements(spark, source, part)
        stream = spark.readStream.schema("key string, status string, ordinal long").parquet(source)
        keyed.run_latest(stream, root, sticky="closed")
    rank = lambda r: (r[1] is not None and r[1] != "closed", r[2], r[1] or "")
    want = {}
    for r in every:
        if r[0] and r[2] is not None and (r[0] not in want or rank(r) > rank(want[r[0]])):
            want[r[0]] = r
    assert {tuple(r) for r in keyed.read_state(spark, root).collect()} == set(want.values())
    keyed.run_latest(stream, root, sticky="closed")  # nothing new: nothing counted twice
    assert {tuple(r) for r in keyed.read_state(spark, root).collect()} == set(want.values())
    changes = spark.read.parquet(f"{root}/changes")
    assert changes.groupBy("batch").count().count() >= 3 and changes.groupBy("key").agg(F.max_by("status", "batch").alias("s")).filter("s = 'closed'").count() == sum(r[1] == "closed" for r in want.values())


@pytest.mark.parametrize("attempts", [1, 2, 4])
def test_one_probe_for_any_number_of_attempts(spark, tmp_path, attempts):
    rng = random.Random(attempts)
    names = [f"k{i}" for i in range(attempts)]
    facts = [(i, *(rng.choice([None, "a", "b", "c", "d", "z"]) for _ in names)) for i in range(200)] * 2
    spark.createDataFrame([("a", 1), ("b", None), ("d", 4)], "k string, v int").write.parquet(f"{tmp_path}/dim")
    dim = spark.read.parquet(f"{tmp_path}/dim")
    known = {"a": 1, "b": None, "d": 4}
    rows = spark.createDataFrame(facts, "i int, " + ", ".join(f"{n} string" for n in names))
    got = K.lookup_first(rows, dim, [[n] for n in names], ["k"], ["v"])
    assert plan(got).count("FileScan parquet") == 1
    want = [(*r, next((known[k] for k in r[1:] if k in known), None)) for r in facts]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    salted = K.lookup_first(rows.fillna("-"), dim, [[n] for n in names], ["k"], ["v"], salts=3)
    assert sorted((r["i"], r["v"] is None) for r in salted.collect()) == sorted((r[0], r[-1] is None) for r in want)
    drops = Q.silent_drops(rows.withColumn("own", F.lit(None).cast("int")), "own", dim.withColumn("status", F.lit("ok")), [[n] for n in names], ["k"])
    assert drops.count() == sum(any(k in known for k in r[1:]) for r in facts)
