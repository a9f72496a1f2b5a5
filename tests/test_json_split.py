"""The splitting JSON reader against the json module, on files cut into many byte ranges; catalog documents by line."""

import json
import random

import pytest

from weftline.sources import json_split as J


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return rng.randrange(1000)
    if kind < 3:
        return "".join(rng.choice('ab,{}[]":\\\n é') for _ in range(rng.randrange(12)))
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i},{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_big_map_and_list_against_json(spark, tmp_path, small_ranges, indent):
    rng = random.Random(7)
    m = {f"key {i}": {"v": value(rng)} if i % 5 else value(rng) for i in range(400)} | {"_note": "x, y"}
    items = [{"id": i, "body": value(rng)} for i in range(300)]
    long = {"a": "word, " * 3000, "b": [1, 2]}  # one record longer than several ranges
    for name, doc in (("m", m), ("l", items), ("long", long)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
    assert J.scan_pieces(spark, f"{tmp_path}/m.json").rdd.getNumPartitions() > 4
    plain = lambda v: v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False)
    got = {r["key"]: r for r in J.scan_big_map(spark, f"{tmp_path}/m.json").collect()}
    assert set(got) == set(m) - {"_note"}
    assert sorted(got, key=lambda k: got[k]["pos"]) == [k for k in m if k != "_note"]
    for k, r in got.items():
        want = m[k]
        assert r["value"] == want if isinstance(want, str) else plain(json.loads(r["value"])) == plain(want)
    recs = sorted(J.records(J.scan_pieces(spark, f"{tmp_path}/l.json")).collect(), key=lambda r: r["pos"])
    assert [json.loads(r["text"]) for r in recs] == items
    assert {r["key"]: r["value"] for r in J.scan_big_map(spark, f"{tmp_path}/long.json").collect()}["a"] == long["a"]
    rows = J.scan_big_list(spark, f"{tmp_path}/l.json", "id int, body string").select("pos", "id").collect()
    assert sorted((r["pos"], r["id"]) for r in rows) == [(i, i) for i in range(300)]


def test_several_files_and_empty_documents(spark, tmp_path):
    for name, text in (("a", "[]"), ("b", "{}"), ("c", " \n"), ("d", '[1, "x,y", null]'), ("e", '["q"]\n'), ("f", "[[1], [2, [3]]]")):
        (tmp_path / f"{name}.json").write_text(text)
    got = sorted((r["file"][-6], r["pos"], json.loads(r["text"])) for r in J.records(J.scan_pieces(spark, f"{tmp_path}/*.json")).collect())
    assert [g for g in got if g[0] != "d"] == [("e", 0, "q"), ("f", 0, [1]), ("f", 1, [2, [3]])]
    assert [g[2] for g in got if g[0] == "d"] == [1, "x,y", None]


def test_runs_within_a_byte_range(spark, tmp_path, monkeypatch):
    """A byte range is summed in runs of few pieces; strings, records and documents cross them."""
    items = [{"id": i, "body": ["a,b]", {"c": '},"{'}] * (i % 4)} for i in range(60)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps(items))
    monkeypatch.setattr(J, "RUN", 3)
    got = J.records(J.scan_pieces(spark, f"{tmp_path}/*.json")).collect()
    for name in ("a", "b"):
        assert [json.loads(r["text"]) for r in sorted(got, key=lambda r: r["pos"]) if r["file"].endswith(f"{name}.json")] == items
