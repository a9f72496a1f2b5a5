"""The operators against brute-force versions, on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.llm import archive, exact_dedup, hilbert, isolation, line_dedup, ngram_join, packing, pieces_codec, quality_rules, substring_dedup, token_files, wordbpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, label long, size long, n_words long, rank long, _c0 string"


def rows(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", f"s{k % 3}", None if t is None else len(t), "k", 1, 2, 3, 4, "c") for k, (i, t) in enumerate(zip(ids, texts))]


def prose(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(12, 90)) for _ in range(40)]
    near = []
    for t in base[:12]:
        words = t.split()
        words[rng.randrange(len(words))] = "other"
        near.append(" ".join(words))
    passage = prose(rng, 45)
    shared = [prose(rng, 20) + " " + passage + "\n" + prose(rng, 15) for _ in range(6)]
    lines = ["\n".join(prose(rng, 12) for _ in range(4)) for _ in range(6)]
    lines += [x.replace(" ", "\t", 1) for x in lines[:3]] + ["\n".join(" ".join(y.split()[:-1]) for y in x.split("\n")) for x in lines[:3]]
    odd = [None, "", "  \n ", "one", "one", "One  two\tthree", "One two three", "é, à. ß " * 30, "a b c d e " * 40, prose(rng, 12000, 30000), "mix\x1f. . x <|endoftext|> don't"]
    out = base + near + shared + lines + base[:5] + odd
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    data = rows(texts)
    data += [data[3], data[3], (None, texts[4], "en", "s", 3, "k", 1, 2, 3, 4, "c"), (None, "no id here at all", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def words(t):
    return (t or "").encode().split()


def test_exact_dedup_against_brute_force(docs, empty):
    for frame, by_content, digest in ((docs, False, exact_dedup.sha256), (docs, True, lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(3)).cast("string"))):
        got = exact_dedup.exact_dedup(frame, digest=digest, by_content=by_content, salts=3).collect()
        groups = defaultdict(list)
        for r in frame.collect():
            groups[norm(r.text)].append(r.doc_id)
        want = Counter()
        for text, ids in groups.items():
            known = [i for i in ids if i is not None]
            keep = min(known) if known else None
            for i in ids:
                want[(i, keep, len(ids), i == keep)] += 1
        assert Counter(tuple(r)[:4] for r in got) == want
    sha = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_dedup(docs).collect()}
    assert all(sha[r.doc_id] == hashlib.sha256(norm(r.text).encode()).hexdigest() for r in docs.collect() if r.doc_id is not None)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_first(empty).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(norm(r.text) for r in kept.collect()) == sorted(set(groups))


def test_exact_dedup_stops_on_a_digest_of_two_contents(docs):
    with pytest.raises(Exception, match="two contents share a digest"):
        exact_dedup.exact_dedup(docs, digest=lambda c: F.lit("x")).collect()


@pytest.mark.parametrize("n,bits", [(1, 3), (2, 3), (3, 2)])
def test_hilbert_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    frame = spark.createDataFrame(cells, ", ".join(f"x{i} long" for i in range(n)))
    order = sorted((r[-1], tuple(r)[:-1]) for r in frame.withColumn("h", hilbert.curve_index([F.col(f"x{i}") for i in range(n)], bits)).collect())
    assert [h for h, _ in order] == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(order, order[1:]))


def test_hilbert_shards_are_level_and_gapless(docs, empty):
    got = hilbert.hilbert_shards(docs, ["lang", "source", "n_chars"]).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == docs.count() and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own))) and [r.hilbert for r in own] == sorted(r.hilbert for r in own)
    have = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == have
    assert hilbert.hilbert_shards(empty, ["lang", "n_chars"]).count() == 0
    assert sorted(r.shard for r in hilbert.hilbert_shards(docs.limit(3), ["lang"]).collect()) == [0, 2, 5]
    assert "ArrowPython" not in hilbert.hilbert_shards(docs, ["lang"])._jdf.queryExecution().toString()


def test_hilbert_cells_against_brute_force(spark):
    """Texts alike in their first 20 characters, a hot value, nulls, bytes and NaN."""
    rng = random.Random(3)
    head = "https://a.example/va"
    data = [(i, rng.choice([None, head, *(head + f"/{k:02d}" for k in range(60))]), rng.choice([None, float("nan"), 7.0, 7.0, rng.random()]), bytes([rng.randrange(120, 140)])) for i in range(600)]
    data += [(i, head + "/hot", 1.0, None) for i in range(600, 900)]
    frame = spark.createDataFrame(data, "id long, u string, x double, b binary")
    low = float("-inf")
    plain = {"u": lambda v: b"" if v is None else b"x" + v.encode(), "x": lambda v: low if v is None or v != v else v, "b": lambda v: b"" if v is None else b"x" + v}
    for column, name in ((1, "u"), (2, "x"), (3, "b")):
        key = hilbert.sort_key(frame, name)
        cuts = hilbert.boundaries(frame, key, 8)
        values = sorted(plain[name](r[column]) for r in data)
        assert [bytes(c) if name != "x" else c for c in cuts] == sorted({values[-(-len(values) * i // 8) - 1] for i in range(1, 8)})
        got = {r.id: r.c for r in frame.select("id", hilbert.cell(key, cuts).alias("c")).collect()}
        assert got == {r[0]: sum(plain[name](r[column]) > (bytes(c) if name != "x" else c) for c in cuts) for r in data}
    assert len({r.hilbert for r in hilbert.with_curve(frame.filter(f"u <> '{head}/hot'"), ["u"], 4).collect()}) == 16


def test_hilbert_shards_let_a_reader_skip_files(spark):
    """Boxes of the shards hold every matching row, and a range in either dimension needs few of them."""
    rng = random.Random(4)
    data = [(i, "t", f"common beginning of all {rng.randrange(1000):04d}", rng.randrange(1000)) for i in range(4000)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, n long")
    shards = hilbert.hilbert_shards(frame, ["lang", "n"], shards=64)
    box = hilbert.box_of_shards(shards.join(frame, "doc_id"), ["lang", "n"]).collect()
    shard_of = {r.doc_id: r.shard for r in shards.collect()}
    for low in (0, 300, 900):
        ends = f"common beginning of all {low:04d}", f"common beginning of all {low + 50:04d}"
        by_n = {r.shard for r in box if r.min_n <= low + 50 and r.max_n >= low}
        by_lang = {r.shard for r in box if r.min_lang <= ends[1] and r.max_lang >= ends[0]}
        assert {shard_of[r[0]] for r in data if low <= r[3] <= low + 50} <= by_n and {shard_of[r[0]] for r in data if ends[0] <= r[2] <= ends[1]} <= by_lang
        assert max(len(by_n), len(by_lang)) <= 24


def test_archive_gives_back_every_record(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "b" * 70000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1", h, "d") for i, h in enumerate(html)] + [(9, None, "solo", "d"), (None, "u", "solo", "d")], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in archive.archived(pages).collect()}
    last = {h or "": i for i, h in [*enumerate(html), (9, "solo")]}
    for i, h in [*enumerate(html), (9, "solo")]:
        body, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
        assert bytes(r.payload) == body and bytes(r.record).startswith(b"WARC/1.1\r\n") and b"\nEvil" not in bytes(r.header)
    assert got[None].record_type == "revisit" and got[None].refers_to == 9
    archive.write_archive(pages, str(tmp_path / "a"), min_revisit_bytes=1000)
    assert {r.record_type for r in archive.read_records(spark, str(tmp_path / "a")).collect()} == {"response"}
    assert archive.archived(pages.limit(0)).count() == 0


def test_word_cache_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = wordbpe.tokenizer_path()
    whole, own, rng = Tokenizer.from_file(path), wordbpe.WordBpe(path, limit=300), random.Random(3)
    parts = [*"aAbBsSt'’dlver.,!  \n\t-_<|>É é×÷»1٣ΣςK\u0085́İßǅ\x1c\x1f", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "É", ". ", ", ", ").", "###"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(15)))
        assert np.frombuffer(own.ids(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_token_files_hold_all_ids_in_order(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(wordbpe.tokenizer_path())
    for encoding in ("dictionary", "delta"):
        path = str(tmp_path / encoding)
        token_files.write_tokens(docs, path, encoding=encoding, runs=3)
        got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i))
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
            at += r.n_tokens
        assert Counter(tuple(r.ids) for r in got) == Counter((*whole.encode(r.text or "", add_special_tokens=False).ids, 2) for r in docs.collect())
        import glob

        column = [pq.ParquetFile(f).metadata.row_group(0).column(4) for f in sorted(glob.glob(f"{path}/*.parquet")) if pq.ParquetFile(f).metadata.num_rows]
        assert all(c.has_offset_index and c.has_column_index for c in column) and all(("DELTA_BINARY_PACKED" in c.encodings) == (encoding == "delta") for c in column)
    digests = token_files.token_digests(docs).collect()
    assert Counter(r.ids_crc32 for r in digests) == Counter(zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert token_files.token_digests(empty).count() == 0


def naive_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        open_ = [i for i, r in enumerate(bins) if r >= n]
        if open_:
            bins[min(open_, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.randrange(5, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(0, 120))]
        plan, used, seen = packing.best_fit_plan(Counter(lengths), capacity), defaultdict(list), Counter()
        for length in sorted(lengths, reverse=True):
            nth = seen[length]
            seen[length] += 1
            at = max(k for k in range(len(plan["length"])) if plan["length"][k] == length and plan["first"][k] <= nth)
            own = nth - plan["first"][at]
            used[plan["bin"][at] + own // plan["each"][at]].append((plan["offset"][at] + own % plan["each"][at] * length, length))
        for content in used.values():
            end = 0
            for offset, length in sorted(content):
                assert offset == end
                end += length
            assert end <= capacity
        assert len(used) == naive_best_fit(lengths, capacity)


def test_packing_whole_documents(docs, empty):
    from tokenizers import Tokenizer

    whole, capacity = Tokenizer.from_file(wordbpe.tokenizer_path()), 64
    got = packing.best_fit_packing(docs, capacity).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), capacity)):
            want[(r.doc_id, p, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(bins) == naive_best_fit([k[3] for k, n in want.items() for _ in range(n)], capacity)
    assert packing.best_fit_packing(empty).count() == 0


def slow_counts(text):
    w, t = words(text), text or ""
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + d for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for d in range(5)}
    lines = [x for x in t.split("\n") if x.encode().strip()]
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_verdicts(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality_rules.quality_rules(docs, labels).collect():
        if r.doc_id is not None:
            text = next(x.text for x in docs.collect() if x.doc_id == r.doc_id)
            n, chars, signs, lines, again = slow_counts(text)
            failed = n < 10 or 100 * again > 20 * n
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.anomaly) == (n, chars, signs, lines, again, failed, not failed, None)
    assert quality_rules.quality_rules(empty, labels).count() == 0 and quality_rules.keep_good(empty, labels).count() == 0


def test_quality_forest_tells_junk_from_prose(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    found = quality_rules.quality_rules(docs, train).join(held, "doc_id").collect()
    good, bad = [r for r in found if r.quality == 1], [r for r in found if r.quality == 0]
    assert sum(r.kept or r.n_words < 10 for r in good) >= 0.97 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}


def test_quality_keeps_a_clean_text_of_any_length(spark, sf):
    """Different good texts joined: common words come again, and the share of distinct words of the whole text falls."""
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id").where("text is not null").select("text").distinct().orderBy("text")
    clean = "\n".join(r.text for r in good.collect())
    assert len(clean.split()) > 300_000
    junk = " ".join(random.Random(1).choices("buy now cheap best offer click here free win cash".split(), k=100_000))
    long = spark.createDataFrame([(1, clean), (2, junk)], "doc_id long, text string")
    model = quality_rules.fit_rules(docs, labels)
    (counts, ratios), (_, bad) = (quality_rules.statistics(r.text) for r in long.orderBy("doc_id").collect())
    assert 100 * counts[4] <= 20 * counts[0]
    assert model.score(np.array([ratios]))[0] <= model.limit < model.score(np.array([bad]))[0]
    words = [b"%d" % (i % 150) for i in range(1000)]
    assert [quality_rules.distinct_share(words[:n]) for n in (0, 1, 100, 150, 1000)] == [0, 1, 1, 1, 1] and quality_rules.distinct_share(words[:150] + [b"x"] * 10, 100) == 191 / 200


def test_isolation_forest_scores_outliers_higher():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(400, 3)), [[9, 9, 9], [-8, 7, 9]]])
    score = isolation.IsolationForest(100, 128).fit(x).score(x)
    assert score[-2:].min() > np.quantile(score[:-2], 0.99)


def sets_of(data, width=5):
    out = []
    for i, t in data:
        w = words(t)
        k = min(width, len(w))
        out.append((i, frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if w else frozenset()))
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_ngram_join_against_all_pairs(docs, block):
    got = Counter((r.doc_id, r.class_id, r.group_id, r.n_links) for r in ngram_join.ngram_join(docs, block=block).collect())
    data = sets_of([(r.doc_id, r.text) for r in docs.collect()])
    link = [[k != m and a and b and i is not None and j is not None and len(a & b) >= 0.8 * len(a | b) for m, (j, b) in enumerate(data)] for k, (i, a) in enumerate(data)]
    group = list(range(len(data)))
    for _ in data:
        group = [min([group[k], *(group[m] for m, x in enumerate(link[k]) if x)]) for k in range(len(data))]
    want = Counter()
    for k, (i, s) in enumerate(data):
        if i is None:
            want[(None, None, None, 0)] += 1
        else:
            same = min([j for j, t in data if s and t == s and j is not None], default=i)
            want[(i, same, min(data[m][0] for m in range(len(data)) if group[m] == group[k] and data[m][0] is not None), sum(map(bool, link[k])))] += 1
    assert got == want and any(k[3] for k in want)


def test_ngram_join_on_nothing(empty):
    assert ngram_join.ngram_join(empty).count() == 0 and ngram_join.keep_one_of_group(empty).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = ngram_join.least_matches(112, 0.8, 1e-6)
    assert 50 < least < 90 and [ngram_join.least_matches(n, 0.8, 1e-6) for n in (16, 64, 112)] == sorted(ngram_join.least_matches(n, 0.8, 1e-6) for n in (16, 64, 112))
    rng = np.random.default_rng(4)
    sigs = rng.integers(0, 256, (40, 112)).astype("u1")
    sigs[1] = sigs[0]
    p = ngram_join.Pruner(112, 0.8, 1e-6)
    assert p.block(sigs, sigs)[0, 1] and p.block(sigs, sigs).sum() == 42 and list(p.pairs(np.array([0, 0]), np.array([1, 2]), sigs)) == [0]


@pytest.mark.parametrize("window,seed", [(35, 8), (6, 3), (4, 3)])
def test_substring_dedup_against_all_windows(docs, window, seed):
    data = [(r.doc_id, words(r.text)) for r in docs.collect()]
    seen = Counter(tuple(w[q : q + window]) for _, w in data for q in range(len(w) - window + 1))
    want = Counter()
    for i, w in data:
        gone = {q + d for q in range(len(w) - window + 1) if seen[tuple(w[q : q + window])] > 1 for d in range(window)}
        want[(i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())] += 1
    assert Counter(tuple(r) for r in substring_dedup.substring_dedup(docs, window=window, seed=seed).collect()) == want
    assert any(k[2] for k in want)


def test_without_repeats_keeps_columns_and_nulls(docs, empty):
    got = substring_dedup.without_repeats(docs)
    assert got.schema.names == docs.schema.names and got.count() == docs.count()
    found = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    for r in docs.collect():
        if r.doc_id is not None:
            assert (found[r.doc_id].text is None) == (r.text is None) and found[r.doc_id].n_words == 3 and found[r.doc_id]._c0 == "c"
    assert substring_dedup.without_repeats(empty).count() == 0 and substring_dedup.substring_dedup(empty).count() == 0


def test_line_dedup_against_all_pairs(docs, empty):
    data = [(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None]
    frame = docs.where("doc_id is not null")
    lines = sorted({(i, k, tuple(x.encode().split())) for i, t in data for k, x in enumerate(t.split("\n")) if x.encode().split()}, key=lambda x: x[:2])
    kept = defaultdict(list)
    late = 0
    for at, (i, k, w) in enumerate(lines):
        if any(v == w for _, _, v in lines[:at]):
            continue
        if len(w) >= 8 and any(len(v) >= 8 and abs(len(v) - len(w)) <= 1 and line_dedup.within_one_edit(list(v), list(w)) for _, _, v in lines[:at]):
            late += 1
            continue
        kept[i].append(k)
    got = line_dedup.line_dedup(frame).collect()
    assert late and {r.doc_id: r.kept for r in got} == {i: kept[i] for i, _ in data}
    count = {i: sum(bool(x.encode().split()) for x in t.split("\n")) for i, t in data}
    assert all(r.n_lines == count[r.doc_id] and r.n_kept == len(r.kept) for r in got)
    assert line_dedup.line_dedup(empty).count() == 0 and line_dedup.line_dedup(docs).count() == docs.count()
    cut = {r.doc_id: r.text for r in line_dedup.without_lines(frame).collect()}
    assert all(cut[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if not x.encode().split() or k in kept[i]) for i, t in data if t)


def test_within_one_edit_by_trying_all_edits():
    for a in itertools.product("ab", repeat=3):
        for n in (1, 2, 3, 4, 5):
            for b in itertools.product("abc", repeat=n):
                edits = {a} | {a[:i] + (c,) + a[i + 1 :] for i in range(3) for c in "abc"} | {a[:i] + a[i + 1 :] for i in range(3)} | {a[:i] + (c,) + a[i:] for i in range(4) for c in "abc"}
                assert line_dedup.within_one_edit(list(a), list(b)) == (b in edits)


def plain_viterbi(model, text):
    best = [0.0] + [-np.inf] * len(text)
    for at in range(len(text)):
        single = False
        for to in range(at + 1, min(at + model.longest, len(text)) + 1):
            s = model.scores.get(text[at:to])
            if s is not None:
                single |= to == at + 1
                best[to] = max(best[to], best[at] + s)
        if not single:
            best[at + 1] = max(best[at + 1], best[at] + model.penalty)
    return best[-1]


def score_of(model, ids):
    """Byte ids count as one character that no piece covers."""
    total, held = 0.0, b""
    for i in ids:
        if model.bytes.get((model.raw[i] or b"\0")[0]) == i and len(model.raw[i]) == 1:
            held += model.raw[i]
            try:
                held.decode()
                total, held = total + model.penalty, b""
            except UnicodeDecodeError:
                pass
        else:
            total += model.scores[model.raw[i].decode()]
    return total


def test_codec_finds_best_paths_and_reads_back(spark, docs, texts, empty):
    own = pieces_codec.Codec(pieces_codec.model_path(), limit=500)
    rng = random.Random(8)
    for t in [*(t for t in texts if t and len(t) < 3000), *("".join(rng.choice("abc é梦\U0001f600,.  \n") for _ in range(30)) for _ in range(200))]:
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert own.decode(ids) == t
        assert abs(score_of(own.model, ids) - plain_viterbi(own.model, "▁" + t.replace(" ", "▁"))) < 1e-6
        stream, got = pieces_codec.StreamingViterbi(own.model), []
        sign = "▁" + t.replace(" ", "▁")
        for a in range(0, len(sign), 37):
            got += stream.feed(sign[a : a + 37], a + 37 >= len(sign))
            assert stream.window <= 9 * own.model.longest + 37 + 200
        assert abs(score_of(own.model, got) - score_of(own.model, ids)) < 1e-6
    assert all(r.round_trip for r in pieces_codec.piece_digests(docs).collect())
    back = pieces_codec.decode_pieces(pieces_codec.encode_pieces(docs))
    assert Counter(tuple(r) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert pieces_codec.piece_digests(empty).count() == 0


def test_codec_is_as_good_as_the_library_with_the_same_scores():
    """The public file says BPE; with its type set to unigram, the library searches for best paths too."""
    import sentencepiece

    raw = bytearray(open(pieces_codec.model_path(), "rb").read())

    def varint(i):
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if raw[i - 1] < 128:
                return value, i

    def fields(i, end):
        while i < end:
            tag, i = varint(i)
            if tag & 7 == 2:
                n, i = varint(i)
                yield tag >> 3, i, i + n
                i += n
            else:
                start = i
                i = varint(i)[1] if tag & 7 == 0 else i + (4 if tag & 7 == 5 else 8)
                yield tag >> 3, start, i

    trainer = next((a, b) for n, a, b in fields(0, len(raw)) if n == 2)
    raw[next(a for n, a, _ in fields(*trainer) if n == 3)] = 1
    library, own, rng = sentencepiece.SentencePieceProcessor(model_proto=bytes(raw)), pieces_codec.Codec(pieces_codec.model_path()), random.Random(6)
    same = 0
    for _ in range(400):
        t = "".join(rng.choice("theandingou éß., \n12梦") for _ in range(25))
        mine, theirs = np.frombuffer(own.encode(t), "<u4").tolist(), library.encode(t)
        assert score_of(own.model, mine) >= score_of(own.model, theirs) - 1e-3
        same += mine == theirs
    assert same > 200


def test_codec_of_a_bpe_file_gives_the_ids_of_the_library(spark, docs, texts):
    """The public file as it is: merge order, in words, in long stretches without a border and in small blocks."""
    import sentencepiece

    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=pieces_codec.model_path()), pieces_codec.codec(pieces_codec.model_path()), random.Random(9)
    assert pieces_codec.model_path().endswith("piece_bpe_32k.model")
    small = type(own)(pieces_codec.model_path(), limit=100, block=50)
    plain = ["Und ein Haus, the thing and l'été", "a" * 20_000, "".join(rng.choice("etaoin") for _ in range(5000)), " " * 3000, "=-" * 1000 + "theing" * 1000, "\x00\t \ra", "▁ x"]
    mixed = ["".join(rng.choice(a) for _ in range(rng.choice((1, 3, 25, 400)))) for a in ("abc é梦\U0001f600,.  \n", "theandingou éß., \n12梦", "aaab", "= -_") for _ in range(100)]
    for t in [*plain, *mixed, *(t for t in texts if t)]:
        want = library.encode(t)
        for c in (own, small):
            assert np.frombuffer(c.encode(t), "<u4").tolist() == want
    got = pieces_codec.encode_pieces(docs.where("text is not null")).collect()
    want = Counter((r.doc_id, *library.encode(r.text)) for r in docs.where("text is not null").collect())
    assert Counter((r.doc_id, *r.ids) for r in got) == want
    text = "".join(rng.choice("etaoin") for _ in range(6000))
    stream = own.search(own.model)
    for a in range(0, len(text), 37):
        stream.feed(text[a : a + 37], a + 37 >= len(text))
        assert stream.window <= 9 * own.model.longest + 37 + 200


def test_codec_keeps_best_paths_for_unigram_files(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(open(pieces_codec.model_path(), "rb").read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    (tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    own = pieces_codec.codec(str(tmp_path / "unigram.model"))
    assert type(own) is pieces_codec.Codec and own.encode("Und ein Haus") == pieces_codec.Codec(pieces_codec.model_path()).encode("Und ein Haus")
    proto.trainer_spec.model_type = proto.trainer_spec.BPE
    for piece in proto.pieces[400:404]:  # pieces of the user are cut out before anything is merged
        piece.type = piece.USER_DEFINED
    (tmp_path / "user.model").write_bytes(proto.SerializeToString())
    own, library, rng = pieces_codec.codec(str(tmp_path / "user.model")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "user.model")), random.Random(2)
    parts = [*own.model.defined, "the", " ", "and", "é", "梦"]
    for _ in range(300):
        t = "".join(rng.choice(parts) for _ in range(20)).replace("▁", " ")
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t)


def test_pipeline_stages_against_brute_force(spark, sf):
    import corpus_pipeline as pipeline

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram join", "substring dedup", "best-fit packing"]
    stage = [f for _, f in pipeline.STAGES]
    good = stage[0](spark, docs, sf).cache()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    once = stage[1](spark, good, sf).cache()
    first = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(first.values())
    far = stage[2](spark, once, sf).cache()
    data = sets_of(sorted((r.doc_id, r.text) for r in once.collect()))
    group = {i: i for i, _ in data}
    for _ in range(4):
        for (i, a), (j, b) in itertools.combinations(data, 2):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                group[i] = group[j] = min(group[i], group[j])
    assert sorted(r.doc_id for r in far.collect()) == sorted(i for i in group if group[i] == i)
    cut = stage[3](spark, far, sf).cache()
    assert good.columns == once.columns == far.columns == cut.columns == docs.columns
    kept = {r.doc_id: r.n_words - r.n_removed for r in substring_dedup.substring_dedup(far).collect()}
    assert {r.doc_id: len(words(r.text)) for r in cut.collect()} == kept
    packed = stage[4](spark, cut, sf)
    assert {r.doc_id for r in packed.collect()} == set(kept)
    assert pipeline.run(spark, sf).count() == packed.count()


def test_keep_first_holds_rows_of_any_names_and_white_space(spark):
    rows = [(1, "a  b\n", "x", 1), (2, "a b ", "y", 2), (None, "a b ", "z", 3), (3, None, "n", 4), (4, "", "m", 5), (5, " \n", "w", 6), (6, " ", "v", 7), (None, "q", "u", 8), (None, "q", "u", 8), (7, "\tx y\n\nz", "t", 9), (8, "é  ü", "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _dedup_digest string, row int")
    got = exact_dedup.keep_first(frame)
    assert got.columns == frame.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[5], rows[7], rows[9], rows[10]], key=str)


@pytest.mark.parametrize("ids", [[None] * 2000, [5] * 2000])
def test_many_copies_under_one_key_are_told_once(spark, ids):
    text = prose(random.Random(1), 400, 900)
    frame = spark.createDataFrame([(i, text, 1, "k") for i in ids] + [(9, "short", 2, "l"), (10, None, 3, "m")], "doc_id long, text string, _did int, _th string")
    began = time.perf_counter()
    assert {(r.n_words, r.n_removed, r["count"]) for r in substring_dedup.substring_dedup(frame).groupBy("n_words", "n_removed").count().collect()} == {(400, 400, 2000), (1, 0, 1), (0, 0, 1)}
    assert time.perf_counter() - began < 40
    left = substring_dedup.without_repeats(frame.where("doc_id > 5 or doc_id is null").limit(5))
    assert left.columns == frame.columns and left.where("text is null").count() <= 1
