"""Substring deduplication by counts of content-cut phrases and of the windows around their ends, in place of a greedy relative parse.

Every document falls into phrases at places that its words alone decide: the windows of `window` words whose smallest seed (a run of
`seed` words) is the same one form a phrase. Equal passages therefore have equal phrases inside, wherever they stand.

Nothing walks a document from left to right, extends a match or chains factors. Whole phrases are counted by hash; of the other phrases
that share their seed with one elsewhere, single windows are counted by hash. A window counts as repeated exactly when its words start
anywhere else too, so the spans are those of a comparison of all windows, at a fraction of the rows.

Hot passages: counts are combined by the map tasks, and joins on hot seeds or windows have a written table of unique keys on their other
side, so Spark splits them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_or_empty, written

_K1, _K2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MIX = np.uint64(0xFF51AFD7ED558CCD)
PHRASES = "did long, th int, at long, seed long, phrase long"
WINDOWS = "did long, th int, q int, w1 long, w2 int, weight int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of k and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get(k)
    if have is None or len(have[0]) < n:
        n = max(2 * n, 1 << 12)
        one = lambda base: np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n - 1, base, "u8")]), dtype="u8")
        have = _powers[k] = (one(k), one(pow(k, -1, 1 << 64)))
    return have


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any runs of a text's words, from sums of word hashes times powers."""

    def __init__(self, words: list[bytes], k: int = _K1):
        from xxhash import xxh3_64_intdigest

        n = len(words)
        h = np.fromiter(map(xxh3_64_intdigest, words), "u8", n)
        power, self.inverse = _power(k, n + 1)
        self.sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(h * power[:n], dtype="u8")])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def phrases(words: list[bytes], window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, seed hash and content hash of each phrase of a text."""
    n, w = len(words) - window + 1, window - seed + 1
    if n < 1:
        return (np.empty(0, "i8"),) * 2 + (np.empty(0, "u8"),) * 2
    rolling = Rolling(words)
    at = np.arange(len(words) - seed + 1)
    code = rolling.of(at, at + seed)
    least = np.arange(n) + np.concatenate([np.lib.stride_tricks.sliding_window_view(code[a : a + 4096 + w - 1], w).argmin(1) for a in range(0, n, 4096)])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return first, last, code[least[first]], rolling.of(first, last + window)


def _phrase_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends, parts = [], []
            for data in batch.column(2).cast(pa.binary()).to_pylist():
                first, last, code, content = phrases(data.split(), window, seed)
                ends.append(len(first))
                parts.append((first * 64 + (last - first), code.view("i8"), content.view("i8")))
            row = pa.array(np.repeat(np.arange(len(ends)), ends))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(np.concatenate([p[i] for p in parts] or [np.empty(0, "i8")]), pa.int64()) for i in range(3))], ["did", "th", "at", "seed", "phrase"])

    return run


def _window_rows(window: int):
    """(did, th, text, edges) -> the windows of the phrases at factor boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, qs, ones, twos, weights = [], [], [], [], []
            for data, edges in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words, e = data.split(), np.array(edges, "i8")
                weight, start, more = e & 3, e >> 8, (e >> 2) & 63
                q = np.repeat(start, more + 1) + np.concatenate([np.arange(m + 1) for m in more])
                sizes.append(len(q))
                qs.append(q)
                ones.append(Rolling(words).of(q, q + window).view("i8"))
                twos.append((Rolling(words, _K2).of(q, q + window) >> np.uint64(32)).astype("u4").view("i4"))
                weights.append(np.repeat(weight, more + 1))
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            flat = lambda x, kind: pa.array(np.concatenate(x or [np.empty(0, "i8")]).astype(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), flat(qs, "i4"), flat(ones, "i8"), flat(twos, "i4"), flat(weights, "i4")], [x.split()[0] for x in WINDOWS.split(", ")])

    return run


def uncovered(words: list[bytes], windows: np.ndarray, window: int) -> list[bytes]:
    """The words outside the given windows."""
    if not len(windows):
        return words
    step = np.zeros(len(words) + 1, "i4")
    np.add.at(step, windows, 1)
    np.add.at(step, windows + window, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def _all_windows(whole: list[int] | None, single: list[int] | None = None) -> np.ndarray:
    w = np.array(whole or [], "i8")
    more = w & 63
    spread = np.repeat(w >> 6, more + 1) + np.concatenate([np.arange(m + 1) for m in more] or [np.empty(0, "i8")])
    return np.concatenate([spread, np.array(single or [], "i8")])


def _cleaned(data: bytes, whole: list[int] | None, single: list[int] | None, window: int) -> tuple[int, int, str, bytes]:
    """Words, removed words, digest of the kept ones, and the kept text: as it is where nothing goes, else its words joined by one space."""
    words = data.split()
    kept = uncovered(words, _all_windows(whole, single), window)
    text = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text if len(kept) < len(words) else data


def _columns(rows: list[tuple], with_text: bool) -> list[pa.Array]:
    n, gone, sha, text = zip(*rows, strict=True) if rows else ((),) * 4
    return [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), *([pa.array(text, pa.binary()).cast(pa.string())] if with_text else [])]


def _parse(window: int, with_text: bool, names: list[str]):
    """(doc_id, text, whole, edges, ...) -> results of the texts without boundaries to check; the others keep their text for that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for data, whole, edges in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).is_valid().to_pylist(), strict=True):
                rows.append((None,) * 4 if edges else _cleaned(data, whole, None, window))
                texts.append(data if edges else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows, with_text), pa.array(texts, pa.binary()).cast(pa.string()), *batch.columns[2:]], names)

    return run


def _finish(window: int, with_text: bool, names: list[str]):
    """(doc_id, text, whole, single, ...) -> results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_cleaned(*row, window) for row in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows, with_text), *batch.columns[4:]], names)

    return run


def _key(doc_id: str, text: str) -> list[Column]:
    """A row is known by its id (or, without one, its text's hash) and a second hash of its text; equal rows share a key and a result."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text)).alias("did"), F.hash(text).alias("th")]


def substring_dedup(docs: DataFrame, window: int = 35, seed: int = 8, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, carry: list[Column] | None = None) -> DataFrame:
    """Removes every word inside a window of `window` words whose sequence also starts anywhere else, in this document or another.

    Returns doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space), one row per row; `with_text` adds
    kept_text (an untouched text stays as it is), and the columns in `carry` pass through as _c0, _c1 and so on.

    Defined results: null and empty texts have no words; a text shorter than a window keeps all; rows without an id are rows like
    others; repeated rows are copies of each other, so all of their windows repeat; an empty table gives an empty result; other columns
    are ignored.
    """
    if not 1 <= window - seed < 64:
        raise ValueError("a window holds its seed, and at most 64 places for it")
    key = _key(doc_id, text)
    own = docs.select(*key, text_or_empty(text).alias("text"))
    found = written(own.mapInArrow(_phrase_rows(window, seed), PHRASES), "phrases")
    seeds = written(found.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("seed"), "seeds")
    shared = written(found.join(seeds, "seed"), "shared")
    reference = written(shared.groupBy("seed", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "th", "at")).alias("first")), "reference")
    whole = shared.join(reference.where("n > 1").select("seed", "phrase"), ["seed", "phrase"]).groupBy("did", "th").agg(F.collect_set("at").alias("whole"))  # a set: copies of a row share its key and its places
    several = reference.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("seed").alias("_seed"))
    edge = reference.join(several, F.col("seed") == F.col("_seed")).select("first.*", F.least("n", F.lit(2)).alias("weight"))
    edges = edge.groupBy("did", "th").agg(F.collect_list(F.col("at") * 4 + F.col("weight")).alias("edges"))  # both lists end with the document
    known = whole.join(edges, ["did", "th"], "full")

    carried = list(carry or [])
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), *key, *(c.alias(f"_c{i}") for i, c in enumerate(carried)))
    names = [f"_c{i}" for i in range(len(carried))]
    result = RESULT + (", kept_text string" if with_text else "")
    extra = "".join(f", {n} {texts.schema[n].dataType.simpleString()}" for n in names)
    columns = [x.split()[0] for x in result.split(", ")]
    joined = texts.join(known, ["did", "th"], "left").select("doc_id", "text", "whole", "edges", "did", "th", *names)
    kept = [*columns, "text", "whole", "edges", "did", "th", *names]
    parsed = written(joined.mapInArrow(_parse(window, with_text, kept), f"{result}, text string, whole array<long>, edges array<long>, did long, th int{extra}"), "parsed")
    open_ = parsed.where("edges is not null")
    windows = open_.select("did", "th", "text", "edges").mapInArrow(_window_rows(window), WINDOWS)
    twice = written(windows.groupBy("w1", "w2").agg(F.sum("weight").alias("_n")).where("_n > 1").select("w1", "w2"), "windows")
    single = windows.join(twice, ["w1", "w2"]).groupBy("did", "th").agg(F.collect_set("q").alias("single"))
    checked = open_.join(single, ["did", "th"], "left").select("doc_id", "text", "whole", "single", *names).mapInArrow(_finish(window, with_text, [*columns, *names]), result + extra)
    return parsed.where("edges is null").select(*columns, *names).union(checked)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the repeated passages taken out of their texts, all other columns as they are, and n_chars, where there is one, counted anew.

    Texts of which nothing is left stay as empty texts; null and empty texts stay as they are; repeated rows, with or without an id, are
    copies of each other and all stay; an empty table gives an empty result; column names of any kind are kept.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = substring_dedup(docs, with_text=True, carry=[*(F.col(f"`{c}`") for c in others), F.col("text").isNull()], **options)
    text = F.when(~F.col(f"_c{len(others)}"), F.col("kept_text"))
    new = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"_c{i}") for i, c in enumerate(others)}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(new["n_chars"])
    return found.select(*(new[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
