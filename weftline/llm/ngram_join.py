"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Documents with one set of shingles form a class; only classes are compared. Classes that share a band of their MinHash values meet in a
bucket. There their values are compared a few at a time, and a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold falls below a tolerance. What remains is gathered into candidate components, and inside those every pair that
survives the same pruning is verified on its whole sets.

No step writes all pairs of a group: buckets and components pass on one link per member, pairs live as bits inside a block of bounded
size, and only the number of links of each class comes out. Buckets and components above the block size are split into blocks that
meet in pairs, so no task holds a hot group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import task_count, text_or_empty, written
from weftline.llm.grouping import components

_M = np.uint64(0x9DDFEA08EB382D69)
SKETCH = "doc_id long, text_hash long, key binary, n_shingles long, sig binary, bands array<long>"
LINKS = "a binary, b binary"


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; a shorter text is one run, a text without words has none."""
    from xxhash import xxh3_64_intdigest

    words = data.split()
    if not words:
        return np.empty(0, "u8")
    h = np.fromiter(map(xxh3_64_intdigest, words), "u8", len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    code = np.full(n, width, "u8")
    for i in range(width):
        code = (code ^ h[i : n + i]) * _M
        code ^= code >> np.uint64(29)
    return np.unique(code)


def set_key(shingles: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(shingles.tobytes())


class MinHash:
    """`bands` x `rows` multiply-shift functions; a signature keeps one byte of each value, band keys are made of whole values."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, n = bands, rows, bands * rows
        self.a, self.b = rng.integers(1, 1 << 63, n, dtype="u8") * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype="u8")

    def values(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo("u8").max, "u8")
        for at in range(0, len(shingles), 1024):
            part = np.multiply.outer(shingles[at : at + 1024], self.a)
            part += self.b
            np.minimum(least, part.min(0), out=least)
        return least

    def signature(self, values: np.ndarray) -> bytes:
        return (values * _M >> np.uint64(56)).astype("u1").tobytes()

    def band_keys(self, values: np.ndarray) -> np.ndarray:
        v = values.reshape(self.bands, self.rows)
        code = np.arange(1, self.bands + 1, dtype="u8")
        for i in range(self.rows):
            code = (code ^ v[:, i]) * _M
            code ^= code >> np.uint64(29)
        return code.view("i8")


def least_matches(n: int, threshold: float, tolerance: float, grid: int = 4000) -> int:
    """The smallest number of matches among n values with P(similarity >= threshold | matches) >= tolerance.

    Prior: every similarity is equally likely; one byte matches with probability s + (1 - s) / 256.
    """
    s = (np.arange(grid) + 0.5) / grid
    p = s + (1 - s) / 256
    for m in range(n + 1):
        log = lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(p) + (n - m) * np.log1p(-p)
        w = np.exp(log - log.max())
        if w[s >= threshold].sum() / w.sum() >= tolerance:
            return m
    return n


class Pruner:
    """Compares signatures step by step."""

    def __init__(self, length: int, threshold: float, tolerance: float, step: int = 16):
        ends = [*range(step, length, step), length]
        self.steps = [(a, b, least_matches(b, threshold, tolerance)) for a, b in zip([0, *ends], ends, strict=False)]

    def pairs(self, x: np.ndarray, y: np.ndarray, sigs: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows (x[i], y[i]) survive, as indices into x."""
        alive, matches = np.arange(len(x)), np.zeros(len(x), "i4")
        for a, b, least in self.steps:
            matches = matches + (sigs[x[alive], a:b] == sigs[y[alive], a:b]).sum(1)
            stay = matches >= least
            alive, matches = alive[stay], matches[stay]
        return alive

    def block(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Boolean matrix of the surviving pairs between two blocks."""
        matches = np.zeros((len(left), len(right)), "u1" if self.steps[-1][1] < 256 else "u2")
        for a, b, least in self.steps:
            for k in range(a, b):
                matches += left[:, k, None] == right[None, :, k]
            matches[matches < least] = 0
            if not matches.any():
                break
        return matches >= self.steps[-1][2]


def spread_labels(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest label of each component under the links (x, y)."""
    while True:
        before = labels.copy()
        np.minimum.at(labels, x, labels[y])
        np.minimum.at(labels, y, labels[x])
        labels = labels[labels]
        if (labels == before).all():
            return labels


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Regroups a stream that is sorted by its first `width` columns into tables of whole groups; a group spans tables only as it does in one."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        first = tuple(batch.column(i)[0].as_py() for i in range(width))
        end = tuple(batch.column(i)[-1].as_py() for i in range(width))
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        if end == first and (not held or last == first):
            held.append(batch)
        else:
            same = np.logical_and.reduce([np.asarray(batch.column(i)) == end[i] for i in range(width)])
            cut = int(np.argmax(same))
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        last = end
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, width: int) -> np.ndarray:
    """Starts of the groups and the end."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for i in range(width):
        c = np.asarray(table.column(i))
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """A column of binary values of one length as a matrix."""
    values = column.combine_chunks().to_pylist() if column.num_chunks != 1 else column.chunk(0).to_pylist()
    return np.frombuffer(b"".join(values), "u1").reshape(len(values), -1)


def in_blocks(df: DataFrame, group: str, size: str, member: str, block: int) -> DataFrame:
    """Adds _i, _j and _side: groups of up to `block` rows stay whole, larger ones are dealt into parts, and each pair of parts meets once."""
    parts = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    own = F.pmod(F.xxhash64(member, group), parts.cast("long")).cast("int")
    rows = df.withColumn("_part", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumn("_i", F.least("_part", "_other")).withColumn("_j", F.greatest("_part", "_other")).withColumn("_side", (F.col("_part") != F.col("_i")).cast("int"))


def _bucket_links(pruner: Pruner) -> Callable:
    """Sorted (group, _i, _j, _side, key, sig) -> one link per member that a surviving pair ties to another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            keys, sigs, side = table.column(4).combine_chunks(), _bytes(table.column(5)), np.asarray(table.column(3))
            i, j = np.asarray(table.column(1)), np.asarray(table.column(2))
            bounds = _bounds(table, 3)
            size = np.diff(bounds)
            labels = np.arange(table.num_rows)
            group = np.repeat(np.arange(len(size)), size)
            small = size[group] <= 64
            x, y = [], []
            for lag in range(1, int(min(size.max(initial=1), 64))):
                at = np.flatnonzero(small[:-lag] & (group[:-lag] == group[lag:]) & ((i == j)[:-lag] | (side[:-lag] != side[lag:])))
                x.append(at)
                y.append(at + lag)
            if x:
                x, y = np.concatenate(x), np.concatenate(y)
                for at in range(0, len(x), 1 << 18):
                    a, b = x[at : at + (1 << 18)], y[at : at + (1 << 18)]
                    alive = pruner.pairs(a, b, sigs)
                    labels = spread_labels(labels, a[alive], b[alive])
            for g in np.flatnonzero(size > 64):
                rows = np.arange(bounds[g], bounds[g + 1])
                left, right = (rows, rows) if i[rows[0]] == j[rows[0]] else (rows[side[rows] == 0], rows[side[rows] == 1])
                a, b = np.nonzero(pruner.block(sigs[left], sigs[right]))
                labels = spread_labels(labels, left[a], right[b])
            tied = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(tied)), keys.take(pa.array(labels[tied]))], ["a", "b"])

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of their incidence matrices over a few columns at a time."""
    flat = np.concatenate([*left, *right])
    column = np.unique(flat, return_inverse=True)[1].ravel()
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(left), len(right)), "f4")
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
        a, b = np.searchsorted(column, [at, at + chunk])
        m = np.zeros((len(left) + len(right), chunk), "f4")
        m[row[a:b], column[a:b] - at] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _verified(pruner: Pruner, width: int, threshold: float) -> Callable:
    """Sorted (group, _i, _j, _side, key, sig, size, text) -> (a, b, links): links of a to the group's block, b a member of its part of the component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            bounds = _bounds(table, 3)
            out_a, out_b, out_n = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                part = table.slice(lo, hi - lo)
                keys, rows, sets = part.column(4).to_pylist(), [], []
                texts = part.column(7).cast(pa.binary())
                for r, key in enumerate(keys):
                    if rows and keys[rows[-1]] == key:
                        continue  # a repeated row
                    s = shingle_set(texts[r].as_py(), width)
                    if set_key(s) == key:  # else another text under the same id
                        rows.append(r)
                        sets.append(s)
                if len(rows) < 2:
                    continue
                rows = np.array(rows)
                sigs, side, weight = _bytes(part.column(5))[rows], np.asarray(part.column(3))[rows], np.asarray(part.column(6))[rows]
                one = part.column(1)[0].as_py() == part.column(2)[0].as_py()
                left, right = (np.arange(len(rows)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
                a, b = np.nonzero(np.triu(pruner.block(sigs, sigs), 1) if one else pruner.block(sigs[left], sigs[right]))
                a, b = left[a], right[b]
                if not len(a):
                    continue
                size = np.array([len(s) for s in sets])
                if len(a) > 8 * len(rows):
                    both = _common([sets[k] for k in left], [sets[k] for k in right])[np.searchsorted(left, a), np.searchsorted(right, b)]
                else:
                    both = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(a, b, strict=True)])
                true = both >= threshold * (size[a] + size[b] - both) - 1e-9
                a, b = a[true], b[true]
                n = np.bincount(a, weight[b], len(rows)) + np.bincount(b, weight[a], len(rows))
                labels = spread_labels(np.arange(len(rows)), a, b)
                for r in np.flatnonzero(n):
                    out_a.append(keys[rows[r]])
                    out_b.append(keys[rows[labels[r]]])
                    out_n.append(int(n[r]))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary()), pa.array(out_n, pa.int64())], ["a", "b", "links"])

    return run


def _sketch(minhash: MinHash, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sigs, bands = [], [], [], []
            for data in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingle_set(data, width)
                v = minhash.values(s) if len(s) else None
                keys.append(None if v is None else set_key(s))
                sizes.append(len(s))
                sigs.append(None if v is None else minhash.signature(v))
                bands.append(None if v is None else minhash.band_keys(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], [x.split()[0] for x in SKETCH.split(", ")])

    return run


def ngram_join(docs: DataFrame, width: int = 5, threshold: float = 0.8, bands: int = 28, rows: int = 4, tolerance: float = 1e-6, block: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, group_id, n_links, n_shingles and text_hash.

    class_id is the smallest id among documents with the same set of shingles; group_id the smallest id of the near-duplicate group
    (connected through similarities of at least `threshold`); n_links the number of other documents at that similarity, copies
    included. A pair at similarity s is missed by the buckets with probability (1 - s**rows)**bands, 4e-7 at 0.8, and by the pruning
    with about the tolerance; every reported link is exact.

    Defined results: a null or empty text has no shingles, its class and group are itself and it has no links; a text of fewer than
    `width` words is one shingle; rows without an id are not compared (null class and group, no links); repeated rows count as
    documents; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    minhash, pruner = MinHash(bands, rows), Pruner(bands * rows, threshold, tolerance)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text_or_empty(text).alias("text"))
    sketch = written(source.mapInArrow(_sketch(minhash, width), SKETCH), "sketch")
    classes = written(sketch.where("key is not null and doc_id is not null").groupBy("key").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")), "classes")

    # buckets with two classes or more, as (bucket, key); signatures join afterwards
    entries = classes.select("key", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = entries.join(shared, "bucket").join(classes.select("key", "sig"), "key")
    dealt = in_blocks(met, "bucket", "members", "key", block).repartition(task_count(spark), "bucket", "_i", "_j")
    likely = dealt.select("bucket", "_i", "_j", "_side", "key", "sig").sortWithinPartitions("bucket", "_i", "_j", "key").mapInArrow(_bucket_links(pruner), LINKS)
    near = components(likely.distinct())

    # candidate components, each text once for every block of its component
    sizes = near.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    members = near.join(sizes, "label").join(classes.select(F.col("key").alias("node"), "class_id", "size", "sig"), "node")
    texts = source.join(members, source.doc_id == members.class_id).select("label", "members", F.col("node").alias("key"), "sig", "size", "text")
    blocks = in_blocks(texts, "label", "members", "key", block).repartition(task_count(spark), "label", "_i", "_j")
    checked = written(blocks.select("label", "_i", "_j", "_side", "key", "sig", "size", "text").sortWithinPartitions("label", "_i", "_j", "key").mapInArrow(_verified(pruner, width, threshold), "a binary, b binary, links long"), "verified")
    links = checked.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    groups = components(checked.where("a <> b").select("a", "b"))
    first = groups.join(classes.select(F.col("key").alias("node"), "class_id"), "node").groupBy("label").agg(F.min("class_id").alias("group_id"))
    info = classes.select("key", "class_id", "size").join(links, "key", "left").join(groups.withColumnRenamed("node", "key").join(first, "label").drop("label"), "key", "left")

    found = sketch.join(info, "key", "left")
    has_id = F.col("doc_id").isNotNull()
    return found.select(
        "doc_id", F.when(has_id, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(has_id, F.coalesce("group_id", "class_id", "doc_id")).alias("group_id"),
        F.when(has_id, F.coalesce(F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))).otherwise(0).cast("long").alias("n_links"), "n_shingles", "text_hash")


def keep_one_of_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with one document of each near-duplicate group, the one with the smallest id; texts without words and rows without an id stay."""
    found = ngram_join(docs, doc_id=doc_id, text=text, **options)
    gone = found.where("doc_id <> group_id").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_hash")).distinct()
    return docs.join(gone, (F.col(doc_id) == F.col("_gone")) & (F.xxhash64(text) == F.col("_gone_hash")), "left_anti")
