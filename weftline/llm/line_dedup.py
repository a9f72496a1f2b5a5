"""Line deduplication by a deletion-neighbourhood join: equal lines, and lines one word apart, keep their earliest.

Lines are compared as lists of words. Copies collapse first. Of the distinct lines, only those that share a half with another line can
lie within one edit of it: an edit leaves the words before it or the words behind it untouched. These emit their whole deletion
neighbourhood, the line itself and the line without each of its words, as hashed keys with the place of the deleted word. Equal keys join:

* two lines without the same word place: one word was replaced;
* a line, and another line without one word: one word was added.

So all lines under one key lie within the bound of each other, and the earliest line of a key, found by aggregates that map tasks combine,
is all that the others need to meet; no pairs of a group are made. Each (line, earlier line) is then verified on its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_or_empty, written

_K = 0x9E3779B97F4A7C15
_KINV = np.uint64(pow(_K, -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
LINES = "did long, th int, line int, k1 long, k2 long, halves array<long>"
NEAR = "did long, th int, line int, words string"
VARIANTS = "v long, pos int, did long, th int, line int"
#: A line with a word: [^\x20\x09-\x0D] somewhere between line feeds.
LINE_WITH_WORD = r"[^\n]*[^\x20\x09-\x0D][^\n]*"


def half_keys(words: list[bytes]) -> list[int]:
    """Hashes of the first and of the last half, for the halves of this length and of one word less: lines one edit apart share one."""
    from xxhash import xxh3_64_intdigest

    n = len(words)
    keys = [(tag, size, part) for size in {n // 2, (n - 1) // 2} for tag, part in ((b"a", words[:size]), (b"z", words[n - size :]))]
    return [xxh3_64_intdigest(b"%s%d " % (tag, size) + b" ".join(part)) - (1 << 63) for tag, size, part in keys]


def _line_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, line, k1, k2, halves = [], [], [], [], []
            for d, data in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                for i, x in enumerate(data.split(b"\n")):
                    words = x.split()
                    if words:
                        digest = hashlib.md5(b" ".join(words), usedforsecurity=False).digest()
                        doc.append(d)
                        line.append(i)
                        k1.append(int.from_bytes(digest[:8], "big", signed=True))
                        k2.append(int.from_bytes(digest[8:], "big", signed=True))
                        halves.append(half_keys(words) if len(words) >= min_words else None)
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(line, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(halves, pa.list_(pa.int64()))], [x.split()[0] for x in LINES.split(", ")])

    return run


def _near_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, th, text, lines) -> the words of those lines."""
    for batch in batches:
        doc, line, words = [], [], []
        for d, (data, wanted) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            all_lines = data.split(b"\n")
            for i in wanted:
                doc.append(d)
                line.append(i)
                words.append(b" ".join(all_lines[i].split()))
        at = pa.array(doc, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(line, pa.int32()), pa.array(words, pa.binary()).cast(pa.string())], [x.split()[0] for x in NEAR.split(", ")])


def deletion_keys(words: list[bytes]) -> np.ndarray:
    """Hashes of the line and, behind it, of the line without each of its words."""
    from xxhash import xxh3_64_intdigest

    n = len(words)
    power = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, _K, "u8")]), dtype="u8")
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(np.fromiter(map(xxh3_64_intdigest, words), "u8", n) * power[:n], dtype="u8")])
    code = np.concatenate([sums[n:], sums[:n] + (sums[n] - sums[1:]) * _KINV])
    code = (code ^ (code >> np.uint64(33))) * _MIX
    return (code ^ (code >> np.uint64(29))).view("i8")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):  # a line makes a row per word
            part = batch.slice(a, 2048)
            keys = [deletion_keys(x.split()) for x in part.column(3).cast(pa.binary()).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            pos = np.concatenate([np.arange(-1, len(k) - 1) for k in keys]).astype("i4")
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(pos), *(part.column(i).take(at) for i in range(3))], [x.split()[0] for x in VARIANTS.split(", ")])


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one replaced, added or removed word, or none, makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, th, line, words, earlier words) -> the lines within one edit of the earlier line."""
    for batch in batches:
        same = [within_one_edit(x.split(), y.split()) for x, y in zip(batch.column(3).cast(pa.binary()).to_pylist(), batch.column(4).cast(pa.binary()).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(same, pa.bool_())) for c in batch.columns[:3]], ["did", "th", "line"])


def kept_lines(docs: DataFrame, min_words: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(did, th, kept): the places, from 0, of the lines that each document keeps, for documents that keep any."""
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text)).alias("did"), F.hash(text).alias("th"), text_or_empty(text).alias("text"))
    first = F.struct("did", "th", "line")
    lines = source.mapInArrow(_line_rows(min_words), LINES)
    distinct = written(lines.groupBy("k1", "k2").agg(F.min(first).alias("first"), F.any_value("halves").alias("halves")), "lines")

    halves = distinct.select(F.explode("halves").alias("half"), "first")
    shared = written(halves.groupBy("half").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("half"), "halves")
    wanted = halves.join(shared, "half").select("first.*").groupBy("did", "th").agg(F.collect_set("line").alias("lines"))
    near = written(source.join(wanted, ["did", "th"]).select("did", "th", "text", "lines").mapInArrow(_near_lines, NEAR), "near")

    variants = near.mapInArrow(_variants, VARIANTS)
    firsts = variants.groupBy("v", "pos").agg(F.min(first).alias("e"), F.count(F.lit(1)).alias("n"))
    by_key = firsts.groupBy("v").agg(F.min(F.when(F.col("pos") < 0, F.col("e"))).alias("whole"), F.min(F.when(F.col("pos") >= 0, F.col("e"))).alias("shorter"), F.sum("n").alias("_n")).where("_n > 1")
    meet = firsts.join(by_key, "v").select("v", "pos", F.when(F.col("pos") < 0, F.col("shorter")).otherwise(F.least("e", "whole")).alias("earlier"))
    meet = written(meet.where("earlier is not null"), "meet")
    pairs = variants.join(meet, ["v", "pos"]).where(F.col("earlier") < first).select("did", "th", "line", "earlier").distinct()
    other = near.select(F.col("did").alias("_d"), F.col("th").alias("_t"), F.col("line").alias("_l"), F.col("words").alias("_words"))
    both = pairs.join(near, ["did", "th", "line"]).join(other, (F.col("earlier.did") == F.col("_d")) & (F.col("earlier.th") == F.col("_t")) & (F.col("earlier.line") == F.col("_l")))
    late = written(both.select("did", "th", "line", "words", "_words").mapInArrow(_verify, "did long, th int, line int").distinct(), "late")
    return distinct.select("first.*").join(late, ["did", "th", "line"], "left_anti").groupBy("did", "th").agg(F.sort_array(F.collect_list("line")).alias("kept"))


def line_dedup(docs: DataFrame, min_words: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines (lines with a word), n_kept and kept (their places in the text, from 0), one row per row.

    Lines are what stands between line feeds, compared by their words. A line goes if an equal line stands earlier (smaller doc_id, or
    earlier in the document), or if it and an earlier line have at least `min_words` words each and lie one word apart (replaced, added
    or removed); the earlier line counts even if it goes itself. Lines without words are left alone.

    Defined results: null and empty texts have no lines; rows without an id take a place by their text's hash; repeated rows with one id
    and one text keep the same lines; an empty table gives an empty result; other columns are ignored.
    """
    kept = kept_lines(docs, min_words, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text)).alias("did"), F.hash(text).alias("th"), F.regexp_count(text_or_empty(text), F.lit(LINE_WITH_WORD)).cast("long").alias("n_lines"))
    found = rows.join(kept, ["did", "th"], "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    return found.select("doc_id", "n_lines", F.size("kept").cast("long").alias("n_kept"), "kept")


def without_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """`docs` with the late lines taken out of column text; lines without words and all other columns stay."""
    kept = kept_lines(docs, min_words).withColumnsRenamed({"did": "_did", "th": "_th", "kept": "_kept"})
    rows = docs.join(kept, (F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")) == F.col("_did")) & (F.hash("text") == F.col("_th")), "left")
    places = F.coalesce("_kept", F.array().cast("array<int>"))
    stay = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")) | F.array_contains(places, i))
    return rows.withColumn("text", F.array_join(stay, "\n")).select(*docs.columns)
