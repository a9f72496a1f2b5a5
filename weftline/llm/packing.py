"""Best-fit decreasing packing of token sequences, over the whole corpus at once.

Pieces of one length are interchangeable, so the packing needs only how many pieces there are of each length: at most `capacity`
numbers, whatever the corpus. The lengths are taken from the longest down; a segment tree over remaining capacities finds the
tightest open bin in logarithmic time, and bins with one content are kept as one group with a count, so that a length is placed in a
whole group of bins at once. What comes out is the result of best-fit decreasing document by document: a plan with an interval of
bins for each interval of the pieces of a length. Spark numbers the pieces of a length and looks their bins up in the plan.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import text_or_empty, written
from weftline.llm.wordbpe import tokenizer_path, word_bpe

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, run int, own long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Tightest:
    """Segment tree over remaining capacities: how many bins are open at each, and the smallest capacity that still holds a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        at = remaining + self.size
        while at:
            self.open[at] += bins
            at >>= 1

    def find(self, length: int) -> int | None:
        """The smallest remaining capacity of at least `length` with an open bin."""
        at = length + self.size
        if self.open[at]:
            return length
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Rows (length, first, bin, each, offset): the pieces of a length from number `first` on go to the bins from `bin` on, `each` to a bin.

    Bins are grouped by content; a length splits at most one group, so there are at most a few groups per length, and a plan of that size.
    """
    tree, groups, bins, rows = Tightest(capacity), {}, 0, []
    for length in sorted((n for n in counts if n > 0), reverse=True):
        left, placed = counts[length], 0
        while left:
            remaining = tree.find(length)
            if remaining is None:
                remaining, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = groups[remaining].pop()
                tree.add(remaining, -n)
                each = remaining // length
            offset, whole = capacity - remaining, min(n, left // each)
            rest = left - whole * each if whole < n else 0
            if whole + bool(rest) < n:
                groups.setdefault(remaining, []).append((first + whole + bool(rest), n - whole - bool(rest)))
                tree.add(remaining, n - whole - bool(rest))
            for at, k, m in ((first, whole, each), (first + whole, bool(rest), rest)):
                after = remaining - m * length
                if k and after:
                    groups.setdefault(after, []).append((at, k))
                    tree.add(after, k)
            rows.append((length, placed, first, each, offset))
            placed += whole * each + rest
            left -= whole * each + rest
    table = np.array(rows, "i8").reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "first", "bin", "each", "offset"))}


def _cut(path: str, capacity: int, end_id: int):
    tail = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, number, seen = word_bpe(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8")
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, text in zip(ids, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                coded = words.ids(text) + tail
                for piece, at in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[at : at + 4 * capacity]
                    length = len(part) // 4
                    rows.append((i, piece, at // 4, length, zlib.crc32(part), number, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return run


def pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One written row per piece of at most `capacity` ids, with its number among the pieces of its length in its task (`run`, `own`)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return written(rows.mapInArrow(_cut(tokenizer or tokenizer_path(), capacity, end_id), PIECES), "pieces")


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Sequence and offset for each row of `pieces`.

    The number of a piece among all of its length is its number in its task and the pieces of that length in the tasks before it, so
    a length that a third of the pieces share is numbered by all tasks.
    """
    per_run = cut.groupBy("length", "run").agg(F.count(F.lit(1)).alias("_n"))
    before = per_run.select("length", "run", (F.sum("_n").over(Window.partitionBy("length").orderBy("run")) - F.col("_n")).alias("_before"))
    counts = {r["length"]: r["_n"] for r in per_run.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}  # at most `capacity` rows
    plan = best_fit_plan(counts, capacity)
    order = np.lexsort((plan["first"], plan["length"]))
    plan = {k: v[order] for k, v in plan.items()}
    shared = cut.sparkSession.sparkContext.broadcast((plan, int(max(counts.values(), default=0)) + 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, most = shared.value
        keys = plan["length"] * most + plan["first"]
        for batch in batches:
            length, nth = np.asarray(batch.column(3)).astype("i8"), np.asarray(batch.column(5)) + np.asarray(batch.column(6))
            row = np.searchsorted(keys, length * most + nth, side="right") - 1
            own, each = nth - plan["first"][row], plan["each"][row]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(length), batch.column(4), pa.array(plan["bin"][row] + own // each), pa.array(plan["offset"][row] + own % each * length)], [x.split()[0] for x in PACKED.split(", ")])

    return cut.join(before, ["length", "run"]).select("doc_id", "piece", "start", "length", "ids_crc32", "own", "_before").mapInArrow(place, PACKED)


def best_fit_packing(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every whole document, with its end id, into sequences of at most `capacity` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset, one row per piece. Only documents longer than `capacity`
    are cut, into full pieces and a last shorter one. Sequences are numbered from 0, and the pieces of one fill it without gaps.

    Defined results: a null or empty text is a document of its end id alone; a null doc_id stays null; repeated rows are packed
    each; an empty table gives an empty result; other columns are ignored.
    """
    return pack(pieces(docs, capacity, end_id, tokenizer, doc_id, text), capacity)
