"""Quality rules: exact statistics of every text, two base rules, and an isolation forest over how far the statistics leave the usual range.

Clean texts differ in many harmless ways, and a forest over the raw statistics would set the rare ones apart. So the usual range of each
statistic is taken from rows labelled good, and the forest sees only by how much a text leaves it: nothing for usual texts, something
for texts that break a rule. Few random splits isolate those, and the score from which they are rejected is calibrated on labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_or_empty
from weftline.llm.isolation import IsolationForest

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_HIGH = bytes(range(128, 256))
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbols", "repeated", "capitals", "letters", "distinct")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{r} double" for r in RATIOS)
BLOCK = 100  # words
_K = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of `width` words that are found twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), "i8", len(words)).view("u8")
    code = h[:n].copy()
    for i in range(1, width):
        code = code * _K + h[i : n + i]
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(code, twice))
    windows = [tuple(words[i : i + width]) for i in at]  # equal hashes are compared word by word
    seen = Counter(windows)
    covered = np.zeros(len(words), bool)
    for i, w in zip(at, windows, strict=True):
        if seen[w] > 1:
            covered[i : i + width] = True
    return int(covered.sum())


def distinct_share(words: list[bytes], block: int = BLOCK) -> float:
    """Mean share of distinct words over consecutive blocks of `block` words; the last block reaches back, so that it's full too.

    Over a whole text the share would fall with the text's length, as common words come again. A text shorter than a block is one block.
    """
    n = len(words)
    if n <= block:
        return len(set(words)) / max(n, 1)
    starts = [*range(0, n - block, block), n - block]
    return sum(len(set(words[a : a + block])) for a in starts) / (block * len(starts))


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five counts and the five ratios of a whole text."""
    data = text.encode()
    without = lambda chars: len(data) - len(data.translate(None, chars))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(text) - without(_BLANKS)
    symbols, repeated = without(_SYMBOLS), repeated_words(words)
    other = len(text) - (len(data) - without(_HIGH))  # code points beyond ASCII count as letters
    n, c = max(len(words), 1), max(chars, 1)
    return [len(words), chars, symbols, len(lines) - len(set(lines)), repeated], [symbols / c, repeated / n, without(_UPPER) / c, (without(_LETTERS) + other) / c, distinct_share(words)]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(COUNTS))), *(pa.array([f[1][i] for f in found], pa.float64()) for i in range(len(RATIOS)))], ["doc_id", *COUNTS, *RATIOS])


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The statistics of every whole text, one row per row."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(_measure, STATS)


class RuleModel:
    """Usual ranges, forest and limit; small and of fixed size, so it travels inside the tasks."""

    def __init__(self, rows: np.ndarray, good: np.ndarray, margin: float, clean_weight: float, trees: int, subsample: int, seed: int):
        self.low, self.high = np.quantile(rows[good], [margin, 1 - margin], axis=0)
        self.width = np.maximum(self.high - self.low, 1e-6)
        self.forest = IsolationForest(trees, subsample, seed).fit(self.excess(rows))
        score = self.score(rows)
        at = np.unique(score)
        limits = np.append((at[1:] + at[:-1]) / 2, at[-1])
        gain = [(score[~good] > t).mean() - clean_weight * (score[good] > t).mean() for t in limits]
        best = max(gain)
        self.limit = float(max(t for t, g in zip(limits, gain, strict=True) if g == best))

    def excess(self, rows: np.ndarray) -> np.ndarray:
        return np.log1p((np.maximum(0, rows - self.high) + np.maximum(0, self.low - rows)) / self.width)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Texts inside every usual range share one row of zeros and are scored once."""
        distinct, back = np.unique(self.excess(rows), axis=0, return_inverse=True)
        return self.forest.score(distinct)[back.ravel()]


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = 8192, margin: float = 0.002, clean_weight: float = 4.0, trees: int = 200, subsample: int = 256, seed: int = 7, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> RuleModel | None:
    """Fit on at most `sample` labelled rows, those with the smallest id hashes; None where one of the classes has no row."""
    chosen = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(quality).alias("_good")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # at most `sample` rows of two numbers
    found = measured(texts, "_id", "_text").join(F.broadcast(chosen.withColumnRenamed("_id", "doc_id")), "doc_id").orderBy("doc_id", *RATIOS).limit(sample).toPandas()
    good = found["_good"].to_numpy() == 1
    if not good.any() or good.all():
        return None
    return RuleModel(found[list(RATIOS)].to_numpy("f8"), good, margin, clean_weight, trees, subsample, seed)


def quality_rules(docs: DataFrame, labels: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, doc_id: str = "doc_id", text: str = "text", **fit) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, anomaly (the forest's score) and the five ratios, for every row of `docs`.

    A text fails the base rules with fewer than `min_words` words or with more than `max_repeat_percent` of its words in repeated
    windows of five words. A text that passes them is kept unless its anomaly score exceeds the calibrated limit.

    Defined results: a null text has no words and fails; null ids are judged like others; repeated rows get equal verdicts; an empty
    table gives an empty result; labels with nulls are left out; without good or without bad labelled rows there is no forest, the
    score is null and the base rules decide; other columns are ignored, whatever their names.
    """
    model = fit_rules(docs, labels, doc_id=doc_id, text=text, **fit)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, repeated = (np.asarray(batch.column(i)) for i in (1, 5))
            failed = (n < min_words) | (100 * repeated > max_repeat_percent * n)
            score = np.full(batch.num_rows, np.nan) if model is None else model.score(np.column_stack([np.asarray(c) for c in batch.columns[6:]]))
            odd = np.zeros(batch.num_rows, bool) if model is None else score > model.limit
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(failed), pa.array(~failed & ~odd), pa.array(score, from_pandas=True), *batch.columns[6:]], ["doc_id", *COUNTS, "base_failed", "kept", "anomaly", *RATIOS])

    return measured(docs, doc_id, text).mapInArrow(judge, STATS.replace(", symbols", ", base_failed boolean, kept boolean, anomaly double, symbols"))


def keep_good(docs: DataFrame, labels: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, **fit) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns as they are; judged where they are read, without a shuffle."""
    model, place = fit_rules(docs, labels, **fit), docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t or "") for t in batch.column(place).to_pylist()]
            kept = np.array([c[0] >= min_words and 100 * c[4] <= max_repeat_percent * c[0] for c, _ in found], bool)
            if model is not None and len(found):
                kept &= model.score(np.array([r for _, r in found])) <= model.limit
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(judge, docs.schema)
