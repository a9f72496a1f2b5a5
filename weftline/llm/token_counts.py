"""Token counts at every prefix of a text, by dynamic programming over byte-level BPE, stored to answer budget questions without encoding.

Inside a piece (what the pre-tokenizer keeps together) the encoding of a prefix ends in one token t, and what stands before t is the
encoding of the shorter prefix. A token t fits behind a prefix whose last token is l exactly when the pair of them is its own encoding.
So one pass from left to right finds the last token and the count of every prefix: count[i] = count[i - len(t)] + 1.

Across pieces only white space looks ahead: a run of it is one piece at the end of a text, but gives its last character to what follows.
Pieces are therefore evaluated in units (a run with the piece behind it), whose counts depend on the unit alone; equal units, and equal
stretches between single spaces, are worked out once per process.

A store has one row per document: the counts as 16-bit steps per character in blocks, with the count each block begins with and the
least count inside, so that a question about one budget reads one block.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_or_empty, written
from weftline.llm.wordbpe import _byte_letters, tokenizer_path

#: Unicode white space, as the pre-tokenizer knows it (fixed values).
BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WS = re.escape(BLANKS)
#: A single space between two other characters.
SPLIT = re.compile(rf"(?<=[^{WS}]) (?=[^{WS}])")
#: Where a space stands beside other white space.
UNEVEN = re.compile(rf"[{WS}] | [{WS}]|^ | $")
#: Endings that the pre-tokenizer cuts off (fixed values).
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Signs that are a piece and a token of their own behind a word.
_SIGNS = (",", ".", ":", ";", "!", "?")
_ONE = array("h", [1]).tobytes()
#: Latin letters, and characters beyond those on which Unicode versions agree what is a letter or a number.
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+\\Z")
_FAR = re.compile("[^\0-\u024f]")
#: Where units are more than pieces put together.
_JOINED = re.compile(f"[{WS}]{{2}}|'")
#: Steps of short pieces, by their change of the count (negative ones from the end).
_STEP = [array("h", [d]).tobytes() for d in (*range(128), *range(-128, 0))]
#: State of the empty prefix: last token, count, size of that token, state in front of it, steps, count behind the last whole character.
_NONE = (-1, 0, 0, None, b"", 0)
STORE = "doc_id long, n_bytes long, starts array<int>, lows array<int>, steps array<binary>"
BLOCK = 1 << 15


@lru_cache(maxsize=1)
def _units():
    import regex

    core = rf"\p{{L}}+|\p{{N}}+|[^{WS}\p{{L}}\p{{N}}]+"
    return regex.compile(rf"{'|'.join(ENDINGS)}|{core}|[{WS}]* (?:{core})|[{WS}]+")


class PrefixCounts:
    """Prefix counts under a byte-level BPE file; counts include all special tokens that the tokenizer finds in texts by default."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
            raise ValueError(f"{path} is not a byte-level file whose texts are cut as they are")
        tokenizer = Tokenizer.from_file(path)
        self._model, self._cut, self._letters, self._limit = tokenizer.model, tokenizer.pre_tokenizer, _byte_letters(), limit
        byte = {c: b for b, c in enumerate(self._letters)}
        special = {t["content"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._ids = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._bytes = {i: t for t, i in self._ids.items()}
        self._longest = [0] * 256
        for t in self._ids:
            self._longest[t[-1]] = max(self._longest[t[-1]], len(t))
        self._fits: dict[tuple[int, int], bool] = {}
        self._prefixes: dict[bytes, tuple] = {b"": _NONE}
        self._first: dict[str, bytes] = {}
        self._rest: dict[str, bytes] = {}

    def _together(self, last: int, token: int) -> bool:
        """Whether the two tokens (or the one, if last < 0) are the encoding of their bytes."""
        data = (self._bytes[last] if last >= 0 else b"") + self._bytes[token]
        found = [t.id for t in self._model.tokenize("".join(map(self._letters.__getitem__, data)))]
        if len(self._fits) >= 4 * self._limit:
            self._fits.clear()
        known = self._fits[last, token] = found == ([last, token] if last >= 0 else [token])
        return known

    def _next(self, data: bytes, i: int, state: tuple, before) -> tuple[int, int, int, tuple]:
        """The last token, count, size of that token and state in front of it for data[:i], from those of the shorter prefixes (`before` by length)."""
        ids, fits = self._ids, self._fits
        size, last = state[2] + 1, state[3]  # only one token fits; mostly the last one grows, or a short one begins
        for short in range(0, min(i, self._longest[data[i - 1]]) + 1):
            if short:
                size, last = short, state if short == 1 else before(i - short)
            elif last is None:
                continue
            token = ids.get(data[i - size : i])
            if token is not None:
                known = fits.get((last[0], token))
                if self._together(last[0], token) if known is None else known:
                    return token, last[1] + 1, size, last
        raise ValueError("a byte without a token")

    def piece(self, text: str, remembered: int = 64) -> bytes:
        """Steps of one piece. What is known of a short prefix, its own steps among it, serves all pieces that begin with it."""
        data = text.encode()
        known, n = self._prefixes, len(data)
        if n > remembered:
            states = [_NONE]
            for i in range(1, n + 1):
                states.append(self._next(data, i, states[-1], states.__getitem__))
            counts = [s[1] for i, s in enumerate(states) if i == n or data[i] & 0xC0 != 0x80]
            return array("h", map(sub, counts[1:], counts)).tobytes()
        if (state := known.get(data)) is not None:
            return state[4]
        if len(known) >= 2 * self._limit:
            known.clear()
            known[b""] = _NONE
        at = n - 1
        while (state := known.get(data[:at])) is None:
            at -= 1
        for i in range(at + 1, n + 1):
            token, count, size, last = self._next(data, i, state, lambda j: known[data[:j]])
            steps, base = state[4], state[5]
            if i == n or data[i] & 0xC0 != 0x80:  # a character ends
                steps, base = steps + _STEP[count - base], count
            state = known[data[:i]] = (token, count, size, last, steps, base)
        return state[4]

    def _units_of(self, text: str) -> Iterator[tuple[str, int]]:
        """Units and where they end. Beyond the letters that everybody agrees on, the pre-tokenizer itself says where pieces end."""
        if not _FAR.search(text):
            yield from ((m[0], m.end()) for m in _units().finditer(text))
            return
        begin = None  # of a run of white space
        for _, (a, b) in self._cut.pre_tokenize_str(text):
            if not text[a:b].strip(BLANKS):
                begin = a if begin is None else begin
                continue
            if begin is not None and text[a] != " ":
                yield text[begin:a], a
                begin = None
            yield text[a if begin is None else begin : b], b
            begin = None
        if begin is not None:
            yield text[begin:], len(text)

    def _steps(self, text: str) -> bytes:
        """Steps at all prefixes of a stretch that nothing in front of it reaches into."""
        if not _JOINED.search(text):
            return b"".join([self.piece(unit) for unit, _ in self._units_of(text)])
        out: list[int] = []
        base = 0
        counts_of = lambda piece: np.frombuffer(self.piece(piece), "i2").cumsum(dtype="i4").tolist()
        for unit, end in self._units_of(text):
            if unit in ENDINGS:
                one = counts_of("'")[0]
                out += (base + one, *(base + one + c for c in counts_of(unit[1:])[:-1]))
                base += counts_of(unit)[-1]
                out.append(base)
                continue
            run = len(unit) - len(unit.lstrip(BLANKS))
            if not run:
                counts = counts_of(unit)
                out += (base + c for c in counts)
                base += counts[-1]
                continue
            blank = counts_of(unit[:run])
            out += (base + c for c in blank)
            if run < len(unit):  # the space goes with what follows
                counts = counts_of(unit[run - 1 :])[1:]
                base += blank[run - 2] if run > 1 else 0
                out += (base + c for c in counts)
                base += counts[-1]
            elif end < len(text) and run > 1:
                base += blank[run - 2] + counts_of(unit[-1])[0]
            else:
                base += blank[-1]
        return array("h", map(sub, out, (0, *out))).tobytes()

    def _stretch(self, known: dict[str, bytes], text: str, front: str) -> bytes:
        if text[-1:] in _SIGNS and _WORD.match(text[:-1]):  # a sign behind a word is one more token
            return (known.get(text[:-1]) or self._stretch(known, text[:-1], front)) + _ONE
        steps = self.piece(front + text) if _WORD.match(text) else self._steps(front + text)
        if len(text) <= 64:
            if len(known) >= self._limit:
                known.clear()
            known[text] = steps
        return steps

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        parts = (SPLIT if UNEVEN.search(text) else _SPACE).split(text)
        first, rest = self._first, self._rest
        out = [first.get(parts[0]) or self._stretch(first, parts[0], "")]
        out += [rest.get(p) or self._stretch(rest, p, " ") for p in parts[1:]]
        return b"".join(out)

    def steps(self, text: str) -> bytes:
        """Changes of the token count from each prefix to the next, a 16-bit integer per character."""
        if self._special is None or not (hits := list(self._special.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in hits:  # inside a special token the prefix is ordinary text; at its end it is one token behind the text before it
            steps = np.frombuffer(self._plain(text[at : m.end() - 1]), "i2")
            before, here = int(steps[: m.start() - at].sum()), int(steps.sum())
            out += (steps.tobytes(), np.array([before + 1 - here], "i2").tobytes())
            at = m.end()
        return b"".join((*out, self._plain(text[at:])))


class _SPACE:
    """str.split with the interface of a pattern."""

    split = staticmethod(lambda text: text.split(" "))


@lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    """One per worker process."""
    return PrefixCounts(path)


def _store_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counts(path)
        names, types = zip(*(("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int32())), ("lows", pa.list_(pa.int32())), ("steps", pa.list_(pa.binary()))), strict=True)
        rows, held = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                steps = counter.steps(text)
                starts, lows, blocks, count = [], [], [], 0
                for a in range(0, len(steps), 2 * BLOCK):
                    block = steps[a : a + 2 * BLOCK]
                    counts = count + np.cumsum(np.frombuffer(block, "i2"), dtype="i4")
                    starts.append(count)
                    lows.append(int(counts.min()))
                    blocks.append(block)
                    count = int(counts[-1])
                rows.append((doc_id, len(text.encode()), starts, lows, blocks))
                held += len(steps)
                if held >= 8 << 20:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return run


def prefix_store(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of `docs`: doc_id, n_bytes (UTF-8) and the token counts of all prefixes in blocks (`starts`, `lows`, `steps`).

    Defined results: null and empty texts have no bytes, blocks or tokens; rows without an id and repeated rows have rows of their own; an
    empty table gives an empty store; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(_store_rows(path or tokenizer_path("byte_bpe_50k.json")), STORE)


def count_at(starts: list[int], steps: list[bytes], n_chars: int) -> int:
    """Tokens of the first n_chars characters."""
    if n_chars <= 0 or not steps:
        return 0
    b = min((n_chars - 1) // BLOCK, len(steps) - 1)
    return starts[b] + int(np.frombuffer(steps[b], "i2")[: n_chars - b * BLOCK].sum())


def longest_within(starts: list[int], lows: list[int], steps: list[bytes], budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens; counts may fall from one prefix to the next, so the last such prefix counts."""
    for b in range(len(steps) - 1, -1, -1):
        if lows[b] <= budget:
            counts = starts[b] + np.cumsum(np.frombuffer(steps[b], "i2"), dtype="i4")
            return b * BLOCK + int(np.flatnonzero(counts <= budget)[-1]) + 1
    return 0


def _answers(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fit = [], []
            for starts, lows, steps in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True):
                starts, lows, steps = starts.as_py(), lows.as_py(), steps.as_py()
                n.append(count_at(starts, steps, BLOCK * len(steps)))
                fit.append(longest_within(starts, lows, steps, budget))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fit, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "fitting_chars"])

    return run


def budget_answers(store: DataFrame, budget: int = 1024) -> DataFrame:
    """From a prefix store, without encoding: doc_id, n_bytes, n_tokens, over_limit (more tokens than `budget`) and fitting_chars, the length
    in characters of the longest prefix within the budget."""
    found = store.mapInArrow(_answers(budget), "doc_id long, n_bytes long, n_tokens long, fitting_chars long")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"), "fitting_chars")


def token_counts(docs: DataFrame, budget: int = 1024, **options) -> DataFrame:
    """Writes a prefix store of `docs` to the shared folder and answers the budget question from it."""
    return budget_answers(written(prefix_store(docs, **options), "prefixes"), budget)
