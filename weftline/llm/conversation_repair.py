"""Repair of conversations by a dynamic program over a grammar of their role and fault sequences.

Every row becomes one symbol: the first letter of its role, in capitals where the text breaks off, or X where the row must go. A row's
edits move between four states (nothing written, after s, after u, after a), so a symbol is a 4 x 4 matrix of (cost, audit) under
"least, then ASCII-least", and a sequence of symbols is the product of its matrices. Re-Pair rules over the distinct sequences of the
corpus, learned in rounds as Spark jobs, name frequent neighbours; each rule's matrix is evaluated once from the two below it (bottom-up),
its audits are ropes that share the pieces of the rules inside, and all conversations are then products of rule matrices.

Audits of one stretch at one cost are never prefixes of each other (each extra letter could only be an insert, at a cost), so comparing
least parts gives the least whole, and the products may be formed in any grouping.

A conversation of any length is cut into blocks of bounded rows and bytes after a range exchange on (conversation, turn, role, text), so
one that holds a third of all rows is spread over tasks. Blocks pass on their matrix; a stream over the blocks of a conversation picks
the best path with a window that is committed where all paths agree, and the texts are repaired block by block.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import task_count, written

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 3, 4, 3, 3
STATES = range(4)  # nothing written, after s, after u, after a
#: Where writing a letter leads from each state.
WRITES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
DONE = (0, 3)
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"
#: What any other state can cost more than the ones after u or a, from here on: farther behind, a path is lost.
BEHIND = 7

STATS = "n_rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, min_turn long, max_turn long, turns long, first_turn long, last_turn long"
BLOCK = f"pid int, k int, whole boolean, symbols string, roles array<string>, texts array<string>, {STATS}"

Rope = str | tuple["Rope", "Rope"]
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def letters(rope: Rope) -> Iterator[str]:
    """The pieces of a rope from left to right."""
    stack = [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x:
                yield x
        else:
            stack += (x[1], x[0])


def flat(rope: Rope) -> str:
    return "".join(letters(rope))


def precedes(x: Rope, y: Rope) -> bool:
    """Whether the rope x is ASCII-less than y; pieces that both share in front are passed over whole."""
    while isinstance(x, tuple) and isinstance(y, tuple) and x[0] is y[0]:
        x, y = x[1], y[1]
    if x is y:
        return False
    a, b, p, q = letters(x), letters(y), "", ""
    while True:
        p, q = p or next(a, ""), q or next(b, "")
        n = min(len(p), len(q))
        if not n or p[:n] != q[:n]:
            return p[:n] < q[:n] if n else bool(q)
        p, q = p[n:], q[n:]


def best(old: tuple[int, Rope] | None, new: tuple[int, Rope]) -> tuple[int, Rope]:
    return new if old is None or new[0] < old[0] or (new[0] == old[0] and precedes(new[1], old[1])) else old


def _inserts() -> dict[tuple[int, int], int]:
    """Fewest inserted rows between two states."""
    steps = {(p, p): 0 for p in STATES}
    for _ in STATES:
        for (p, q), n in list(steps.items()):
            for role in "ua":
                if (to := WRITES[role].get(q)) is not None and steps.get((p, to), 9) > n + 1:
                    steps[p, to] = n + 1
    return steps


INSERTS = _inserts()


def symbol_matrix(symbol: str) -> Matrix:
    """The edits of one row, each after the inserts that lead to it."""
    out: Matrix = {}
    extra = BROKEN if symbol.isupper() else 0
    for (p, q), n in INSERTS.items():
        moves = [(q, DELETE, "D")]
        if symbol != "X":
            moves += [(to, KEEP + extra, "K") for role, at in WRITES.items() if role == symbol.lower() and (to := at.get(q)) is not None]
            moves += [(to, REROLE + extra, "R") for role in "ua" if (to := WRITES[role].get(q)) is not None]
        for to, cost, letter in moves:
            out[p, to] = best(out.get((p, to)), (n * INSERT + cost, "I" * n + letter))
    return out


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = {}
    for (p, m), (c, a) in x.items():
        for q in STATES:
            if (step := y.get((m, q))) is not None:
                out[p, q] = best(out.get((p, q)), (c + step[0], (a, step[1])))
    return out


def finish(p: int) -> int | None:
    """Inserts after the last row that make a state one to end in."""
    return min((INSERTS[p, q] for q in DONE if (p, q) in INSERTS), default=None)


class Transfers:
    """Matrices of a grammar: of the nine symbols, and bottom-up of every rule. `rules` are (new symbol, left, right) in order."""

    def __init__(self, rules: tuple[tuple[str, str, str], ...]):
        self.rules = rules
        self.of = {s: symbol_matrix(s) for s in "suaoSUAOX"}
        for new, left, right in rules:
            self.of[new] = product(self.of[left], self.of[right])
        self._known: dict[str, tuple[int, str]] = {}

    def compress(self, symbols: str) -> str:
        for new, left, right in self.rules:
            symbols = symbols.replace(left + right, new)
        return symbols

    def matrix(self, symbols: str) -> Matrix:
        out: Matrix = {(p, p): (0, "") for p in STATES}
        for s in self.compress(symbols):
            out = product(out, self.of[s])
        return out

    def whole(self, symbols: str, limit: int = 50_000) -> tuple[int, str]:
        """Cost and audit of a whole conversation; equal sequences are worked out once per process."""
        if (known := self._known.get(symbols)) is None:
            row: Matrix = {(0, 0): (0, "")}
            for s in self.compress(symbols):
                row = product(row, self.of[s])
            ends = None
            for (_, q), (cost, audit) in row.items():
                if (n := finish(q)) is not None:
                    ends = best(ends, (cost + n * INSERT, (audit, "I" * n)))
            if len(self._known) >= limit:
                self._known.clear()
            known = self._known[symbols] = (ends[0], flat(ends[1]))
        return known


@lru_cache(maxsize=4)
def transfers(rules: tuple[tuple[str, str, str], ...]) -> Transfers:
    """One per worker process and grammar."""
    return Transfers(rules)


def repaired(state: int, audit: str, roles: list[str | None], texts: list[str | None]) -> tuple[list[str], list[str]]:
    """Roles and texts that an audit leaves, beginning in `state`."""
    out_roles, out_texts, at = [], [], 0
    for letter in audit:
        role, text = "assistant" if state == 2 else "user", ""
        if letter != "I":
            role, text = (roles[at] if letter == "K" else role), texts[at]
            at += 1
        if letter != "D":
            state = WRITES[role[:1]][state]
            out_roles.append(role)
            out_texts.append(text)
    return out_roles, out_texts


# Re-Pair


def _pairs(rules: tuple) -> object:
    """(symbols, n) -> how often each pair of neighbours stands in the compressed sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, found = transfers(rules).compress, Counter()
        for batch in batches:
            for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = compress(symbols)
                for pair in zip(c, c[1:], strict=False):
                    found["".join(pair)] += n
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["pair", "n"])

    return run


def grammar(sequences: DataFrame, rules: int = 512, per_round: int = 64) -> tuple[tuple[str, str, str], ...]:
    """Re-Pair rules over (symbols, n): rounds name the most frequent pairs that can't overlap, until none occurs twice.

    `rules` bounds the grammar and so what the driver holds and the tasks are sent; it decides how far sequences shrink, never a result.
    Pairs per task are bounded by the square of the symbols.
    """
    out: tuple[tuple[str, str, str], ...] = ()
    while len(out) < rules:
        counts = sequences.mapInArrow(_pairs(out), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        lefts, rights, new = set(), set(), []
        for r in counts.orderBy(F.desc("n"), "pair").limit(min(per_round, rules - len(out))).collect():
            a, b = r["pair"]
            if a not in rights and b not in lefts and a != b or not new and a == b:
                new.append((chr(0xE000 + len(out) + len(new)), a, b))
                lefts.add(a)
                rights.add(b)
                if a == b:
                    break
        if not new:
            return out
        out += tuple(new)
    return out


# Blocks of rows


def _cut(block_rows: int, block_bytes: int, conv_type: pa.DataType):
    """Sorted (conv, turn, role, text, n, first, pid) -> blocks. A block is a whole conversation, or marked as a part of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", *(x.split()[0] for x in BLOCK.split(", "))]
        types = [conv_type, pa.int32(), pa.int32(), pa.bool_(), pa.string(), *[pa.list_(pa.string())] * 2, *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 5]
        conv, symbols, roles, texts, size, whole, k, pid = None, [], [], [], 0, False, 0, None
        count, turns, edge, last, begun = Counter(), [], ["", ""], None, False

        def block(is_whole: bool):
            first, end = (turns[0], turns[-1]) if turns else (None, None)
            return (conv, pid, k, is_whole, "".join(symbols), roles, texts, len(symbols), count["blank"], count["duplicate"], count["truncated"], count["illegal"], *edge,
                    min(turns, default=None), max(turns, default=None), len(turns), first, end)

        def table(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

        ready: list[tuple] = []
        held = 0
        for batch in batches:
            for c, turn, role, text, n, first, part in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not begun or c != conv:
                    if symbols:
                        ready.append(block(whole))
                        held, k = held + size, k + 1
                    whole = begun  # the first conversation of a task may have begun in the one before
                    conv, symbols, roles, texts, size, count, turns, last, begun = c, [], [], [], 0, Counter(), [], None, True
                pid = part
                bare = text.strip(SPACES)
                for copy in range(n):
                    if len(symbols) >= block_rows or size >= block_bytes:
                        whole = False
                        ready.append(block(False))
                        held, k = held + size, k + 1
                        symbols, roles, texts, size, count, turns, last = [], [], [], 0, Counter(), [], None
                    if not bare:
                        symbol, fault = "X", "blank"
                    elif copy or not first:
                        symbol, fault = "X", "duplicate"
                    else:
                        symbol = role[:1] if role[:1] in tuple("sua") else "o"
                        symbol, fault = (symbol, "") if bare[-1] in ".!?" else (symbol.upper(), "truncated")
                    symbols.append(symbol)
                    roles.append(None if symbol == "X" else role)
                    texts.append(None if symbol == "X" else text)
                    size += 0 if symbol == "X" else len(text)
                    count[fault] += 1
                    count["illegal"] += last is not None and last + role[:1] not in LEGAL
                    last = role[:1]
                    edge = [edge[0] if len(symbols) > 1 else last, last]
                    if turn is not None and (not turns or turns[-1] != turn):
                        turns.append(turn)
                    if held >= block_bytes or len(ready) >= 4096:
                        yield table(ready)
                        ready, held = [], 0
        if symbols:
            ready.append(block(False))  # the next task may go on with it
        if ready:
            yield table(ready)

    return run


def shaped(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text): nulls of role and text are one space."""
    return rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Repeatable damage of (conv, turn, role, text) by the crc32 of `conv:turn`, nulls as one space, modulo 20: 0 drops the row, 1 empties its
    text, 2 takes out its sentence ends, 3 repeats it, 4 makes its role user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(spaced("conv"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_hit", hit).where("_hit <> 0").select("conv", "turn", F.when(F.col("_hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_c")).drop("_c")


def blocks_of(rows: DataFrame, block_rows: int = 512, block_bytes: int = 4 << 20) -> DataFrame:
    """`rows` of (conv, turn, role, text) as blocks in the order of turn (nulls first), role and the text's digest.

    Equal rows are folded with a count before the range exchange; a row is a duplicate if its role and text stand earlier, which the
    smallest place per (conversation, role, digest) tells. Only groups with two places or more come into that join.
    """
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    folded = rows.groupBy("conv", "turn", "role", F.sha2("text", 256).alias("digest")).agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("n"))
    firsts = rows.groupBy("conv", "turn", "role", F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n")).groupBy("conv", "role", "digest").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "_first")
    firsts = written(firsts, "firsts")
    met = folded.join(firsts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    first = F.coalesce(F.col("_first") == place, F.lit(True))
    spark = rows.sparkSession
    order = ["conv", "turn", "role", "digest"]
    dealt = met.select(*order, "text", "n", first.alias("first")).repartitionByRange(task_count(spark), *order).sortWithinPartitions(*order)
    conv = rows.schema["conv"].dataType
    arrow = pa.int64() if conv.simpleString() == "bigint" else pa.int32() if conv.simpleString() == "int" else pa.string()
    cut = dealt.select("conv", "turn", "role", "text", "n", "first", F.spark_partition_id().alias("pid")).mapInArrow(_cut(block_rows, block_bytes, arrow), f"conv {conv.simpleString()}, {BLOCK}")
    return written(cut, "blocks")


# Paths of conversations in several blocks


def _matrices(rules: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transfers(rules)
        for batch in batches:
            found = [t.matrix(s) for s in batch.column(3).to_pylist()]
            cells = [[(p, q, c, flat(a)) for (p, q), (c, a) in m.items()] for m in found]
            kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            rows = pa.array([[dict(zip("p q cost audit".split(), x, strict=True)) for x in c] for c in cells], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rows], ["conv", "pid", "k", "cells"])

    return run


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, pid, k, cells) -> the state each block begins in, its audit and cost on the best path."""
    done: list[tuple] = []
    conv, begun, window = None, False, []
    alive: dict[int, tuple[int, tuple]] = {}  # state -> cost, ((start state, audit, cost) per block of the window)

    def settle(paths: list[tuple]):
        """Blocks on which all paths agree leave the window."""
        nonlocal window, alive
        n = 0
        while n < len(window) and all(p[n] == paths[0][n] for p in paths):
            done.append((*window[n], *paths[0][n]))
            n += 1
        if n:
            window = window[n:]
            alive = {q: (c, p[n:]) for q, (c, p) in alive.items()}

    def close():
        ends = None
        for q, (cost, path) in alive.items():
            if (n := finish(q)) is not None:
                new = (cost + n * INSERT, "".join(x[1] for x in path) + "I" * n, n, path)
                ends = new if ends is None or new[:2] < ends[:2] else ends
        if ends:
            _, _, n, path = ends
            state, audit, cost = path[-1]
            settle([(*path[:-1], (state, audit + "I" * n, cost + n * INSERT))])

    def out():
        columns = zip(*done, strict=True) if done else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["pid", "k", "state", "audit", "cost"])

    for batch in batches:
        for c, pid, k, cells in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not begun or c != conv:
                close()
                conv, begun, window, alive = c, True, [], {0: (0, ())}
            new: dict[int, tuple] = {}
            for x in cells:
                if (old := alive.get(x["p"])) is not None:
                    path = (old[0] + x["cost"], "".join(y[1] for y in old[1]) + x["audit"], (*old[1], (x["p"], x["audit"], x["cost"])))
                    if x["q"] not in new or path[:2] < new[x["q"]][:2]:
                        new[x["q"]] = path
            least = min((new[q][0] for q in (2, 3) if q in new), default=1 << 60)
            window.append((pid, k))
            alive = {q: (cost, path) for q, (cost, _, path) in new.items() if cost <= least + BEHIND}
            paths = [p for _, p in alive.values()]
            if len(window) > 1:  # the last block stays: the end may add to its audit
                last, window = window[-1], window[:-1]
                kept = [p[-1:] for p in paths]
                alive = {q: (cost, p[:-1]) for q, (cost, p) in alive.items()}
                settle([p[:-1] for p in paths])
                alive = {q: (cost, p + e) for (q, (cost, p)), e in zip(alive.items(), kept, strict=True)}
                window.append(last)
        if len(done) >= 1024:
            yield out()
            done.clear()
    close()
    yield out()


SOLVED = "audit string, cost long, roles array<string>, texts array<string>"


def _solve_whole(rules: tuple, conv_type: str):
    """(conv, pid, k, symbols, roles, texts, ...) of whole conversations -> their repair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transfers(rules)
        for batch in batches:
            rows = []
            for symbols, roles, texts in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                cost, audit = t.whole(symbols)
                rows.append((audit, cost, *repaired(0, audit, roles, texts)))
            yield _solved(batch, rows, 6)

    return run


def _solve_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, pid, k, symbols, roles, texts, state, audit, cost, ...) -> the repair of each block."""
    for batch in batches:
        rows = [(audit, cost, *repaired(state, audit, roles, texts)) for roles, texts, state, audit, cost in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6, 7, 8)), strict=True)]
        yield _solved(batch, rows, 9)


def _solved(batch: pa.RecordBatch, rows: list[tuple], rest: int) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    types = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
    names = ["conv", "pid", "k", "audit", "cost", "roles", "texts", *(batch.schema.names[rest:])]
    return pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), *batch.columns[rest:]], names)


def repair(rows: DataFrame, block_rows: int = 512, block_bytes: int = 4 << 20, rules: int = 512) -> DataFrame:
    """Repairs (conv, turn, role, text), see `shaped`, to role letters `(s?(ua)+)?` at least cost; of equal costs the ASCII-least audit.

    Returns blocks of bounded size: conv, pid and k (their order), whole (a conversation of one block), audit and cost (the block's share),
    roles and texts (what is left or inserted, in order), and counts of the block's rows and faults. `repaired_turns` makes rows of them,
    `repair_report` one row per conversation.

    Edits: keep 0; give another role (user or assistant) 3; delete 4, which blank rows and duplicates need; insert an empty user or
    assistant row 3; a row left with a text that breaks off 3 more. Rows are taken by turn, nulls first; rows of one turn by role and
    SHA-256 of the text. A null conversation id is a conversation of its own; roles other than s..., u... and a... can't be kept;
    repeated rows are duplicates, however many; an empty table gives no blocks; other columns are ignored.
    """
    blocks = blocks_of(rows, block_rows, block_bytes)
    sequences = written(blocks.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "sequences")
    found = grammar(sequences, rules)
    conv = rows.schema["conv"].dataType.simpleString()
    stats = [x.split()[0] for x in STATS.split(", ")]
    result = f"conv {conv}, pid int, k int, {SOLVED}, whole boolean, {STATS}"
    narrow = ["conv", "pid", "k", "symbols", "roles", "texts"]
    whole = blocks.where("whole").select(*narrow, "whole", *stats).mapInArrow(_solve_whole(found, conv), result)
    parts = blocks.where("not whole")
    matrices = parts.select("conv", "pid", "k", "symbols").mapInArrow(_matrices(found), f"conv {conv}, pid int, k int, cells array<struct<p:int,q:int,cost:bigint,audit:string>>")
    paths = written(matrices.repartition(task_count(rows.sparkSession), "conv").sortWithinPartitions("conv", "pid", "k").mapInArrow(_paths, "pid int, k int, state int, audit string, cost long"), "paths")
    pieces = parts.join(paths, ["pid", "k"]).select(*narrow, "state", "audit", "cost", "whole", *stats).mapInArrow(_solve_parts, result)
    return whole.unionByName(pieces)


def repaired_turns(blocks: DataFrame) -> DataFrame:
    """The rows of repaired conversations: conv, pid, k, i (their order), role, text."""
    return blocks.select("conv", "pid", "k", F.posexplode(F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))).alias("i", "_r")).select("conv", "pid", "k", "i", "_r.role", "_r.text")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_blocks long"


def _report(conv_type: pa.DataType):
    """Sorted blocks -> one row per conversation. Texts pass through a running SHA-256, which has to see them in order; nothing but the audit is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, sha, audit, done = None, False, None, [], []
        n: Counter = Counter()
        low = high = border = None
        end = ""

        def close():
            if begun:
                done.append((conv, 0 if low is None else high - low + 1 - n["turns"], n["blank"], n["duplicate"], n["truncated"], n["illegal"], n["cost"], "".join(audit), sha.hexdigest(), n["blocks"]))

        def out():
            types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [()] * 10, types, strict=True)], ["conv", *(x.split()[0] for x in REPORT.split(", "))])

        for batch in batches:
            for x in (dict(zip(batch.schema.names, r, strict=True)) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if not begun or x["conv"] != conv:
                    close()
                    conv, begun, sha, audit, n, low, high, border, end = x["conv"], True, hashlib.sha256(), [], Counter(), None, None, None, ""
                for role, text in zip(x["roles"], x["texts"], strict=True):
                    sha.update((("\n" if n["turn"] else "") + f"{role}:{text}").encode())
                    n["turn"] += 1
                for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                    n[c] += x[c]
                n["illegal"] += n["blocks"] > 0 and end + x["first"] not in LEGAL
                n["turns"] -= border is not None and border == x["first_turn"]
                if x["turns"]:
                    low, high, border = x["min_turn"] if low is None else min(low, x["min_turn"]), x["max_turn"] if high is None else max(high, x["max_turn"]), x["last_turn"]
                end = x["last"]
                n["blocks"] += 1
                audit.append(x["audit"])
            if len(done) >= 1024:
                yield out()
                done.clear()
        close()
        yield out()

    return run


def repair_report(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id with gaps, faults, cost, audit and the SHA-256 of the repaired `role:text` lines, for every value in convs.conv.

    Conversations of one block need no exchange. A conversation without rows has zeros, an empty audit and the digest of nothing.
    """
    kind = convs.schema["conv"].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    lines = F.array_join(F.transform(F.arrays_zip(F.col("roles").alias("r"), F.col("texts").alias("t")), lambda x: F.concat(x["r"], F.lit(":"), x["t"])), "\n")
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0)).cast("long")
    names = [x.split()[0] for x in REPORT.split(", ")]
    one = blocks.where("whole").select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"), F.lit(1).cast("long").alias("n_blocks"))
    many = blocks.where("not whole").repartition(task_count(blocks.sparkSession), "conv").sortWithinPartitions("conv", "pid", "k").mapInArrow(_report(arrow), f"conv {kind}, {REPORT}")
    found = one.select("conv", *names).unionByName(many).withColumnRenamed("conv", "_conv")
    out = convs.select("conv").distinct().join(found, F.col("conv").eqNullSafe(F.col("_conv")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return out.select(F.col("conv").alias("conv_id"), *(F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in names))


def conversation_repair(conversations: DataFrame, **options) -> DataFrame:
    """Damages `conversations`, repairs them, and reports each original conversation."""
    rows = shaped(conversations)
    return repair_report(repair(damaged(rows), **options), rows)
