"""Conversation repair, prefix token counts and hard negatives against brute-force versions, with nulls, ties, repeated rows and odd columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import conversation_repair, hard_negatives, token_counts
from weftline.llm.wordbpe import tokenizer_path

CONVERSATIONS = "conv_id long, turn long, role string, text string, conv long, pid int, k int, symbols string, _conv string, _hit int"
BLANK = " \t\n\x0b\x0c\r"


# conversations


def edits_of(rows, letters):
    """Cost and repaired rows of an audit, or None where it doesn't lead to `(s?(ua)+)?`."""
    cost, out, at = 0, [], 0
    for letter in letters:
        role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if letter == "I":
            cost += 3
            out.append((role, ""))
            continue
        if at == len(rows):
            return None
        (own, text, fault), at = rows[at], at + 1
        if letter == "D":
            cost += 4
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += (3 if letter == "R" else 0) + (3 if fault == "truncated" else 0)
        out.append((own if letter == "K" else role, text))
    if at < len(rows):
        return None
    initials = "".join(r[0][:1] or "-" for r in out)
    body = initials[1:] if initials[:1] == "s" else initials
    legal = len(body) % 2 == 0 and body == "ua" * (len(body) // 2) and (body or not initials)
    return (cost, out) if legal else None


def least_audit(rows):
    """Least (cost, audit), one row after the other."""
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def filled(best):
        for _ in range(4):
            for q, (c, a) in list(best.items()):
                for r in "ua":
                    if q in step[r]:
                        to = step[r][q]
                        best[to] = min(best.get(to, (1 << 60, "")), (c + 3, a + "I"))
        return best

    best = {0: (0, "")}
    for role, _, fault in rows:
        new = {}
        for q, (c, a) in filled(best).items():
            moves = [(q, 4, "D")]
            if fault not in ("blank", "duplicate"):
                moves += [(step[r][q], (3 if fault else 0) + (0 if e == "K" else 3), e) for r in step for e in "KR" if q in step[r] and (r == role[:1] if e == "K" else r != "s")]
            for to, cost, e in moves:
                new[to] = min(new.get(to, (1 << 60, "")), (c + cost, a + e))
        best = new
    return min(v for q, v in filled(best).items() if q in (0, 3))


def brute_repair(data):
    groups = defaultdict(list)
    for conv, turn, role, text in data:
        groups[conv]
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else text.translate({ord(c): None for c in ".!?"}) if hit == 2 else text
        groups[conv] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, told = set(), []
        for _, role, text in rows:
            bare = text.strip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role, text, fault))
        turns = {r[0] for r in rows if r[0] is not None}
        n = Counter(f for _, _, f in told)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        cost, audit = least_audit(told)
        kept = "\n".join(f"{r}:{t}" for r, t in edits_of(told, audit)[1])
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(kept.encode()).hexdigest())
    return out


def talks(rng, n, longest):
    data = []
    for conv in range(n):
        said = []
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["", None, " \n", "Yes.", "Who is it?", "no end", "Well , and", f"a{rng.randrange(9)}.", "ünd é!  "])
            said.append((conv if conv else None, rng.choice([turn, turn, turn, turn // 2, None]), role, text))
        data += said + said[: rng.randrange(2)]
    return data


def frame(spark, data):
    return spark.createDataFrame([(*r, 5, 6, 7, "x", "y", 8) for r in data], CONVERSATIONS)


@pytest.mark.parametrize(("block_rows", "rules"), [(512, 512), (3, 8), (1, 0)])
def test_repair_against_brute_force(spark, block_rows, rules):
    data = talks(random.Random(block_rows), 60, 40)
    got = conversation_repair.conversation_repair(frame(spark, data), block_rows=block_rows, rules=rules).drop("n_blocks").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_repair(data)


def test_audits_are_the_least_of_all(spark):
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "x", rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randrange(4))]
        every = ("".join(a) for n in range(7) for a in itertools.product("DIKR", repeat=n))
        least = min((found[0], a) for a in every if (found := edits_of(rows, a)))
        symbols = "".join("X" if f == "blank" else (r[0] if r[0] in "sua" else "o").upper() if f else (r[0] if r[0] in "sua" else "o") for r, _, f in rows)
        assert least == conversation_repair.Transfers(()).whole(symbols) == least_audit(rows)


def test_rules_share_matrices_and_change_nothing():
    rng = random.Random(4)
    turn, two, led = map(chr, (0xE000, 0xE001, 0xE002))
    rules = ((turn, "u", "a"), (two, turn, turn), (led, "s", two))
    small, large = conversation_repair.Transfers(()), conversation_repair.Transfers(rules)
    assert large.compress("suauaX") == led + "X"
    for _ in range(300):
        s = "".join(rng.choice("uauauaXsUAo") for _ in range(rng.randrange(60)))
        assert small.whole(s) == large.whole(s)
        flat = lambda m: {k: (c, conversation_repair.flat(a)) for k, (c, a) in m.items()}
        assert flat(small.matrix(s)) == flat(large.matrix(s))


def test_one_long_conversation_is_cut_and_many_equal_rows_fold(spark):
    data = [(7, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(3000)] + [(8, 1, "user", "again.")] * 3000 + [(9, None, None, None)]
    rows = conversation_repair.shaped(frame(spark, data))
    blocks = conversation_repair.repair(rows, block_rows=64)
    assert blocks.agg(F.max(F.length("audit"))).first()[0] <= 66
    got = {r.conv_id: r for r in conversation_repair.repair_report(blocks, rows).collect()}
    assert got[7].audit == "K" * 3000 and got[7].cost == 0 and got[7].n_blocks >= 3000 // 64
    assert (got[8].audit, got[8].duplicate) == ("K" + "D" * 2999 + "I", 2999) and got[9].audit == "D"
    turns = conversation_repair.repaired_turns(blocks).where("conv = 7").orderBy("pid", "k", "i").collect()
    assert [(r.role, r.text) for r in turns] == [r[2:] for r in data[:3000]]


def test_repair_of_an_empty_table(spark):
    assert conversation_repair.conversation_repair(frame(spark, [])).count() == 0


# token counts


@pytest.fixture(scope="module")
def counter():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    return token_counts.PrefixCounts(path, limit=200), lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


def test_every_prefix_has_the_count_of_the_tokenizer(counter):
    own, want = counter
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", " '", "'s", "'re", "'ll", "'", "é", "中文", "1", "23", ".", "!!", "--", "<|endoftext|>", "<|endo", "\x1c", "\x1c\x1c", "\x85", "Word,", "Thaterer.", "\U0001f600", "ing", "²", "٣", "\u0558", "\u3000", " \u0915\u094d"]
    for _ in range(700):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        counts = np.cumsum(np.frombuffer(own.steps(text), "i2")).tolist()
        assert counts == [want(text[:i]) for i in range(1, len(text) + 1)], text
    for text in ("x" * 40_000, "abcdef" * 3000, " " * 3000, "é中" * 2000):
        counts = np.cumsum(np.frombuffer(own.steps(text), "i2"))
        assert all(counts[i - 1] == want(text[:i]) for i in (*rng.sample(range(1, len(text)), 5), len(text)))


def test_pieces_are_those_of_the_tokenizer(counter):
    own, _ = counter
    for c in (*range(0x3400), *range(0xA000, 0xD800), *range(0xE000, 0x20000, 7)):
        text = "a{0}b1{0}2. {0}".format(chr(c))
        if not chr(c) in token_counts.BLANKS:
            assert [u for u, _ in own._units_of(text)] == [text[a:b] for _, (a, b) in own._cut.pre_tokenize_str(text)], hex(c)


class _Probes(dict):
    n = 0

    def get(self, *a):
        self.n += 1
        return super().get(*a)

    def __getitem__(self, k):
        self.n += 1
        return super().__getitem__(k)


def test_a_known_piece_is_read_at_once(counter):
    """Its steps are held with its last prefix; only the new end of a longer piece is worked out."""
    own, want = counter
    own.steps("Unbekanntheiten")
    held = own._prefixes
    try:
        for text, most in (("Unbekanntheiten", 1), ("Unbekanntheiten\u00fc", 9)):
            own._first.clear()
            own._prefixes = probes = _Probes(held)
            steps = np.frombuffer(own.steps(text), "i2")
            assert probes.n <= most
            assert np.cumsum(steps).tolist() == [want(text[:i]) for i in range(1, len(text) + 1)]
    finally:
        own._prefixes = held


def test_answers_come_from_the_store(spark, counter):
    _, want = counter
    rng = random.Random(2)
    long = " ".join(rng.choice(["some", "words.", "über", "a\nb", "<|endoftext|>", "1234"]) for _ in range(20_000))
    texts = [(1, long), (2, None), (3, ""), (None, "no id"), (1, long), (4, "many  blanks   "), (5, "x" * 70_000)]
    rows = spark.createDataFrame([(i, t, "s", [1], 3) for i, t in texts], "doc_id long, text string, steps string, starts array<int>, n_bytes long")
    store = token_counts.prefix_store(rows)
    got = token_counts.budget_answers(store, 1024).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter((i, len((t or "").encode()), want(t or ""), want(t or "") > 1024) for i, t in texts)
    for r in got:
        text = dict(texts)[r.doc_id] or ""
        assert want(text[: r.fitting_chars]) <= 1024 and (r.fitting_chars == len(text) or want(text[: r.fitting_chars + 1]) > 1024)
    r = store.where("doc_id = 5").first()
    assert len(r.steps) == 3 and all(token_counts.count_at(r.starts, r.steps, n) == want("x" * n) for n in (0, 1, 32768, 32769, 70_000))
    assert token_counts.token_counts(rows.limit(0)).count() == 0


def test_a_budget_reaches_the_last_prefix_that_fits():
    steps = [np.array([1, 1, 1, -2, 1], "i2").tobytes()]
    assert [token_counts.longest_within([0], [1], steps, b) for b in (0, 1, 2, 3)] == [0, 4, 5, 5]


# hard negatives


def brute_negatives(data, n_positives=5, n_negatives=3):
    rows = {}
    for i, vec, label in data:
        if i is None or label is None or vec is None or any(v is None or not np.isfinite(v) for v in vec):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        new = (label, [float(np.floor(256.0 * v)) for v in vec])
        rows[i] = min(rows.get(i, new), new)
    width = max((len(v) for _, v in rows.values()), default=0)
    rows = {i: (label, [int(x) for x in v] + [0] * (width - len(v))) for i, (label, v) in rows.items()}
    out = set()
    for a, (label, v) in rows.items():
        if a % 50:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in rows.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == label][:n_positives]:
            fit = [i for i in order if rows[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out |= {(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit[:n_negatives], 1)}
    return out


def vectors(rng, n, dims, spread):
    centres = rng.normal(size=(6, dims))
    return [(i, [float(np.float32(x)) for x in centres[i % 6] * spread + rng.normal(size=dims) * 0.4], int(i % 5)) for i in range(n)]


@pytest.mark.parametrize(("fan", "leaf", "group"), [(32, 2048, 4096), (4, 20, 3)])
def test_negatives_against_brute_force(spark, fan, leaf, group):
    rng = np.random.default_rng(fan)
    data = vectors(rng, 420, 6, 1.0)
    data += [(1000 + k, data[0][1], k % 3) for k in range(60)]  # copies of one vector, an anchor among them
    data += [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 6, 2), (903, [float("inf")] * 6, 2), (904, data[3][1], None), (None, data[3][1], 1), (950, [], 3), (905, [2.0, 1.0], 2), data[50], (100, [9.0] * 6, 4)]
    frame = spark.createDataFrame([(*r, "n", 1, b"x", 2) for r in data], "vec_id long, embedding array<float>, label int, node string, part int, vec binary, score long")
    got = hard_negatives.hard_negatives(frame, fan=fan, leaf=leaf, group=group).collect()
    assert {tuple(r) for r in got} == brute_negatives(data) and len(got) == len({tuple(r) for r in got})


def test_walks_leave_siblings_out(spark):
    data = vectors(np.random.default_rng(8), 1200, 5, 4.0)
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    tree = hard_negatives.build(hard_negatives.quantised(frame), fan=8, leaf=40)
    anchors = tree.leaves.where("vec_id % 50 = 0").select(F.col("vec_id").alias("anchor_id"), "vec", "square", F.lit(0.0).alias("low"), F.lit(200.0).alias("high"))
    read = hard_negatives.walk(tree, anchors)
    leaves = tree.parts.count()
    assert len(tree.levels) > 1 and tree.leaves.count() == 1200
    assert read.count() < 0.5 * leaves * anchors.count()  # and what was left out holds no row that near
    near = {(a.anchor_id, r.vec_id) for a in anchors.collect() for r in tree.leaves.collect() if np.sqrt(a.square + tree.long - 2 * (np.frombuffer(a.vec, "f8") @ np.frombuffer(r.vec, "f8"))) <= 200.0}
    reached = {(r.anchor_id, r.vec_id) for r in read.join(tree.leaves, "node").select("anchor_id", "vec_id").collect()}
    assert near <= reached


def test_scores_beyond_doubles_are_exact():
    x, y = np.array([[2.0**40, 3.0]]), np.array([[2.0**22, 1.0], [2.0**40, 0.0]])
    assert hard_negatives.scores(x, y).tolist() == [[(1 << 62) + 3, (1 << 63) - 1]]


def test_negatives_of_an_empty_table(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
