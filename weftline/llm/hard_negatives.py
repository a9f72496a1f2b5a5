"""Hard-negative mining on a multiway hyperplane tree with sibling ranges.

Vectors are lifted to one length by one more coordinate, so a score (inner product with the anchor) is a distance: the higher, the
nearer. A node of the tree has `fan` split points; every vector goes to its nearest one, and each split point keeps the smallest and
largest distance to the vectors below every sibling. A search asks for the vectors whose distance to the anchor lies in an annulus (the
window of scores it wants). With the distance to a split point known, a sibling's range says which annuli it can meet; siblings that all
split points leave no room for are not visited. Leaves compute exact integer scores.

The tree is built level by level as Spark jobs; nodes above the leaf size split until they fit, and vectors that no split can tell apart
are dealt into parts. Anchors walk the tree level by level too: (anchor, node) rows meet their node's split points in a join. At the
leaves, blocks of bounded rows meet bounded groups of anchors. The driver sees counts per level only.

Positives take two walks: an anchor's own leaf bounds the distance of its fifth-best row, then all leaves within that bound are read.
Negatives take one walk per anchor over the union of its positives' windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import written

#: Slack of distances against rounding, relative to the common length.
SLACK = 1e-6
FRAME = "vec_id long, label long, vec binary"


def quantised(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, comps): components as floor(256 * x), doubles; labels moved on by one, modulo ten, where 7 divides the id.

    Rows without id, label or vector, and rows with a component that is null or not finite, take no part. An id on several rows stands for
    one of them, the least by label and vector.
    """
    scaled = F.transform(F.col(embedding).cast("array<double>"), lambda v: F.lit(256.0) * v)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), scaled.alias("_x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("_x").isNotNull()).where(F.forall("_x", finite))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    comps = F.transform("_x", lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v))  # larger doubles are whole
    return rows.select("vec_id", moved.alias("label"), comps.alias("comps")).groupBy("vec_id").agg(F.min(F.struct("label", "comps")).alias("_r")).select("vec_id", "_r.label", "_r.comps")


def _packed(width: int):
    """Components as little-endian doubles, zeros behind the shorter vectors, with their squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, square = [], []
            for row in batch.column(2):
                v = np.zeros(width)
                v[: len(row)] = row.values.to_numpy(zero_copy_only=False)
                vec.append(v.tobytes())
                square.append(float(v @ v))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vec, pa.binary()), pa.array(square, pa.float64())], ["vec_id", "label", "vec", "square"])

    return run


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "f8").reshape(len(column), width)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; products that doubles can't hold exactly are worked out as Python integers and held to 64 bits."""
    top = max(np.abs(x).max(initial=0.0), 1.0) * max(np.abs(y).max(initial=0.0), 1.0) * x.shape[1]
    if top < 2.0**53:
        return (x @ y.T).astype("i8")
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(x) @ whole(y).T, -(1 << 63), (1 << 63) - 1).astype("i8")


def distances(x: np.ndarray, y: np.ndarray, long: float) -> np.ndarray:
    """Distances of lifted vectors (both of squared length `long`) from their parts."""
    lift = lambda m: np.sqrt(np.maximum(long - (m * m).sum(1), 0.0))
    return np.sqrt(np.maximum(2 * long - 2 * (x @ y.T + np.outer(lift(x), lift(y))), 0.0))


# The tree


def _assign(width: int, long: float):
    """(vec_id, label, vec, square, node, points) -> the nearest split point, and the distances to all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec, nodes = matrix(batch.column(2), width), batch.column(4).to_pylist()
            child, dist = np.zeros(len(nodes), "i4"), [b""] * len(nodes)
            for rows, points in _by_node(nodes, batch.column(5)):
                d = distances(vec[rows], np.frombuffer(points, "f8").reshape(-1, width), long)
                child[rows] = d.argmin(1)
                for r, x in zip(rows, d, strict=True):
                    dist[r] = x.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(child), pa.array(dist, pa.list_(pa.float64()))], ["vec_id", "label", "vec", "square", "node", "child", "dist"])

    return run


def _by_node(nodes: list[str], values: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """Rows of each node, with the node's value (equal in all of its rows)."""
    order: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        order.setdefault(n, []).append(i)
    for rows in order.values():
        yield np.array(rows), values[rows[0]].as_py()


class Tree:
    """Tables of a built tree. `levels`: (node, points, spans) per level, at most fan x fan spans; `leaves`: (node, part, vec_id, label,
    vec, square), parts of at most `leaf` rows or so; `parts`: (node, n_parts) of the leaves."""

    def __init__(self, levels: list[DataFrame], leaves: DataFrame, parts: DataFrame, width: int, long: float):
        self.levels, self.leaves, self.parts, self.width, self.long = levels, leaves, parts, width, long


def _points(rows: DataFrame, large: DataFrame, fan: int) -> DataFrame:
    """(node, points): the `fan` different vectors of each large node with the least hashes, a fixed bounded choice."""
    first = Window.partitionBy("node").orderBy(F.xxhash64("vec"), "vec")
    chosen = rows.join(large.select("node"), "node").select("node", "vec").distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= fan)
    packed = chosen.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("_r", "vec"))).alias("_p"))
    return packed.select("node", F.aggregate("_p", F.lit(b""), lambda acc, x: F.concat(acc, x["vec"])).alias("points"))


def build(rows: DataFrame, fan: int = 32, leaf: int = 2048, depth: int = 12) -> Tree:
    """The tree of (vec_id, label, comps). Nodes split until they have at most `leaf` rows, can't be told apart, or lie `depth` levels deep."""
    found = rows.agg(F.max(F.size("comps")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    width = max(found["width"] or 1, 1)
    packed = written(rows.select("vec_id", "label", "comps").mapInArrow(_packed(width), f"{FRAME}, square double"), "vectors")
    long = float(packed.agg(F.max("square")).first()[0] or 0.0)
    now, levels, done = packed.withColumn("node", F.lit("")), [], []
    for _ in range(depth):
        counts = now.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("vec").alias("_a"), F.max("vec").alias("_b"))
        large = written(counts.where((F.col("n") > leaf) & (F.col("_a") != F.col("_b"))).select("node"), "large")
        if large.isEmpty():
            break
        points = written(_points(now, large, fan), "points")
        # a node's rows keep apart from its points: the join side has one row per node
        dealt = written(now.join(points.select("node", "points"), "node").select(*packed.columns, "node", "points").mapInArrow(_assign(width, long), f"{FRAME}, square double, node string, child int, dist array<double>"), "dealt")
        spans = dealt.select("node", "child", F.posexplode("dist").alias("i", "d")).groupBy("node", "i", "child").agg(F.min("d").alias("low"), F.max("d").alias("high"))
        ranges = spans.groupBy("node").agg(F.collect_list(F.struct("i", "child", "low", "high")).alias("spans"))  # fan * fan entries
        levels.append(written(points.join(ranges, "node"), "ranges"))
        done.append(now.join(large, "node", "left_anti").select("node", *packed.columns))
        now = written(dealt.select(*packed.columns, F.concat("node", F.lit("/"), F.col("child").cast("string")).alias("node")), "level")
    done.append(now.select("node", *packed.columns))
    leaves = done[0]
    for d in done[1:]:
        leaves = leaves.unionByName(d)
    parts = written(leaves.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("n_parts")), "parts")
    part = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("n_parts").cast("long")).cast("int")
    return Tree(levels, written(leaves.join(parts, "node").withColumn("part", part).drop("n_parts"), "leaves"), parts, width, long)


# Walks


def _siblings(width: int, long: float, own: bool):
    """(anchor_id, vec, square, low, high, node, points, spans) -> the children that the annulus [low, high] may meet, or only the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, child = [], []
            vec, nodes = matrix(batch.column(1), width), batch.column(5).to_pylist()
            square, low, high = (np.asarray(batch.column(i), "f8") for i in (2, 3, 4))
            spans = batch.column(7)
            for rows, points in _by_node(nodes, batch.column(6)):
                p = np.frombuffer(points, "f8").reshape(-1, width)
                d = np.sqrt(np.maximum(square[rows, None] + long - 2 * (vec[rows] @ p.T), 0.0))
                n = len(p)
                least, most = np.full((n, n), np.inf), np.full((n, n), -np.inf)
                for x in spans[rows[0]].as_py():
                    least[x["i"], x["child"]], most[x["i"], x["child"]] = x["low"], x["high"]
                full = np.isfinite(least[0])
                if own:
                    at = np.where(full, d, np.inf).argmin(1)
                    row += rows.tolist()
                    child += at.tolist()
                    continue
                slack = SLACK * (np.sqrt(long) + 1)
                for k in range(0, len(rows), 512):
                    some, e = rows[k : k + 512], d[k : k + 512, :, None]
                    near = np.maximum(e - most[None], least[None] - e).max(1)  # no row of the child is nearer,
                    far = (e + most[None]).min(1)  # or farther than this
                    a, b = np.nonzero(full & (near <= high[some, None] + slack) & (far >= low[some, None] - slack))
                    row += some[a].tolist()
                    child += b.tolist()
            at = pa.array(row, pa.int64())
            where = [f"{nodes[r]}/{c}" for r, c in zip(row, child, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(5)), pa.array(where, pa.string())], ["anchor_id", "vec", "square", "low", "high", "node"])

    return run


def walk(tree: Tree, anchors: DataFrame, own: bool = False) -> DataFrame:
    """(anchor_id, node) of the leaves that anchors (anchor_id, vec, square, low, high) have to read."""
    at, ended = anchors.select("anchor_id", "vec", "square", "low", "high").withColumn("node", F.lit("")), []
    for level in tree.levels:
        ended.append(at.join(level.select("node"), "node", "left_anti").select("anchor_id", "node"))
        at = at.join(level, "node").select("anchor_id", "vec", "square", "low", "high", "node", "points", "spans").mapInArrow(_siblings(tree.width, tree.long, own), "anchor_id long, vec binary, square double, low double, high double, node string")
        at = written(at, "walk")
    found = at.select("anchor_id", "node")
    for e in ended:
        found = found.unionByName(e)
    return found


def _with_parts(tree: Tree, met: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """(anchor_id, node) -> (anchor_id, node, part, chunk), and (node, part, chunk): chunks bound the anchors that meet a block at once."""
    sizes = met.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("n_chunks")).join(tree.parts, "node")
    chunk = F.pmod(F.xxhash64("anchor_id", F.lit(3)), F.col("n_chunks").cast("long")).cast("int")
    calls = met.join(sizes, "node").select("anchor_id", "node", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), chunk.alias("chunk"))
    calls = written(calls, "calls")
    return calls, calls.select("node", "part", "chunk").distinct().toDF("node", "part", "chunk")


def _best(width: int, most: int, wanted) -> object:
    """Cogroups of a block and its anchors -> at most `most` candidates per anchor; `wanted` yields (anchor row, mask and order over the block)."""

    def run(block: pa.Table, calls: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if block.num_rows and calls.num_rows:
            ids, labels = np.asarray(block["vec_id"]), np.asarray(block["label"])
            s = scores(matrix(calls["vec"].combine_chunks(), width), matrix(block["vec"].combine_chunks(), width))
            for key, row, mask in wanted(calls, ids, labels, s):
                at = np.flatnonzero(mask)
                if len(at):
                    order = at[np.lexsort((ids[at], -s[row][at]))[:most]]
                    out += ((*key, int(ids[i]), int(s[row][i])) for i in order)
        n = len(out[0]) if out else 0
        columns = list(zip(*out, strict=True)) if out else None
        names = wanted.names
        return pa.table({c: pa.array(columns[i] if n else [], pa.int64()) for i, c in enumerate(names)})

    return run


def _same_label(calls: pa.Table, ids: np.ndarray, labels: np.ndarray, s: np.ndarray):
    for r, (anchor, label) in enumerate(zip(calls["anchor_id"].to_pylist(), calls["label"].to_pylist(), strict=True)):
        yield (anchor,), r, (labels == label) & (ids != anchor)


_same_label.names = ("anchor_id", "vec_id", "score")


def _windows(low: int, high: int, unit: int):
    def wanted(calls: pa.Table, ids: np.ndarray, labels: np.ndarray, s: np.ndarray):
        for r, (anchor, label, positives) in enumerate(zip(calls["anchor_id"].to_pylist(), calls["label"].to_pylist(), calls["positives"].to_pylist(), strict=True)):
            for p in positives:
                t = p["score"]
                if low * t <= high * t:
                    least, most = -(-low * t // unit), high * t // unit
                    yield (anchor, p["vec_id"], t), r, (labels != label) & (s[r] >= least) & (s[r] <= most)

    wanted.names = ("anchor_id", "positive_id", "positive_score", "vec_id", "score")
    return wanted


def _search(tree: Tree, met: DataFrame, anchors: DataFrame, wanted, most: int, group: int, extra: list[str]) -> DataFrame:
    """Best `most` rows per key of `wanted` over the leaves that each anchor meets."""
    calls, blocks = _with_parts(tree, met, group)
    asked = calls.join(anchors.select("anchor_id", "vec", *extra), "anchor_id")
    rows = tree.leaves.join(blocks, ["node", "part"]).select("node", "part", "chunk", "vec_id", "label", "vec")
    key = ["node", "part", "chunk"]
    found = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_best(tree.width, most, wanted), ", ".join(f"{c} long" for c in wanted.names))
    keys = [c for c in wanted.names if c not in ("vec_id", "score")]
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _annulus(score: Column, long: float) -> Column:
    """Distance from the anchor at a score (its own lift is zero); null without one."""
    return F.when(score.isNotNull(), F.sqrt(F.greatest(F.col("square") + F.lit(long) - 2 * score.cast("double"), F.lit(0.0))))


def hard_negatives(table: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, unit: int = 100, fan: int = 32, leaf: int = 2048, group: int = 4096, **names: str) -> DataFrame:
    """For anchors (ids divisible by `every`) and their `n_positives` best other rows of the same label, the `n_negatives` best rows of another
    label whose score s satisfies low * p <= unit * s <= high * p, p the positive's score: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. Scores are exact; ties go to the smaller id.

    Defined results: see `quantised` for rows that take no part and for repeated ids; a shorter vector counts as followed by zeros; an
    anchor without positives, a negative p and an empty window give no rows; copies of a vector all count; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = written(quantised(table, **names), "quantised")
    tree = build(rows, fan, leaf)
    own = tree.leaves.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "vec", "square", F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"))
    anchors = written(own, "anchors")

    # the own leaf gives a bound on the last positive, and the bound says which other leaves may hold better ones
    first = _search(tree, walk(tree, anchors, own=True), anchors, _same_label, n_positives, group, ["label"])
    bound = first.groupBy("anchor_id").agg(F.when(F.count(F.lit(1)) == n_positives, F.min("score")).alias("_least"))
    bounded = written(anchors.join(bound, "anchor_id", "left").withColumn("high", F.coalesce(_annulus(F.col("_least"), tree.long), F.lit(float("inf")))).drop("_least"), "bounded")
    positives = _search(tree, walk(tree, bounded), bounded, _same_label, n_positives, group, ["label"])
    listed = positives.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"), F.max("score").alias("_top"), F.min(F.when(F.col("score") >= 0, F.col("score"))).alias("_low"))
    windows = anchors.drop("low", "high").join(listed, "anchor_id").where("_top >= 0")
    windows = written(windows.withColumn("low", _annulus(F.floor(F.col("_top") * high / unit), tree.long)).withColumn("high", _annulus(F.ceil(F.col("_low") * low / unit), tree.long)), "windows")
    found = _search(tree, walk(tree, windows), windows, _windows(low, high, unit), n_negatives, group, ["label", "positives"])
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
