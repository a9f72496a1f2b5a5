"""Sharding along a Hilbert curve, with DataFrame functions only.

Each metadata dimension is cut at its exact quantiles into 2**bits intervals, the cell of a row gets its index on the Hilbert curve, rows
are sorted by that index and the order is cut into runs of equal length. Neighbours on the curve are neighbours in every dimension,
so each run covers a small box and a reader skips most files by their minima and maxima, whichever dimension it filters on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.core import let
from weftline.llm.common import task_count, text_or_empty, written


def sort_key(df: DataFrame, name: str) -> Column:
    """A value without nulls in the column's own order, null below everything: numbers as doubles, text and bytes whole, behind a mark."""
    if dict(df.dtypes)[name] in ("string", "binary"):
        return F.coalesce(F.concat(F.lit("x").cast("binary"), F.col(name).cast("binary")), F.lit("").cast("binary"))
    return F.coalesce(F.nullif(F.col(name).cast("double"), F.lit(float("nan"))), F.lit(float("-inf")))


def with_starts(runs: DataFrame, size: Column) -> DataFrame:
    """Per run of a range-partitioned table: the size of the runs before it, and of all; one row per run."""
    own = runs.groupBy("_run").agg(F.sum(size).alias("_size"))
    return own.select("_run", (F.sum("_size").over(Window.orderBy("_run")) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("_all"))


def boundaries(df: DataFrame, key: Column, parts: int) -> list:
    """The values at which the running share of all rows reaches 1/parts, 2/parts and so on, exactly: at most parts - 1 values, all that
    the driver ever sees of the data.

    Rows are counted per value first, so a hot value is one row from then on; the distinct values are range-partitioned and written,
    and the counts run on from one partition to the next.
    """
    counts = df.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    runs = written(counts.repartitionByRange(task_count(df.sparkSession), "_k").withColumn("_run", F.spark_partition_id()), "hilbert-values")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_run").orderBy("_k"))
    d = runs.join(with_starts(runs, F.col("_n")), "_run").withColumn("_upto", upto)
    reached = F.least(F.expr(f"_upto * {parts} div _all"), F.lit(parts - 1).cast("long"))
    return sorted(r[0] for r in d.filter(reached > F.expr(f"(_upto - _n) * {parts} div _all")).select("_k").collect())


def cell(key: Column, cuts: list) -> Column:
    """Number of boundaries below the value."""
    return reduce(lambda a, b: a + b, [(key > F.lit(c)).cast("long") for c in cuts], F.lit(0).cast("long"))


def curve_index(coordinates: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve through the cube of side 2**bits.

    The bits of all axes are taken from the highest down. Before each lower bit, the axes are turned so that the sub-cube is entered
    where the previous one was left; the Gray code of the resulting bits is undone at the end. Every step binds its state, so that an
    expression is evaluated once however often it is named.
    """
    n = len(coordinates)
    at = lambda s, i: F.element_at(s, i + 1)
    bit = lambda x, q: F.shiftright(x, q).bitwiseAND(F.lit(1).cast("long"))

    def turn(level, i):
        low = F.lit((1 << level) - 1).cast("long")

        def body(s):
            swap = at(s, 0).bitwiseXOR(at(s, i)).bitwiseAND(low)
            has = bit(at(s, i), level) == 1
            first = F.when(has, at(s, 0).bitwiseXOR(low)).otherwise(at(s, 0).bitwiseXOR(swap))
            own = F.when(has, at(s, i)).otherwise(at(s, i).bitwiseXOR(swap))
            return F.array(first, *(own if k == i else at(s, k) for k in range(1, n)))
        return body

    def gray(i):
        return lambda s: F.array(*(at(s, k).bitwiseXOR(at(s, k - 1)) if k == i else at(s, k) for k in range(n)))

    state = F.array(*(c.cast("long") for c in coordinates))
    for step in [*(turn(level, i) for level in range(bits - 1, 0, -1) for i in range(n)), *map(gray, range(1, n))]:
        state = let(state, step)
    flip = lambda x: reduce(lambda a, b: a.bitwiseXOR(b), [bit(x, q) * ((1 << q) - 1) for q in range(1, bits)], F.lit(0).cast("long"))
    state = let(state, lambda s: let(flip(at(s, n - 1)), lambda f: F.transform(s, lambda x: x.bitwiseXOR(f))))
    return let(state, lambda s: reduce(lambda out, qk: F.shiftleft(out, 1).bitwiseOR(bit(at(s, qk[1]), qk[0])), [(q, k) for q in range(bits - 1, -1, -1) for k in range(n)], F.lit(0).cast("long")))


def with_curve(df: DataFrame, dims: list[str], bits: int = 4, name: str = "hilbert") -> DataFrame:
    """`df` with the index of each row's cell on the curve."""
    keys = [sort_key(df, d) for d in dims]
    return df.withColumn(name, curve_index([cell(k, boundaries(df, k, 1 << bits)) for k in keys], bits))


def ranked(df: DataFrame, order: list[str], name: str = "rank", tag: str = "ranked") -> tuple[DataFrame, int]:
    """`df` with the place of each row, from 0, in the order of the given columns, without a window over all rows; and the number of rows.

    Rows are range-partitioned and written with the number of their run, so every later step sees one and the same layout; each run is
    numbered alone and starts after the rows of the runs before it (one row per run).
    """
    runs = written(df.repartitionByRange(task_count(df.sparkSession), *order).withColumn("_run", F.spark_partition_id()), tag)
    own = F.row_number().over(Window.partitionBy("_run").orderBy(*order)) - 1
    return runs.withColumn("_own", own).join(with_starts(runs, F.lit(1)).drop("_all"), "_run").withColumn(name, F.col("_before") + F.col("_own")).drop("_run", "_own", "_before"), runs.count()


def hilbert_shards(docs: DataFrame, dims: list[str], shards: int = 8, bits: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A shard and a place in it for every row, by the law `rows`: shards hold equal numbers of rows, at most one apart.

    Returns doc_id, size (UTF-8 bytes of the text and 1), text_crc32, law, shard, slot (gapless from 0 in curve order), grown_shard
    (null: it belongs to another law) and hilbert. Only these narrow columns are shuffled, never the texts.

    Defined results: null metadata counts as the smallest value, null text as empty; ties on the curve are ordered by doc_id (null
    first) and checksum, so equal rows are interchangeable; with fewer rows than shards some shards are empty; an empty table gives an
    empty result; other columns are ignored.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(text_or_empty(text)) + 1).cast("long").alias("size"), F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"), *(F.col(d).alias(f"_d{i}") for i, d in enumerate(dims)))
    order = ["hilbert", "doc_id", "text_crc32"]
    placed, total = ranked(with_curve(narrow, [f"_d{i}" for i in range(len(dims))], bits).drop(*(f"_d{i}" for i in range(len(dims)))), order, tag="hilbert")
    shard = F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def box_of_shards(shards: DataFrame, dims: list[str], shard: str = "shard") -> DataFrame:
    """Minimum and maximum of each dimension per shard: what a reader prunes files with."""
    return shards.groupBy(shard).agg(*(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))))
