"""Exact deduplication by skew-safe combining.

Copies are folded three times, and each time rows count as equal only if their whole normalised contents are equal:

1. inside every map task (the map side of the first aggregate), so a task sends one row per content and salt however many copies it read;
2. per (salt, digest, content): a content that fills a third of the corpus is merged by `salts` tasks instead of one;
3. per (digest, content) over the salt winners, at most `salts` rows for each content.

The documents then look up their winner by digest; the lookup table has one row per digest, and a hot digest is a skewed join side
that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, text_or_empty


def normalised(text: str | Column) -> Column:
    """Runs of ASCII white space become one space; null is the empty text."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def combine(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16, digest=sha256) -> DataFrame:
    """One row per distinct content: `_digest`, `_content`, `keep_id` (smallest id, null if all are null) and `group_size`."""
    content = normalised(text)
    rows = docs.select(F.col(doc_id).alias("_id"), content.alias("_content"), digest(content).alias("_digest"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(salts)).alias("_salt"))
    salted = rows.groupBy("_salt", "_digest", "_content").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_digest", "_content").agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16, digest=sha256, by_content: bool = False) -> DataFrame:
    """Every row of `docs` with its group of equal texts.

    Returns doc_id, keep_id, group_size, kept and text_sha256 (the digest of the normalised text), one row per input row.

    Defined results: a null text is the empty text; an id that is null stays only if its whole group has null ids; repeated rows with
    one id and one text share the verdict (all kept or all dropped) and all count in group_size; other columns are ignored, whatever
    their names. An empty table gives an empty result. Two contents under one digest never merge: the lookup then stops with an error,
    or, with `by_content`, it compares contents as well and every digest, however weak, gives right groups.
    """
    groups = combine(docs, doc_id, text, salts, digest)
    content = normalised(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), digest(content).alias("_digest"), *([content.alias("_content")] if by_content else []))
    key = F.col("_digest").cast("binary").alias("_key")  # another expression than the groups are dealt by, so both sides are dealt anew and Spark can split a hot digest
    if by_content:
        found = rows.join(groups, ["_digest", "_content"])
    else:
        groups = groups.groupBy("_digest").agg(
            F.when(F.count(F.lit(1)) == 1, F.struct(F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size")))
            .otherwise(F.raise_error(F.lit("two contents share a digest; call exact_dedup(by_content=True)"))).alias("_g"))
        found = rows.withColumn("_key", key).join(groups.select(key, "_g"), "_key").select("doc_id", "_digest", "_g.keep_id", "_g.group_size")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_digest").alias("text_sha256"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """`docs` without the copies: one row of each group of equal texts, all columns unchanged.

    The rows themselves go through the three foldings, beside their normalised content; what the normalised form lost of the text
    travels as its white space alone. So no row moves again once its group's winner is known.

    Defined results: of equal texts the row with the smallest id stays, rows without an id come last; of rows that share that id, the one
    with the ASCII-least white space; of repeated rows one. A null text is equal to the empty one and stays null where it wins. Column
    names of any kind are kept; an empty table gives an empty result.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    content, column = normalised(text), lambda c: F.col(f"`{c}`")
    blanks = F.when(F.col(text) != content, F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"))
    others = [F.when(F.col(text).isNull(), True).alias(n) if c == text else column(c).alias(n) for n, c in zip(names, docs.columns, strict=True)]
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.coalesce(blanks, F.lit("")).alias("blanks"))
    rows = docs.select(F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), sha256(content).alias("digest"), content.alias("content"), order.alias("order"), F.struct(*others, blanks.alias("blanks")).alias("row"))
    best = lambda d, *keys: d.groupBy(*keys, "digest", "content").agg(F.min_by("row", "order").alias("row"), F.min("order").alias("order"))
    first = best(best(rows, "salt"))
    whole = F.array_join(F.zip_with(F.split("row.blanks", "x", -1), F.split(F.trim("content"), " ", -1), lambda gap, word: F.concat(gap, F.coalesce(word, F.lit("")))), "")
    back = F.when(F.col(f"row.{names[docs.columns.index(text)]}"), None).otherwise(F.coalesce(whole, "content"))
    return first.select(*(back.cast(docs.schema[c].dataType).alias(c) if c == text else F.col(f"row.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)))
