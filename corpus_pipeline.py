"""A corpus pipeline over `documents`: quality rules, exact dedup, near-duplicate join, substring dedup, packing."""

from __future__ import annotations

from weftline.llm.common import table, written
from weftline.llm.exact_dedup import keep_first
from weftline.llm.ngram_join import keep_one_of_group
from weftline.llm.packing import best_fit_packing
from weftline.llm.quality_rules import keep_good
from weftline.llm.substring_dedup import without_repeats


def quality_stage(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark, docs, sf_dir):
    """Of equal texts, the one with the smallest id stays."""
    return keep_first(docs)


def near_stage(spark, docs, sf_dir):
    """Of each near-duplicate group, the document with the smallest id stays."""
    return keep_one_of_group(docs)


def substring_stage(spark, docs, sf_dir):
    """Repeated passages go from the texts; the documents stay."""
    return without_repeats(docs)


def packing_stage(spark, docs, sf_dir):
    """A place in a training sequence for every piece of every document that is left."""
    return best_fit_packing(docs)


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("n-gram join", near_stage), ("substring dedup", substring_stage), ("best-fit packing", packing_stage)]

#: The n-gram join, the forest and the tokenizer are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to `documents`, each written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs, f"stage{k}") if k + 1 < len(STAGES) else docs
    return docs
