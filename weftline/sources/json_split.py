"""One large JSON map or list, read by many tasks and cut at its own record borders.

Spark's text reader already deals byte ranges of a file; with the comma as line separator every piece ends where a record may end. A
comma ends a record where the text before it has closed all its strings and all but ``level`` brackets. Both are prefix sums over the
pieces: inside a run of pieces of one byte range by a window, across runs by one row per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of pieces that windows sort and sum at once, whatever the size of the byte range it lies in.
RUN = 4096
BLOCK = ["file", "part", "start", "run"]
KEY = ["run", "range"]


def scan_pieces(spark: SparkSession, path: str, whole: str = "file") -> DataFrame:
    """Text between commas with its place: (file, part, start, seq, piece).

    ``whole``: "file" where each file is a document of its own, "folder" where the files of a folder, in the order of their names,
    make one document (a document that Spark wrote in parts).
    """
    d = spark.read.option("lineSep", ",").text(path)
    name = F.col("_metadata.file_path")
    last = F.substring_index(name, "/", -1)
    file, part = (name, F.lit("")) if whole == "file" else (name.substr(F.lit(1), F.length(name) - F.length(last) - 1), last)
    return d.select(file.alias("file"), part.alias("part"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("piece"))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _net(marks: Column) -> Column:
    """Brackets opened less brackets closed outside strings; the text begins outside."""
    bare = F.regexp_replace(marks, '"[^"]*(?:"|$)', "")
    return _count(bare, "[{") - _count(bare, "]}")


def _before(total: str, by: Window) -> Column:
    return F.coalesce(F.sum(total).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def records(pieces: DataFrame, level: int = 1) -> DataFrame:
    """Pieces -> (file, pos, text): whole records in document order, without the separating commas.

    ``level`` is the number of brackets open around a record: 1 for a document that is a map or a list, 0 for bare records. The brackets of
    the document itself are taken off its first and last record. Defined results: empty documents and documents of blanks give no rows, a
    comma at the end gives no record, commas and brackets inside strings separate nothing, escaped quotes don't end strings. The windows
    sort inside a run of at most ``RUN`` pieces, the one over runs has one short row per run, and pieces carry numbers instead of paths; a
    record is one row, as it is for its reader.
    """
    inside, runs = Window.partitionBy(*KEY).orderBy("seq"), Window.partitionBy("file").orderBy("part", "start", "run")
    d = pieces.withColumn("run", F.expr(f"seq div {RUN}")).withColumn("range", F.xxhash64("file", "part", "start"))
    d = d.withColumn("_m", F.regexp_replace("piece", r'(?s)\\.|[^"\[\]{}\\]+', ""))  # quotes and brackets; an escape never spans a comma
    marks = [_count(F.col("_m"), '"').alias("_q"), _net(F.col("_m")).alias("_out"), _net(F.concat(F.lit('"'), "_m")).alias("_in")]
    named = d.groupBy(*BLOCK, "range").agg(F.min("seq").alias("_first"))
    named = named.withColumn("doc", F.min("_first").over(Window.partitionBy("file"))).withColumn("ord", F.row_number().over(runs))
    d = d.select(*KEY, "seq", "piece", *marks).withColumn("_odd", _before("_q", inside) % 2)
    pick = lambda odd, when_out, when_in: F.when(odd == 0, when_out).otherwise(when_in)
    # what a run adds to the depth, for either state of its beginning
    size = d.groupBy(*KEY).agg(F.sum("_q").alias("_q"), F.sum(pick(F.col("_odd"), F.col("_out"), F.col("_in"))).alias("_if_out"), F.sum(pick(F.col("_odd"), F.col("_in"), F.col("_out"))).alias("_if_in"))
    by_doc = Window.partitionBy("doc").orderBy("ord")
    size = size.join(named.select(*KEY, "doc", "ord"), KEY).withColumn("_odd0", _before("_q", by_doc) % 2).withColumn("_d", pick(F.col("_odd0"), F.col("_if_out"), F.col("_if_in")))
    d = d.join(size.select(*KEY, "doc", "ord", "_odd0", _before("_d", by_doc).alias("_depth0")), KEY)
    d = d.withColumn("_odd", (F.col("_odd") + F.col("_odd0")) % 2).withColumn("_net", pick(F.col("_odd"), F.col("_out"), F.col("_in")))
    depth = F.col("_depth0") + F.sum("_net").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ends = (depth == level) & ((F.col("_odd") + F.col("_q")) % 2 == 0)
    d = d.select(*KEY, "doc", "ord", "seq", "piece", depth.alias("_depth"), ends.cast("long").alias("_end")).withColumn("_no", _before("_end", inside))
    cuts = d.groupBy(*KEY, "doc", "ord").agg(F.sum("_end").alias("_ends"))
    d = d.join(cuts.select(*KEY, _before("_ends", by_doc).alias("_no0")), KEY)
    place = F.struct("ord", "seq")
    r = d.groupBy("doc", (F.col("_no0") + F.col("_no")).alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct("ord", "seq", "piece"))).alias("_l"), F.max(F.struct(place.alias("at"), F.col("_depth").alias("left"))).alias("_left"))
    text = F.array_join(F.transform("_l", lambda x: x["piece"]), ",")
    text = F.when(F.col("pos") == 0, F.regexp_replace(text, rf"^\s*(?:[\[{{]\s*){{{level}}}", "")).otherwise(text)
    last = F.col("_left.left") < level  # only the document's end closes its own brackets
    r = r.select("doc", "pos", "_left", text.alias("text")).withColumn("text", F.trim(F.when(last, F.regexp_replace("text", rf"(?:\s*[\]}}]){{{level}}}\s*$", "")).otherwise(F.col("text"))))
    r = r.filter(~F.col("text").rlike(r"^\s*$"))
    return r.join(named.select("doc", "file").distinct(), "doc").select("file", "pos", "text")


def map_rows(recs: DataFrame) -> DataFrame:
    """Records of a map -> (file, pos, key, value), the value as JSON text (strings unquoted); keys that start with an underscore are comments."""
    entry = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,string>")
    return recs.select("file", "pos", F.explode(entry).alias("key", "value")).filter(~F.col("key").startswith("_"))


def scan_big_map(spark: SparkSession, path: str, whole: str = "file") -> DataFrame:
    """Map-shaped JSON files of any size -> rows (file, pos, key, value)."""
    return map_rows(records(scan_pieces(spark, path, whole)))


def scan_big_list(spark: SparkSession, path: str, schema: str, whole: str = "file") -> DataFrame:
    """List-shaped JSON files of any size -> rows (file, pos, fields of ``schema``)."""
    return records(scan_pieces(spark, path, whole)).select("file", "pos", F.from_json("text", schema).alias("_r")).select("file", "pos", "_r.*")
