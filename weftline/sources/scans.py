"""Readers. A directory of per-record files is read once as a table; the file name becomes a key column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.core import col, text_or_null
from weftline.operators.layout import in_tasks
from weftline.operators.overlay import effective_overrides

OVERRIDE_KINDS = {"libraries": "library", "attractions": "attraction", "passes": "pass", "branches": "branch"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _with_corrupt(schema: str | T.StructType) -> T.StructType:
    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([*s.fields, T.StructField("_corrupt_record", T.StringType())])


def path_part(n: int) -> Column:
    """n-th folder (or file) name from the end of the file path; 1 is the file itself."""
    return F.try_element_at(F.split(F.col("_metadata.file_path"), "/"), F.lit(-n))


def scan_exploded(spark: SparkSession, glob: str, schema: str, array: str, platform_depth: int = 3, lines: bool = False) -> DataFrame:
    """JSON documents -> one row per array element, with the platform taken from the path and the element position.

    A file holds one document, or with ``lines`` one per line, which lets Spark deal a large file to many tasks.
    """
    d = spark.read.schema(schema).option("multiLine", not lines).json(glob).withColumn("platform", path_part(platform_depth))
    rest = [c for c in d.columns if c != array]
    return d.select(*rest, F.posexplode(array).alias("pos", "_e")).select(*rest, "pos", "_e.*")


def scan_keyed(spark: SparkSession, glob: str, schema: str, key_regex: str, keys: Sequence[str]) -> DataFrame:
    """Files whose names are keys: one scan, keys cut out of the path (group i -> keys[i])."""
    d = spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("_path", F.col("_metadata.file_path"))
    return keyed_by_path(d, key_regex, keys)


def keyed_by_path(df: DataFrame, key_regex: str, keys: Sequence[str], path: str = "_path") -> DataFrame:
    """Group i of the pattern in the column ``path`` as column keys[i], in front of the other columns; the path itself goes."""
    return df.select(*[F.regexp_extract(path, key_regex, i + 1).alias(k) for i, k in enumerate(keys)], *[c for c in df.columns if c not in keys and c != path])


def index_types(index: DataFrame, canonical: str = "canonical", rows: int | None = None, within: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Index rows (platform, library_id, pos, slug, canonical, pass_type, museum_hex) -> lookups by slug and by id; the later row wins.

    ``rows``, where known, lays out the shuffles (see ``layout.in_tasks``). ``within``: columns that follow from the library, by which the
    index is dealt already; the lookups carry them and are built in place."""
    own, keys = [*within, "platform", "library_id"], ["library_id", "key", *within, "platform"]
    laid = (lambda df: in_tasks(df, rows, *own, "key")) if rows is not None else (lambda df: df)
    entry = lambda key, o: F.struct(F.col(key).alias("key"), o.alias("_o"))
    both = F.explode(F.array(entry("slug", F.col("pos") * 2), entry(canonical, F.col("pos") * 2 + 1)))  # no union, which would forget the layout
    slugs = index.select(*own, "pass_type", both.alias("_e")).select(*own, "_e.key", "pass_type", "_e._o")
    by_slug = laid(slugs.filter(text_or_null("key").isNotNull())).groupBy(*keys).agg(F.max_by("pass_type", "_o").alias("pass_type"))
    by_id = laid(index.filter(text_or_null("museum_hex").isNotNull()).select(*own, F.col("museum_hex").alias("key"), "pass_type", "pos")).groupBy(*keys).agg(F.max_by("pass_type", "pos").alias("pass_type"))
    return by_slug, by_id


RECORD = "status string, source string, evidence string, note string"


def override_records(df: DataFrame, text: str) -> DataFrame:
    """JSON override record -> columns; the corrected value stays JSON text (strings unquoted) whatever its shape."""
    return df.withColumn("_r", F.from_json(text, RECORD + ", corrected_value string")).select(
        "kind", "id", "field", "_r.status", F.col("_r.corrected_value").alias("value"), "_r.source", "_r.evidence", "_r.note")


def scan_overrides(spark: SparkSession, root: str, consolidated: str | None = None) -> DataFrame:
    """Per-field override files (<kind folder>/<id>/<field>.json) with the consolidated {target: record} file winning."""
    d = spark.read.text(f"{root}/*/*/*.json", wholetext=True).withColumn("_kind", path_part(3)) \
        .withColumn("id", path_part(2)).withColumn("field", F.regexp_replace(path_part(1), r"\.json$", ""))
    kinds = F.create_map(*[F.lit(x) for kv in OVERRIDE_KINDS.items() for x in kv])
    files = override_records(d.withColumn("kind", F.try_element_at(kinds, F.col("_kind"))).filter(F.col("kind").isNotNull()), "value")
    if consolidated is None:
        return files
    one = spark.read.text(consolidated, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("target", "value"))
    p = F.split("target", ":", 3)
    listed = override_records(one.select(p[0].alias("kind"), p[1].alias("id"), p[2].alias("field"), "value"), "value")
    return effective_overrides(files, listed)


def seed_rows(df: DataFrame, text: str, schema: str, wrapper: str) -> DataFrame:
    """Seed texts, each a JSON list or an object holding the list under ``wrapper`` -> one row per entry, other columns kept.

    Text of neither form, null text and empty lists give no rows.
    """
    listed = f"array<struct<{schema}>>"
    entries = F.when(F.ltrim(text).startswith("["), F.from_json(text, listed)).otherwise(F.from_json(text, f"{wrapper} {listed}")[wrapper])
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(entries).alias("_s")).select(*rest, "_s.*")


def scan_seeds(spark: SparkSession, path: str, schema: str, wrapper: str) -> DataFrame:
    """Seed files read whole, in either form of ``seed_rows``."""
    return seed_rows(spark.read.text(path, wholetext=True), "value", schema, wrapper)


def explode_map(df: DataFrame, text: str, value_type: str = "string", under: str | None = None, names: tuple[str, str] = ("key", "value")) -> DataFrame:
    """Map-shaped JSON config -> rows; keys that start with an underscore are comments."""
    body = F.get_json_object(text, f"$.{under}") if under else col(text)
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(F.from_json(body, f"map<string,{value_type}>")).alias(*names)).filter(~F.col(names[0]).startswith("_"))


def scan_map(spark: SparkSession, path: str, value_type: str = "string", under: str | None = None) -> DataFrame:
    return explode_map(spark.read.text(path, wholetext=True), "value", value_type, under)


def scan_tolerant(spark: SparkSession, glob: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): malformed records (one per line) are kept aside, with their file, instead of failing the read."""
    d = spark.read.text(glob).withColumn("_file", F.col("_metadata.file_path"))
    good, bad = parse_tolerant(d, "value", schema)
    return good.drop("value"), bad


def parse_tolerant(df: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The same split for JSON text held in a column."""
    d = df.withColumn("_r", F.from_json(text, _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt_record").isNotNull()
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    return d.filter(~bad).select(*df.columns, *[F.col(f"_r.{n}").alias(n) for n in names]), d.filter(bad).select(*df.columns)


def unknown_fields(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Fields a locked schema does not know, with the number of records that carry them."""
    known = F.array(*[F.lit(f.name) for f in T.StructType.fromDDL(schema).fields])
    extra = F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), known)
    return df.select(F.explode(extra).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def _unlisted(v: Column, known: T.DataType, at: str) -> Column:
    """Distinct paths in one variant that ``known`` lacks, outermost unknown field only."""
    none = F.array().cast("array<string>")
    if isinstance(known, T.ArrayType):
        found = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: _unlisted(e, known.elementType, f"{at}[]"))
        return F.coalesce(F.array_distinct(F.flatten(found)), none)
    if not isinstance(known, T.StructType):
        return none
    fields, prefix = F.try_variant_get(v, "$", "map<string,variant>"), f"{at}." if at else ""
    own = F.array_except(F.coalesce(F.map_keys(fields), none), F.array(*[F.lit(f.name) for f in known.fields]))
    inner = [_unlisted(F.try_element_at(fields, F.lit(f.name)), f.dataType, prefix + f.name) for f in known.fields if isinstance(f.dataType, (T.StructType, T.ArrayType))]
    return F.concat(F.transform(own, lambda k: F.concat(F.lit(prefix), k)), *inner)


def unknown_paths(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Paths, of any depth, that a locked schema does not know, with the number of records that carry them; "[]" stands for list items.

    Every text is parsed once into a variant and compared inside its row, so one pass and one combinable count do. A field counts
    whatever its value, null included; fields below an unknown field are not listed again; a value of another kind than the schema's
    (a string for a list, say) hides nothing in other records. Malformed texts and nulls carry nothing; empty input gives no rows.
    """
    d = df.select(F.try_parse_json(text).alias("_v")).filter(F.col("_v").isNotNull())
    return d.select(F.explode(_unlisted(F.col("_v"), T.StructType.fromDDL(schema), "")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def scan_locked(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Strict read: a malformed record fails the job, an unknown field raises before anything is used."""
    extra = unknown_fields(spark.read.text(glob), "value", schema).limit(20).collect()  # names for the message only
    if extra:
        raise ValueError("unknown fields: " + ", ".join(sorted(r["field"] for r in extra)))
    return spark.read.schema(schema).option("mode", "FAILFAST").json(glob)


def scan_pages(spark: SparkSession, glob: str) -> DataFrame:
    """Saved pages <entity>.html / <entity>__<sub>.html -> (entity, page, html, source_url)."""
    from weftline.functions.text import source_marker
    d = spark.read.text(glob, wholetext=True).withColumn("page", F.regexp_replace(path_part(1), r"\.html$", ""))
    return d.select(F.split_part("page", F.lit("__"), F.lit(1)).alias("entity"), "page", F.col("value").alias("html"), source_marker("value").alias("source_url"))


def seed_rosters(spark: SparkSession, rosters: dict[str, list[dict]]) -> DataFrame:
    """Literal branch rosters {library: [{slug, name, address, phone}]} -> branch rows."""
    rows = [(f"{lib}-{b['slug']}", lib, b["name"], b.get("address"), b.get("phone")) for lib, items in rosters.items() for b in items]
    return spark.createDataFrame(rows, "id string, library_id string, name string, address string, phone string")
