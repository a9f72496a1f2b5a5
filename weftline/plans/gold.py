"""The four built tables and their gates, as lazy plans over normalized input tables.

Input columns are documented per function. All lookup sides are unique on their key, so no join multiplies rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions import benefit, weekly
from weftline.functions.core import cascade, first_truthy, map_codes, text_or_null
from weftline.functions.dates import restrictions_struct
from weftline.functions.labels import canonical_labels
from weftline.functions.prices import old_price_rows
from weftline.functions.text import address_struct, clean_title, humanize, last_segment, tighten
from weftline.operators import keys as K
from weftline.operators import layout, overlay, quality
from weftline.operators.matching import place_branches
from weftline.session import cut_lineage
from weftline.sources.scans import index_types

OWN = ["platform", "library_id", "attraction_rawslug"]
RESIDENCY = "struct<restricted:string,scope:string,source:string,evidence:string>"
PASS_FIELDS = {"pass_form": "string", "source_url": "string", "requires_own_card": "boolean", "eligibility_override": "string"}


def pass_form(block_text, catalog_text, platform, pass_type, old_form) -> Column:
    """Five signals, strongest first: offer text, catalog text (calendar platform only), index code, old extraction, default."""
    return _form_of(benefit.delivery_form(block_text), catalog_text, platform, pass_type, old_form)


def _form_of(block_form, catalog_text, platform, pass_type, old_form) -> Column:
    text = F.when(F.col(platform) == fx.CALENDAR_PLATFORM, benefit.delivery_form(catalog_text))
    return cascade(block_form, text, map_codes(pass_type, fx.PASS_TYPE_TO_FORM), old_form, F.lit("physical_coupon"))


def residency(block_text, old: Column, library: Column) -> Column:
    """Stated policy only: offer text, else the old stated 'yes', else the library-wide policy, else unknown."""
    return _residency_of(benefit.residency_from_block(block_text), old, library)


def _residency_of(stated: Column, old: Column, library: Column) -> Column:
    s = lambda v: v.cast("string")
    row = lambda r, sc, so, ev: F.struct(s(r).alias("restricted"), s(sc).alias("scope"), s(so).alias("source"), s(ev).alias("evidence"))
    none = F.lit(None)
    kept = F.when(old["restricted"] == "yes", row(old["restricted"], old["scope"], old["source"], old["evidence"]))
    blanket = F.when(library.isNotNull(), row(F.coalesce(library["restricted"], F.lit("yes")), library["scope"],
                                              F.coalesce(text_or_null(library["source"]), F.lit("library_pass_policy")), library["evidence"]))
    return F.coalesce(stated, kept, blanket, row(F.lit("unknown"), none, none, none))


SIDES = 2  # a task by library holds and sorts its passes and all their sides, so it gets half the passes


def task_column(spark: SparkSession, rows: int | None) -> str:
    """Name of the column that ``by_library`` adds; it tells layouts apart."""
    return "_task" if rows is None else f"_task_{layout.task_count(spark, SIDES * rows)}"


def by_library(df: DataFrame, rows: int | None = None, library: str = "library_id") -> DataFrame:
    """Rows dealt by their library's text into tasks laid out for ``rows`` passes, with the task as ``task_column`` (see ``layout.dealt``).

    Every key of the passes holds the library, so sides dealt like this meet on any of those keys without another shuffle. A library has
    at most one pass per attraction, which bounds its share of a task.
    """
    return layout.dealt(df, F.coalesce(F.col(library).cast("string"), F.lit("")), task_column(df.sparkSession, rows), None if rows is None else SIDES * rows)


def build_passes(catalog: DataFrame, index: DataFrame, old: DataFrame, auth: DataFrame, probes: DataFrame, days: DataFrame,
                 library_residency: DataFrame, overrides: DataFrame, aliases: DataFrame, rows: int | None = None) -> DataFrame:
    """Pass rows.

    Texts are read on the side they come from. Passes are shuffled twice, by slug for their canonical slug and by library for all the
    rest. ``rows``, where known, is about the number of passes and lays out the shuffles (see ``layout.in_tasks``). Sides that come from
    ``by_library`` with the same ``rows`` (they hold its column) stay where they are.

    catalog(platform, library_id, attraction_rawslug, detail_url, benefit_text, pass_type);
    index(platform, library_id, pos, slug, pass_type, museum_hex); old(OWN, status, pass_form, coupon, restrictions, residency);
    auth(library_id, slug, status, raw, capacity_kind, capacity_n, audience_policies, source_phrases, blackout_dates, weekdays_only, seasonal);
    probes(OWN, verdict, restricted, evidence, prober_card, probed_date); days(OWN, day, status), unique per day;
    library_residency(library_id, restricted, scope, source, evidence); overrides(kind, id, field, status, value); aliases(raw, canonical).
    """
    slugs = catalog.select(F.col("attraction_rawslug").alias("raw")).union(index.select("slug")).distinct()
    known = cut_lineage(K.canonical_key(slugs, "raw", aliases))  # resolved once; otherwise every lookup below would carry the alias plan
    laid = (lambda df, *by: layout.in_tasks(df, rows, *by)) if rows is not None else (lambda df, *by: df)
    named = lambda df, raw, out: laid(df, raw).join(known.select(F.col("raw").alias(raw), F.col("canonical").alias(out)), raw, "left")
    task = task_column(catalog.sparkSession, rows)
    dealt = lambda df: df if task in df.columns else by_library(df, rows)
    d = dealt(named(catalog, "attraction_rawslug", "attraction_slug")).withColumn("_target", overlay.target_key("library_id", "attraction_rawslug"))
    fixes = by_library(overlay.with_owners(overrides.filter(F.col("kind") == "pass"), "_owner"), rows, "_owner").drop("_owner")
    d = overlay.drop_removed(d, "_target", fixes, within=[task]).join(overlay.corrections_by_entity(fixes, list(PASS_FIELDS), "_target", within=[task]), ["_target", task], "left").drop("_target")
    by_slug, by_id = index_types(dealt(named(index, "slug", "canonical")), within=[task])
    d = d.withColumn("_hex", last_segment("detail_url"))
    # keys that begin alike are sorted once: first those with the canonical slug, then those with the raw one
    at = lambda key: ["library_id", key, task, "platform"]
    typed = lambda df, key, side, out: df.join(side.select(F.col("key").alias(key), task, "platform", "library_id", F.col("pass_type").alias(out)), at(key), "left")
    d = typed(typed(d, "_hex", by_id, "_t2"), "attraction_slug", by_slug, "_t1")

    # what an offer text states is read once per record
    said = lambda block: F.struct(benefit.delivery_form(block).alias("form"), benefit.residency_from_block(block).alias("residency"))
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    record = dealt(auth).select(task, "library_id", "slug", ok.alias("ok"), F.when(ok, benefit.coupon_struct("capacity_kind", "capacity_n", "audience_policies", "source_phrases", "raw")).alias("coupon"),
                                F.when(ok, restrictions_struct("blackout_dates", "weekdays_only", "seasonal")).alias("restrictions"), F.when(ok, said("raw")).alias("said"))
    d = K.lookup_first(d, record, [["library_id", "attraction_slug"], ["library_id", "attraction_rawslug"]], ["library_id", "slug"], ["ok", "coupon", "restrictions", "said"], "_a_", within=[task])

    # the sides with the passes' own key
    mine = at("attraction_rawslug")
    kept = dealt(old.filter(F.col("status") == "ok")).select(*mine, F.struct(F.coalesce("pass_form", F.lit("physical_coupon")).alias("pass_form"), "coupon", "restrictions", "residency",
                                                                            said(F.col("coupon.source_phrase_block")).alias("said")).alias("_v"))
    probed = dealt(probes).select(*mine, F.struct("verdict", "restricted", "evidence", "prober_card", "probed_date").alias("_v"))
    open_days = dealt(days).select(*mine, F.struct(F.col("day").cast("string").alias("k"), F.col("status").alias("v")).alias("_v"))
    d = typed(d, "attraction_rawslug", by_slug, "_t0")
    for side, fold, name in ((kept, F.first("_v", True), "_old"), (probed, F.first("_v", True), "_p"), (open_days, F.map_from_entries(F.array_sort(F.collect_list("_v"))), "availability")):
        d = d.join(side.groupBy(*mine).agg(fold.alias(name)), mine, "left")
    lib = dealt(library_residency).select(task, "library_id", F.struct("restricted", "scope", "source", "evidence").alias("_lib_policy"))
    d = d.join(lib, ["library_id", task], "left")

    ok = F.coalesce("_a_ok", F.lit(False))
    read = F.when(ok, F.col("_a_said")).otherwise(F.col("_old.said"))
    code = first_truthy(*[text_or_null(c) for c in ("pass_type", "_t0", "_t1", "_t2")])
    access = map_codes(F.col("_p.verdict"), fx.PROBE_TO_ACCESS)
    seen = lambda c: F.when(access.isNotNull(), F.col(f"_p.{c}"))
    own_card = F.coalesce(F.col("_p.restricted") == "yes", F.lit(False))
    corrections = [f"_over_{f}" for f in PASS_FIELDS]
    out = d.select(
        "platform", "library_id", "attraction_slug", "attraction_rawslug",
        _form_of(read["form"], F.col("benefit_text"), "platform", code, F.col("_old.pass_form")).alias("pass_form"),
        F.lit(True).alias("all_branches"), F.col("detail_url").alias("source_url"), F.when(ok, F.col("_a_coupon")).otherwise(F.col("_old.coupon")).alias("coupon"),
        F.coalesce("_a_restrictions", "_old.restrictions").alias("restrictions"),
        _residency_of(read["residency"], F.col("_old.residency"), F.col("_lib_policy")).alias("residency_restriction"),
        own_card.alias("requires_own_card"), F.when(own_card, F.col("_p.evidence")).alias("own_card_evidence"),
        F.struct(F.coalesce(access, F.lit("not_verified")).alias("verdict"), F.when(access.isNotNull(), F.lit("booking_probe")).alias("source"),
                 seen("evidence").alias("evidence"), seen("prober_card").alias("prober_card"), seen("probed_date").alias("probed_date")).alias("booking_access_probe"),
        F.coalesce("availability", F.create_map().cast("map<string,string>")).alias("availability"), F.lit(None).cast("string").alias("eligibility_override"), *corrections)
    return overlay.lay_over(out, PASS_FIELDS)


def coverage_gaps(passes: DataFrame, auth: DataFrame) -> DataFrame:
    """Passes that ship without an offer although an authoritative ok record exists under either key."""
    return quality.silent_drops(passes, "coupon", auth, [["library_id", "attraction_slug"], ["library_id", "attraction_rawslug"]], ["library_id", "slug"])


ARCHIVE = ("slug string, museum_name string, website string, phone string, address string, description string, categories array<string>, "
           "hero_image struct<og_image_url:string>, hours struct<regular_hours:map<string,string>>, original_price struct<"
           "age_pricing:map<string,struct<price:double,min_age:int,max_age:int>>,identity_pricing:map<string,struct<price:double>>,"
           "family:struct<price:double>,free_under_age:int>")


def archive_attractions(archive: DataFrame) -> DataFrame:
    """Archive records (schema ARCHIVE) -> enrichment rows: name, price rows, weekly hours and hero URL in the current shapes."""
    tiers = F.col("original_price")
    def field(name: str) -> Column:
        if name == "free_under_age":
            return tiers["free_under_age"]
        tier, part = name.rsplit("_", 1)
        if tier == "family":
            return tiers["family"]["price"]
        if tier in fx.IDENTITY_AUDIENCES:
            return F.try_element_at(tiers["identity_pricing"], F.lit(tier))["price"]
        return F.try_element_at(tiers["age_pricing"], F.lit(tier))[{"price": "price", "min": "min_age", "max": "max_age"}[part]]
    none = F.lit(None).cast("string")
    rows = F.transform(old_price_rows(field), lambda p: F.struct(
        p["audience"].alias("audience"), p["price"].alias("price"), none.alias("source_block"), none.alias("source_url"), p["min"].alias("age_min"),
        p["max"].alias("age_max"), p["phrase"].alias("source_phrase")))
    return archive.select("slug", text_or_null(F.trim("museum_name")).alias("name"), "website", "phone", "address", "description", "categories",
                          text_or_null(F.col("hero_image.og_image_url")).alias("hero_image"), rows.alias("prices"), weekly.convert_hours(F.col("hours.regular_hours")).alias("hours"))


def build_libraries(seeds: DataFrame, zips: DataFrame, archive: DataFrame, policies: DataFrame, overrides: DataFrame, evidence: DataFrame,
                    fields: Mapping[str, str] | None = None) -> DataFrame:
    """Library rows from seeds(id, name, town, network, platform, card_page, card_issuance_groups, card_auth_groups, address, geo),
    zips(town, zips), archive(id, address, geo), policies(id, card_eligibility, pass_pickup), evidence(id, source_block, source_phrase, source_url)."""
    d = seeds.join(zips.select("town", F.col("zips").alias("resident_zips")), "town", "left")
    d = d.join(archive.select("id", F.col("address").alias("_addr"), F.col("geo").alias("_geo")), "id", "left")
    d = d.join(policies.select("id", "card_eligibility", F.col("pass_pickup").alias("pass_pickup_default")), "id", "left")
    empty = F.array().cast("array<string>")
    groups = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array("network"))
    d = d.select("id", "name", "town", "network", "platform", "card_page", groups("card_issuance_groups").alias("card_issuance_groups"),
                 groups("card_auth_groups").alias("card_auth_groups"), F.coalesce("resident_zips", empty).alias("resident_zips"),
                 F.coalesce("address", "_addr").alias("address"), F.coalesce("geo", "_geo").alias("geo"),
                 F.coalesce("card_eligibility", F.lit("unknown")).alias("card_eligibility"), F.coalesce("pass_pickup_default", F.lit("unknown")).alias("pass_pickup_default"))
    d = overlay.apply_overrides(d, "id", overrides.filter(F.col("kind") == "library"), fields or {"card_eligibility": "string", "pass_pickup_default": "string"})
    ev = evidence.filter(F.length("source_block") > 0).select("id", F.struct(
        F.col("source_phrase").alias("evidence"), tighten("source_block").alias("block"), F.col("source_url").alias("source")).alias("card_evidence"))
    return d.join(ev, "id", "left")


def build_attractions(catalog: DataFrame, pages: DataFrame, prices: DataFrame, hours: DataFrame, archive: DataFrame, overrides: DataFrame,
                      evidence: DataFrame, aliases: DataFrame) -> DataFrame:
    """Attraction rows.

    catalog(attraction_slug raw, title, pos); pages(slug raw, url, title, og_image); prices(slug, status, prices); hours(slug, status, hours map);
    archive(slug, name, website, phone, address text, description, categories, hero_image, prices, hours map);
    evidence(slug, prices array of audience/source_block/source_url).
    """
    c = K.canonical_key(catalog.withColumnRenamed("attraction_slug", "raw"), "raw", aliases, "slug")
    p = K.canonical_key(pages.withColumnRenamed("slug", "raw"), "raw", aliases, "slug")
    universe = K.key_universe(c.select("slug"), p.select("slug"))
    titled = c.withColumn("title", F.trim("title")).filter(F.length("title") > 0)
    best = K.best_by(titled, "slug", "title", F.length("title"), "pos", "_catalog")
    page = p.groupBy("slug").agg(F.min_by(F.struct("url", "title", "og_image"), "raw").alias("_page"))
    def ok(df, value, name):
        t = K.canonical_key(df.withColumnRenamed("slug", "raw"), "raw", aliases, "slug")
        fetched = p.select("raw").distinct()
        return K.first_ok(t.join(fetched, "raw", "left_semi"), "slug", "raw", "status", [value]).withColumnRenamed(value, name)
    d = universe.join(best, "slug", "left").join(page, "slug", "left").join(ok(prices, "prices", "_prices"), "slug", "left").join(ok(hours, "hours", "_hours"), "slug", "left")
    a = archive.select("slug", F.struct(*[x for x in archive.columns if x != "slug"]).alias("_a"))
    d = d.join(a, "slug", "left")
    name = first_truthy(text_or_null(F.col("_a.name")), clean_title("_catalog"), clean_title(F.col("_page.title")), humanize("slug"))
    site = first_truthy(text_or_null(F.col("_page.url")), text_or_null(F.col("_a.website")))
    some = lambda col: F.when(F.size(col) > 0, F.col(col))
    d = d.select("slug", name.alias("name"), site.alias("website"), F.col("_a.phone").alias("phone"), address_struct(F.col("_a.address")).alias("address"),
                 F.col("_a.description").alias("description"), canonical_labels(F.col("_a.categories")).alias("categories"),
                 first_truthy(text_or_null(F.col("_a.hero_image")), F.col("_page.og_image")).alias("hero_image"),
                 F.coalesce(some("_prices"), some("_a.prices")).alias("prices"), weekly.pick_hours("_hours", F.col("_a.hours")).alias("hours"),
                 F.when(site.isNotNull(), F.array(site)).otherwise(F.array().cast("array<string>")).alias("sources"))
    mine = overrides.filter(F.col("kind") == "attraction")
    d = overlay.apply_overrides(d, "slug", mine, {"name": "string", "hours": "map<string,string>", "categories": "array<string>", "phone": "string", "website": "string"})
    d = d.withColumn("closed_days", weekly.closed_days("hours"))  # after the overlay, so corrected hours count
    ev = evidence.select("slug", F.col("prices").alias("_ev"))
    return d.join(ev, "slug", "left").withColumn("prices", F.when(F.col("_ev").isNotNull(), overlay.overlay_prices("prices", "_ev")).otherwise(F.col("prices"))).drop("_ev")


def build_branches(rosters: DataFrame, libraries: DataFrame, hits: DataFrame, overrides: DataFrame) -> DataFrame:
    """Branch rows(branch_id, library_id, name, lat, lon) with accepted coordinates and corrections by library__branch."""
    d = place_branches(rosters, libraries, hits)
    d = d.withColumn("_target", overlay.branch_target("library_id", "branch_id"))
    mine = overrides.filter(F.col("kind") == "branch")
    return overlay.apply_overrides(d, "_target", mine, {"name": "string", "lat": "double", "lon": "double"}).drop("_target")


def integrity_report(passes: DataFrame, libraries: DataFrame, attractions: DataFrame) -> DataFrame:
    """Unknown libraries, unknown attractions, duplicate pairs: everything that must stop a release."""
    return quality.run_checks(
        quality.rows_check(quality.orphans(passes, "library_id", libraries, "id"), "pass_unknown_library"),
        quality.rows_check(quality.orphans(passes, "attraction_slug", attractions, "slug"), "pass_unknown_attraction"),
        quality.rows_check(quality.duplicates(passes, ["library_id", "attraction_slug"]), "duplicate_pass_pair"))


def validation_report(libraries: DataFrame, attractions: DataFrame, passes: DataFrame) -> DataFrame:
    """Coverage metrics of the built tables as (table, metric, n, n_bad, pct) rows; one aggregate per table."""
    specs = [
        ("libraries", libraries, {"card_eligibility_unknown": F.col("card_eligibility") == "unknown", "pass_pickup_unknown": F.col("pass_pickup_default") == "unknown"}),
        ("attractions", attractions, {"prices_missing": F.col("prices").isNull() | (F.size("prices") == 0), "hours_missing": ~weekly.any_known("hours"), "categories_empty": F.size("categories") == 0}),
        ("passes", passes, {"coupon_missing": F.col("coupon").isNull(), "residency_unknown": F.col("residency_restriction.restricted") == "unknown",
                            "duplicate_audience": F.coalesce(F.size(F.array_distinct(_audiences())) != F.size(_audiences()), F.lit(False))}),
    ]
    out = None
    for name, df, metrics in specs:
        c = quality.coverage(df, metrics)
        rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col("n"), F.col(f"n_{m}").alias("n_bad"), F.col(f"pct_{m}").alias("pct")) for m in metrics]))
        part = c.select(F.lit(name).alias("table"), rows.alias("r")).select("table", "r.*")
        out = part if out is None else out.unionByName(part)
    return out


def _audiences() -> Column:
    return F.transform(F.col("coupon.audience_policies"), lambda p: F.to_json(F.struct(p["audience"].alias("a"), p["age_range"].alias("r"))))
