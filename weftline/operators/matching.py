"""Matrix, card matching, pickup expansion, probe planning and ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions.core import col, map_codes
from weftline.operators.keys import ranked_top
from weftline.session import cut_lineage


def join_dims(facts: DataFrame, dims: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Inner joins to key-unique dimensions."""
    out = facts
    for dim, key in dims:
        out = out.join(dim, key, "inner")
    return out


def matrix(facts: DataFrame, row: str, column: str, columns: Sequence, value: Column, rows: DataFrame | None = None) -> DataFrame:
    """Dense matrix: one row per row key, one column per listed column key, NULL where there is no fact.

    The column keys are given, so this is one aggregate without a cross join. ``rows`` (unique on ``row``) is the row dimension:
    every one of its keys has a row, also without any fact, and its other columns come along. ``matrix_grid`` is the long form.
    """
    cells = facts.groupBy(row).agg(*[F.max(F.when(F.col(column) == c, value)).alias(f"c_{c}") for c in columns])
    return cells if rows is None else rows.join(cells, row, "left")


def matrix_grid(rows: DataFrame, row: str, columns: Sequence[tuple], facts: DataFrame, column: str, audits: DataFrame, shown: Column | None = None) -> DataFrame:
    """Every cell of the matrix in long form, whatever its width: ``row``, library and branch of the column, cell and its flags.

    ``columns`` lists (column key, branch or None) pairs and is unfolded inside each row, so no tables are multiplied. A branch
    column shows the pass of its library only where it is picked up at branches (physical forms). ``facts`` holds pass_form,
    verdict, restricted and scope per (row, column) and ``audits`` a status per (row, column); several are reduced first.
    ``masked`` marks filled cells that the filter ``shown`` (over the facts' columns) hides.
    """
    key = dict(facts.dtypes)[column]
    pairs = F.array(*[F.struct(F.lit(c).cast(key).alias(column), F.lit(b).cast("string").alias("branch")) for c, b in columns])
    cells = facts.groupBy(row, column).agg(F.min(F.struct("pass_form", "verdict", "restricted", "scope")).alias("_c")).select(row, column, "_c.*").withColumn("_shown", F.lit(True) if shown is None else F.coalesce(shown, F.lit(False)))
    state = audits.groupBy(row, column).agg(F.bool_or(F.col("status") == "approved").alias("_approved"), F.bool_or(F.col("status") == "corrected").alias("_corrected"))
    grid = rows.select(row, F.explode(pairs).alias("_k")).select(row, "_k.*").join(cells, [row, column], "left").join(state, [row, column], "left")
    here = F.col("pass_form").isNotNull() & (F.col("branch").isNull() | F.col("pass_form").startswith("physical"))
    flag = lambda c: here & F.coalesce(c, F.lit(False))
    return grid.select(row, column, "branch", F.when(here, F.col("pass_form")).alias("pass_form"), F.when(here, F.col("verdict")).alias("verdict"),
                       flag(~F.col("_shown")).alias("masked"), flag(F.col("_approved")).alias("approved"), flag(F.col("_corrected")).alias("corrected"))


def matrix_cells(facts: DataFrame, row: str, column: str, value: Column) -> DataFrame:
    """The filled cells of the matrix in long form."""
    return facts.groupBy(row, column).agg(F.max(value).alias("cell"))


def branch_columns(libraries: DataFrame, branches: DataFrame, expanded: DataFrame) -> DataFrame:
    """Column headings: every library, then the branches of the expanded ones that have more than one."""
    libs = libraries.select("library_id", F.lit("lib").alias("kind"), F.lit(None).cast("string").alias("branch"))
    opened = branches.join(expanded.select("library_id").distinct(), "library_id", "left_semi")
    many = opened.groupBy("library_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("library_id")
    subs = opened.join(many, "library_id", "left_semi").select("library_id", F.lit("branch").alias("kind"), F.col("branch").cast("string").alias("branch"))
    return libs.unionByName(subs)


def cell_match(form=None, verdict=None, residency=None) -> Column:
    """Cell filter; unset criteria pass. 'town' keeps town-restricted passes, 'open' all others."""
    ok = F.lit(True)
    if form:
        ok = ok & (F.col("pass_form") == form)
    if verdict:
        ok = ok & F.coalesce(F.col("verdict") == verdict, F.lit(False))
    town = F.coalesce((F.col("restricted") == "yes") & (F.col("scope") == "town"), F.lit(False))
    if residency == "town":
        ok = ok & town
    if residency == "open":
        ok = ok & ~town
    return ok


def usable_cards(cards: DataFrame) -> DataFrame:
    """Cards with the required fields, disabled ones out."""
    return cards.filter(F.col("library_id").isNotNull() & F.col("card_number").isNotNull() & F.coalesce(F.col("enabled"), F.lit(True)))


def import_cards(cards: DataFrame, position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted with defaults, rejected). A card needs a library and a number.

    Rejected rows carry a ``reason`` with every missing field and, where a column tells the place of a row, its ``position``.
    """
    lacks = lambda c: ~F.coalesce(F.length(F.col(c).cast("string")) > 0, F.lit(False))
    missing = F.array_compact(F.array(*[F.when(lacks(c), F.lit(c)) for c in ("library_id", "card_number")]))
    good = cards.filter(F.size(missing) == 0).withColumns({"note": F.coalesce("note", F.lit("")), "enabled": F.coalesce(F.col("enabled"), F.lit(True))})
    bad = cards.filter(F.size(missing) > 0).withColumn("reason", F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    return good, bad if position is None else bad.withColumn("position", F.col(position))


def match_cards(passes: DataFrame, cards: DataFrame, libraries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per pass (and owner, with ``by``): usable cards that match exactly (same library) and by network (sibling library,
    unless the pass takes own cards only).

    Cards are counted per library and per network first, so the work is linear in cards + passes; no card-pass pairs are formed.
    """
    libs = libraries.select("library_id", "network")
    own = usable_cards(cards).groupBy(*by, "library_id").agg(F.count("*").alias("_own"))
    net = own.join(libs, "library_id", "inner").groupBy(*by, "network").agg(F.sum("_own").alias("_net"))
    j = passes.join(libs, "library_id", "inner").join(own, [*by, "library_id"], "left").join(net, [*by, "network"], "left")
    exact = F.coalesce("_own", F.lit(0))
    siblings = F.coalesce("_net", F.lit(0)) - exact
    closed = F.coalesce(F.col("verdict") == "own_card_only", F.lit(False))
    return j.withColumns({"n_exact": exact, "n_network": F.when(closed, F.lit(0)).otherwise(siblings)}).drop("_own", "_net")


def card_choice(passes: DataFrame, cards: DataFrame, libraries: DataFrame, card: str = "card_id", by: Sequence[str] = ()) -> DataFrame:
    """The best usable card per pass (and owner, with ``by``): one of the pass's own library before one of a sibling library in its
    network, then the smallest id. Adds ``card``, card_library and kind ('exact', 'network' or NULL).

    Cards are reduced to one per library and one per network first. Where a library has a card of its own it is taken, so the
    network's best card is only used where it belongs to a sibling; passes that take own cards only never get one.
    """
    libs = libraries.select("library_id", "network")
    best = usable_cards(cards).groupBy(*by, "library_id").agg(F.min(card).alias("_own"))
    net = best.join(libs, "library_id").groupBy(*by, "network").agg(F.min(F.struct(F.col("_own").alias("id"), "library_id")).alias("_net"))
    j = passes.join(libs, "library_id").join(best, [*by, "library_id"], "left").join(net, [*by, "network"], "left")
    open_ = ~F.coalesce(F.col("verdict") == "own_card_only", F.lit(False))
    sibling = F.when(F.col("_own").isNull() & open_, F.col("_net"))
    return j.withColumns({card: F.coalesce("_own", sibling["id"]), "card_library": F.when(F.col("_own").isNotNull(), F.col("library_id")).otherwise(sibling["library_id"]),
                          "kind": F.when(F.col("_own").isNotNull(), "exact").when(sibling.isNotNull(), "network")}).drop("_own", "_net")


def pickup_method(pass_type) -> Column:
    return F.when(col(pass_type).isin("physical-circ", "physical-coupon"), "physical_at_branch").otherwise("digital")


def expand_pickup(passes: DataFrame, branches: DataFrame, library: str = "library_id") -> DataFrame:
    """Pickup method per pass and, for physical ones, the number of located branches (all branches of the library hold it).

    The branch list itself stays a table of (library, branch) rows; copying it into every pass would multiply it.
    """
    located = branches.filter(F.col("lat").isNotNull()).groupBy(library).agg(F.count("*").alias("_n"))
    d = passes.join(located, library, "inner").withColumn("pickup_method", pickup_method("pass_type"))
    physical = F.col("pickup_method") == "physical_at_branch"
    return d.withColumns({"all_branches": physical, "n_branches": F.when(physical, F.col("_n")).otherwise(F.lit(0))}).drop("_n")


def probe_plan(passes: DataFrame, cards: Sequence[str]) -> DataFrame:
    """(pass, card) pairs to probe: the given short card list is unfolded inside each row that has a key and a URL."""
    labels = F.array(*[F.lit(c) for c in cards])
    usable = passes.filter((F.length("pass_key") > 0) & (F.length("source_url") > 0))
    return usable.withColumn("prober_card", F.explode(labels))


def assign_prober(libs: DataFrame, overrides: DataFrame, untestable: DataFrame, by_network: DataFrame) -> DataFrame:
    """Card used to probe each library: none if untestable, its own override, else the network default."""
    d = libs.join(untestable.select("library_id").distinct(), "library_id", "left_anti")
    d = d.join(overrides.select("library_id", F.col("card").alias("_own")), "library_id", "left")
    d = d.join(by_network.select("network", F.col("card").alias("_net")), "network", "left")
    return d.withColumn("prober", F.coalesce("_own", "_net")).drop("_own", "_net").filter(F.col("prober").isNotNull())


def resolve_retries(base: DataFrame, retry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocked results with the verdict of their retry; resolved when that verdict is conclusive."""
    j = base.join(retry.select(*keys, F.col("verdict").alias("retry_verdict")), list(keys), "left")
    return j.withColumn("resolved", F.coalesce(F.col("retry_verdict").isin(*fx.CONCLUSIVE_VERDICTS), F.lit(False)))


def roster_union(libs: DataFrame, multi: DataFrame) -> DataFrame:
    """Branches of multi-branch libraries, plus one '<library>--main' row for every other library; rows without a location are skipped."""
    known = multi.select("library_id").distinct()
    cols = ["branch_id", "library_id", "name", "address", "lat", "lon"]
    many = multi.filter(F.col("lat").isNotNull()).select(*cols)
    single = libs.join(known, "library_id", "left_anti").filter(F.col("lat").isNotNull() & (F.length("address") > 0)) \
        .withColumn("branch_id", F.concat(F.col("library_id").cast("string"), F.lit("--main"))).select(*cols)
    return many.unionByName(single)


def place_branches(branches: DataFrame, libraries: DataFrame, hits: DataFrame, max_miles: float = fx.MAX_BRANCH_MILES) -> DataFrame:
    """Coordinates per branch: own, else the first accepted geocode hit, else the library centroid for a main branch.

    ``hits`` holds (branch_id, attempt, ok, lat, lon). The distance guard runs before hits are reduced per branch.
    """
    from weftline.functions.geo import accepted_hit, is_main_branch
    libs = libraries.select("library_id", F.coalesce("town", "city", F.lit("Boston")).alias("town"), F.col("lat").alias("_llat"), F.col("lon").alias("_llon"))
    b = branches.join(libs, "library_id", "left")
    h = hits.select("branch_id", "attempt", "ok", F.col("lat").alias("_hlat"), F.col("lon").alias("_hlon"))
    tried = b.select("branch_id", "_llat", "_llon").join(h, "branch_id").withColumn("_hit", accepted_hit("ok", "_hlat", "_hlon", "_llat", "_llon", max_miles))
    best = tried.filter(F.col("_hit").isNotNull()).groupBy("branch_id").agg(F.min_by("_hit", "attempt").alias("_hit"))
    point = lambda la, lo: F.struct(F.col(la).alias("lat"), F.col(lo).alias("lon"))
    own = F.when(F.col("lat").isNotNull(), point("lat", "lon"))
    main = F.when(is_main_branch("name", F.col("branch_id").cast("string")) & F.col("_llat").isNotNull(), point("_llat", "_llon"))
    geo = F.coalesce(own, F.col("_hit"), main)
    return b.join(best, "branch_id", "left").withColumn("_geo", geo).select(
        "branch_id", "library_id", "name", "town", F.col("_geo.lat").alias("lat"), F.col("_geo.lon").alias("lon"))


def strength(form) -> Column:
    return map_codes(form, fx.FORM_STRENGTH, 0)


def rank_tags(df: DataFrame, by: Sequence[str], group: str, force: str, distance: str, tie: str, n: int = 4) -> DataFrame:
    """Offer tags per attraction and date: the best digital one, then physical, then loan passes by strength and distance; n in all."""
    order = [F.col(force).desc(), F.col(distance), F.col(tie)]
    d = df.withColumn("_g", F.when(F.col(group) == "digital", 0).when(F.col(group) == "physical", 1).otherwise(2))
    short = ranked_top(d, [*by, "_g"], order, n, "_r").filter((F.col("_g") > 0) | (F.col("_r") == 1)).drop("_r")
    return ranked_top(short, by, [F.col("_g"), *order], n, "tag_no").drop("_g")


def list_order(favourite: Column, has_pass: Column, field: Sequence) -> list[Column]:
    """Sort keys of the listing: favourites, then rows with a pass, then the chosen field."""
    return [F.when(favourite, 0).when(has_pass, 1).otherwise(2), *field]


def network_order(network, order: Sequence[str] | None = None) -> Column:
    """Position in the fixed display order; unknown networks come last."""
    names = order or fx.NETWORK_ORDER
    at = F.array_position(F.array(*[F.lit(n) for n in names]), col(network))
    return F.when(at > 0, at).otherwise(F.lit(len(names) + 1)).cast("int")


def _hash_ranked(df: DataFrame, key: Sequence[str], take: int) -> DataFrame:
    """The first ``take`` rows per pool by hash, with their rank.

    Hashes are cut into 4,096 ranges by their first digits. Counts per range say where each range starts in its pool, so ranges that
    start beyond ``take`` are never ranked, and the others are ranked side by side: no pool goes through one task.
    """
    d = df.withColumn("_b", F.substring("_h", 1, 3))
    w = Window.partitionBy("pool_no").orderBy("_b")  # one row per range of hashes
    starts = d.groupBy("pool_no", "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    d = d.join(starts.filter(F.col("_before") < take).drop("_n"), ["pool_no", "_b"])
    d = ranked_top(d, ["pool_no", "_b", "_before"], [F.col("_h"), *key], take, "_own")
    return d.withColumn("_rank", F.col("_before") + F.col("_own")).filter(F.col("_rank") <= take).drop("_b", "_before", "_own")


def seeded_pools(df: DataFrame, key: Sequence[str], pools: Mapping[str, tuple[Column, int]], seed: str) -> DataFrame:
    """Reproducible sample of each pool in turn, no row used twice; takes of any size.

    A pool can lose at most what earlier pools took, so its first sum-of-takes rows by hash decide everything: two passes over the
    data keep those. The pools are then dealt one after another from that short table, each without the picks before it; every step is
    checkpointed, so a lost executor costs one step. Keys count as equal by value, nulls included; each key should be one row.
    """
    total = sum(take for _, take in pools.values())
    tags = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(i).alias("pool_no"), F.lit(name).alias("pool")))
                                     for i, (name, (cond, _)) in enumerate(pools.items())]))
    d = df.select(*key, F.explode(tags).alias("_t")).select(*key, "_t.pool_no", "_t.pool")
    d = d.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), "pool", *key), 256))
    short = cut_lineage(_hash_ranked(d, key, total).drop("_rank"))
    picked = None
    for i, (_, take) in enumerate(pools.values()):
        free = short.filter(F.col("pool_no") == i)
        if picked is not None:
            taken = picked.select(*[F.col(k).alias(f"_t{j}") for j, k in enumerate(key)])
            free = free.join(taken, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_t{j}")) for j, k in enumerate(key)]), "left_anti")
        own = _hash_ranked(free, key, take).select("pool", F.col("_rank").cast("int").alias("pick_no"), *key)
        picked = cut_lineage(own if picked is None else picked.unionByName(own))
    return picked
