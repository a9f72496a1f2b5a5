"""Input views over the driver tables. One SQL text per view, valid in Spark and in DuckDB, so both sides start from the same rows.

The tables carry no offers, pages of venues or calendars, so these views compute such texts from the columns of whole tables; the
parameters of every text are columns too, which lets a query's SQL state the expected reading without any text matching.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.layout import in_tasks, spread_scan

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
        "benchmark", "labels", "conversations"]
_MONTHS = "January February March April May June July August September October November December"
_S = lambda c: f"CAST({c} AS STRING)"

VIEWS = {
    # a pass = one supplier (library) offering one part (attraction)
    "d_pass": "SELECT DISTINCT l_suppkey AS library_id, l_partkey AS attraction_id FROM {lineitem}",
    "d_key": f"""SELECT p_partkey, p_type, p_size, concat('part-', {_S('p_partkey')}) AS base,
        concat('part-', {_S('p_partkey')}, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-e-coupon' WHEN 2 THEN '-physical-pass' ELSE '-unknownx' END) AS raw
        FROM {{part}}""",
    "d_hand": f"""SELECT concat('part-', {_S('p_partkey')}) AS raw, concat('hand-', lower(p_brand)) AS canonical FROM {{part}} WHERE p_type = 'PROMO'""",
    "d_archive": f"""SELECT concat('part-', {_S('p_partkey')}) AS raw, concat('entity-', {_S('p_partkey - p_partkey % 2')}) AS canonical
        FROM {{part}} WHERE p_size > 10""",
    "d_alias": """SELECT raw, canonical FROM {d_hand} h UNION ALL
        SELECT a.raw, a.canonical FROM {d_archive} a WHERE NOT EXISTS (SELECT 1 FROM {d_hand} h2 WHERE h2.raw = a.raw)""",
    "d_catalog": """SELECT p.library_id, p.attraction_id, k.raw AS attraction_rawslug, k.base, k.p_size, k.p_type,
        CASE p.library_id % 3 WHEN 0 THEN 'wizard' WHEN 1 THEN 'libcal' ELSE 'login' END AS platform
        FROM {d_pass} p JOIN {d_key} k ON k.p_partkey = p.attraction_id""",
    "d_canon": """SELECT k.p_partkey, k.raw, coalesce(d.canonical, CASE WHEN k.p_partkey % 4 IN (1, 2) THEN s.canonical END, k.raw) AS canonical
        FROM {d_key} k LEFT JOIN {d_alias} d ON d.raw = k.raw LEFT JOIN {d_alias} s ON s.raw = k.base""",
    # offers in words; n, pct and d are the parameters
    "d_offer": f"""SELECT p_partkey, kind, n, pct, d, CASE kind
        WHEN 0 THEN concat('Pass admits up to ', {_S('n')}, ' people for ', {_S('pct')}, '% off regular museum admission rates.')
        WHEN 1 THEN concat({_S('n')}, ' free admissions for the family.')
        WHEN 2 THEN concat('Save $', {_S('d')}, ' off each ticket at the door.')
        WHEN 3 THEN concat('Visitors pay $', {_S('d')}, ' per person with this pass. Regular admission is $40.')
        WHEN 4 THEN 'Buy one get one on general tickets.'
        WHEN 5 THEN 'Discounted admission for cardholders.'
        WHEN 6 THEN 'Please select a date.'
        WHEN 7 THEN concat('Adults $', {_S('d + 10')}, ', children $', {_S('d')}, ' with the pass.')
        WHEN 8 THEN concat('Free parking for ', {_S('n')}, ' vehicles; display the pass in your vehicle.')
        WHEN 9 THEN 'The museum opened long ago. It holds a large collection. Walk the halls. See the garden. Enjoy the view. Pass benefits: free guest admission all year.'
        WHEN 10 THEN concat('Good for ', split_part('zero one two three four five six seven', ' ', CAST(n + 1 AS INT)), ' adults at half price.')
        ELSE 'A lovely place to spend the day.' END AS body
        FROM (SELECT p_partkey, p_partkey % 12 AS kind, 2 + p_size % 6 AS n, 10 + p_size AS pct, 1 + p_size % 20 AS d FROM {{part}}) b""",
    # stated rules in words
    "d_rule": f"""SELECT p_partkey, kind, d, month_no, CASE kind
        WHEN 0 THEN concat('Not valid in ', split_part('{_MONTHS}', ' ', CAST(month_no AS INT)), '. Monday through Friday.')
        WHEN 1 THEN 'Advance reservation requested.'
        WHEN 2 THEN 'Limit one pass per household. One booking per month.'
        WHEN 3 THEN concat('A late fee of $', {_S('d')}, ' applies.')
        WHEN 4 THEN 'Only Acton residents may reserve this pass.'
        WHEN 5 THEN 'Visitors must be Massachusetts residents to use it.'
        ELSE 'Enjoy.' END AS body
        FROM (SELECT p_partkey, p_partkey % 7 AS kind, 1 + p_size % 20 AS d, 1 + p_size % 12 AS month_no FROM {{part}}) b""",
    # two partly overlapping extraction sources
    "d_auth": """SELECT p.library_id, c.canonical AS slug, CASE WHEN min(s.s_acctbal) < 0 THEN 'failed' ELSE 'ok' END AS status,
        max(k.p_size) AS val FROM {d_pass} p JOIN {d_key} k ON k.p_partkey = p.attraction_id JOIN {d_canon} c ON c.p_partkey = k.p_partkey
        JOIN {supplier} s ON s.s_suppkey = p.library_id WHERE k.p_type IN ('PROMO', 'SMALL', 'LARGE') GROUP BY p.library_id, c.canonical""",
    "d_auth_raw": """SELECT p.library_id, k.raw AS slug, 'ok' AS status, k.p_size + 100 AS val
        FROM {d_pass} p JOIN {d_key} k ON k.p_partkey = p.attraction_id WHERE k.p_type IN ('SMALL', 'MEDIUM')""",
    # corrections: one per order, aimed at the customer of the order
    "d_override": f"""SELECT 'order' AS kind, {_S('o_orderkey')} AS id, CASE WHEN o_custkey % 2 = 0 THEN 'o_orderpriority' ELSE 'o_orderstatus' END AS field,
        CASE o_orderstatus WHEN 'F' THEN 'corrected' WHEN 'O' THEN 'noted' ELSE 'removed' END AS status,
        CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE concat('fixed-', o_orderpriority) END AS value FROM {{orders}}""",
    # two snapshots of the orders
    "d_today": f"""SELECT o_custkey AS file, {_S('o_orderkey')} AS slug, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS pass_type,
        o_orderpriority AS label, concat(o_orderpriority, CASE WHEN o_custkey % 3 = 0 THEN '  ship.' ELSE ' ship' END) AS benefits_text
        FROM {{orders}} WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')""",
    "d_prior": f"""SELECT o_custkey AS file, {_S('o_orderkey')} AS slug, o_orderstatus AS pass_type,
        CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_orderpriority END AS label,
        concat(o_orderpriority, CASE WHEN o_custkey % 5 = 0 THEN ' post' ELSE ' ship' END) AS benefits_text
        FROM {{orders}} WHERE NOT (o_orderpriority = '2-HIGH' AND o_orderstatus = 'P')""",
    # availability statements: one per event, the day part of the event's time is the day, the event id orders pages
    "d_day": """SELECT user_id AS pass_id, CAST(ts AS DATE) AS day, event_id AS page_no,
        CASE event_type WHEN 'signup' THEN 'available' WHEN 'purchase' THEN 'booked' WHEN 'error' THEN 'closed' ELSE 'unavailable' END AS status FROM {events}""",
    # opening hours per supplier, one value per day
    "d_hours": " UNION ALL ".join(f"""SELECT s_suppkey, {i} AS i, CASE (s_suppkey + {i} * (1 + s_suppkey % 2)) % 4 WHEN 0 THEN 'closed' WHEN 1 THEN '09:00-17:00'
        WHEN 2 THEN '10:00-17:30' ELSE 'unknown' END AS v FROM {{supplier}}""" for i in range(7)),
    "d_week": """SELECT s_suppkey, max(CASE WHEN i = 0 THEN v END) AS d0, max(CASE WHEN i = 1 THEN v END) AS d1, max(CASE WHEN i = 2 THEN v END) AS d2,
        max(CASE WHEN i = 3 THEN v END) AS d3, max(CASE WHEN i = 4 THEN v END) AS d4, max(CASE WHEN i = 5 THEN v END) AS d5, max(CASE WHEN i = 6 THEN v END) AS d6
        FROM {d_hours} h GROUP BY s_suppkey""",
    # places
    "d_library": """SELECT s_suppkey AS library_id, s_name AS name, n_name AS network, r_name AS area, s_acctbal,
        CASE WHEN s_acctbal < 0 THEN CAST(NULL AS DOUBLE) ELSE 42 + CAST(s_suppkey % 100 AS DOUBLE) / 100 END AS lat,
        CASE WHEN s_acctbal < 0 THEN CAST(NULL AS DOUBLE) ELSE -71 - CAST(s_suppkey % 80 AS DOUBLE) / 100 END AS lon
        FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey""",
    "d_branch": """SELECT c_custkey AS branch_id, s.s_suppkey AS library_id, c_name AS name, c_mktsegment AS segment, c_acctbal,
        42 + CAST(c_custkey % 90 AS DOUBLE) / 100 AS lat, -71 - CAST(c_custkey % 70 AS DOUBLE) / 100 AS lon
        FROM {customer} JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM {supplier} GROUP BY s_nationkey) s ON s.s_nationkey = c_nationkey""",
    # access facts per pass
    "d_access": """SELECT library_id, attraction_id, CASE (library_id + attraction_id) % 5 WHEN 0 THEN 'own_card_only' WHEN 1 THEN 'network_open' WHEN 2 THEN 'ambiguous' ELSE 'not_verified' END AS verdict,
        CASE (library_id + attraction_id) % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS restricted,
        CASE WHEN (library_id + attraction_id) % 4 = 0 THEN CASE WHEN attraction_id % 3 = 0 THEN 'town' ELSE 'ma' END END AS scope,
        CASE attraction_id % 3 WHEN 0 THEN 'digital_email' WHEN 1 THEN 'physical_coupon' ELSE 'physical_circ' END AS pass_form FROM {d_pass} p""",
    "d_card": """SELECT c_custkey AS card_id, c_mktsegment AS owner, s.s_suppkey AS library_id, c_name AS card_number, c_acctbal >= 0 AS enabled
        FROM {customer} JOIN (SELECT s_nationkey, max(s_suppkey) AS s_suppkey FROM {supplier} GROUP BY s_nationkey) s ON s.s_nationkey = c_nationkey""",
    # attempts per order, in line order
    "d_attempt": """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'accepted' ELSE 'rejected_resident' END
        WHEN 'R' THEN 'unknown' ELSE 'format_error' END AS verdict FROM {lineitem}""",
    "d_status": """SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'ok' WHEN '2-HIGH' THEN 'ok' WHEN '3-MEDIUM' THEN 'empty'
        WHEN '4-NOT SPECIFIED' THEN 'failed:timeout' ELSE 'failed:http:404' END AS status FROM {orders}""",
    # statuses of the pages' sites
    "d_url": """SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 503 WHEN 3 THEN 301 END AS status FROM {pages}""",
}

_PLACEHOLDER = re.compile(r"\{([a-z]\w*)\}")


def expand(sql: str) -> str:
    """DuckDB form of a text: {view} becomes its subquery, {table} the table's name."""
    return _PLACEHOLDER.sub(lambda m: f"({expand(VIEWS[m[1]])})" if m[1] in VIEWS else m[1], sql)


def _registered(spark: SparkSession, folder: str, name: str) -> str:
    """Name of the temporary view of a table or derived view; set up once per session and folder, so that files are listed and
    schemas read once."""
    alias = f"weft_{hashlib.md5(folder.encode()).hexdigest()[:8]}_{name}"
    if not spark.catalog.tableExists(alias):
        df = spark.read.parquet(f"{folder}/{name}.parquet") if name in BASE else LAID_OUT[name](spark, folder) if name in LAID_OUT else spark.sql(spark_sql(spark, folder, VIEWS[name]))
        df.createOrReplaceTempView(alias)
    return alias


def pass_rows(spark: SparkSession, folder: str) -> int:
    """Rows behind the passes, from which shuffles of passes are laid out."""
    return view(spark, folder, "lineitem").count()


def _passes(spark: SparkSession, folder: str) -> DataFrame:
    """``d_pass``, dealt by attraction: what is known of attractions joins without another shuffle of the passes."""
    lines = view(spark, folder, "lineitem").select(F.col("l_suppkey").alias("library_id"), F.col("l_partkey").alias("attraction_id"))
    return in_tasks(lines, pass_rows(spark, folder), "attraction_id").distinct()


#: Views whose shuffle is laid out by their row count; same rows as their SQL.
LAID_OUT = {"d_pass": _passes}


def spark_sql(spark: SparkSession, folder: str, sql: str) -> str:
    return _PLACEHOLDER.sub(lambda m: _registered(spark, folder, m[1]), sql)


def spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view made of one scan, dealt out over all cores for text work."""
    return spread_scan(view(spark, folder, name))


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.table(_registered(spark, folder, name))
