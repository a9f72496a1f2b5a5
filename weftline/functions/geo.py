"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions.core import col


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(col(lon2) - col(lon1)) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return F.lit(2 * fx.EARTH_RADIUS_MILES) * F.asin(F.sqrt(a))


def accepted_hit(ok, lat, lon, anchor_lat, anchor_lon, max_miles: float = fx.MAX_BRANCH_MILES) -> Column:
    """STRUCT<lat,lon> when the lookup worked and lies near the anchor (or there is no anchor), else NULL."""
    near = col(anchor_lat).isNull() | (haversine_miles(anchor_lat, anchor_lon, lat, lon) <= max_miles)
    return F.when(col(ok) & near, F.struct(col(lat).alias("lat"), col(lon).alias("lon")))


def is_main_branch(name, branch_id) -> Column:
    return F.lower(F.trim(col(name))).isin(*fx.MAIN_BRANCH_NAMES) | F.coalesce(col(branch_id).endswith("-main"), F.lit(False))
