"""Distances, local projection and lattice arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius, metres per degree, and the local plane's reference latitude.
EARTH_RADIUS_M = 6_371_000.0
M_PER_DEG = 111_320.0
LAT_REF = 47.5
PLANE_M_PER_DEG_LAT = 111_132.0
PLANE_M_PER_DEG_LON = 111_320.0 * math.cos(math.radians(LAT_REF))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                radius: float = EARTH_RADIUS_M) -> Column:
    h_lat = F.sin(F.radians(lat2 - lat1) / 2)
    h_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = h_lat * h_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * h_lon * h_lon
    root = F.sqrt(h)
    return F.lit(2 * radius) * F.asin(F.when(root > 1, F.lit(1.0)).otherwise(root))


def plane_x(lon: Column) -> Column:
    return lon * F.lit(PLANE_M_PER_DEG_LON)


def plane_y(lat: Column) -> Column:
    return lat * F.lit(PLANE_M_PER_DEG_LAT)


def point_segment_dist_sq(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared planar distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    len_sq = dx * dx + dy * dy
    along = (px - ax) * dx + (py - ay) * dy
    t = F.when(len_sq == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / len_sq)))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def point_segment_dist_m(plon: Column, plat: Column, alon: Column, alat: Column,
                         blon: Column, blat: Column) -> Column:
    """Distance in metres on a plane scaled at the point's own latitude."""
    k = F.lit(M_PER_DEG) * F.cos(F.radians(plat))
    d = F.lit(M_PER_DEG)
    return F.sqrt(point_segment_dist_sq(plon * k, plat * d, alon * k, alat * d, blon * k, blat * d))


def half_up(c: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity, the same way on every engine."""
    if digits == 0:
        return F.floor(c + F.lit(0.5))
    p = float(10 ** digits)
    return F.floor(c * F.lit(p) + F.lit(0.5)) / F.lit(p)


def exact_sum(c: Column) -> Column:
    """Order-independent sum of degrees (nano-degree decimals), so centroids and ids never wobble."""
    return F.sum(c.cast("decimal(18,9)")).cast("double")


def cell_polygon(w: Column, s: Column, e: Column, n: Column) -> Column:
    """GeoJSON Polygon geometry of one raster cell, as text."""
    pt = lambda x, y: F.concat(F.lit("["), fixed(x), F.lit(","), fixed(y), F.lit("]"))
    ring = F.concat_ws(",", pt(w, s), pt(e, s), pt(e, n), pt(w, n), pt(w, s))
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}"))


def fixed(c: Column, digits: int = 6) -> Column:
    """Fixed-point text of a coordinate."""
    return F.format_string(f"%.{digits}f", half_up(c, digits))
