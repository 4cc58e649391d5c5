"""Spatial column expressions: tiles, UTM, and closed-form geometry per edge.

Polygons are edge rows ``x1, y1, x2, y2``; outer rings run counter-clockwise and
holes clockwise, so every formula is a sum over edges and needs no geometry type.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the public tile scheme and the WGS84 ellipsoid ------------
TILE_SIZE = 256
MIN_LAT, MAX_LAT = -85.05112878, 85.05112878
MIN_LON, MAX_LON = -180.0, 180.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_EAST = 500000.0
UTM_NORTH_SOUTH = 10000000.0
# -----------------------------------------------------------------------------


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def global_pixel(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator pixel of a position, half a pixel added, clipped to the map."""
    size = float(TILE_SIZE * 2**zoom)
    s = F.sin(_clip(lat, MIN_LAT, MAX_LAT) * F.lit(math.pi / 180))
    u = (_clip(lon, MIN_LON, MAX_LON) + 180.0) / 360.0
    v = F.lit(0.5) - F.log((1 + s) / (1 - s)) / F.lit(4 * math.pi)
    return _clip(u * size + 0.5, 0.0, size - 1), _clip(v * size + 0.5, 0.0, size - 1)


def tile_of(px: Column, py: Column) -> tuple[Column, Column]:
    return F.floor(px / TILE_SIZE).cast("int"), F.floor(py / TILE_SIZE).cast("int")


def quadkey(tx: Column, ty: Column, zoom: int) -> Column:
    """One digit per zoom level: bit of x plus twice the bit of y, highest first."""
    digits = [
        F.shiftright(tx, k).bitwiseAND(F.lit(1)) + F.shiftright(ty, k).bitwiseAND(F.lit(1)) * 2
        for k in range(zoom - 1, -1, -1)
    ]
    return F.concat(*[d.cast("string") for d in digits])


def tile_bounds(tx: Column, ty: Column, zoom: int) -> dict[str, Column]:
    """Longitude/latitude box of a tile: ``minx, miny, maxx, maxy``."""
    size = float(TILE_SIZE * 2**zoom)

    def lon(p: Column) -> Column:
        return (_clip(p, 0.0, size - 1) / size - 0.5) * 360.0

    def lat(p: Column) -> Column:
        y = F.lit(0.5) - _clip(p, 0.0, size - 1) / size
        return F.lit(90.0) - F.lit(360.0) * F.atan(F.exp(-y * F.lit(2 * math.pi))) / F.lit(math.pi)

    x0, y0 = tx * float(TILE_SIZE), ty * float(TILE_SIZE)
    return {"minx": lon(x0), "miny": lat(y0 + TILE_SIZE), "maxx": lon(x0 + TILE_SIZE), "maxy": lat(y0)}


def utm_zone(lon: Column) -> Column:
    return (((lon + 180.0) / 6.0).cast("int") % 60 + 1).cast("int")


def is_north(lat: Column) -> Column:
    return lat > 0


def to_utm(lon: Column, lat: Column, zone: Column | int) -> tuple[Column, Column]:
    """Easting and northing in metres (Krueger series to third order in n)."""
    f = WGS84_F
    n = f / (2 - f)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    z = F.lit(zone) if isinstance(zone, int) else zone
    dl = F.radians(lon) - F.radians(z * 6.0 - 183.0)
    phi = F.radians(lat)
    sp = F.sin(phi)
    t = F.sinh(F.atanh(sp) - e * F.atanh(sp * e))
    xi = F.atan2(t, F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(alpha, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    k = UTM_SCALE * radius
    return UTM_EAST + k * east, k * north + F.when(lat < 0, F.lit(UTM_NORTH_SOUTH)).otherwise(F.lit(0.0))


def cell(v: Column, size: float | Column, origin: float = 0.0) -> Column:
    """Integer grid index of a coordinate."""
    return F.floor((v - origin) / size).cast("int")


def crosses_ray(px: Column, py: Column, x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """1 when the edge crosses the ray from the point to +x, else 0."""
    x1, y1, x2, y2 = (F.col(c) for c in (x1, y1, x2, y2))
    at = F.try_divide((x2 - x1) * (py - y1), y2 - y1) + x1
    return F.when(((y1 > py) != (y2 > py)) & (px < at), 1).otherwise(0)


def box_edge_area(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One edge's signed share of the area of polygon and box ``[a,c] x [b,d]``.

    It is the area under the edge inside the box; the sum over all edges of a
    polygon is the area of the overlap.
    """
    x1, y1, x2, y2 = (F.col(k) for k in ("x1", "y1", "x2", "y2"))
    u = F.greatest(F.least(x1, x2), a)
    v = F.least(F.greatest(x1, x2), c)
    slope = F.try_divide(y2 - y1, x2 - x1)
    yu, yv = y1 + (u - x1) * slope, y1 + (v - x1) * slope

    def under(y: Column) -> Column:
        """Integral of the clamped height above the box floor."""
        h = F.least(F.greatest(y, b), d) - b
        return h * h / 2 + F.greatest(y - d, F.lit(0.0)) * (d - b)

    level = (F.least(F.greatest(yu, b), d) - b) * (v - u)
    sloped = F.try_divide((v - u) * (under(yv) - under(yu)), yv - yu)
    sign = F.when(x2 > x1, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(v > u, sign * F.when(F.abs(yv - yu) < 1e-12, level).otherwise(sloped)).otherwise(F.lit(0.0))


def disk_edge_area(cx: Column, cy: Column, r: Column | float) -> Column:
    """One edge's signed share of the area of polygon and disk."""
    r2 = F.lit(r) * F.lit(r) if not isinstance(r, Column) else r * r
    ax, ay = F.col("x1") - cx, F.col("y1") - cy
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    bx, by = ax + dx, ay + dy
    qa = dx * dx + dy * dy
    qb = ax * dx + ay * dy
    disc = qb * qb - qa * (ax * ax + ay * ay - r2)
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    s0 = F.when(disc > 0, _clip(F.try_divide(-qb - root, qa), 0.0, 1.0)).otherwise(F.lit(0.0))
    s1 = F.when(disc > 0, _clip(F.try_divide(root - qb, qa), 0.0, 1.0)).otherwise(F.lit(0.0))
    px, py = ax + s0 * dx, ay + s0 * dy
    qx, qy = ax + s1 * dx, ay + s1 * dy

    def sector(ux, uy, wx, wy):
        return F.atan2(ux * wy - uy * wx, ux * wx + uy * wy)

    return r2 / 2 * (sector(ax, ay, px, py) + sector(qx, qy, bx, by)) + (px * qy - py * qx) / 2


def edge_distance2(px: Column, py: Column) -> Column:
    """Squared distance from a point to the edge."""
    x1, y1 = F.col("x1"), F.col("y1")
    dx, dy = F.col("x2") - x1, F.col("y2") - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, _clip(F.try_divide((px - x1) * dx + (py - y1) * dy, len2), 0.0, 1.0)).otherwise(F.lit(0.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def shoelace() -> Column:
    """One edge's share of twice the signed area."""
    return F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")


def edge_spheroid_area() -> Column:
    """One edge's signed share of the area in m2 of a lon/lat polygon on the sphere
    of equal area, from the trapezoid between the edge and the equator."""
    e2 = WGS84_F * (2 - WGS84_F)
    e = math.sqrt(e2)
    authalic2 = WGS84_A**2 / 2 * (1 + (1 - e2) / e * math.atanh(e))

    def q(lat: Column) -> Column:
        """sin of the authalic latitude"""
        s = F.sin(F.radians(lat))
        return ((1 - e2) * (s / (1 - e2 * s * s) + F.atanh(s * e) / e)) / (1 + (1 - e2) / e * math.atanh(e))

    dlon = F.radians(F.col("x2")) - F.radians(F.col("x1"))
    return -dlon * (q(F.col("y1")) + q(F.col("y2"))) / 2 * authalic2
