"""Spatial joins and measures on edge tables.

Every join is an equality on grid cells, so Spark can hash, broadcast or split
skewed cells by itself, followed by a closed-form test per edge and a sum.  Edge
tables have one row per polygon edge: ``key, x1, y1, x2, y2``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemap.functions import geo as G
from changemap.operators.leaves import KEYS, Leaves


@dataclass(frozen=True)
class Grid:
    """A square grid: cell size, corner, and whether rows count from the north."""

    res: float
    x0: float = 0.0
    y0: float = 0.0
    north_up: bool = False

    def col(self, x: Column) -> Column:
        return G.cell(x, self.res, self.x0)

    def row(self, y: Column) -> Column:
        if self.north_up:
            return F.floor((F.lit(self.y0) - y) / self.res).cast("int")
        return G.cell(y, self.res, self.y0)

    def box(self, row: Column, col: Column) -> tuple[Column, Column, Column, Column]:
        """minx, miny, maxx, maxy"""
        left = F.lit(self.x0) + col * self.res
        low = F.lit(self.y0) - (row + 1) * self.res if self.north_up else F.lit(self.y0) + row * self.res
        return left, low, left + self.res, low + self.res


def bounds(edges: DataFrame, *keys: str) -> DataFrame:
    """Bounding box per key (of the whole table without keys)."""
    lo_hi = [
        F.min(F.least("x1", "x2")).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"),
        F.max(F.greatest("x1", "x2")).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy"),
    ]
    return edges.groupBy(*keys).agg(*lo_hi) if keys else edges.agg(*lo_hi)


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is never broadcast. Cells, edges and samples are made by
    exploding small rows, which Spark's size estimates do not see: by them it would send all to the driver."""
    return rows.hint("merge")


def with_bounds(edges: DataFrame, key: str) -> DataFrame:
    return edges.join(shuffled(bounds(edges, key)), key)


def _range(a: Column, b: Column) -> Column:
    return F.explode(F.sequence(F.least(a, b), F.greatest(a, b)))


def area_centroid(edges: DataFrame, key: str) -> DataFrame:
    """``area, cx, cy`` per polygon; sums run relative to the polygon's own corner
    so that large coordinates lose no digits."""
    e = with_bounds(edges, key)
    ax, ay = F.col("x1") - F.col("minx"), F.col("y1") - F.col("miny")
    bx, by = F.col("x2") - F.col("minx"), F.col("y2") - F.col("miny")
    cross = ax * by - bx * ay
    s = e.groupBy(key).agg(
        F.sum(cross).alias("_s"), F.sum((ax + bx) * cross).alias("_mx"), F.sum((ay + by) * cross).alias("_my"),
        F.min("minx").alias("_x"), F.min("miny").alias("_y"),
    )
    return s.select(
        key, (F.abs("_s") / 2).alias("area"),
        (F.col("_x") + F.col("_mx") / (3 * F.col("_s"))).alias("cx"),
        (F.col("_y") + F.col("_my") / (3 * F.col("_s"))).alias("cy"),
    )


def spheroid_area(edges: DataFrame, key: str) -> DataFrame:
    """Area in m2 of lon/lat polygons."""
    return edges.groupBy(key).agg(F.abs(F.sum(G.edge_spheroid_area())).alias("area"))


def to_utm(edges: DataFrame, zone: int) -> DataFrame:
    """Both ends of every edge from lon/lat to metres."""
    e1, n1 = G.to_utm(F.col("x1"), F.col("y1"), zone)
    e2, n2 = G.to_utm(F.col("x2"), F.col("y2"), zone)
    return edges.withColumns({"x1": e1, "y1": n1, "x2": e2, "y2": n2})


def table_utm_zone(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Zone and hemisphere of the centroid of all distinct points."""
    c = points.select(lon, lat).distinct().agg(F.avg(lon).alias("lon"), F.avg(lat).alias("lat"))
    return c.select(G.utm_zone(F.col("lon")).alias("zone"), G.is_north(F.col("lat")).alias("north"))


# --- point in polygon ---------------------------------------------------------


def _strips(edges: DataFrame, key: str, size: float) -> DataFrame:
    """Edges on every cell of their rows from the polygon's left end to their own right end."""
    e = with_bounds(edges, key)
    return e.withColumn("gy", _range(G.cell(F.col("y1"), size), G.cell(F.col("y2"), size))).withColumn(
        "gx", _range(G.cell(F.col("minx"), size), G.cell(F.greatest("x1", "x2"), size))
    )


def _decided(spread: DataFrame, key: str, at: list[str], size: float | Column) -> DataFrame:
    """What a point in a cell must be tested against, per polygon and cell (``at``) of ``size``.

    Cells without an edge of their own are inside or outside as a whole, decided
    once at their centre: inside ones get one row with ``inner`` set.  Cells with
    an edge get the edges of their row strip from the cell to the right.
    """
    spread = spread.withColumn("_own", F.col("gx") >= G.cell(F.least("x1", "x2"), size))
    mid = G.crosses_ray((F.col("gx") + 0.5) * size, (F.col("gy") + 0.5) * size)
    kinds = spread.groupBy(key, *at).agg(F.max("_own").alias("_own"), F.sum(mid).alias("_n"))
    coords = ["x1", "y1", "x2", "y2"]
    inner = kinds.where(~F.col("_own") & (F.col("_n") % 2 == 1)).select(
        key, *at, *[F.lit(None).cast("double").alias(c) for c in coords], F.lit(True).alias("inner")
    )
    border = spread.where(F.col("y1") != F.col("y2")).join(shuffled(kinds.where("_own").select(key, *at)), [key, *at])
    return inner.unionByName(border.select(key, *at, *coords, F.lit(False).alias("inner")))


def _on_leaves(edges: DataFrame, key: str, leaves: Leaves) -> DataFrame:
    """As ``_decided``, on cells that follow density: strips of split cells go on to their quarters."""
    meets = lambda s: F.col("gy").between(
        G.cell(F.least("y1", "y2"), s), G.cell(F.greatest("y1", "y2"), s)) & (F.col("gx") <= G.cell(F.greatest("x1", "x2"), s))
    spread = leaves.refine(_strips(edges, key, leaves.size), meets)
    return leaves.salted(_decided(spread, key, ["level", "gx", "gy"], leaves.size_at(F.col("level"))))


def points_in_polygons(
    points: DataFrame,
    edges: DataFrame,
    point_key: str,
    poly_key: str,
    cell_size: float,
    x: str = "x",
    y: str = "y",
    leaves: Leaves | None = None,
) -> DataFrame:
    """``point_key, poly_key`` for every point inside a polygon.

    Holes and multi-part polygons need no special care: inside means an odd number
    of edge crossings to the right. With ``leaves`` the cells follow the density of
    points instead of ``cell_size``; the result is the same.
    """
    p = points.select(point_key, F.col(x).alias("_px"), F.col(y).alias("_py")).where(
        F.col("_px").isNotNull() & F.col("_py").isNotNull()
    )
    if leaves is None:
        p = p.withColumns({"gx": G.cell(F.col("_px"), cell_size), "gy": G.cell(F.col("_py"), cell_size)})
        j = p.join(shuffled(_decided(_strips(edges, poly_key, cell_size), poly_key, ["gx", "gy"], cell_size)), ["gx", "gy"])
    else:
        j = leaves.place(p, F.col("_px"), F.col("_py"), point_key).join(shuffled(_on_leaves(edges, poly_key, leaves)), [*KEYS])
    # a point in an inner cell is decided where it stands; only border cells are counted
    decided = j.where("inner").select(point_key, poly_key)
    hits = F.sum(G.crosses_ray(F.col("_px"), F.col("_py"))).alias("_n")
    tested = j.where("NOT inner").groupBy(point_key, poly_key).agg(hits).where(F.col("_n") % 2 == 1)
    return decided.unionByName(tested.select(point_key, poly_key))


def point_in_polygon(
    points: DataFrame,
    edges: DataFrame,
    point_key: str,
    poly_key: str,
    cell_size: float,
    how: str = "left",
    x: str = "x",
    y: str = "y",
    leaves: Leaves | None = None,
) -> DataFrame:
    """Points with the polygon they lie in (``left``, ``inner``), or only those in
    any polygon (``left_semi``)."""
    return points.join(shuffled(points_in_polygons(points, edges, point_key, poly_key, cell_size, x, y, leaves)), point_key, how)


def assign_admin(
    points: DataFrame,
    edges: DataFrame,
    admin: DataFrame,
    point_key: str,
    poly_key: str,
    cell_size: float,
    **kw,
) -> DataFrame:
    """All admin names and ids of the unit containing the point, in one join."""
    pairs = points_in_polygons(points, edges, point_key, poly_key, cell_size, **kw)
    return points.join(shuffled(pairs.join(admin, poly_key)), point_key, "left")


def admin_hierarchy(adm3: DataFrame, adm1: DataFrame, adm2: DataFrame, names: Sequence[str]) -> DataFrame:
    """Lowest level with the ids of the two levels above, matched by name."""
    n1, n2 = names
    return adm3.join(adm1, n1).join(adm2, n2)


# --- overlaps -----------------------------------------------------------------


def grid_overlap(edges: DataFrame, key: str, grid: Grid) -> DataFrame:
    """``key, row, col, area`` for every grid cell a polygon covers in part.

    Each edge contributes to the cells of the columns it spans, from its own height
    down to the polygon's floor; the contributions add up to exact areas. Heights are
    taken from that floor where it is inside the cell, so that a flat floor adds nothing to round.
    """
    e = with_bounds(edges, key).where(F.col("x1") != F.col("x2"))
    top = F.greatest("y1", "y2")
    spread = e.withColumn("col", _range(grid.col(F.col("x1")), grid.col(F.col("x2")))).withColumn(
        "row", _range(grid.row(top), grid.row(F.col("miny")))
    )
    left, low, right, high = grid.box(F.col("row"), F.col("col"))
    share = G.box_edge_area(left, F.greatest(low, F.least("miny", high)), right, high)
    return spread.groupBy(key, "row", "col").agg(F.sum(share).alias("area")).where(F.col("area") > 1e-9)


def _boxes_by_cell(edges: DataFrame, key: str, size: float, margin: float = 0.0) -> DataFrame:
    """A polygon's box on every cell it covers, widened by ``margin``: one row a cell,
    however many edges the polygon has."""
    e = bounds(edges, key)
    lo = {c: G.cell(F.col(c) - margin, size) for c in ("minx", "miny")}
    hi = {c: G.cell(F.col(c) + margin, size) for c in ("maxx", "maxy")}
    return e.withColumn("gx", _range(lo["minx"], hi["maxx"])).withColumn("gy", _range(lo["miny"], hi["maxy"]))


def _pairs_on_leaves(points: DataFrame, edges: DataFrame, point_key: str, poly_key: str, radius: float, leaves: Leaves) -> DataFrame:
    """Points (``_px, _py``) with the boxes, widened by ``radius``, of the one leaf they lie in."""
    meets = lambda s: F.col("gx").between(G.cell(F.col("minx") - radius, s), G.cell(F.col("maxx") + radius, s)) & F.col("gy").between(
        G.cell(F.col("miny") - radius, s), G.cell(F.col("maxy") + radius, s))
    boxes = leaves.salted(leaves.refine(_boxes_by_cell(edges, poly_key, leaves.size, radius), meets))
    p = points.where(F.col("_px").isNotNull() & F.col("_py").isNotNull())
    return leaves.place(p, F.col("_px"), F.col("_py"), point_key).join(shuffled(boxes), [*KEYS])


def _with_edges(pairs: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Pairs whose boxes meet, with the edges of their polygon."""
    return pairs.join(shuffled(edges.select(key, "x1", "y1", "x2", "y2")), key)


def disk_overlap(
    points: DataFrame,
    edges: DataFrame,
    point_key: str,
    poly_key: str,
    radius: float,
    cell_size: float,
    x: str = "x",
    y: str = "y",
    leaves: Leaves | None = None,
) -> DataFrame:
    """``point_key, poly_key, area``: overlap of a disk around each point with polygons.

    A pair meets in several cells; it is evaluated in the lowest common one only. With ``leaves``
    a point stands in one cell, which follows density, and boxes are widened by the radius.
    """
    px, py = F.col("_px"), F.col("_py")
    p = points.select(point_key, F.col(x).alias("_px"), F.col(y).alias("_py"))
    meet = (px + radius > F.col("minx")) & (px - radius < F.col("maxx")) & (py + radius > F.col("miny")) & (py - radius < F.col("maxy"))
    if leaves is None:
        p = p.withColumn("gx", _range(G.cell(px - radius, cell_size), G.cell(px + radius, cell_size)))
        p = p.withColumn("gy", _range(G.cell(py - radius, cell_size), G.cell(py + radius, cell_size)))
        j = p.join(shuffled(_boxes_by_cell(edges, poly_key, cell_size)), ["gx", "gy"]).where(
            (F.col("gx") == F.greatest(G.cell(F.col("minx"), cell_size), G.cell(px - radius, cell_size)))
            & (F.col("gy") == F.greatest(G.cell(F.col("miny"), cell_size), G.cell(py - radius, cell_size)))
        )
    else:
        j = _pairs_on_leaves(p, edges, point_key, poly_key, radius, leaves)
    j = j.where(meet)
    j = _with_edges(j.select(point_key, "_px", "_py", poly_key), edges, poly_key)
    share = G.disk_edge_area(px, py, radius)
    return j.groupBy(point_key, poly_key).agg(F.sum(share).alias("area")).where(F.col("area") > 1e-9)


def within_distance(
    points: DataFrame,
    edges: DataFrame,
    point_key: str,
    poly_key: str,
    radius: float,
    cell_size: float,
    x: str = "x",
    y: str = "y",
    leaves: Leaves | None = None,
) -> DataFrame:
    """``point_key, poly_key`` for points inside a polygon or at most ``radius`` away."""
    px, py = F.col("_px"), F.col("_py")
    p = points.select(point_key, F.col(x).alias("_px"), F.col(y).alias("_py"))
    if leaves is None:
        p = p.withColumns({"gx": G.cell(px, cell_size), "gy": G.cell(py, cell_size)})
        j = p.join(shuffled(_boxes_by_cell(edges, poly_key, cell_size, radius)), ["gx", "gy"])
    else:
        j = _pairs_on_leaves(p, edges, point_key, poly_key, radius, leaves)
    j = j.where(
        px.between(F.col("minx") - radius, F.col("maxx") + radius)
        & py.between(F.col("miny") - radius, F.col("maxy") + radius)
    )
    j = _with_edges(j.select(point_key, "_px", "_py", poly_key), edges, poly_key)
    near = j.groupBy(point_key, poly_key).agg(
        F.sum(G.crosses_ray(px, py)).alias("_n"), F.min(G.edge_distance2(px, py)).alias("_d2")
    )
    return near.where((F.col("_n") % 2 == 1) | (F.col("_d2") <= radius * radius)).select(point_key, poly_key)


def _edge_cells(edges: DataFrame, size: float, prefix: str = "") -> DataFrame:
    """Edges on every cell they pass through, found row by row: the part of an edge within
    a row of cells spans an interval of columns, about two for a steep edge. The interval is widened
    by what rounding may take off it, so that two edges meet in the cell of a point they share."""
    x1, y1, x2, y2 = (F.col(prefix + c) for c in ("x1", "y1", "x2", "y2"))
    left, right, low, high = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)
    rows = edges.withColumn("gy", _range(G.cell(y1, size), G.cell(y2, size)))
    slope = F.when(y1 == y2, 0.0).otherwise((x2 - x1) / F.when(y1 != y2, y2 - y1))
    ends = [x1 + (F.least(F.greatest(low, e * size), high) - y1) * slope for e in (F.col("gy"), F.col("gy") + 1)]
    off = 1e-12 * (F.abs(x1) + F.abs(x2) + F.abs(y1 * slope) + F.abs(y2 * slope) + size)
    first = F.when(y1 == y2, left).otherwise(F.greatest(left, F.least(*ends) - off))
    last = F.when(y1 == y2, right).otherwise(F.least(right, F.greatest(*ends) + off))
    return rows.withColumn("gx", _range(G.cell(first, size), G.cell(last, size)))


def intersects(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell_size: float) -> DataFrame:
    """``a_key, b_key`` of polygons that touch: an edge crosses, or a corner of one
    lies in the other."""
    ea = _edge_cells(a.select(a_key, "x1", "y1", "x2", "y2"), cell_size)
    eb = _edge_cells(b.select(b_key, *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")]), cell_size, "b")
    j = ea.join(shuffled(eb), ["gx", "gy"])

    def side(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    c = {k: F.col(k) for k in ("x1", "y1", "x2", "y2", "bx1", "by1", "bx2", "by2")}
    s1 = side(c["x1"], c["y1"], c["x2"], c["y2"], c["bx1"], c["by1"])
    s2 = side(c["x1"], c["y1"], c["x2"], c["y2"], c["bx2"], c["by2"])
    s3 = side(c["bx1"], c["by1"], c["bx2"], c["by2"], c["x1"], c["y1"])
    s4 = side(c["bx1"], c["by1"], c["bx2"], c["by2"], c["x2"], c["y2"])
    boxes = (
        (F.greatest(c["x1"], c["x2"]) >= F.least(c["bx1"], c["bx2"]))
        & (F.greatest(c["bx1"], c["bx2"]) >= F.least(c["x1"], c["x2"]))
        & (F.greatest(c["y1"], c["y2"]) >= F.least(c["by1"], c["by2"]))
        & (F.greatest(c["by1"], c["by2"]) >= F.least(c["y1"], c["y2"]))
    )
    crossing = j.where(boxes & (s1 * s2 <= 0) & (s3 * s4 <= 0)).select(a_key, b_key)

    def corners(e: DataFrame, key: str) -> DataFrame:
        return e.select(F.col(key), F.col("x1").alias("x"), F.col("y1").alias("y")).withColumn(
            "_c", F.struct(key, "x", "y")
        )

    a_in_b = points_in_polygons(corners(a, a_key).distinct(), b, "_c", b_key, cell_size)
    b_in_a = points_in_polygons(corners(b, b_key).distinct(), a, "_c", a_key, cell_size)
    return (
        crossing.unionByName(a_in_b.select(F.col(f"_c.{a_key}").alias(a_key), b_key))
        .unionByName(b_in_a.select(a_key, F.col(f"_c.{b_key}").alias(b_key)))
        .distinct()
    )


def in_box(x: Column, y: Column, box: Sequence[float]) -> Column:
    """Point inside ``(minx, miny, maxx, maxy)``, borders included."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


# --- map tiles ----------------------------------------------------------------


def add_quadkey(points: DataFrame, zoom: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``tile_x, tile_y, qk`` of every point."""
    tx, ty = G.tile_of(*G.global_pixel(F.col(lon), F.col(lat), zoom))
    out = points.withColumns({"tile_x": tx, "tile_y": ty})
    return out.withColumn("qk", G.quadkey(F.col("tile_x"), F.col("tile_y"), zoom))


def tile_coverage(edges: DataFrame, key: str, zoom: int) -> DataFrame:
    """Tiles touched by each lon/lat polygon, with the share of the tile inside it.

    Columns: ``key, qk, tile_x, tile_y, zoom, minx, miny, maxx, maxy, area_fraction``.
    """
    e = with_bounds(edges, key).where(F.col("x1") != F.col("x2"))
    tx0, ty0 = G.tile_of(*G.global_pixel(F.col("minx"), F.col("maxy"), zoom))
    tx1, ty1 = G.tile_of(*G.global_pixel(F.col("maxx"), F.col("miny"), zoom))
    ex0, ey0 = G.tile_of(*G.global_pixel(F.least("x1", "x2"), F.greatest("y1", "y2"), zoom))
    ex1, _ = G.tile_of(*G.global_pixel(F.greatest("x1", "x2"), F.col("miny"), zoom))
    # the pixel rounding may shift an edge by one tile, so look one tile further
    xs = F.sequence(F.greatest(tx0, ex0 - 1), F.least(tx1, ex1 + 1))
    ys = F.sequence(F.greatest(ty0, ey0 - 1), ty1)
    spread = e.withColumn("tile_x", F.explode(xs)).withColumn("tile_y", F.explode(ys))
    box = G.tile_bounds(F.col("tile_x"), F.col("tile_y"), zoom)
    share = G.box_edge_area(box["minx"], box["miny"], box["maxx"], box["maxy"])
    tiles = spread.groupBy(key, "tile_x", "tile_y").agg(F.sum(share).alias("_a")).where(F.col("_a") > 1e-12)
    return tiles.select(
        key, G.quadkey(F.col("tile_x"), F.col("tile_y"), zoom).alias("qk"), "tile_x", "tile_y", F.lit(zoom).alias("zoom"),
        *[v.alias(k) for k, v in box.items()],
        (F.col("_a") / ((box["maxx"] - box["minx"]) * (box["maxy"] - box["miny"]))).alias("area_fraction"),
    )


def tile_grid(edges: DataFrame, key: str, zoom: int) -> DataFrame:
    """The tiles of ``tile_coverage`` without the share."""
    return tile_coverage(edges, key, zoom).drop("area_fraction")
