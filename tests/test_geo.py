import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from changemap.functions import geo as G
from changemap.operators import geo
from changemap.operators.geo import Grid

# concave outline with a square hole; outer counter-clockwise, hole clockwise
OUTER = [(0, 0), (100, 0), (100, 100), (50, 30), (0, 100)]
HOLE = [(40, 5), (40, 15), (60, 15), (60, 5)]


def ring_edges(ring):
    return [(float(a), float(b), float(c), float(d)) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])]


POLY = ring_edges(OUTER) + ring_edges(HOLE)


def edge_frame(spark, polys):
    rows = [(k, *e) for k, es in polys.items() for e in es]
    return spark.createDataFrame(rows, "poly string, x1 double, y1 double, x2 double, y2 double")


def inside(px, py, edges=POLY):
    n = 0
    for x1, y1, x2, y2 in edges:
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            n += 1
    return n % 2 == 1


@pytest.mark.parametrize("cell", [3.0, 10.0, 45.0, 500.0])
def test_point_in_polygon_equals_brute_force(spark, cell):
    rng = random.Random(3)
    # whole numbers put points on cell borders and on the heights of corners
    pts = [(i, rng.uniform(-10, 110), rng.uniform(-10, 110)) for i in range(600)]
    pts += [(1000 + i, float(rng.randrange(-5, 105)), float(rng.randrange(-5, 105))) for i in range(400)]
    p = spark.createDataFrame(pts, "id int, x double, y double")
    got = {r.id for r in geo.points_in_polygons(p, edge_frame(spark, {"a": POLY}), "id", "poly", cell).collect()}
    assert got == {i for i, x, y in pts if inside(x, y)}


def test_left_join_keeps_points_outside_and_nulls(spark):
    p = spark.createDataFrame([(1, 20.0, 20.0), (2, 50.0, 90.0), (3, None, 1.0)], "id int, x double, y double")
    out = {r.id: r.poly for r in geo.point_in_polygon(p, edge_frame(spark, {"a": POLY}), "id", "poly", 10.0).collect()}
    assert out == {1: "a", 2: None, 3: None}


def shoelace(edges):
    return abs(sum(a * d - c * b for a, b, c, d in edges)) / 2


@pytest.mark.parametrize("shift", [0.0, 3.5e6])
def test_area_and_centroid(spark, shift):
    sq = [(x1 + shift, y1 + shift, x2 + shift, y2 + shift) for x1, y1, x2, y2 in POLY]
    r = geo.area_centroid(edge_frame(spark, {"a": sq}), "poly").first()
    assert r.area == pytest.approx(shoelace(POLY), rel=1e-9)
    # centroid by a fine grid of the outline
    pts = [(x + 0.5, y + 0.5) for x in range(100) for y in range(100) if inside(x + 0.5, y + 0.5)]
    assert r.cx - shift == pytest.approx(sum(x for x, _ in pts) / len(pts), abs=0.3)
    assert r.cy - shift == pytest.approx(sum(y for _, y in pts) / len(pts), abs=0.3)


@pytest.mark.parametrize("grid", [Grid(10.0), Grid(7.3, x0=-3.0, y0=2.0), Grid(10.0, y0=205.0, north_up=True)])
def test_cell_parts_sum_to_the_polygon(spark, grid):
    o = geo.grid_overlap(edge_frame(spark, {"a": POLY}), "poly", grid)
    parts = o.collect()
    assert sum(r.area for r in parts) == pytest.approx(shoelace(POLY), rel=1e-9)
    assert max(r.area for r in parts) <= grid.res**2 + 1e-9


def test_rectangles_cover_cells_to_the_last_bit(spark, sf):
    """Scores of exactly the threshold hang on the last bit: a rectangle's part is the product of its sides in the cell."""
    from changemap.plans import fixtures as X

    box = {r.building_id: r for r in geo.bounds(X.edges(spark, sf), "building_id").collect()}
    for r in geo.grid_overlap(X.edges(spark, sf), "building_id", Grid(10.0)).collect():
        b, left, low = box[r.building_id], r.col * 10.0, r.row * 10.0
        assert r.area == (min(b.maxx, left + 10) - max(b.minx, left)) * (min(b.maxy, low + 10) - max(b.miny, low))


def test_overlap_of_one_cell_by_counting(spark):
    parts = {(r.row, r.col): r.area for r in geo.grid_overlap(edge_frame(spark, {"a": POLY}), "poly", Grid(20.0)).collect()}
    for (row, col), area in parts.items():
        n = sum(inside(col * 20 + i / 5 + 0.1, row * 20 + j / 5 + 0.1) for i in range(100) for j in range(100))
        assert area == pytest.approx(n / 25, abs=6.0)


def test_disk_overlap(spark):
    big = ring_edges([(-50, -50), (250, -50), (250, 250), (-50, 250)])
    e = edge_frame(spark, {"big": big, "shape": POLY})
    p = spark.createDataFrame([(1, 100.0, 100.0), (2, 50.0, 30.0), (3, 400.0, 0.0), (4, 50.0, 10.0)], "id int, x double, y double")
    got = {(r.id, r.poly): r.area for r in geo.disk_overlap(p, e, "id", "poly", 10.0, 16.0).collect()}
    assert got[1, "big"] == pytest.approx(math.pi * 100)
    assert (3, "big") not in got
    for pid, cx, cy in ((2, 50, 30), (4, 50, 10)):
        step = 0.05
        n = sum(
            inside(cx + (i + 0.5) * step, cy + (j + 0.5) * step)
            for i in range(-200, 200) for j in range(-200, 200)
            if math.hypot((i + 0.5) * step, (j + 0.5) * step) < 10
        )
        assert got[pid, "shape"] == pytest.approx(n * step * step, abs=0.5)


def test_within_distance_includes_the_border(spark):
    e = edge_frame(spark, {"b": ring_edges([(0, 0), (10, 0), (10, 10), (0, 10)])})
    p = spark.createDataFrame(
        [(1, 15.0, 5.0), (2, 15.1, 5.0), (3, 13.0, 14.0), (4, 5.0, 5.0), (5, 14.0, 14.0)], "id int, x double, y double"
    )
    assert {r.id for r in geo.within_distance(p, e, "id", "poly", 5.0, 8.0).collect()} == {1, 3, 4}


def test_intersects_covers_crossing_containment_and_distance(spark):
    a = edge_frame(spark, {
        "in": ring_edges([(10, 10), (12, 10), (12, 12), (10, 12)]),
        "cross": ring_edges([(-5, 50), (5, 50), (5, 52), (-5, 52)]),
        "around": ring_edges([(-50, -50), (200, -50), (200, 200), (-50, 200)]),
        "hole": ring_edges([(45, 8), (55, 8), (55, 12), (45, 12)]),
        "far": ring_edges([(300, 300), (310, 300), (310, 310), (300, 310)]),
    })
    b = edge_frame(spark, {"z": POLY}).withColumnRenamed("poly", "area")
    assert {r.poly for r in geo.intersects(a, b, "poly", "area", 20.0).collect()} == {"in", "cross", "around"}


def test_quadkey_and_bounds_of_known_tiles(spark):
    r = spark.range(1).select(
        G.quadkey(F.lit(3), F.lit(5), 3).alias("q"), G.tile_bounds(F.lit(0), F.lit(0), 1)["minx"].alias("w"),
        G.tile_bounds(F.lit(0), F.lit(0), 1)["miny"].alias("s"),
    ).first()
    assert r.q == "213" and r.w == -180.0 and abs(r.s) < 1e-9


@pytest.mark.parametrize("lon,lat,zone,east,north", [
    (-79.387139, 43.642567, 17, 630084.3, 4833438.6),
    (33.0, 0.0, 36, 500000.0, 0.0),
    (0.0, 51.0, 31, 289511.14, 5654109.2),
])
def test_utm_of_known_points(spark, lon, lat, zone, east, north):
    e, n = G.to_utm(F.lit(lon), F.lit(lat), zone)
    r = spark.range(1).select(e.alias("e"), n.alias("n"), G.utm_zone(F.lit(lon)).alias("z")).first()
    assert r.z == zone and r.e == pytest.approx(east, abs=1.0) and r.n == pytest.approx(north, abs=1.0)


def test_spheroid_area_of_one_degree_at_the_equator(spark):
    e = edge_frame(spark, {"d": ring_edges([(0, 0), (1, 0), (1, 1), (0, 1)])})
    # published value for the cell of one degree north-east of (0, 0): 12308.8 km2
    assert geo.spheroid_area(e, "poly").first().area == pytest.approx(12308.8e6, rel=1e-3)


def test_tile_coverage_sums_to_the_outline(spark):
    e = edge_frame(spark, {"a": [tuple(v / 500 + o for v, o in zip(q, (34.2, 31.3, 34.2, 31.3))) for q in POLY]})
    t = geo.tile_coverage(e, "poly", 13)
    box = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    assert t.agg(F.sum(F.col("area_fraction") * box)).first()[0] == pytest.approx(shoelace(POLY) / 250000, rel=1e-9)


def test_a_long_edge_lies_on_the_cells_it_passes(spark):
    n = 500
    e = spark.createDataFrame([(1, 3.1, 0.7, n * 10 - 2.3, n * 10 - 4.9), (2, 5.0, n * 10.0, 5.0, 0.0), (3, -7.0, 5.0, 90.0, 5.0)],
                              "k int, x1 double, y1 double, x2 double, y2 double")
    got = {r.k: r["count"] for r in geo._edge_cells(e, 10.0).groupBy("k").count().collect()}
    assert n <= got[1] <= 2 * n and got[2] == n + 1 and got[3] == 11


def test_edges_that_share_a_point_share_a_cell(spark):
    """Every pair of edges that touch, ends on cell borders and corners included, meets in a cell."""
    r = random.Random(11)
    at = lambda: r.choice([r.uniform(-40, 40), 10.0 * r.randrange(-4, 5), 5.0 * r.randrange(-8, 9)])
    edges = [(k, at(), at(), at(), at()) for k in range(120)]

    def side(p, q, t):
        v = (Fraction(q[0]) - Fraction(p[0])) * (Fraction(t[1]) - Fraction(p[1])) - (Fraction(q[1]) - Fraction(p[1])) * (Fraction(t[0]) - Fraction(p[0]))
        return (v > 0) - (v < 0)

    def touch(a, b):
        (p, q), (s, t) = ((a[1:3], a[3:5]), (b[1:3], b[3:5]))
        box = all(max(p[i], q[i]) >= min(s[i], t[i]) and max(s[i], t[i]) >= min(p[i], q[i]) for i in (0, 1))
        return box and side(p, q, s) * side(p, q, t) <= 0 and side(s, t, p) * side(s, t, q) <= 0

    cells = {}
    for x in geo._edge_cells(spark.createDataFrame(edges, "k int, x1 double, y1 double, x2 double, y2 double"), 10.0).collect():
        cells.setdefault(x.k, set()).add((x.gx, x.gy))
    missed = [(a[0], b[0]) for a in edges for b in edges if a[0] < b[0] and touch(a, b) and not cells[a[0]] & cells[b[0]]]
    assert not missed
