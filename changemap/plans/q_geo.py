"""Queries: spatial joins, areas, tiles, pixels, buildings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions import geo as G
from changemap.functions.scalars import area_at_least
from changemap.operators import buildings as B
from changemap.operators import geo, obs, pixels, stats, windows
from changemap.operators.leaves import density_leaves
from changemap.plans import fixtures as X

GRID = geo.Grid(P.PIXEL_M)
ADMIN_CELL = 40.0
BUILDING_CELL = 32.0


# --- point in polygon -------------------------------------------------------------


def geo_point_in_polygon(spark, sf):
    """Every point with its district or null."""
    return geo.point_in_polygon(
        X.points(spark, sf).select("point_id", "x", "y"), X.polygons(spark, sf), "point_id", "poly_id", ADMIN_CELL
    )


def geo_point_in_polygon_dense(spark, sf):
    """Every point with its district or null, on cells that follow the density of points."""
    pts = X.points(spark, sf).select("point_id", "x", "y")
    return geo.point_in_polygon(
        pts, X.polygons(spark, sf), "point_id", "poly_id", ADMIN_CELL, leaves=density_leaves(pts, 4 * ADMIN_CELL)
    )


def geo_within_boundary(spark, sf):
    """Buildings of at least 50 m2 whose centroid lies in a district."""
    out = B.within_boundary(X.edges(spark, sf), X.polygons(spark, sf), "building_id", "poly_id", ADMIN_CELL)
    return out.withColumns(X.round6("area_m2", "cx", "cy"))


def geo_assign_admin(spark, sf):
    """All admin levels on every point in one spatial join."""
    region = X.table(spark, sf, "region")
    nation = X.table(spark, sf, "supplier").join(X.table(spark, sf, "nation"), F.col("s_suppkey") % 25 == F.col("n_nationkey"))
    adm = geo.admin_hierarchy(
        nation.select(F.col("s_suppkey").alias("poly_id"), F.col("n_name").alias("adm3"), F.col("n_regionkey").alias("rk"),
                      F.concat(F.lit("g"), F.col("n_regionkey")).alias("adm2")),
        region.select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("adm1")),
        region.select(F.concat(F.lit("g"), F.col("r_regionkey")).alias("adm2"), F.concat(F.lit("2_"), F.col("r_regionkey")).alias("adm2_id")),
        ("rk", "adm2"),
    )
    pts = X.points(spark, sf).select("point_id", "x", "y")
    return geo.assign_admin(pts, X.polygons(spark, sf), adm, "point_id", "poly_id", ADMIN_CELL)


def geo_intersects(spark, sf):
    """Buildings touching a district outline or lying in it."""
    return geo.intersects(X.edges(spark, sf), X.polygons(spark, sf), "building_id", "poly_id", ADMIN_CELL)


# --- measures ---------------------------------------------------------------------


def geo_area_centroid(spark, sf):
    return geo.area_centroid(X.edges(spark, sf), "building_id").withColumns(X.round6("area", "cx", "cy"))


def geo_bounds(spark, sf):
    return geo.bounds(X.edges(spark, sf), "building_id").withColumns(X.round6("minx", "miny", "maxx", "maxy"))


def geo_bounds_all(spark, sf):
    return geo.bounds(X.edges(spark, sf)).withColumns(X.round6("minx", "miny", "maxx", "maxy"))


def geo_utm(spark, sf):
    """Sites in metres, with their zone, at millimetres."""
    e, n = G.to_utm(F.col("lon"), F.col("lat"), 36)
    return X.sites(spark, sf).select(
        "site_id", G.utm_zone(F.col("lon")).alias("zone"), G.is_north(F.col("lat")).alias("north"),
        F.round(e + 1e-6, 3).alias("easting"), F.round(n + 1e-6, 3).alias("northing"),
    )


def geo_table_zone(spark, sf):
    return geo.table_utm_zone(X.sites(spark, sf))


def geo_spheroid_area(spark, sf):
    """Ellipsoid area of small lon/lat rectangles around every site."""
    return geo.spheroid_area(_site_boxes(spark, sf), "site_id").withColumns(
        {"area": F.round(F.col("area") + 1e-6, 2)}
    )


def _site_boxes(spark, sf, w: float = 0.002, h: float = 0.003):
    """A parallelogram in degrees around every site."""
    lon, lat = F.col("lon"), F.col("lat")

    def e(x1, y1, x2, y2):
        return F.struct((lon + x1).alias("x1"), (lat + y1).alias("y1"), (lon + x2).alias("x2"), (lat + y2).alias("y2"))

    return X.sites(spark, sf).select(
        "site_id",
        F.inline(F.array(e(0.0, 0.0, w, h / 3), e(w, h / 3, w, h), e(w, h, 0.0, h * 2 / 3), e(0.0, h * 2 / 3, 0.0, 0.0))),
    )


def geo_quadkey(spark, sf):
    return geo.add_quadkey(X.sites(spark, sf), P.TILE_ZOOM).select("site_id", "tile_x", "tile_y", "qk")


def geo_global_pixel(spark, sf):
    px, py = G.global_pixel(F.col("lon"), F.col("lat"), P.TILE_ZOOM)
    return X.sites(spark, sf).select("site_id", F.round(px + 1e-6, 4).alias("px"), F.round(py + 1e-6, 4).alias("py"))


def geo_tile_bounds(spark, sf):
    t = geo.add_quadkey(X.sites(spark, sf), P.TILE_ZOOM).select("qk", "tile_x", "tile_y").distinct()
    return t.select("qk", *[F.round(v + 1e-8, 6).alias(k) for k, v in G.tile_bounds(F.col("tile_x"), F.col("tile_y"), P.TILE_ZOOM).items()])


def geo_tile_coverage(spark, sf):
    """Share of each zoom-15 tile inside the parallelogram around each site."""
    out = geo.tile_coverage(_site_boxes(spark, sf, 0.02, 0.03), "site_id", 15)
    return out.where(F.col("area_fraction") > 1e-6).select(
        "site_id", "qk", F.round(F.col("area_fraction") + 1e-8, 6).alias("area_fraction")
    )


def geo_tile_grid(spark, sf):
    """Tiles per site outline."""
    out = geo.tile_grid(_site_boxes(spark, sf, 0.02, 0.03), "site_id", 13)
    return out.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_tiles"), F.min("qk").alias("first_qk"))


# --- overlaps ---------------------------------------------------------------------


def geo_pixel_overlap(spark, sf):
    """Area of every building in every 10 m pixel."""
    return geo.grid_overlap(X.edges(spark, sf), "building_id", GRID).where(F.col("area") > 1e-5).withColumns(X.round6("area"))


def geo_polygon_overlap(spark, sf):
    """Area of every district (concave, with holes) in every 25 m cell that has points."""
    o = geo.grid_overlap(X.polygons(spark, sf), "poly_id", geo.Grid(25.0)).where(F.col("area") > 1e-5)
    pts = X.points(spark, sf).groupBy(G.cell(F.col("y"), 25.0).alias("row"), G.cell(F.col("x"), 25.0).alias("col")).agg(
        F.count(F.lit(1)).alias("n_points")
    )
    return o.join(geo.shuffled(pts), ["row", "col"]).withColumns(X.round6("area"))


def geo_disk_overlap(spark, sf):
    """Area of every building in the 10 m disk around every point."""
    out = geo.disk_overlap(X.points(spark, sf), X.edges(spark, sf), "point_id", "building_id", P.POINT_BUFFER_M, BUILDING_CELL)
    return out.where(F.col("area") > 1e-5).withColumns(X.round6("area"))


def geo_disk_overlap_dense(spark, sf):
    """Area of every building in the 10 m disk around every point, on cells that follow the density of points."""
    pts = X.points(spark, sf)
    out = geo.disk_overlap(pts, X.edges(spark, sf), "point_id", "building_id", P.POINT_BUFFER_M, BUILDING_CELL,
                           leaves=density_leaves(pts, 4 * BUILDING_CELL))
    return out.where(F.col("area") > 1e-5).withColumns(X.round6("area"))


def geo_within_distance_dense(spark, sf):
    """Points inside a building or at most 5 m away, on cells that follow the density of points."""
    pts = X.points(spark, sf)
    return geo.within_distance(pts, X.edges(spark, sf), "point_id", "building_id", P.LABEL_BUFFER_M, BUILDING_CELL,
                               leaves=density_leaves(pts, 4 * BUILDING_CELL))


def geo_within_distance(spark, sf):
    """Points inside a building or at most 5 m away."""
    return geo.within_distance(
        X.points(spark, sf), X.edges(spark, sf), "point_id", "building_id", P.LABEL_BUFFER_M, BUILDING_CELL
    )


# --- buildings --------------------------------------------------------------------


def _scores(spark, sf):
    return B.from_pixels(X.edges(spark, sf), X.pixels(spark, sf), GRID, win="win")


def _dated(df):
    return df.withColumn("start_post", F.element_at(windows.window_array(X.POST), F.col("win"))["start_post"]).drop("win")


def building_scores(spark, sf):
    """Area-weighted mean and maximum per building and window, from pixels."""
    return _scores(spark, sf).withColumns(X.round6("weighted_mean", "max"))


def building_scores_from_points(spark, sf):
    """The same from disks around points that carry a prediction per window."""
    p = X.points(spark, sf)
    values = p.select("point_id", F.explode(F.sequence(F.lit(1), F.lit(19))).alias("win"), "pred").withColumn(
        "pred", F.when((F.col("point_id") + F.col("win")) % 7 != 0, (F.col("pred") + F.col("win") * 11) % 256)
    )
    out = B.from_points(p, values, X.edges(spark, sf), cell_size=BUILDING_CELL, win="win")
    return out.withColumns(X.round6("weighted_mean", "max"))


def building_wide(spark, sf):
    """One column per window."""
    wide = B.to_wide(_scores(spark, sf), list(range(1, 20)), win="win")
    return wide.select("building_id", *[F.round(F.col(str(i)) + 1e-8, 6).alias(f"w{i}") for i in range(1, 20)])


def building_long_again(spark, sf):
    wide = B.to_wide(_scores(spark, sf), list(range(1, 20)), win="win")
    return B.to_long(wide, list(range(1, 20)), win="win").withColumns(X.round6("weighted_mean"))


def building_max_pre_post(spark, sf):
    return B.max_pre_post(_dated(_scores(spark, sf)), X.CHANGE).withColumns(X.round6("max_pre", "max_post"))


def _classified(spark, sf, **kw):
    return B.classify(_dated(_scores(spark, sf)), change_date=X.CHANGE, **kw)


def building_classify(spark, sf):
    return _classified(spark, sf).withColumns(X.round6("max_pre", "max_post"))


def building_classify_strict(spark, sf):
    """Needs a value in all six windows before the change; area above 50 m2."""
    gap = (F.col("building_id") + F.month("start_post")) % 13 == 0
    some = _dated(_scores(spark, sf)).withColumn("weighted_mean", F.when(~gap, F.col("weighted_mean")))
    out = B.classify(some, change_date=X.CHANGE, strict=True, n_pre=6)
    b = X.buildings(spark, sf).where(area_at_least("area_m2", inclusive=False)).select("building_id")
    return out.join(b, "building_id").select("building_id", "damaged")


def building_with_preds_left(spark, sf):
    """Buildings without any pixel stay."""
    out = B.with_preds(X.buildings(spark, sf).select("building_id", "area_m2"), _classified(spark, sf).select("building_id", "damaged"))
    return out


def building_with_preds_right(spark, sf):
    out = B.with_preds(
        X.buildings(spark, sf).where(area_at_least("area_m2")).select("building_id", "area_m2"),
        _classified(spark, sf).select("building_id", "damaged"), "right",
    )
    return out


def building_attach_labels(spark, sf):
    """Most severe label within 5 m of every building."""
    return B.attach_labels(X.buildings(spark, sf).select("building_id", "adm2_name"), X.edges(spark, sf), X.points(spark, sf), cell_size=BUILDING_CELL)


def building_attach_labels_by_area(spark, sf):
    """Labels count only for buildings touching the label's own district."""
    k = F.col("point_id")
    p = X.points(spark, sf).withColumn("aoi", (F.floor(k / X.POINTS_A_SQUARE) * X.POLYGONS_A_SQUARE + k % X.POLYGONS_A_SQUARE).cast("int"))
    areas = X.polygons(spark, sf).withColumnRenamed("poly_id", "aoi")
    return B.attach_labels(
        X.buildings(spark, sf).select("building_id"), X.edges(spark, sf), p, radius=30.0, cell_size=BUILDING_CELL,
        carry=("date", "aoi"), areas=areas, area_cell=ADMIN_CELL,
    )


def building_area_filter(spark, sf):
    a = X.buildings(spark, sf)
    return a.groupBy("adm2_name").agg(
        F.count_if(area_at_least("area_m2", 56.0)).alias("at_least"),
        F.count_if(area_at_least("area_m2", 56.0, inclusive=False)).alias("above"),
    )


def _report_table(spark, sf):
    b = X.buildings(spark, sf).select("building_id", "area_m2", "adm2_name")
    return B.with_preds(b, _classified(spark, sf))


def stats_by_admin(spark, sf):
    out = stats.by_admin(_report_table(spark, sf), digits=6)
    return out


def stats_by_admin_cutoff(spark, sf):
    return stats.by_admin_cutoff(_report_table(spark, sf), digits=6)


def stats_admin_damage(spark, sf):
    t = _report_table(spark, sf)
    admins = X.table(spark, sf, "nation").select(F.col("n_name").alias("adm2_name"))
    damaged = t.where((F.col("damaged") == 1) & area_at_least("area_m2", inclusive=False))
    return stats.admin_damage(admins, t, damaged).withColumns(X.round6("perc_damaged"))


def stats_temporal_curve(spark, sf):
    t = _dated(_scores(spark, sf)).join(X.buildings(spark, sf).select("building_id", "adm2_name"), "building_id")
    return stats.temporal_curve(t).withColumns(X.round6("mean_value"))


def stats_totals(spark, sf):
    return stats.totals(_classified(spark, sf)).withColumns(X.round6("pct_damaged", "pct_undamaged"))


# --- pixels -----------------------------------------------------------------------


def pixel_boxes(spark, sf):
    px = pixels.centres(X.pixels(spark, sf), GRID)
    return pixels.to_boxes(px, P.PIXEL_M).select("win", "row", "col", "pred", "minx", "miny", "maxx", "maxy")


def pixel_focal_mean(spark, sf):
    p = X.pixels(spark, sf).withColumn("pred", F.when((F.col("row") + F.col("col")) % 3 != 0, F.col("pred")))
    return pixels.focal_mean(p, ["pred"], 3, ["win"]).withColumns(X.round6("pred"))


def pixel_mosaic(spark, sf):
    """Two overlapping tiles per cell, with no-data holes."""
    p = X.pixels(spark, sf).withColumn("tile", F.explode(F.array(F.lit("q0"), F.lit("q1"))))
    k = F.col("row") + F.col("col") * 3 + F.col("win")
    p = p.withColumn("pred", F.when(F.col("tile") == "q1", F.when(k % 3 == 0, 0).otherwise((F.col("pred") + 7) % 256)).otherwise(
        F.when(k % 2 == 0, 0).otherwise(F.col("pred"))
    ))
    return pixels.mosaic(p)


def pixel_sample(spark, sf):
    return pixels.sample(X.points(spark, sf), X.pixels(spark, sf), GRID, "point_id")


def pixel_sample_window_max(spark, sf):
    """3 x 3 maximum at every point and window, 0 outside the grid."""
    p = X.points(spark, sf).select("point_id", (F.col("x") * 1.05).alias("x"), (F.col("y") * 1.05).alias("y"))
    s = pixels.sample(p, X.pixels(spark, sf), GRID, "point_id", 3, "max")
    return pixels.fill_samples(p.select("point_id"), s, range(1, 20), "point_id")


def pixel_sample_window_mean(spark, sf):
    p = X.points(spark, sf)
    s = pixels.sample(p, X.pixels(spark, sf), GRID, "point_id", 3, "mean", first_cell=(0, 0))
    return s.withColumns(X.round6("pred"))


def pixel_sample_nearest(spark, sf):
    """Points beyond the grid take the nearest border cell."""
    p = X.points(spark, sf).select("point_id", (F.col("x") * 1.3 - 150).alias("x"), (F.col("y") - 60).alias("y"))
    return pixels.sample(p, X.pixels(spark, sf), GRID, "point_id", bounds=(0, 0, None, 99))


def pixel_in_box(spark, sf):
    px = pixels.centres(X.pixels(spark, sf), GRID)
    return px.where(geo.in_box(F.col("x"), F.col("y"), (205.0, 95.0, 745.5, 611.0))).select("win", "row", "col", "pred")


# --- observations -----------------------------------------------------------------


def _point_cells(spark, sf):
    s = F.col("s_suppkey")
    return X.table(spark, sf, "supplier").select(
        s.alias("site_id"), (s % 50).cast("int").alias("row"), F.floor(s / 50).cast("int").alias("col")
    )


def obs_at_points(spark, sf):
    """Scene values at points, scene time carried along, first band required."""
    return obs.extract_at_points(
        _point_cells(spark, sf), X.scene_pixels(spark, sf), X.scenes(spark, sf), ["vv", "vh"], required=["vh"]
    )


def obs_at_points_coarse(spark, sf):
    """Values at the coarser scale: the mean of the 3 x 3 pixels of the scene."""
    out = obs.extract_at_points(_point_cells(spark, sf), X.scene_pixels(spark, sf), X.scenes(spark, sf), ["vv", "vh"], k=3)
    return out.groupBy("site_id", "orbit").agg(F.count(F.lit(1)).alias("n"), F.avg("vv").alias("vv"), F.avg("vh").alias("vh")).withColumns(
        X.round6("vv", "vh")
    )


def obs_fill_mean(spark, sf):
    """Missing values filled with the mean over time of the same site and orbit."""
    o = X.obs(spark, sf)
    gap = F.dayofmonth("obs_date") % 4 == 0
    o = o.withColumns({"vv": F.when(~gap, F.col("vv")), "vh": F.when(F.col("orbit") != 87, F.col("vh"))})
    return obs.fill_with_mean(o, ["vv", "vh"]).withColumns(X.round6("vv", "vh"))


QUERIES = {
    f.__name__: f
    for f in (
        geo_point_in_polygon, geo_within_boundary, geo_assign_admin, geo_intersects, geo_area_centroid, geo_bounds,
        geo_bounds_all, geo_utm, geo_table_zone, geo_spheroid_area, geo_quadkey, geo_global_pixel, geo_tile_bounds,
        geo_tile_coverage, geo_tile_grid, geo_pixel_overlap, geo_polygon_overlap, geo_disk_overlap,
        geo_within_distance, geo_point_in_polygon_dense, geo_disk_overlap_dense, geo_within_distance_dense, building_scores, building_scores_from_points, building_wide, building_long_again,
        building_max_pre_post, building_classify, building_classify_strict, building_with_preds_left,
        building_with_preds_right, building_attach_labels, building_attach_labels_by_area, building_area_filter, stats_by_admin,
        stats_by_admin_cutoff, stats_admin_damage, stats_temporal_curve, stats_totals, pixel_boxes, pixel_focal_mean,
        pixel_mosaic, pixel_sample, pixel_sample_nearest, pixel_sample_window_max, pixel_sample_window_mean, pixel_in_box, obs_at_points,
        obs_at_points_coarse, obs_fill_mean,
    )
}

# --- SQL --------------------------------------------------------------------------

_CROSS = "CASE WHEN (y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END"
_PIP = (
    "pip AS (SELECT point_id, poly_id FROM points, polygons GROUP BY ALL HAVING sum("
    + _CROSS.format(x="x", y="y")
    + ") % 2 = 1)"
)
_BB = "bb AS (SELECT building_id, min(least(x1, x2)) AS minx, min(least(y1, y2)) AS miny, max(greatest(x1, x2)) AS maxx, max(greatest(y1, y2)) AS maxy FROM edges GROUP BY ALL)"
_AC = (
    "ac AS (SELECT building_id, maxx - minx AS w, maxy - miny AS h, (maxx - minx) * (maxy - miny) AS area, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM bb)"
)
# rectangles: the overlap with a pixel is the product of the overlaps per axis
_OV = (
    "ov AS (SELECT building_id, row, col, area FROM (SELECT building_id, CAST(r.range AS INT) AS row, CAST(c.range AS INT) AS col,"
    " (least(maxx, c.range * 10 + 10) - greatest(minx, c.range * 10)) * (least(maxy, r.range * 10 + 10) - greatest(miny, r.range * 10)) AS area"
    " FROM bb, unnest(range(CAST(floor(minx / 10) AS BIGINT), CAST(floor(maxx / 10) AS BIGINT) + 1)) c(range),"
    " unnest(range(CAST(floor(miny / 10) AS BIGINT), CAST(floor(maxy / 10) AS BIGINT) + 1)) r(range)) WHERE area > 1e-9)"
)
_SC = (
    "sc AS (SELECT building_id, win, coalesce(sum(pred * area), 0) / sum(area) AS weighted_mean, CAST(max(pred) AS DOUBLE) AS max"
    " FROM ov JOIN pixels p ON p.row = ov.row AND p.col = ov.col GROUP BY ALL)"
)
_PP = (
    f"pp AS (SELECT building_id, max(weighted_mean) FILTER (start_post < DATE '{X.CHANGE}') AS max_pre,"
    f" max(weighted_mean) FILTER (start_post >= DATE '{X.CHANGE}') AS max_post FROM sc JOIN windows w ON w.win = sc.win GROUP BY building_id)"
)
_CL = "cl AS (SELECT building_id, max_pre, max_post, CASE WHEN max_post >= 170 AND max_pre < 170 THEN 1 ELSE 0 END AS damaged FROM pp)"


def _b(*more: str, views=("edges", "pixels", "buildings")) -> str:
    return X.with_views(*views, windows=X.POST, extra=(_BB, _OV, _SC, _PP, _CL, *more))


def _box_share(a, b, c, d) -> str:
    """One edge's area under it inside a box, as SQL."""
    u, v = f"greatest(least(x1, x2), {a})", f"least(greatest(x1, x2), {c})"
    yu, yv = f"(y1 + ({u} - x1) * (y2 - y1) / (x2 - x1))", f"(y1 + ({v} - x1) * (y2 - y1) / (x2 - x1))"

    def h(y):
        return f"CASE WHEN {y} < {b} THEN 0 WHEN {y} <= {d} THEN ({y} - {b}) * ({y} - {b}) / 2 ELSE ({d} - {b}) * ({d} - {b}) / 2 + ({y} - {d}) * ({d} - {b}) END"

    level = f"(least(greatest({yu}, {b}), {d}) - {b}) * ({v} - {u})"
    return (
        f"CASE WHEN x1 = x2 OR {v} <= {u} THEN 0 ELSE CASE WHEN x2 > x1 THEN -1 ELSE 1 END * CASE WHEN abs({yv} - {yu}) < 1e-12 THEN {level}"
        f" ELSE ({v} - {u}) * (({h(yv)}) - ({h(yu)})) / ({yv} - {yu}) END END"
    )


_SITE_BOX = """box AS (SELECT site_id, unnest([{{'x1': lon, 'y1': lat, 'x2': lon + {w}, 'y2': lat + {h} / 3}},
 {{'x1': lon + {w}, 'y1': lat + {h} / 3, 'x2': lon + {w}, 'y2': lat + {h}}}, {{'x1': lon + {w}, 'y1': lat + {h}, 'x2': lon, 'y2': lat + {h} * 2 / 3}},
 {{'x1': lon, 'y1': lat + {h} * 2 / 3, 'x2': lon, 'y2': lat}}], recursive := true) FROM sites)"""


def _mercator(lon: str, lat: str, zoom: int) -> tuple[str, str]:
    size = f"{256 * 2**zoom}e0"
    x = f"least(greatest(({lon} + 180) / 360 * {size} + 0.5e0, 0), {size} - 1)"
    y = (
        f"least(greatest((0.5e0 - ln((1 + sin({lat} * pi() / 180)) / (1 - sin({lat} * pi() / 180))) / (4 * pi())) * {size} + 0.5e0, 0), {size} - 1)"
    )
    return x, y


def _lonlat(tx: str, ty: str, zoom: int) -> dict[str, str]:
    size = f"{256 * 2**zoom}e0"

    def lon(p):
        return f"(least(greatest({p}, 0), {size} - 1) / {size} - 0.5e0) * 360"

    def lat(p):
        return f"90 - 360 * atan(exp(-(0.5e0 - least(greatest({p}, 0), {size} - 1) / {size}) * 2 * pi())) / pi()"

    return {
        "minx": lon(f"({tx} * 256)"), "miny": lat(f"({ty} * 256 + 256)"),
        "maxx": lon(f"({tx} * 256 + 256)"), "maxy": lat(f"({ty} * 256)"),
    }


def _qk(tx: str, ty: str, zoom: int) -> str:
    digits = [f"CAST((({tx} >> {k}) & 1) + (({ty} >> {k}) & 1) * 2 AS VARCHAR)" for k in range(zoom - 1, -1, -1)]
    return " || ".join(digits)


def _tiles(zoom: int, w: str, h: str) -> str:
    """Tile shares by brute force over the tile range of each outline."""
    px0, py0 = _mercator("minx", "maxy", zoom)
    px1, py1 = _mercator("maxx", "miny", zoom)
    b = _lonlat("tx", "ty", zoom)
    share = _box_share("a", "b", "c", "d")
    return X.with_views(
        "sites",
        extra=(
            _SITE_BOX.format(w=w, h=h),
            "bb AS (SELECT site_id, min(least(x1, x2)) AS minx, min(least(y1, y2)) AS miny, max(greatest(x1, x2)) AS maxx, max(greatest(y1, y2)) AS maxy FROM box GROUP BY ALL)",
            f"tl AS (SELECT site_id, tx, unnest(range(CAST(floor({py0} / 256) AS BIGINT), CAST(floor({py1} / 256) AS BIGINT) + 1)) AS ty FROM"
            f" (SELECT *, unnest(range(CAST(floor({px0} / 256) AS BIGINT), CAST(floor({px1} / 256) AS BIGINT) + 1)) AS tx FROM bb))",
            f"tb AS (SELECT site_id, tx, ty, {b['minx']} AS a, {b['miny']} AS b, {b['maxx']} AS c, {b['maxy']} AS d FROM tl)",
            f"fr AS (SELECT tb.site_id, tx, ty, sum({share}) / any_value((c - a) * (d - b)) AS f, sum({share}) AS s FROM tb JOIN box ON box.site_id = tb.site_id GROUP BY tb.site_id, tx, ty)",
        ),
    )


_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)


def _utm_sql() -> str:
    n = _N
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * math.sqrt(n) / (1 + n)
    east = "eta + " + " + ".join(f"CAST({a!r} AS DOUBLE) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    north = "xi + " + " + ".join(f"CAST({a!r} AS DOUBLE) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    return (
        X.with_views(
            "sites",
            extra=(
                f"t1 AS (SELECT *, sinh(atanh(sin(radians(lat))) - CAST({e!r} AS DOUBLE) * atanh(CAST({e!r} AS DOUBLE) * sin(radians(lat)))) AS t, radians(lon - 33) AS dl FROM sites)",
                "t2 AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t1)",
            ),
        )
        + f"""SELECT site_id, CAST(trunc((lon + 180) / 6) % 60 + 1 AS INT) AS zone, lat > 0 AS north,
 round(500000 + CAST({k!r} AS DOUBLE) * ({east}) + 1e-6, 3) AS easting, round(CAST({k!r} AS DOUBLE) * ({north}) + 1e-6, 3) AS northing FROM t2"""
    )


_E2 = 1 / 298.257223563 * (2 - 1 / 298.257223563)
_E = math.sqrt(_E2)
_TOP = 1 + (1 - _E2) / _E * math.atanh(_E)
AUTHALIC_R2 = 6378137.0**2 / 2 * _TOP


def authalic(lat: str) -> str:
    """The share of the hemisphere's area below a latitude, as SQL."""
    s = f"sin(radians({lat}))"
    return f"((1 - {_E2!r}::DOUBLE) * ({s} / (1 - {_E2!r}::DOUBLE * {s} * {s}) + atanh({_E!r}::DOUBLE * {s}) / {_E!r}::DOUBLE)) / {_TOP!r}::DOUBLE"


def _spheroid_sql() -> str:
    q, r2 = authalic, AUTHALIC_R2
    return (
        X.with_views("sites", extra=(_SITE_BOX.format(w="0.002e0", h="0.003e0"),))
        + f"SELECT site_id, round(abs(sum(-radians(x2 - x1) * (({q('y1')}) + ({q('y2')})) / 2)) * {r2!r}::DOUBLE + 1e-6, 2) AS area FROM box GROUP BY site_id"
    )


# disk and rectangle by a fine integral would not match to 6 digits, so the same
# closed form is written out per edge
_DISK = (
    "d1 AS (SELECT point_id, e.building_id, x1 - x AS ax, y1 - y AS ay, x2 - x1 AS dx, y2 - y1 AS dy FROM points p JOIN bb ON"
    " x + 10 > minx AND x - 10 < maxx AND y + 10 > miny AND y - 10 < maxy JOIN edges e ON e.building_id = bb.building_id)",
    "d2 AS (SELECT *, dx * dx + dy * dy AS qa, ax * dx + ay * dy AS qb FROM d1)",
    "d3 AS (SELECT *, qb * qb - qa * (ax * ax + ay * ay - 100) AS disc FROM d2)",
    "d4 AS (SELECT *, CASE WHEN disc > 0 THEN least(greatest((-qb - sqrt(greatest(disc, 0))) / qa, 0), 1) ELSE 0 END AS s0,"
    " CASE WHEN disc > 0 THEN least(greatest((sqrt(greatest(disc, 0)) - qb) / qa, 0), 1) ELSE 0 END AS s1 FROM d3)",
    "d5 AS (SELECT *, ax + s0 * dx AS px, ay + s0 * dy AS py, ax + s1 * dx AS qx, ay + s1 * dy AS qy, ax + dx AS bx, ay + dy AS by_ FROM d4)",
    "dd AS (SELECT point_id, building_id, sum(50e0 * (atan2(ax * py - ay * px, ax * px + ay * py) + atan2(qx * by_ - qy * bx, qx * bx + qy * by_))"
    " + (px * qy - py * qx) / 2) AS area FROM d5 GROUP BY ALL HAVING area > 1e-9)",
)
# a rectangle's distance to a point
_DIST = (
    "wd AS (SELECT point_id, building_id FROM points JOIN bb ON x BETWEEN minx - 5 AND maxx + 5 AND y BETWEEN miny - 5 AND maxy + 5 WHERE"
    " pow(greatest(minx - x, 0, x - maxx), 2) + pow(greatest(miny - y, 0, y - maxy), 2) <= 25)"
)
_PTS = (
    "pv AS (SELECT point_id, CAST(range AS INT) AS win, CASE WHEN (point_id + range) % 7 <> 0 THEN (pred + range * 11) % 256 END AS v FROM points, range(1, 20))"
)
_REPORT = "rt AS (SELECT b.building_id, area_m2, adm2_name, max_pre, max_post, damaged FROM buildings b LEFT JOIN cl ON cl.building_id = b.building_id)"

# a corner in the other shape, or two edges that cross; 'side' is the sign of the turn
_SEG = """seg AS (SELECT e.building_id, p.poly_id FROM edges e JOIN polygons p ON
 greatest(e.x1, e.x2) >= least(p.x1, p.x2) AND greatest(p.x1, p.x2) >= least(e.x1, e.x2)
 AND greatest(e.y1, e.y2) >= least(p.y1, p.y2) AND greatest(p.y1, p.y2) >= least(e.y1, e.y2)
 WHERE sign((e.x2 - e.x1) * (p.y1 - e.y1) - (e.y2 - e.y1) * (p.x1 - e.x1)) * sign((e.x2 - e.x1) * (p.y2 - e.y1) - (e.y2 - e.y1) * (p.x2 - e.x1)) <= 0
 AND sign((p.x2 - p.x1) * (e.y1 - p.y1) - (p.y2 - p.y1) * (e.x1 - p.x1)) * sign((p.x2 - p.x1) * (e.y2 - p.y1) - (p.y2 - p.y1) * (e.x2 - p.x1)) <= 0)"""
_CORNER = (
    "ca AS (SELECT c.building_id, poly_id FROM (SELECT building_id, e AS ce, x1 AS x, y1 AS y FROM edges) c, polygons GROUP BY c.building_id, ce, poly_id"
    " HAVING sum(" + _CROSS.format(x="x", y="y") + ") % 2 = 1)",
    "cb AS (SELECT building_id, c.poly_id FROM (SELECT poly_id, e AS ce, x1 AS x, y1 AS y FROM polygons) c, edges GROUP BY building_id, c.poly_id, ce"
    " HAVING sum(" + _CROSS.format(x="x", y="y") + ") % 2 = 1)",
)

ORACLES = {
    "geo_point_in_polygon": X.with_views("points", "polygons", extra=(_PIP,))
    + "SELECT p.point_id, x, y, poly_id FROM points p LEFT JOIN pip ON pip.point_id = p.point_id",
    "geo_within_boundary": X.with_views("edges", "polygons", extra=(_BB, _AC))
    + f"SELECT building_id, {X.r6('area')} AS area_m2, {X.r6('cx')} AS cx, {X.r6('cy')} AS cy FROM ac WHERE area >= 50 - 1e-9 AND building_id IN"
    + " (SELECT building_id FROM (SELECT building_id, poly_id FROM ac, polygons GROUP BY ALL HAVING sum("
    + _CROSS.format(x="cx", y="cy")
    + ") % 2 = 1))",
    "geo_assign_admin": X.with_views("points", "polygons", extra=(_PIP,))
    + """SELECT p.point_id, x, y, pip.poly_id, 'g' || n_regionkey AS adm2, n_regionkey AS rk, n_name AS adm3, r_name AS adm1,
 '2_' || r_regionkey AS adm2_id FROM points p LEFT JOIN pip ON pip.point_id = p.point_id
 LEFT JOIN nation ON n_nationkey = poly_id % 25 LEFT JOIN region ON r_regionkey = n_regionkey""",
    "geo_intersects": X.with_views("edges", "polygons", extra=(_SEG, *_CORNER))
    + "SELECT * FROM seg UNION SELECT * FROM ca UNION SELECT * FROM cb",
    "geo_area_centroid": X.with_views("edges", extra=(_BB, _AC))
    + f"SELECT building_id, {X.r6('area')} AS area, {X.r6('cx')} AS cx, {X.r6('cy')} AS cy FROM ac",
    "geo_bounds": X.with_views("edges", extra=(_BB,)) + "SELECT building_id, " + ", ".join(f"{X.r6(c)} AS {c}" for c in ("minx", "miny", "maxx", "maxy")) + " FROM bb",
    "geo_bounds_all": X.with_views("edges", extra=(_BB,))
    + f"SELECT {X.r6('min(minx)')} AS minx, {X.r6('min(miny)')} AS miny, {X.r6('max(maxx)')} AS maxx, {X.r6('max(maxy)')} AS maxy FROM bb",
    "geo_utm": _utm_sql(),
    "geo_table_zone": X.with_views("sites")
    + "SELECT CAST(trunc((avg(lon) + 180) / 6) % 60 + 1 AS INT) AS zone, avg(lat) > 0 AS north FROM (SELECT DISTINCT lon, lat FROM sites)",
    "geo_spheroid_area": _spheroid_sql(),
    "geo_quadkey": X.with_views("sites", extra=("m AS (SELECT site_id, CAST(floor({} / 256) AS INT) AS tile_x, CAST(floor({} / 256) AS INT) AS tile_y FROM sites)".format(*_mercator("lon", "lat", 12)),))
    + f"SELECT site_id, tile_x, tile_y, {_qk('tile_x', 'tile_y', 12)} AS qk FROM m",
    "geo_global_pixel": X.with_views("sites")
    + "SELECT site_id, round({} + 1e-6, 4) AS px, round({} + 1e-6, 4) AS py FROM sites".format(*_mercator("lon", "lat", 12)),
    "geo_tile_bounds": X.with_views("sites", extra=("m AS (SELECT DISTINCT CAST(floor({} / 256) AS INT) AS tx, CAST(floor({} / 256) AS INT) AS ty FROM sites)".format(*_mercator("lon", "lat", 12)),))
    + f"SELECT {_qk('tx', 'ty', 12)} AS qk, " + ", ".join(f"{X.r6(v)} AS {k}" for k, v in _lonlat("tx", "ty", 12).items()) + " FROM m",
    "geo_tile_coverage": _tiles(15, "0.02e0", "0.03e0") + f"SELECT site_id, {_qk('tx', 'ty', 15)} AS qk, {X.r6('f')} AS area_fraction FROM fr WHERE f > 1e-6",
    "geo_tile_grid": _tiles(13, "0.02e0", "0.03e0") + f"SELECT site_id, count(*) AS n_tiles, min({_qk('tx', 'ty', 13)}) AS first_qk FROM fr WHERE s > 1e-12 GROUP BY site_id",
    "geo_pixel_overlap": X.with_views("edges", extra=(_BB, _OV)) + f"SELECT building_id, row, col, {X.r6('area')} AS area FROM ov WHERE area > 1e-5",
    "geo_polygon_overlap": X.with_views("polygons", "points", extra=(
        "pc AS (SELECT CAST(floor(y / 25) AS INT) AS row, CAST(floor(x / 25) AS INT) AS col, count(*) AS n_points FROM points GROUP BY ALL)",
        "o AS (SELECT poly_id, row, col, n_points, sum(" + _box_share("col * 25e0", "row * 25e0", "(col * 25e0 + 25)", "(row * 25e0 + 25)") + ") AS area FROM pc, polygons GROUP BY ALL)",
    )) + f"SELECT poly_id, row, col, n_points, {X.r6('area')} AS area FROM o WHERE area > 1e-5",
    "geo_disk_overlap": X.with_views("points", "edges", extra=(_BB, *_DISK)) + f"SELECT point_id, building_id, {X.r6('area')} AS area FROM dd WHERE area > 1e-5",
    "geo_within_distance": X.with_views("points", "edges", extra=(_BB, _DIST)) + "SELECT point_id, building_id FROM wd",
    "building_scores": _b() + f"SELECT building_id, win, {X.r6('weighted_mean')} AS weighted_mean, {X.r6('max')} AS max FROM sc",
    "building_scores_from_points": X.with_views("points", "edges", extra=(_BB, *_DISK, _PTS))
    + f"""SELECT building_id, win, {X.r6('coalesce(sum(v / 255e0 * area), 0) / sum(area)')} AS weighted_mean, {X.r6('max(v / 255e0)')} AS max
 FROM dd JOIN pv ON pv.point_id = dd.point_id GROUP BY building_id, win""",
    "building_wide": _b() + "SELECT building_id, " + ", ".join(f"{X.r6(f'max(weighted_mean) FILTER (win = {i})')} AS w{i}" for i in range(1, 20)) + " FROM sc GROUP BY building_id",
    "building_long_again": _b() + f"SELECT building_id, win, {X.r6('weighted_mean')} AS weighted_mean FROM sc",
    "building_max_pre_post": _b() + f"SELECT building_id, {X.r6('max_pre')} AS max_pre, {X.r6('max_post')} AS max_post FROM pp",
    "building_classify": _b() + f"SELECT building_id, {X.r6('max_pre')} AS max_pre, {X.r6('max_post')} AS max_post, damaged FROM cl",
    "building_classify_strict": _b(
        "st AS (SELECT building_id, count(m) FILTER (start_post < DATE '1997-01-07') AS n, max(m) FILTER (start_post < DATE '1997-01-07') AS a,"
        " max(m) FILTER (start_post >= DATE '1997-01-07') AS b FROM (SELECT building_id, start_post, CASE WHEN (building_id + month(start_post)) % 13 <> 0 THEN weighted_mean END AS m FROM sc JOIN windows w ON w.win = sc.win) GROUP BY building_id)"
    )
    + "SELECT st.building_id, CASE WHEN n = 6 AND a < 170 AND b >= 170 THEN 1 ELSE 0 END AS damaged FROM st JOIN buildings bu ON bu.building_id = st.building_id WHERE area_m2 > 50",
    "building_with_preds_left": _b() + "SELECT bu.building_id, area_m2, damaged FROM buildings bu LEFT JOIN cl ON cl.building_id = bu.building_id",
    "building_with_preds_right": _b() + "SELECT cl.building_id, area_m2, damaged FROM cl LEFT JOIN (SELECT * FROM buildings WHERE area_m2 >= 50) bu ON cl.building_id = bu.building_id",
    "building_attach_labels": X.with_views("buildings", "edges", "points", extra=(
        _BB, _DIST,
        "best AS (SELECT building_id, damage, p.point_id, date, row_number() OVER (PARTITION BY building_id ORDER BY damage, p.point_id, ep) AS rn FROM wd JOIN points p ON p.point_id = wd.point_id)",
    )) + "SELECT b.building_id, adm2_name, damage AS label_damage, point_id AS label_id, date AS label_date FROM buildings b LEFT JOIN best ON best.building_id = b.building_id AND rn = 1",
    "building_attach_labels_by_area": X.with_views("buildings", "edges", "points", "polygons", extra=(
        _BB, _DIST.replace("- 5", "- 30").replace("+ 5", "+ 30").replace("<= 25", "<= 900"), _SEG, *_CORNER,
        "tc AS (SELECT * FROM seg UNION SELECT * FROM ca UNION SELECT * FROM cb)",
        "best AS (SELECT wd.building_id, damage, p.point_id, date, CAST(p.point_id // 375 * 25 + p.point_id % 25 AS INT) AS aoi,"
        " row_number() OVER (PARTITION BY wd.building_id ORDER BY damage, p.point_id, ep) AS rn FROM wd JOIN points p ON p.point_id = wd.point_id"
        " JOIN tc ON tc.building_id = wd.building_id AND tc.poly_id = p.point_id // 375 * 25 + p.point_id % 25)",
    )) + "SELECT b.building_id, damage AS label_damage, point_id AS label_id, date AS label_date, aoi AS label_aoi FROM buildings b LEFT JOIN best ON best.building_id = b.building_id AND rn = 1",
    "building_area_filter": X.with_views("buildings") + "SELECT adm2_name, count(*) FILTER (area_m2 >= 56) AS at_least, count(*) FILTER (area_m2 > 56) AS above FROM buildings GROUP BY ALL",
    "stats_by_admin": _b(_REPORT) + "SELECT adm2_name, count(damaged) AS n_buildings, CAST(sum(damaged) AS BIGINT) AS n_damaged, round(avg(damaged) * 100, 6) AS pct_damaged, round(avg(max_post), 6) AS mean_max_post FROM rt GROUP BY ALL",
    "stats_by_admin_cutoff": _b(_REPORT) + "SELECT adm2_name, count(max_post) AS n_buildings, round(avg(max_post), 6) AS mean_damage, round(avg(CASE WHEN max_post > 127 THEN 1e0 ELSE 0e0 END) * 100, 6) AS pct_over FROM rt GROUP BY ALL",
    "stats_admin_damage": _b(_REPORT) + f"SELECT adm2_name, count(*) FILTER (area_m2 > 50) AS n_buildings, count(*) FILTER (area_m2 > 50 AND damaged = 1) AS n_buildings_damaged, {X.r6('100e0 * count(*) FILTER (area_m2 > 50 AND damaged = 1) / nullif(count(*) FILTER (area_m2 > 50), 0)')} AS perc_damaged FROM rt GROUP BY adm2_name",
    "stats_temporal_curve": _b() + f"SELECT adm2_name, start_post, {X.r6('avg(weighted_mean)')} AS mean_value FROM sc JOIN windows w ON w.win = sc.win JOIN buildings bu ON bu.building_id = sc.building_id GROUP BY ALL",
    "stats_totals": _b() + f"SELECT count(*) AS n_total, CAST(sum(damaged) AS BIGINT) AS n_damaged, CAST(sum(1 - damaged) AS BIGINT) AS n_undamaged, {X.r6('avg(damaged) * 100')} AS pct_damaged, {X.r6('avg(1 - damaged) * 100')} AS pct_undamaged FROM cl",
    "pixel_boxes": X.with_views("pixels") + "SELECT win, row, col, pred, col * 1e1 AS minx, row * 1e1 AS miny, col * 1e1 + 10 AS maxx, row * 1e1 + 10 AS maxy FROM pixels",
    "pixel_focal_mean": X.with_views("pixels", extra=("p AS (SELECT win, row, col, CASE WHEN (row + col) % 3 <> 0 THEN pred END AS pred FROM pixels)",))
    + f"SELECT a.win, a.row, a.col, {X.r6('avg(b.pred)')} AS pred FROM p a JOIN p b ON b.win = a.win AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.win, a.row, a.col",
    "pixel_mosaic": X.with_views("pixels") + """SELECT win, row, col, CASE WHEN b <> 0 THEN b WHEN a <> 0 THEN a ELSE 0 END AS pred FROM (SELECT win, row, col,
 CASE WHEN (row + col * 3 + win) % 3 = 0 THEN 0 ELSE CAST((pred + 7) % 256 AS INT) END AS b, CASE WHEN (row + col * 3 + win) % 2 = 0 THEN 0 ELSE pred END AS a FROM pixels)""",
    "pixel_sample": X.with_views("points", "pixels") + "SELECT point_id, win, q.pred FROM points p JOIN pixels q ON q.row = CAST(floor(y / 10) AS INT) AND q.col = CAST(floor(x / 10) AS INT)",
    "pixel_sample_nearest": X.with_views("points", "pixels") + """SELECT point_id, win, q.pred FROM points p JOIN pixels q ON q.row = greatest(CAST(floor((y - 60) / 10) AS INT), 0)
 AND q.col = least(greatest(CAST(floor((x * 1.3e0 - 150) / 10) AS INT), 0), 99)""",
    "pixel_sample_window_max": X.with_views("points", "pixels", extra=(
        "s AS (SELECT point_id, win, max(q.pred) AS pred FROM points p JOIN pixels q ON q.row - CAST(floor(y * 1.05e0 / 10) AS INT) BETWEEN -1 AND 1 AND q.col - CAST(floor(x * 1.05e0 / 10) AS INT) BETWEEN -1 AND 1 GROUP BY ALL)",
    )) + "SELECT p.point_id, CAST(range AS INT) AS win, coalesce(s.pred, 0) AS pred FROM points p CROSS JOIN range(1, 20) LEFT JOIN s ON s.point_id = p.point_id AND s.win = range",
    "pixel_sample_window_mean": X.with_views("points", "pixels")
    + f"""SELECT point_id, win, {X.r6('avg(q.pred)')} AS pred FROM (SELECT point_id, CAST(floor(y / 10) AS INT) AS r, CAST(floor(x / 10) AS INT) AS c FROM points) p
 JOIN pixels q ON q.row BETWEEN r - 1 AND r + 1 AND q.col BETWEEN c - 1 AND c + 1 WHERE r >= 1 AND c >= 1 GROUP BY ALL""",
    "pixel_in_box": X.with_views("pixels") + "SELECT win, row, col, pred FROM pixels WHERE col * 10 + 5 BETWEEN 205 AND 745.5 AND row * 10 + 5 BETWEEN 95 AND 611",
    "obs_at_points": X.with_views("scene_pixels", "scenes")
    + """SELECT s_suppkey AS site_id, p.scene_id, vv, vh, orbit, time_start FROM scene_pixels p JOIN scenes s ON s.scene_id = p.scene_id
 JOIN supplier ON row = s_suppkey % 50 AND col = s_suppkey // 50 WHERE vh IS NOT NULL""",
    "obs_at_points_coarse": X.with_views("scene_pixels", "scenes", extra=(
        "c AS (SELECT DISTINCT scene_id, row, col FROM scene_pixels)",
        "f AS (SELECT c.scene_id, c.row, c.col, avg(vv) AS vv, avg(vh) AS vh FROM c JOIN scene_pixels p ON p.scene_id = c.scene_id AND p.row BETWEEN c.row - 1 AND c.row + 1 AND p.col BETWEEN c.col - 1 AND c.col + 1 GROUP BY ALL)",
    )) + f"""SELECT s_suppkey AS site_id, orbit, count(*) AS n, {X.r6('avg(vv)')} AS vv, {X.r6('avg(vh)')} AS vh FROM f JOIN scenes s ON s.scene_id = f.scene_id
 JOIN supplier ON row = s_suppkey % 50 AND col = s_suppkey // 50 GROUP BY ALL""",
    "obs_fill_mean": X.with_views("obs", extra=("g AS (SELECT site_id, orbit, obs_date, CASE WHEN day(obs_date) % 4 <> 0 THEN vv END AS vv, CASE WHEN orbit <> 87 THEN vh END AS vh FROM obs)",))
    + f"SELECT site_id, orbit, obs_date, {X.r6('coalesce(vv, avg(vv) OVER (PARTITION BY site_id, orbit))')} AS vv, {X.r6('coalesce(vh, avg(vh) OVER (PARTITION BY site_id, orbit))')} AS vh FROM g",
}
# the same rows, whatever the cells
ORACLES |= {f"{k}_dense": ORACLES[k] for k in ("geo_point_in_polygon", "geo_disk_overlap", "geo_within_distance")}
