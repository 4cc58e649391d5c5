"""Queries: readers, writers and incremental scoring, as round trips of the tables
through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from changemap.operators import evaluate, ledger, scenes
from changemap.plans import fixtures as X
from changemap.plans.q_labels import _long
from changemap.session import work_path
from changemap.sources import boxes, io
from changemap.streaming import score as stream


def io_csv_to_parquet(spark, sf):
    t = X.table(spark, sf, "supplier")
    src, dst = work_path(spark, "csv"), work_path(spark, "parquet")
    t.write.option("header", True).csv(src)
    io.csv_to_parquet(spark, src, dst, t.schema)
    return spark.read.parquet(dst)


def io_read_labels(spark, sf):
    """Long labels written and read under the label schema."""
    from changemap.operators.labels import with_summary

    path = work_path(spark, "labels")
    rows = with_summary(_long(spark, sf)).withColumn("label_id", F.format_string("%d_%d", "site_id", "ep"))
    rows.select(*[f.name for f in io.T.StructType.fromDDL(io.LABEL_SCHEMA).fields]).write.parquet(path)
    return io.read_labels(spark, path)


def io_read_point_labels(spark, sf):
    """Assessments as GeoJSON points, one feature per line."""
    path = work_path(spark, "points")
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.format_string("%d_%d", "site_id", "ep").alias("label_id"), "site_id", "aoi", "damage", "ep", "date").alias("properties"),
            F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        )
    )
    _long(spark, sf).select(feature.alias("value")).write.text(path)
    return io.read_point_labels(spark, path).select("label_id", "site_id", "aoi", "damage", "ep", "date", "lon", "lat")


def io_read_polygons(spark, sf):
    """District outlines as GeoJSON polygons with holes, back to edges."""
    path = work_path(spark, "polygons")
    e = X.polygons(spark, sf).withColumn("ring", F.when(F.col("e") <= 5, 0).otherwise(1))
    rings = e.groupBy("poly_id", "ring").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("e", "x1", "y1"))), lambda s: F.array(s["x1"], s["y1"])).alias("pts")
    )
    closed = rings.withColumn("pts", F.concat("pts", F.slice("pts", 1, 1)))
    polys = closed.groupBy("poly_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ring", "pts"))), lambda s: s["pts"]).alias("coordinates")
    )
    # every third outline is written the wrong way round
    turned = F.when(F.col("poly_id") % 3 == 0, F.transform("coordinates", lambda r: F.reverse(r))).otherwise(F.col("coordinates"))
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), F.struct(F.col("poly_id").cast("string").alias("poly_id")).alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), turned.alias("coordinates")).alias("geometry"),
        )
    )
    polys.select(feature.alias("value")).write.text(path)
    out = io.read_polygons(spark, path, ["poly_id"])
    return out.select(F.col("poly_id").cast("long").alias("poly_id"), "x1", "y1", "x2", "y2")


def io_one_polygon(spark, sf):
    """One outline out of the edge table, by the name of its unit."""
    named = X.polygons(spark, sf).join(X.table(spark, sf, "nation").select(F.col("n_nationkey").alias("poly_id"), "n_name"), "poly_id")
    return io.one_polygon(named, "n_name", "NATION_6").select("e", "x1", "y1", "x2", "y2")


def io_read_assessments(spark, sf):
    """Wide assessments under the published column names, as CSV and as parquet."""
    dates, classes = io.default_columns()
    wide = X.assess_wide(spark, sf).withColumnsRenamed(
        {**{f"date_{i}": d for i, d in enumerate(dates, 1)}, **{f"class_{i}": c for i, c in enumerate(classes, 1)}}
    )
    wide = wide.select(
        "site_id", F.col("aoi").alias("Governorate"), F.col("adm2_name").alias("Municipality"), "lon", "lat",
        *[c for p in zip(dates, classes) for c in p],
    )
    a, b = work_path(spark, "wide"), work_path(spark, "wide")
    wide.write.option("header", True).csv(a)
    wide.write.parquet(b)
    from changemap.operators.labels import to_long

    both = io.read_assessments(spark, a, "csv").withColumn("src", F.lit("csv")).unionByName(
        io.read_assessments(spark, b).withColumn("src", F.lit("parquet"))
    )
    return to_long(both, ["site_id", "Governorate", "src"], dates, classes)


def io_read_buildings(spark, sf):
    """Buildings of one unit with at least 50 m2, from a table partitioned by unit."""
    path = work_path(spark, "buildings")
    X.buildings(spark, sf).withColumn("adm2_id", F.concat(F.lit("2_"), "adm2_name")).write.partitionBy("adm2_id").parquet(path)
    return io.read_buildings(spark, path, 50.0, "2_NATION_3").select("building_id", "area_m2", "adm2_name")


def io_scan_bbox(spark, sf):
    """Rows whose whole nested box lies inside a box."""
    from changemap.operators.geo import bounds

    path = work_path(spark, "boxes")
    bounds(X.edges(spark, sf), "building_id").select(
        "building_id",
        F.struct(F.col("minx").alias("minX"), F.col("miny").alias("minY"), F.col("maxx").alias("maxX"), F.col("maxy").alias("maxY")).alias("bbox"),
    ).write.parquet(path)
    return io.scan_bbox(spark, path, (100.0, 150.0, 640.5, 800.25)).select("building_id")


def io_read_admin(spark, sf):
    """Units of one parent with fixed spelling and stable ids."""
    n, r = X.table(spark, sf, "nation"), X.table(spark, sf, "region")
    adm = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("adm2_name"), F.col("r_name").alias("adm1_name"), F.col("n_nationkey").alias("row_no")
    )
    return io.read_admin(adm, 2, "adm1_name", "AME", spelling={"NATION_1": "Nation One"}).select("adm2_name", "adm1_name", "admin_id")


def io_boundary(spark, sf):
    """All outlines as one boundary: customers inside it."""
    from changemap.operators.geo import point_in_polygon

    return point_in_polygon(
        X.points(spark, sf).select("point_id", "x", "y"), io.read_boundary(X.polygons(spark, sf)), "point_id", "boundary", 40.0, "left_semi"
    )


def io_read_obs(spark, sf):
    """Observations of one area and orbit from the partitioned cache."""
    path = work_path(spark, "obs")
    io.write_obs(X.obs(spark, sf).join(X.sites(spark, sf).select("site_id", "aoi"), "site_id"), path)
    out = io.read_obs(spark, path, "ASIA", 94)
    return out.select("site_id", "obs_date", "vv", "vh", "aoi", F.col("orbit").cast("int").alias("orbit"))


def io_rewrite_replaces(spark, sf):
    """The cache of all areas, then that of one in its place: no other area is left."""
    path = work_path(spark, "obs")
    o = X.obs(spark, sf).join(X.sites(spark, sf).select("site_id", "aoi"), "site_id")
    io.write_obs(o, path)
    io.write_obs(o.where(F.col("aoi") == "ASIA"), path)
    return io.read_obs(spark, path).groupBy("aoi", "orbit").agg(F.count(F.lit(1)).alias("n"))


def io_read_features(spark, sf):
    """Test rows of one strategy from the partitioned feature set."""
    from changemap.operators.splits import random_all
    from changemap.plans.q_features import feature_table

    path = work_path(spark, "features")
    f = feature_table(spark, sf, reducers=("mean",))
    parts = f.join(random_all(f), "site_id").withColumn("strategy", F.lit("random_all"))
    other = f.withColumn("split", F.when(F.col("aoi").isin(*X.TRAIN_AOIS), "train").otherwise("test")).withColumn("strategy", F.lit("aoi"))
    io.write_features(parts.unionByName(other), path)
    out = io.read_features(spark, path, "test", "random_all", "1x1")
    return out.select("site_id", "orbit", "win", *[F.round(F.col(c) + 1e-8, 6).alias(c) for c in ("vv_pre_1x1_mean", "vv_post_1x1_mean")])


def io_pixel_features(spark, sf):
    """Pixel features stored by window, orbit and tile; bands picked by name."""
    from changemap.functions.names import select_bands
    from changemap.operators.features import from_pixels

    path = work_path(spark, "pixel_features")
    px = X.obs(spark, sf).select(
        F.lpad((F.col("site_id") % 4).cast("string"), 3, "0").alias("tile"), F.floor(F.col("site_id") / 4).cast("int").alias("row"), F.lit(0).alias("col"),
        "orbit", "obs_date", "vv", "vh",
    )
    io.write_pixel_features(from_pixels(px, X.PRE, X.POST, bands=("vv", "vh"), reducers=("mean", "max"), change_date=X.CHANGE), path)
    out = select_bands(io.read_pixels(spark, path), ("vv",), ("win", "orbit", "tile", "row"), reducers=("mean", "max"))
    names = [c for c in out.columns if c.startswith("vv_")]
    return out.withColumns(X.round6(*names))


def io_orbits(spark, sf):
    """Orbit list written as text and parsed again."""
    path = work_path(spark, "orbits")
    sc = X.scenes(spark, sf).withColumn("aoi", F.concat(F.lit("A"), "aoi_no"))
    io.write_orbits(scenes.valid_orbits(sc, X.PRE, 10), path)
    return scenes.aoi_orbits(io.read_orbits(spark, path))


def io_pixels_in_box(spark, sf):
    """Pixels stored with their centres, read back inside a box."""
    from changemap.operators.geo import Grid
    from changemap.operators.pixels import centres

    path = work_path(spark, "pixels")
    centres(X.pixels(spark, sf), Grid(10.0)).repartitionByRange("y", "x").sortWithinPartitions("y", "x").write.parquet(path)
    return io.read_pixels(spark, path, (205.0, 95.0, 745.5, 611.0)).select("win", "row", "col", "pred")


def io_boxed_buildings(spark, sf):
    """Buildings whose box lies inside a box, from the files that may hold any."""
    from changemap.operators.geo import bounds

    path, names = work_path(spark, "boxed"), ("minx", "miny", "maxx", "maxy")
    boxes.write_boxed(bounds(X.edges(spark, sf), "building_id"), path, names, 250)
    return boxes.read_boxed(spark, path, (100.0, 150.0, 640.5, 800.25), names, inside=True).select("building_id")


def io_boxed_pixels(spark, sf):
    """Pixels inside a box, from the files that may hold any."""
    from changemap.operators.geo import Grid
    from changemap.operators.pixels import centres

    path, names = work_path(spark, "boxed"), ("x", "y", "x", "y")
    boxes.write_boxed(centres(X.pixels(spark, sf), Grid(10.0)), path, names, 5000)
    return boxes.read_boxed(spark, path, (205.0, 95.0, 745.5, 611.0), names).select("win", "row", "col", "pred")


def io_pixel_preds(spark, sf):
    """Byte predictions by window and tile; a second write replaces two tiles only."""
    path = work_path(spark, "preds")
    tile = F.lpad((F.floor(F.col("row") / 50) * 2 + F.floor(F.col("col") / 50)).cast("string"), 6, "0")
    p = X.pixels(spark, sf).withColumn("tile", tile).withColumn("pred", F.col("pred").cast("smallint"))
    io.write_pixel_preds(p, path)
    io.write_pixel_preds(p.where((F.col("win") == 2) & (F.col("tile") < "000002")).withColumn("pred", F.lit(1).cast("smallint")), path)
    return io.read_preds(spark, path).groupBy("win", "tile").agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("total"))


def io_preds_or_compute(spark, sf):
    """Predictions computed on the first read and loaded on the second."""
    from changemap.plans.q_predict import orbit_mean

    path = work_path(spark, "saved")
    io.read_preds(spark, path, lambda: orbit_mean(spark, sf).drop("prob"))
    return io.read_preds(spark, path)


def io_labels_by_aoi(spark, sf):
    """Both per-area label sets."""
    path = work_path(spark, "by_aoi")
    io.write_labels_by_aoi(_long(spark, sf), path)
    parts = [spark.read.parquet(f"{path}/{k}").withColumn("kind", F.lit(k)) for k in ("severe", "full")]
    return parts[0].unionByName(parts[1]).select("kind", "aoi", "site_id", "ep", "damage")


def io_runs(spark, sf):
    """Metrics written as JSON per run, read back and ranked."""
    from changemap.plans.q_predict import eval_summarise_runs

    path = work_path(spark, "runs")
    runs = eval_summarise_runs(spark, sf).where(F.col("accuracy").isNotNull())
    io.write_json(runs, path)
    return evaluate.summarise_runs(io.read_runs(spark, path)).select("run_name", *evaluate.METRICS)


def buildings_project_source(spark, sf):
    """Nested source list projected to plain columns, with area and centroid."""
    from changemap.operators.buildings import project_source

    k = F.col("p_partkey")
    raw = X.table(spark, sf, "part").select(
        k.alias("id"), F.col("p_brand").alias("class"), F.lit(None).cast("binary").alias("geometry"),
        F.concat(F.lit('[{"dataset":"'), F.col("p_type"), F.lit('","n":1},{"dataset":"other"}]')).alias("sources"),
    )
    lon, lat = F.lit(34.2) + k * 7919 % 3500 / F.lit(1e4), F.lit(31.2) + k * 104729 % 4000 / F.lit(1e4)
    w, h = F.lit(2e-3), F.lit(3e-3)

    def e(x1, y1, x2, y2):
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    edges = X.table(spark, sf, "part").select(k.alias("building_id"), F.inline(F.array(
        e(lon, lat, lon + w, lat), e(lon + w, lat, lon + w, lat + h), e(lon + w, lat + h, lon, lat + h), e(lon, lat + h, lon, lat))))
    out = project_source(raw, edges).drop("geometry_wkb").where(F.col("lat") < 31.5)
    return out.withColumns({"area": F.round(F.col("area") + 1e-6, 2), "lon": F.round(F.col("lon") + 1e-6, 4), "lat": F.round(F.col("lat") + 1e-6, 4)})


# --- incremental scoring ------------------------------------------------------------

LINE_SCORE = "pmod(l_partkey * 31 + l_linenumber * 17, 256) / 255.0D"


def _line_tiles(df):
    """Pixel rows out of shipments: a tile per supplier, an orbit per line number."""
    return df.select(
        (F.col("l_linenumber") % 4).alias("win"), (F.col("l_suppkey") % 20).alias("tile"), (F.col("l_linenumber") % 3).alias("orbit"),
        F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.expr(LINE_SCORE).alias("prob"),
    )


def stream_score(spark, sf):
    """All shipments scored as a stream, orbits meeting at read time."""
    src, out, ck = work_path(spark, "in"), work_path(spark, "scored"), work_path(spark, "ck")
    t = X.table(spark, sf, "lineitem")
    t.repartition(6, "l_orderkey").write.parquet(src)
    s = _line_tiles(stream.pixel_source(spark, src, t.schema, max_files=2))
    stream.score_stream(s, lambda b: b, out, ck).awaitTermination()
    return stream.scored_pixels(spark, out)


def stream_resume_skip_done(spark, sf):
    """Files that arrive later are scored by a second run; tiles that an earlier output holds are skipped."""
    src, out, ck = work_path(spark, "in"), work_path(spark, "scored"), work_path(spark, "ck")
    t = X.table(spark, sf, "lineitem")
    before = work_path(spark, "before")
    _line_tiles(t).where("tile = 5").write.parquet(f"{before}/batch=0")
    ledger.commit(spark.read.parquet(f"{before}/batch=0"), before, 0)
    for half in (0, 1):
        t.where(F.col("l_orderkey") % 2 == half).write.mode("append").parquet(src)
        s = _line_tiles(stream.pixel_source(spark, src, t.schema))
        stream.score_stream(s, lambda b: b, out, ck, done=lambda: ledger.finished(spark, before).select("win", "tile")).awaitTermination()
    return stream.scored_pixels(spark, out, method="max")


QUERIES = {
    f.__name__: f
    for f in (
        io_csv_to_parquet, io_read_labels, io_read_point_labels, io_read_polygons, io_one_polygon, io_read_assessments,
        io_read_buildings, io_scan_bbox, io_read_admin, io_boundary, io_read_obs, io_rewrite_replaces, io_read_features, io_pixel_features, io_orbits,
        io_pixels_in_box, io_boxed_buildings, io_boxed_pixels, io_pixel_preds, io_preds_or_compute, io_labels_by_aoi, io_runs, buildings_project_source,
        stream_score, stream_resume_skip_done,
    )
}


def _oracles() -> dict[str, str]:
    from changemap.plans import q_geo, q_labels, q_predict
    from changemap.plans.q_features import _features_sql

    long = X.with_views("assess", "sites", "site_summary", extra=(q_labels._LONG,))
    stream_sql = (
        "SELECT CAST(l_linenumber % 4 AS INT) AS win, l_suppkey % 20 AS tile, l_orderkey AS row, l_partkey AS col,"
        " CAST(trunc({agg}((l_partkey * 31 + l_linenumber * 17) % 256 / 255e0) * 255e0 + 1e-9) AS SMALLINT) AS pred FROM lineitem {where} GROUP BY ALL"
    )
    return {
        "io_csv_to_parquet": "SELECT * FROM supplier",
        "io_read_labels": long
        + "SELECT l.site_id || '_' || l.ep AS label_id, l.site_id, aoi, damage, ep, date, lon, lat, y.* EXCLUDE site_id FROM long l JOIN site_summary y ON y.site_id = l.site_id",
        "io_read_point_labels": long + "SELECT site_id || '_' || ep AS label_id, site_id, aoi, damage, ep, date, lon, lat FROM long",
        "io_read_polygons": X.with_views("polygons") + "SELECT poly_id, x1, y1, x2, y2 FROM polygons",
        "io_one_polygon": X.with_views("polygons") + "SELECT e, x1, y1, x2, y2 FROM polygons WHERE poly_id = 6",
        "io_read_assessments": X.with_views("assess", "sites")
        + """SELECT a.site_id || '_' || a.ep AS label_id, a.site_id, s.aoi AS Governorate, src, a.ep, a.date, a.damage
FROM assess a JOIN sites s ON s.site_id = a.site_id, (VALUES ('csv'), ('parquet')) v(src)""",
        "io_read_buildings": X.with_views("buildings") + "SELECT building_id, area_m2, adm2_name FROM buildings WHERE adm2_name = 'NATION_3' AND area_m2 >= 50",
        "io_scan_bbox": X.with_views("edges", extra=(q_geo._BB,))
        + "SELECT building_id FROM bb WHERE minx >= 100 AND miny >= 150 AND maxx <= 640.5 AND maxy <= 800.25",
        "io_read_admin": """SELECT CASE n_name WHEN 'NATION_1' THEN 'Nation One' ELSE n_name END AS adm2_name, r_name AS adm1_name,
 '2_' || n_nationkey AS admin_id FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name LIKE '%AME%'""",
        "io_boundary": X.with_views("points", "polygons", extra=(q_geo._PIP,)) + "SELECT point_id, x, y FROM points WHERE point_id IN (SELECT point_id FROM pip)",
        "io_read_obs": X.with_views("obs", "sites")
        + "SELECT o.site_id, obs_date, vv, vh, aoi, orbit FROM obs o JOIN sites s ON s.site_id = o.site_id WHERE aoi = 'ASIA' AND orbit = 94",
        "io_rewrite_replaces": X.with_views("obs", "sites")
        + "SELECT aoi, orbit, count(*) AS n FROM obs o JOIN sites s ON s.site_id = o.site_id WHERE aoi = 'ASIA' GROUP BY ALL",
        "io_read_features": f"WITH f AS ({_features_sql(('mean',))}), s AS (SELECT site_id, {q_labels._SPLIT.format(p='', seed=42, k='site_id')} FROM (SELECT DISTINCT site_id FROM f))"
        + " SELECT f.site_id, orbit, win, vv_pre_1x1_mean, vv_post_1x1_mean FROM f JOIN s ON s.site_id = f.site_id WHERE split = 'test'",
        "io_pixel_features": X.with_views("obs", windows=X.POST, extra=(
            f"ps AS (SELECT site_id, orbit, avg(vv) AS a, max(vv) AS b FROM obs WHERE obs_date BETWEEN DATE '{X.PRE[0]}' AND DATE '{X.PRE[1]}' GROUP BY ALL)",
            "qs AS (SELECT site_id, orbit, win, avg(vv) AS a, max(vv) AS b FROM obs JOIN windows ON obs_date BETWEEN start_post AND end_post GROUP BY site_id, orbit, win)",
        )) + f"""SELECT w.win, k.orbit, lpad(CAST(k.site_id % 4 AS VARCHAR), 3, '0') AS tile, CAST(k.site_id // 4 AS INT) AS row, {X.r6('ps.a')} AS vv_pre_1x1_mean,
 {X.r6('ps.b')} AS vv_pre_1x1_max, {X.r6('qs.a')} AS vv_post_1x1_mean, {X.r6('qs.b')} AS vv_post_1x1_max
 FROM (SELECT DISTINCT site_id, orbit FROM obs) k CROSS JOIN windows w LEFT JOIN ps ON ps.site_id = k.site_id AND ps.orbit = k.orbit
 LEFT JOIN qs ON qs.site_id = k.site_id AND qs.orbit = k.orbit AND qs.win = w.win""",
        "io_orbits": q_labels._VALID + "SELECT 'A' || aoi AS aoi, orbit FROM v",
        "io_pixels_in_box": q_geo.ORACLES["pixel_in_box"],
        "io_boxed_pixels": q_geo.ORACLES["pixel_in_box"],
        "io_boxed_buildings": X.with_views("edges", extra=(q_geo._BB,))
        + "SELECT building_id FROM bb WHERE minx >= 100 AND miny >= 150 AND maxx <= 640.5 AND maxy <= 800.25",
        "io_pixel_preds": X.with_views("pixels")
        + """SELECT win, tile, count(*) AS n, CAST(sum(CASE WHEN win = 2 AND tile < '000002' THEN 1 ELSE pred END) AS BIGINT) AS total
 FROM (SELECT *, lpad(CAST(row // 50 * 2 + col // 50 AS VARCHAR), 6, '0') AS tile FROM pixels) GROUP BY ALL""",
        "io_preds_or_compute": q_predict._head() + "SELECT site_id, aoi, start_post, pred FROM sp",
        "io_labels_by_aoi": f"SELECT 'severe' AS kind, aoi, site_id, ep, damage FROM ({q_labels._FIRST_SEVERE}) UNION ALL SELECT 'full', aoi, site_id, ep, damage FROM ({q_labels.ORACLES['labels_first']})",
        "io_runs": q_predict.ORACLES["eval_summarise_runs"],
        "buildings_project_source": f"""WITH b AS (SELECT p_type AS dataset, p_partkey AS building_id, p_brand AS osm_class,
 34.2e0 + (p_partkey * 7919 % 3500) / 1e4 AS x, 31.2e0 + (p_partkey * 104729 % 4000) / 1e4 AS y FROM part)
SELECT dataset, building_id, osm_class, round(radians(2e-3) * ({q_geo.authalic("y + 3e-3")} - {q_geo.authalic("y")}) * {q_geo.AUTHALIC_R2!r}::DOUBLE + 1e-6, 2) AS area,
 round(x + 1e-3 + 1e-6, 4) AS lon, round(y + 15e-4 + 1e-6, 4) AS lat FROM b WHERE y + 15e-4 < 31.5e0""",
        "stream_score": stream_sql.format(agg="avg", where=""),
        "stream_resume_skip_done": stream_sql.format(agg="max", where="WHERE l_suppkey % 20 <> 5"),
    }


ORACLES = _oracles()
