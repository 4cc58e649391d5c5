"""Queries: windows and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions.names import feature_name, feature_names
from changemap.functions import scalars as S
from changemap.operators import features, labels, windows
from changemap.plans import fixtures as X

BANDS = ("vv", "vh")


def site_table(spark, sf):
    """Site metadata: area of interest and assessment summary."""
    summary = labels.site_summary(X.assess(spark, sf)).select(
        "site_id", "date_first_severe", F.col("damage_max").alias("damage")
    )
    return X.sites(spark, sf).select("site_id", "aoi").join(summary, "site_id", "left")


def feature_table(spark, sf, **kw):
    kw = {"bands": BANDS, "change_date": X.CHANGE, **kw}
    return features.build_with_pre_window(X.obs(spark, sf), site_table(spark, sf), X.PRE, X.POST, **kw)


def _rounded(df, names):
    return df.withColumns(X.round6(*names))


def features_build(spark, sf):
    return _rounded(feature_table(spark, sf), feature_names(BANDS))


def features_with_counts(spark, sf):
    out = feature_table(spark, sf, with_counts=True, reducers=("mean", "max"))
    return _rounded(out, feature_names(BANDS, ("mean", "max")))


def features_hot_groups(spark, sf):
    """A third of all observations at one site: its groups are as exact as the others."""
    o = X.obs(spark, sf).withColumn("site_id", F.when(F.dayofmonth("obs_date") % 3 == 0, F.lit(7)).otherwise(F.col("site_id")))
    out = features.build_with_pre_window(o, site_table(spark, sf), X.PRE, X.POST, bands=BANDS, change_date=X.CHANGE)
    return _rounded(out, feature_names(BANDS))


def _sql_stats(band: str, alias: str) -> str:
    v = f"CAST({band} AS DOUBLE)"
    const = f"min({band}) = max({band})"
    return f"""avg({v}) AS {alias}_mean, stddev_samp({v}) AS {alias}_stdDev, median({v}) AS {alias}_median,
  min({v}) AS {alias}_min, max({v}) AS {alias}_max,
  CASE WHEN count({band}) < 3 THEN NULL WHEN {const} THEN 0e0 ELSE skewness({v}) END AS {alias}_skew,
  CASE WHEN count({band}) < 4 THEN NULL WHEN {const} THEN 0e0 ELSE kurtosis({v}) END AS {alias}_kurtosis"""


def _features_sql(reducers=P.REDUCERS, counts=False, extra_where="") -> str:
    stats = ",\n  ".join(_sql_stats(b, b) for b in BANDS)
    cols = [
        f"{X.r6(f'{side}.{b}_{r}')} AS {feature_name(b, p, '1x1', r)}"
        for b in BANDS for p, side in (("pre", "p"), ("post", "q")) for r in reducers
    ]
    if counts:
        cols += ["coalesce(p.n, 0) AS n_tiles_pre", "coalesce(q.n, 0) AS n_tiles_post"]
    head = X.with_views(
        "obs", "sites", "site_summary",
        windows=[X.PRE, *X.POST],
        extra=(
            f"pre_stats AS (SELECT site_id, orbit, count(*) AS n, {stats} FROM obs WHERE obs_date BETWEEN DATE '{X.PRE[0]}' AND DATE '{X.PRE[1]}' GROUP BY ALL)",
            f"post_stats AS (SELECT site_id, orbit, win, count(*) AS n, {stats} FROM obs JOIN windows ON obs_date BETWEEN start_post AND end_post GROUP BY site_id, orbit, win)",
            "keys AS (SELECT DISTINCT site_id, orbit FROM obs)",
        ),
    )
    return head + f"""SELECT k.site_id, k.orbit, s.aoi, y.date_first_severe, y.damage_max AS damage, w.win,
 DATE '{X.PRE[0]}' AS start_pre, DATE '{X.PRE[1]}' AS end_pre, w.start_post, w.end_post, w.label,
 {", ".join(cols)}
FROM keys k CROSS JOIN windows w JOIN sites s ON s.site_id = k.site_id
LEFT JOIN site_summary y ON y.site_id = k.site_id
LEFT JOIN pre_stats p ON p.site_id = k.site_id AND p.orbit = k.orbit
LEFT JOIN post_stats q ON q.site_id = k.site_id AND q.orbit = k.orbit AND q.win = w.win
WHERE w.label = 0 OR y.date_first_severe <= w.end_post {extra_where}"""


def window_assign(spark, sf):
    """Observations per window, both ends inclusive."""
    out = windows.assign(X.obs(spark, sf), "obs_date", X.POST)
    return out.groupBy("win", "start_post", "end_post").agg(F.count(F.lit(1)).alias("n"), F.min("obs_date").alias("first"))


def window_assign_half_open(spark, sf):
    out = windows.assign(X.obs(spark, sf), "obs_date", X.POST, inclusive_end=False)
    return out.groupBy("win").agg(F.count(F.lit(1)).alias("n"), F.max("obs_date").alias("last"))


def window_ids(spark, sf):
    """Sites x windows with label and window id."""
    grid = windows.every_window(X.sites(spark, sf).select("site_id"), X.POST)
    grid = grid.withColumn("label", windows.window_label(F.col("end_post"), X.CHANGE))
    return windows.with_id(grid)


def window_pairs(spark, sf):
    """Sites x pre periods x post periods."""
    pre2 = [X.PRE, X.POST[0]]
    return windows.pairs(X.sites(spark, sf).select("site_id", "aoi"), pre2, X.POST).drop("win")


def windows_from_names(spark, sf):
    """Window dates found in file-like names built from the observations."""
    named = windows.with_id(windows.assign(X.obs(spark, sf), "obs_date", X.POST)).select(
        F.concat(F.lit("area_"), "window_id", F.lit(".tif")).alias("path")
    )
    return windows.from_names(named, "path")


def window_sides(spark, sf):
    """Predictions before and after the change, by window start."""
    p = windows.every_window(X.sites(spark, sf).select("site_id"), X.POST)
    return p.groupBy(windows.split_sides("start_post", X.CHANGE).alias("side")).agg(F.count(F.lit(1)).alias("n"))


def features_label_rule(spark, sf):
    """Windows kept per site by the label rule alone."""
    grid = windows.every_window(site_table(spark, sf), [X.PRE, *X.POST])
    grid = grid.withColumn("label", windows.window_label(F.col("end_post"), X.CHANGE))
    kept = grid.where((F.col("label") == 0) | (F.col("date_first_severe") <= F.col("end_post")))
    return kept.groupBy("site_id", "label").agg(F.count(F.lit(1)).alias("n_windows"))


def features_complete(spark, sf):
    """Rows with every feature present, per orbit and label."""
    out = features.drop_incomplete(feature_table(spark, sf), feature_names(BANDS))
    return out.groupBy("orbit", "label").agg(F.count(F.lit(1)).alias("n"))


def features_join_sets(spark, sf):
    """Two feature sets side by side; the second set's shared columns win."""
    a = feature_table(spark, sf, reducers=("mean",))
    b = feature_table(spark, sf, reducers=("max",))
    out = features.join_sets(a, b, ("site_id", "start_post", "orbit"))
    names = feature_names(BANDS, ("mean",)) + feature_names(BANDS, ("max",))
    return _rounded(out, names).select("site_id", "orbit", "start_post", "label", *names)


def features_from_pixels(spark, sf):
    """Feature rows per pixel and orbit, every window kept."""
    o = X.obs(spark, sf)
    px = o.select(
        F.floor(F.col("site_id") / 16).cast("int").alias("tile"),
        F.floor(F.col("site_id") % 16 / 4).cast("int").alias("row"),
        (F.col("site_id") % 4).cast("int").alias("col"),
        "orbit", "obs_date", "vv", "vh",
    )
    out = features.from_pixels(px, X.PRE, X.POST, bands=BANDS, reducers=("mean", "median"), change_date=X.CHANGE)
    return _rounded(out, feature_names(BANDS, ("mean", "median")))


def features_from_pixels_3x3(spark, sf):
    """The same after each scene was smoothed over 3 x 3 cells, with all statistics.

    A scene holds one reading a cell: the second reading of a cell on a day and in an orbit belongs to the second
    scene of that day, and so on, by value. No reading is left out.
    """
    nth = F.row_number().over(Window.partitionBy("site_id", "orbit", "obs_date").orderBy("vv", "vh"))
    k = F.col("site_id")
    px = X.obs(spark, sf).select(
        F.floor(k / 16).cast("int").alias("tile"), F.floor(k % 16 / 4).cast("int").alias("row"), (k % 4).cast("int").alias("col"),
        "orbit", "obs_date", nth.alias("scene"), "vv", "vh",
    )
    out = features.from_pixels(px, X.PRE, X.POST, bands=BANDS, extract_window="3x3", change_date=X.CHANGE, scene=["scene"])
    return _rounded(out, feature_names(BANDS, P.REDUCERS, ("3x3",)))


def features_half_open(spark, sf):
    """Windows without their last day."""
    out = features.build(
        X.obs(spark, sf), site_table(spark, sf), X.PRE, X.POST, bands=BANDS, reducers=("mean", "max"),
        change_date=X.CHANGE, with_counts=True, inclusive_end=False,
    )
    return _rounded(out, feature_names(BANDS, ("mean", "max")))


def features_all_sites(spark, sf):
    """Sites that nobody has observed (here one a part) keep their windows, without values."""
    unseen = X.table(spark, sf, "part").select((-F.col("p_partkey") - 1).alias("site_id"), F.lit("nowhere").alias("aoi"))
    known = site_table(spark, sf).unionByName(unseen, allowMissingColumns=True)
    out = features.build(
        X.obs(spark, sf), known, X.PRE, X.POST, bands=BANDS, reducers=("mean",), change_date=X.CHANGE, grid_from="sites",
    )
    return _rounded(out, feature_names(BANDS, ("mean",))).select("site_id", "orbit", "win", "label", *feature_names(BANDS, ("mean",)))


def features_optical(spark, sf):
    """Several optical bands with image counts per period."""
    o = X.obs(spark, sf).select(
        "site_id", "orbit", "obs_date",
        *[(F.col("vv") * k + F.col("vh")).alias(b) for k, b in enumerate(OPTICAL)],
    )
    out = features.build(
        o, site_table(spark, sf), X.PRE, X.POST, bands=OPTICAL, reducers=("mean", "stdDev"),
        change_date=X.CHANGE, with_counts=True,
    )
    return _rounded(out, feature_names(OPTICAL, ("mean", "stdDev")))


OPTICAL = ("B1", "B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B9", "B11", "B12")


def _optical_sql() -> str:
    stats = ", ".join(f"avg(vv * {k} + vh) AS {b}_mean, stddev_samp(vv * {k} + vh) AS {b}_stdDev" for k, b in enumerate(OPTICAL))
    cols = [
        f"{X.r6(f'{side}.{b}_{r}')} AS {feature_name(b, p, '1x1', r)}"
        for b in OPTICAL for p, side in (("pre", "p"), ("post", "q")) for r in ("mean", "stdDev")
    ]
    return X.with_views(
        "obs", "sites", "site_summary", windows=X.POST,
        extra=(
            f"ps AS (SELECT site_id, orbit, count(*) AS n, {stats} FROM obs WHERE obs_date BETWEEN DATE '{X.PRE[0]}' AND DATE '{X.PRE[1]}' GROUP BY ALL)",
            f"qs AS (SELECT site_id, orbit, win, count(*) AS n, {stats} FROM obs JOIN windows ON obs_date BETWEEN start_post AND end_post GROUP BY site_id, orbit, win)",
            "keys AS (SELECT DISTINCT site_id, orbit FROM obs)",
        ),
    ) + f"""SELECT k.site_id, k.orbit, s.aoi, y.date_first_severe, y.damage_max AS damage, w.win,
 DATE '{X.PRE[0]}' AS start_pre, DATE '{X.PRE[1]}' AS end_pre, w.start_post, w.end_post, w.label,
 {", ".join(cols)}, coalesce(p.n, 0) AS n_tiles_pre, coalesce(q.n, 0) AS n_tiles_post
FROM keys k CROSS JOIN windows w JOIN sites s ON s.site_id = k.site_id
LEFT JOIN site_summary y ON y.site_id = k.site_id
LEFT JOIN ps p ON p.site_id = k.site_id AND p.orbit = k.orbit
LEFT JOIN qs q ON q.site_id = k.site_id AND q.orbit = k.orbit AND q.win = w.win
WHERE w.label = 0 OR y.date_first_severe <= w.end_post"""


def _pixel_features_sql() -> str:
    stats = ", ".join(f"avg({b}) AS {b}_mean, median({b}) AS {b}_median" for b in BANDS)
    cols = [
        f"{X.r6(f'{side}.{b}_{r}')} AS {feature_name(b, p, '1x1', r)}"
        for b in BANDS for p, side in (("pre", "p"), ("post", "q")) for r in ("mean", "median")
    ]
    return X.with_views(
        "obs", windows=X.POST,
        extra=(
            "px AS (SELECT *, CAST(site_id // 16 AS INT) AS tile, CAST(site_id % 16 // 4 AS INT) AS row, CAST(site_id % 4 AS INT) AS col FROM obs)",
            f"ps AS (SELECT tile, row, col, orbit, {stats} FROM px WHERE obs_date BETWEEN DATE '{X.PRE[0]}' AND DATE '{X.PRE[1]}' GROUP BY ALL)",
            f"qs AS (SELECT tile, row, col, orbit, win, {stats} FROM px JOIN windows ON obs_date BETWEEN start_post AND end_post GROUP BY tile, row, col, orbit, win)",
            "keys AS (SELECT DISTINCT tile, row, col, orbit FROM px)",
        ),
    ) + f"""SELECT k.tile, k.row, k.col, k.orbit, w.win, DATE '{X.PRE[0]}' AS start_pre, DATE '{X.PRE[1]}' AS end_pre,
 w.start_post, w.end_post, w.label, {", ".join(cols)}
FROM keys k CROSS JOIN windows w
LEFT JOIN ps p ON p.tile = k.tile AND p.row = k.row AND p.col = k.col AND p.orbit = k.orbit
LEFT JOIN qs q ON q.tile = k.tile AND q.row = k.row AND q.col = k.col AND q.orbit = k.orbit AND q.win = w.win"""


def _smoothed_sql() -> str:
    stats = ", ".join(_sql_stats(b, b) for b in BANDS)
    cols = [
        f"{X.r6(f'{side}.{b}_{r}')} AS {feature_name(b, p, '3x3', r)}"
        for b in BANDS for p, side in (("pre", "p"), ("post", "q")) for r in P.REDUCERS
    ]
    k = "tile, row, col, orbit"
    same = " AND ".join(f"{{0}}.{c} = k.{c}" for c in ("tile", "row", "col", "orbit"))
    return X.with_views(
        "obs", windows=X.POST,
        extra=(
            "c AS (SELECT CAST(site_id // 16 AS INT) AS tile, CAST(site_id % 16 // 4 AS INT) AS row, CAST(site_id % 4 AS INT) AS col, orbit, obs_date,"
            " row_number() OVER (PARTITION BY site_id, orbit, obs_date ORDER BY vv, vh) AS scene, vv, vh FROM obs)",
            "px AS (SELECT a.tile, a.row, a.col, a.orbit, a.obs_date, a.scene, round(avg(b.vv), 9) AS vv, round(avg(b.vh), 9) AS vh FROM c a JOIN c b ON b.tile = a.tile AND b.orbit = a.orbit"
            " AND b.obs_date = a.obs_date AND b.scene = a.scene AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL)",
            f"ps AS (SELECT {k}, {stats} FROM px WHERE obs_date BETWEEN DATE '{X.PRE[0]}' AND DATE '{X.PRE[1]}' GROUP BY ALL)",
            f"qs AS (SELECT {k}, win, {stats} FROM px JOIN windows ON obs_date BETWEEN start_post AND end_post GROUP BY {k}, win)",
            f"keys AS (SELECT DISTINCT {k} FROM px)",
        ),
    ) + f"""SELECT k.tile, k.row, k.col, k.orbit, w.win, DATE '{X.PRE[0]}' AS start_pre, DATE '{X.PRE[1]}' AS end_pre,
 w.start_post, w.end_post, w.label, {", ".join(cols)}
FROM keys k CROSS JOIN windows w LEFT JOIN ps p ON {same.format("p")} LEFT JOIN qs q ON {same.format("q")} AND q.win = w.win"""


def _half_open_sql() -> str:
    sql = _features_sql(("mean", "max"), counts=True).replace("obs_date BETWEEN start_post AND end_post", "obs_date >= start_post AND obs_date < end_post")
    sql = sql.replace(f"obs_date BETWEEN DATE '{X.PRE[0]}' AND DATE '{X.PRE[1]}'", f"obs_date >= DATE '{X.PRE[0]}' AND obs_date < DATE '{X.PRE[1]}'")
    return f"WITH f AS ({sql}) SELECT * REPLACE (CAST(win - 1 AS INT) AS win) FROM f WHERE start_post <> start_pre"


def _all_sites_sql() -> str:
    names = ", ".join(feature_names(BANDS, ("mean",)))
    none = ", ".join(f"NULL AS {n}" for n in feature_names(BANDS, ("mean",)))
    seen = f"SELECT site_id, orbit, win - 1 AS win, label, {names} FROM ({_features_sql(('mean',))}) WHERE win > 1"
    return X.with_views("sites", "site_summary", "obs", windows=X.POST) + f"""SELECT * FROM ({seen}) UNION ALL
SELECT s.site_id, NULL, w.win, w.label, {none} FROM (SELECT site_id FROM sites UNION ALL SELECT -p_partkey - 1 FROM part) s CROSS JOIN windows w
LEFT JOIN site_summary y ON y.site_id = s.site_id
WHERE s.site_id NOT IN (SELECT site_id FROM obs) AND (w.label = 0 OR y.date_first_severe <= w.end_post)"""


def stats_seven_moments(spark, sf):
    """Seven statistics of price per supplier and line number."""
    from changemap.functions.median import grouped_agg
    from changemap.functions.moments import reducer

    li = X.table(spark, sf, "lineitem")
    aggs = [reducer(r, "l_extendedprice").alias(r) for r in P.REDUCERS if r != "median"]
    out = grouped_agg(li, ["l_suppkey", "l_linenumber"], aggs, {"median": "l_extendedprice"})
    return out.withColumns(X.round6(*P.REDUCERS))


def feature_name_parts(spark, sf):
    """Names split back into their parts, with the number of values behind each."""
    from changemap.functions.names import split_name

    names = feature_names(BANDS)
    f = feature_table(spark, sf)
    long = f.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names])))
    per = long.groupBy("feature").agg(F.count("v").alias("n"))
    return per.select("feature", "n", *[c.alias(k) for k, c in split_name("feature").items()])


def _name_parts_sql() -> str:
    base = _features_sql()
    unions = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, count({n}) AS n, '{n.split('_')[0]}' AS band, '{n.split('_')[1]}' AS period,"
        f" '{n.split('_')[2]}' AS \"window\", '{n.split('_')[3]}' AS reducer FROM f"
        for n in feature_names(BANDS)
    )
    return f"WITH f AS ({base}) {unions}"


def dates_from_millis(spark, sf):
    """Scenes per day out of epoch milliseconds."""
    return X.scenes(spark, sf).groupBy(S.millis_to_date("time_start").alias("day")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        features_build, features_with_counts, features_hot_groups, features_label_rule, features_complete,
        features_join_sets, features_from_pixels, features_from_pixels_3x3, features_half_open, features_all_sites, features_optical, window_assign, window_assign_half_open,
        window_ids, window_pairs, windows_from_names, window_sides, stats_seven_moments, feature_name_parts,
        dates_from_millis,
    )
}

ORACLES = {
    "features_build": _features_sql(),
    "features_hot_groups": _features_sql().replace("l_suppkey AS site_id,\n       CASE l_linenumber", "CASE WHEN day(l_shipdate) % 3 = 0 THEN 7 ELSE l_suppkey END AS site_id,\n       CASE l_linenumber"),
    "features_with_counts": _features_sql(("mean", "max"), counts=True),
    "features_label_rule": X.with_views("sites", "site_summary", windows=[X.PRE, *X.POST])
    + """SELECT s.site_id, w.label, count(*) AS n_windows FROM sites s CROSS JOIN windows w
LEFT JOIN site_summary y ON y.site_id = s.site_id
WHERE w.label = 0 OR y.date_first_severe <= w.end_post GROUP BY ALL""",
    "features_complete": f"WITH f AS ({_features_sql()}) SELECT orbit, label, count(*) AS n FROM f WHERE "
    + " AND ".join(f"{n} IS NOT NULL" for n in feature_names(BANDS))
    + " GROUP BY ALL",
    "features_join_sets": f"WITH f AS ({_features_sql(('mean', 'max'))}) SELECT site_id, orbit, start_post, label, "
    + ", ".join(feature_names(BANDS, ("mean",)) + feature_names(BANDS, ("max",)))
    + " FROM f",
    "features_from_pixels": _pixel_features_sql(),
    "features_from_pixels_3x3": _smoothed_sql(),
    "features_half_open": _half_open_sql(),
    "features_all_sites": _all_sites_sql(),
    "features_optical": _optical_sql(),
    "window_assign": X.with_views("obs", windows=X.POST)
    + "SELECT win, start_post, end_post, count(*) AS n, min(obs_date) AS first FROM obs JOIN windows ON obs_date BETWEEN start_post AND end_post GROUP BY ALL",
    "window_assign_half_open": X.with_views("obs", windows=X.POST)
    + "SELECT win, count(*) AS n, max(obs_date) AS last FROM obs JOIN windows ON obs_date >= start_post AND obs_date < end_post GROUP BY ALL",
    "window_ids": X.with_views("sites", windows=X.POST)
    + "SELECT site_id, win, start_post, end_post, label, printf('w%02d_%s_%s', win, CAST(start_post AS VARCHAR), CAST(end_post AS VARCHAR)) AS window_id FROM sites CROSS JOIN windows",
    "window_pairs": X.with_views("sites", windows=X.POST)
    + f"""SELECT site_id, aoi, p.start_pre, p.end_pre, start_post, end_post FROM sites CROSS JOIN windows CROSS JOIN
 (VALUES (DATE '{X.PRE[0]}', DATE '{X.PRE[1]}'), (DATE '{X.POST[0][0]}', DATE '{X.POST[0][1]}')) p(start_pre, end_pre)""",
    "windows_from_names": X.with_views("obs", windows=X.POST)
    + "SELECT DISTINCT start_post, end_post FROM obs JOIN windows ON obs_date BETWEEN start_post AND end_post",
    "window_sides": X.with_views("sites", windows=X.POST)
    + f"SELECT CASE WHEN start_post < DATE '{X.CHANGE}' THEN 'before' ELSE 'after' END AS side, count(*) AS n FROM sites CROSS JOIN windows GROUP BY ALL",
    "stats_seven_moments": "SELECT l_suppkey, l_linenumber, "
    + ", ".join(f"{X.r6(f'x_{r}')} AS {r}" for r in P.REDUCERS)
    + f" FROM (SELECT l_suppkey, l_linenumber, {_sql_stats('l_extendedprice', 'x')} FROM lineitem GROUP BY ALL)",
    "feature_name_parts": _name_parts_sql(),
    "dates_from_millis": "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL",
}
