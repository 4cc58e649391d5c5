"""Views that give the driver's tables the shapes this library works on.

Every view exists twice: as DataFrame code and as the SQL text the checks run.
All of them grow with the tables they read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changemap import params as P

D = dt.date
CHANGE = D(1997, 1, 7)
PRE = (D(1995, 1, 7), D(1996, 1, 6))
POST = P.month_windows(D(1996, 1, 7), 19)
# The plane of the spatial views is a column of 1 km squares. Each takes its share of
# the keys, so the plane grows with the tables and its density does not.
BUILDINGS_A_SQUARE, POINTS_A_SQUARE, POLYGONS_A_SQUARE = 500, 375, 25
SHIPMENTS_A_TASK = 25_000  # behind whose cells there are at most 19 times as many pixels
TRAIN_AOIS = ("AFRICA", "AMERICA")
TEST_AOIS = ("ASIA", "EUROPE", "MIDDLE EAST")


def _square(k, n: int, metres: float = 1000.0):
    """How far up the square of key ``k`` lies."""
    return F.floor(k / n) * F.lit(metres)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _day(c: str):
    return F.col(c).cast("date")


def obs(spark, sf) -> DataFrame:
    """Radar observations per site, orbit and date."""
    ln = F.col("l_linenumber") % 3
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("site_id"),
        F.when(ln == 0, F.lit(87)).when(ln == 1, F.lit(94)).otherwise(F.lit(160)).alias("orbit"),
        _day("l_shipdate").alias("obs_date"),
        (F.col("l_extendedprice") / F.lit(1e3)).alias("vv"),
        (F.col("l_discount") * F.lit(1e2)).alias("vh"),
    )


def sites(spark, sf) -> DataFrame:
    """Points with district and area of interest."""
    k = F.col("s_suppkey")
    return (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            k.alias("site_id"),
            F.col("r_name").alias("aoi"),
            F.col("n_name").alias("adm2_name"),
            (F.lit(34.2) + (k * 7919 % 3500) / F.lit(1e4)).alias("lon"),
            (F.lit(31.2) + (k * 104729 % 4000) / F.lit(1e4)).alias("lat"),
        )
    )


def assess(spark, sf) -> DataFrame:
    """Assessments, long: a supplier's shipments after the change fall into 14
    epochs of four months, each with its first date and the class of its lowest order."""
    d = _day("l_shipdate")
    m = F.col("l_orderkey") % 7
    damage = F.when(m == 0, F.lit(11)).otherwise(m.cast("int"))
    ep = F.least((F.year(d) - 1997) * 3 + F.floor((F.month(d) - 1) / 4) + 1, F.lit(P.N_EPOCHS)).cast("int")
    return (
        table(spark, sf, "lineitem")
        .where(d >= F.lit(CHANGE))
        .groupBy(F.col("l_suppkey").alias("site_id"), ep.alias("ep"))
        .agg(F.min_by(damage, "l_orderkey").alias("damage"), F.min(d).alias("date"))
    )


def assess_wide(spark, sf) -> DataFrame:
    """One row per site with 14 (date, class) column pairs and its district."""
    eps = range(1, P.N_EPOCHS + 1)
    cols = []
    for e in eps:
        cols.append(F.max(F.when(F.col("ep") == e, F.col("date"))).alias(f"date_{e}"))
        cols.append(F.max(F.when(F.col("ep") == e, F.col("damage"))).alias(f"class_{e}"))
    wide = assess(spark, sf).groupBy("site_id").agg(*cols)
    return sites(spark, sf).join(wide, "site_id", "left")


def preds(spark, sf) -> DataFrame:
    """Pseudo-predictions per site, orbit and window number: model-free."""
    k = F.col("site_id")
    return (
        table(spark, sf, "supplier")
        .select(F.col("s_suppkey").alias("site_id"))
        .withColumn("orbit", F.explode(F.array(F.lit(87), F.lit(94), F.lit(160))))
        .withColumn("win", F.explode(F.sequence(F.lit(1), F.lit(19))))
        .withColumn(
            "prob",
            (
                (k * 31 + F.col("win") * 17 + F.col("orbit") + F.when(F.col("win") > 7, F.lit(60)).otherwise(F.lit(0)))
                % 256
            )
            / F.lit(255.0),
        )
    )


def edges(spark, sf) -> DataFrame:
    """Building edges in local metres: rectangles, counter-clockwise."""
    k = F.col("p_partkey")
    b = table(spark, sf, "part").select(
        k.alias("building_id"),
        (k * 97 % 9700 / F.lit(1e1)).alias("x0"),
        (k * 193 % 9700 / F.lit(1e1) + _square(k, BUILDINGS_A_SQUARE)).alias("y0"),
        (F.lit(4.0) + F.col("p_size") % 20).alias("w"),
        (F.lit(4.0) + k % 17).alias("h"),
    )
    x0, y0 = F.col("x0"), F.col("y0")
    x9, y9 = x0 + F.col("w"), y0 + F.col("h")

    def e(i, x1, y1, x2, y2):
        return F.struct(F.lit(i).alias("e"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    return b.select(
        "building_id",
        F.inline(F.array(e(1, x0, y0, x9, y0), e(2, x9, y0, x9, y9), e(3, x9, y9, x0, y9), e(4, x0, y9, x0, y0))),
    )


def buildings(spark, sf) -> DataFrame:
    """Building attributes; the district is a nation."""
    k = F.col("p_partkey")
    w, h = F.lit(4.0) + F.col("p_size") % 20, F.lit(4.0) + k % 17
    return (
        table(spark, sf, "part")
        .select(
            k.alias("building_id"),
            (w * h).alias("area_m2"),
            (k * 97 % 9700 / F.lit(1e1)).alias("x0"),
            (k * 193 % 9700 / F.lit(1e1) + _square(k, BUILDINGS_A_SQUARE)).alias("y0"),
            (k % 25).cast("int").alias("n_nationkey"),
        )
        .join(table(spark, sf, "nation"), "n_nationkey")
        .select("building_id", "area_m2", "x0", "y0", F.col("n_name").alias("adm2_name"))
    )


def pixels(spark, sf) -> DataFrame:
    """Dense probability pixels on a 10 m grid: every cell that a shipment falls in, in
    the square of its part, one value per window, 0 = no data."""
    r, c = F.col("row"), F.col("col")
    # a cell becomes 19 rows behind the shuffle: its partitions must not be merged by their size before that, and
    # grow in number with the table, or what groups the rows of a task outgrows its memory
    shipments = table(spark, sf, "lineitem")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shipments.count() // SHIPMENTS_A_TASK))
    return (
        shipments
        .select(
            ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % 100 + F.floor(F.col("l_partkey") / BUILDINGS_A_SQUARE) * 100).cast("int").alias("row"),
            ((F.col("l_partkey") * 13 + F.col("l_linenumber")) % 100).cast("int").alias("col"),
        )
        .repartition(tasks, "row", "col")
        .distinct()
        .select("row", "col", F.explode(F.sequence(F.lit(1), F.lit(19))).alias("win"))
        .select("win", "row", "col", ((r * 7 + c * 13 + F.col("win") * 29) % 256).cast("int").alias("pred"))
    )


def polygons(spark, sf) -> DataFrame:
    """District edges: one notched pentagon per supplier in a 200 m cell, every
    second one with a square hole; outer rings run counter-clockwise."""
    k = F.col("s_suppkey")
    ox, oy = (k % 5) * F.lit(200.0), F.floor(k / 5) * F.lit(200.0)

    def e(i, x1, y1, x2, y2):
        return F.struct(
            F.lit(i).alias("e"),
            (ox + F.lit(float(x1))).alias("x1"),
            (oy + F.lit(float(y1))).alias("y1"),
            (ox + F.lit(float(x2))).alias("x2"),
            (oy + F.lit(float(y2))).alias("y2"),
        )

    outer = [e(*t) for t in POLY_OUTER]
    hole = [e(*t) for t in POLY_HOLE]
    return table(spark, sf, "supplier").select(
        k.alias("poly_id"),
        F.inline(F.when(k % 2 == 0, F.array(*outer, *hole)).otherwise(F.array(*outer))),
    )


POLY_OUTER = [
    (1, 0, 0, 200, 0), (2, 200, 0, 200, 200), (3, 200, 200, 100, 120), (4, 100, 120, 0, 200), (5, 0, 200, 0, 0),
]
POLY_HOLE = [(6, 60, 40, 60, 80), (7, 60, 80, 100, 80), (8, 100, 80, 100, 40), (9, 100, 40, 60, 40)]


def points(spark, sf) -> DataFrame:
    """Points in local metres with a class, for the spatial joins."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("point_id"),
        (k * 7919 % 10000 / F.lit(1e1) + F.lit(0.03)).alias("x"),
        (k * 104729 % 10000 / F.lit(1e1) + F.lit(0.07) + _square(k, POINTS_A_SQUARE)).alias("y"),
        (k % 6 + 1).cast("int").alias("damage"),
        (k % 14 + 1).cast("int").alias("ep"),
        F.date_add(F.lit(CHANGE), (k % 700).cast("int")).alias("date"),
        (k * 37 % 256).cast("int").alias("pred"),
    )


def scenes(spark, sf) -> DataFrame:
    """Scene metadata, one per order; order dates are midnights in UTC."""
    k = F.col("o_orderkey")
    pol = (
        F.when(k % 4 == 0, F.array(F.lit("VV")))
        .when(k % 4 == 1, F.array(F.lit("HH"), F.lit("HV")))
        .otherwise(F.array(F.lit("VV"), F.lit("VH")))
    )
    return table(spark, sf, "orders").select(
        k.alias("scene_id"),
        pol.alias("polarisation"),
        F.when(k % 5 == 0, F.lit("EW")).otherwise(F.lit("IW")).alias("mode"),
        F.when(F.col("o_orderstatus") == "F", F.lit("A")).otherwise(F.lit("B")).alias("platform"),
        F.when(k % 3 == 0, F.lit(87)).when(k % 3 == 1, F.lit(94)).otherwise(F.lit(160)).alias("orbit"),
        (F.unix_date(_day("o_orderdate")).cast("bigint") * 86_400_000).alias("time_start"),
        (F.col("o_custkey") % 5).cast("int").alias("aoi_no"),
    )


def scene_pixels(spark, sf) -> DataFrame:
    """Band values per scene and cell of a grid 50 cells high."""
    s = F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("scene_id"),
        (s % 50).cast("int").alias("row"),
        F.floor(s / 50).cast("int").alias("col"),
        (F.col("l_extendedprice") / F.lit(1e3)).alias("vv"),
        F.when(F.col("l_quantity") > 5, F.col("l_discount") * F.lit(1e2)).alias("vh"),
    )


# --- the same views as SQL ---------------------------------------------------

SQL = {
    "obs": """
SELECT l_suppkey AS site_id,
       CASE l_linenumber % 3 WHEN 0 THEN 87 WHEN 1 THEN 94 ELSE 160 END AS orbit,
       CAST(l_shipdate AS DATE) AS obs_date, l_extendedprice / 1e3 AS vv, l_discount * 1e2 AS vh
FROM lineitem""",
    "sites": """
SELECT s_suppkey AS site_id, r_name AS aoi, n_name AS adm2_name,
       34.2e0 + (s_suppkey * 7919 % 3500) / 1e4 AS lon, 31.2e0 + (s_suppkey * 104729 % 4000) / 1e4 AS lat
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "assess": """
SELECT l_suppkey AS site_id,
       CAST(least((year(l_shipdate) - 1997) * 3 + (month(l_shipdate) - 1) // 4 + 1, 14) AS INT) AS ep,
       arg_min(CASE WHEN l_orderkey % 7 = 0 THEN 11 ELSE CAST(l_orderkey % 7 AS INT) END, l_orderkey) AS damage,
       CAST(min(l_shipdate) AS DATE) AS date
FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1997-01-07' GROUP BY ALL""",
    "preds": """
SELECT s_suppkey AS site_id, orbit, win,
       (s_suppkey * 31 + win * 17 + orbit + CASE WHEN win > 7 THEN 60 ELSE 0 END) % 256 / 255e0 AS prob
FROM supplier, (VALUES (87), (94), (160)) o(orbit), (SELECT CAST(range AS INT) AS win FROM range(1, 20)) w""",
    "edges": """
SELECT building_id, e,
  CASE e WHEN 1 THEN x0 WHEN 2 THEN x0 + w WHEN 3 THEN x0 + w ELSE x0 END AS x1,
  CASE e WHEN 1 THEN y0 WHEN 2 THEN y0 WHEN 3 THEN y0 + h ELSE y0 + h END AS y1,
  CASE e WHEN 1 THEN x0 + w WHEN 2 THEN x0 + w WHEN 3 THEN x0 ELSE x0 END AS x2,
  CASE e WHEN 1 THEN y0 WHEN 2 THEN y0 + h WHEN 3 THEN y0 + h ELSE y0 END AS y2
FROM (SELECT p_partkey AS building_id, (p_partkey * 97 % 9700) / 1e1 AS x0, (p_partkey * 193 % 9700) / 1e1 + p_partkey // 500 * 1e3 AS y0,
             4e0 + p_size % 20 AS w, 4e0 + p_partkey % 17 AS h FROM part) b,
     (VALUES (1), (2), (3), (4)) k(e)""",
    "buildings": """
SELECT p_partkey AS building_id, (4e0 + p_size % 20) * (4e0 + p_partkey % 17) AS area_m2,
       (p_partkey * 97 % 9700) / 1e1 AS x0, (p_partkey * 193 % 9700) / 1e1 + p_partkey // 500 * 1e3 AS y0, n_name AS adm2_name
FROM part JOIN nation ON p_partkey % 25 = n_nationkey""",
    "pixels": """
SELECT win, row, col, CAST((row * 7 + col * 13 + win * 29) % 256 AS INT) AS pred
FROM (SELECT DISTINCT CAST((l_orderkey * 7 + l_suppkey) % 100 + l_partkey // 500 * 100 AS INT) AS row,
             CAST((l_partkey * 13 + l_linenumber) % 100 AS INT) AS col FROM lineitem) c,
     (SELECT CAST(range AS INT) AS win FROM range(1, 20)) w""",
    "polygons": "SELECT s_suppkey AS poly_id, e, (s_suppkey % 5) * 2e2 + a AS x1, (s_suppkey // 5) * 2e2 + b AS y1,"
    " (s_suppkey % 5) * 2e2 + c AS x2, (s_suppkey // 5) * 2e2 + d AS y2 FROM supplier, (VALUES "
    + ", ".join(str(t) for t in POLY_OUTER + POLY_HOLE)
    + ") v(e, a, b, c, d) WHERE e <= 5 OR s_suppkey % 2 = 0",
    "points": """
SELECT c_custkey AS point_id, c_custkey * 7919 % 10000 / 1e1 + 0.03e0 AS x,
       c_custkey * 104729 % 10000 / 1e1 + 0.07e0 + c_custkey // 375 * 1e3 AS y, CAST(c_custkey % 6 + 1 AS INT) AS damage,
       CAST(c_custkey % 14 + 1 AS INT) AS ep, DATE '1997-01-07' + CAST(c_custkey % 700 AS INT) AS date,
       CAST(c_custkey * 37 % 256 AS INT) AS pred
FROM customer""",
    "scenes": """
SELECT o_orderkey AS scene_id,
       CASE o_orderkey % 4 WHEN 0 THEN ['VV'] WHEN 1 THEN ['HH', 'HV'] ELSE ['VV', 'VH'] END AS polarisation,
       CASE WHEN o_orderkey % 5 = 0 THEN 'EW' ELSE 'IW' END AS mode,
       CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'B' END AS platform,
       CASE o_orderkey % 3 WHEN 0 THEN 87 WHEN 1 THEN 94 ELSE 160 END AS orbit,
       epoch_ms(o_orderdate) AS time_start, CAST(o_custkey % 5 AS INT) AS aoi_no
FROM orders""",
    "scene_pixels": """
SELECT l_orderkey AS scene_id, CAST(l_suppkey % 50 AS INT) AS row, CAST(l_suppkey // 50 AS INT) AS col,
       l_extendedprice / 1e3 AS vv, CASE WHEN l_quantity > 5 THEN l_discount * 1e2 END AS vh
FROM lineitem""",
}


def values_sql(name: str = "windows", spans=None, first: int = 1) -> str:
    """The window list as a CTE: ``win, start_post, end_post, label``."""
    rows = ", ".join(
        f"({i}, DATE '{s}', DATE '{e}', {int(e > CHANGE)})" for i, (s, e) in enumerate(spans or POST, first)
    )
    return f"{name}(win, start_post, end_post, label) AS (VALUES {rows})"


SQL["site_summary"] = """
SELECT site_id, min(date) AS date_first, min(CASE WHEN damage IN (1, 2) THEN date END) AS date_first_severe,
       min(CASE WHEN damage = 1 THEN date END) AS date_first_destroyed, min(damage) AS damage_max
FROM assess GROUP BY site_id"""
NEEDS = {"site_summary": ("assess",)}


def with_views(*names: str, windows=None, extra: tuple[str, ...] = ()) -> str:
    """``WITH`` clause holding the named views (and the window list)."""
    order: list[str] = []
    for n in names:
        for d in (*NEEDS.get(n, ()), n):
            if d not in order:
                order.append(d)
    parts = [f"{n} AS ({SQL[n].strip()})" for n in order]
    if windows is not None:
        parts.insert(0, values_sql(spans=windows))
    return "WITH " + ",\n".join([*parts, *extra]) + "\n"


def r6(expr: str) -> str:
    """Rounding for comparison, SQL side."""
    return f"round({expr} + CAST(1e-8 AS DOUBLE), 6)"


def round6(*cols: str):
    """Rounding for comparison, DataFrame side: ``df.withColumns(round6(...))``."""
    return {c: F.round(F.col(c) + F.lit(1e-8), 6) for c in cols}
