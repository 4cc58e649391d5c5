"""Queries: labels, label statistics, splits, scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions import scalars as S
from changemap.operators import labels, scenes, splits, stats
from changemap.plans import fixtures as X

AOI_OF = {"AFRICA": "A1", "AMERICA": "A2", "ASIA": "A3", "EUROPE": "A4"}
TRAIN, TEST = X.TRAIN_AOIS, X.TEST_AOIS


def _long(spark, sf):
    """Long labels at a location shared by about four sites."""
    s = X.sites(spark, sf).select("site_id", "aoi", *_place())
    return X.assess(spark, sf).join(s, "site_id")


def _place():
    k = F.floor(F.col("site_id") / 4)
    return [(k % 100 / F.lit(1e3)).alias("lon"), (F.floor(k / 100) / F.lit(1e3)).alias("lat")]


_LONG = (
    "long AS (SELECT a.*, s.aoi, a.site_id // 4 % 100 / 1e3 AS lon, a.site_id // 400 / 1e3 AS lat"
    " FROM assess a JOIN sites s ON s.site_id = a.site_id)"
)


def labels_to_long(spark, sf):
    return labels.to_long(X.assess_wide(spark, sf), ["site_id", "aoi"])


def labels_site_summary(spark, sf):
    return labels.with_summary(X.assess(spark, sf))


def labels_assign_aoi(spark, sf):
    """District names to area ids; one name has no area and drops out."""
    return labels.assign_aoi(X.sites(spark, sf).select("site_id", "aoi"), AOI_OF, "aoi", "area_id")


def labels_decode_class(spark, sf):
    a = X.assess(spark, sf)
    return a.select("site_id", "ep", S.decode_class("damage", {1: "one", 2: "two", 11: "eleven"}).alias("name"))


def labels_location_key(spark, sf):
    """Supplier coordinates as location keys at two decimals."""
    kx, ky = S.location_key(F.col("lon") * 1.5, F.col("lat") * 1.5, 2)
    return X.sites(spark, sf).groupBy(kx.alias("kx"), ky.alias("ky")).agg(F.count(F.lit(1)).alias("n"))


def labels_last(spark, sf):
    return labels.combine(_long(spark, sf), "last")


def labels_most_severe(spark, sf):
    return labels.combine(_long(spark, sf), "min")


def labels_first(spark, sf):
    return labels.combine(_long(spark, sf), "first")


def labels_first_severe(spark, sf):
    return labels.combine(_long(spark, sf), "first_severe")


def labels_load(spark, sf):
    """Last epoch per location, then classes 1-2, then two areas."""
    return labels.load(_long(spark, sf), list(TRAIN), [1, 2], "last")


def stats_label_counts(spark, sf):
    return stats.label_counts(labels.combine(_long(spark, sf), "first_severe"))


def stats_date_distribution(spark, sf):
    return stats.date_distribution(labels.site_summary(X.assess(spark, sf)))


def stats_value_counts(spark, sf):
    return stats.value_counts(X.buildings(spark, sf), "adm2_name")


def stats_class_crosstab(spark, sf):
    last = labels.combine(_long(spark, sf), "last")
    return stats.class_crosstab(last.withColumnRenamed("aoi", "municipality"))


def stats_class_shares(spark, sf):
    return stats.class_shares(X.assess(spark, sf))


def stats_distinct(spark, sf):
    return stats.distinct_count(X.obs(spark, sf), "site_id", "orbit")


def split_by_aoi(spark, sf):
    return splits.by_aoi(X.sites(spark, sf), TRAIN, TEST).groupBy("split", "aoi").agg(F.count(F.lit(1)).alias("n"))


def split_random_all(spark, sf):
    return splits.random_all(X.obs(spark, sf))


def split_random_per_aoi(spark, sf):
    return splits.random_per_aoi(X.sites(spark, sf))


def split_random_orders(spark, sf):
    """The exact split over the whole order table."""
    return splits.random_all(X.table(spark, sf, "orders"), seed=7, site="o_orderkey")


def split_apply(spark, sf):
    """Observations of the train part."""
    sp = splits.random_all(X.obs(spark, sf))
    out = splits.apply(X.obs(spark, sf), sp, "train")
    return out.groupBy("site_id", "orbit").agg(F.count(F.lit(1)).alias("n"))


def split_site_union(spark, sf):
    """Distinct ids seen in observations or in the site table."""
    return splits.site_union(X.obs(spark, sf), X.sites(spark, sf))


def scenes_radar(spark, sf):
    out = scenes.select_radar(X.scenes(spark, sf), X.PRE[0], X.CHANGE, orbit=94)
    return out.select("scene_id", "mode", "platform", "orbit", "time_start")


def scenes_radar_any_platform(spark, sf):
    out = scenes.select_radar(
        X.scenes(spark, sf), platform=None, polarisations=("HH",), footprint=F.col("aoi_no").isin(1, 2)
    )
    return out.groupBy("platform", "aoi_no").agg(F.count(F.lit(1)).alias("n"))


def scenes_optical(spark, sf):
    """Images joined with their cloud score and masked below 0.6."""
    k = F.col("o_orderkey")
    images = X.table(spark, sf, "orders").select(
        k.alias("image_id"), (k % 100 / F.lit(1e1)).alias("B2"), (k % 90 / F.lit(1e1)).alias("B8"),
        F.col("o_totalprice").alias("B99"),
    )
    scores = X.table(spark, sf, "orders").where(F.col("o_orderpriority") != "5-LOW").select(
        k.alias("image_id"), (F.col("o_custkey") % 11 / F.lit(1e1)).alias("cs")
    )
    return scenes.select_optical(images, scores, ("B2", "B8"))


def scenes_valid_orbits(spark, sf):
    sc = X.scenes(spark, sf).withColumnRenamed("aoi_no", "aoi")
    return scenes.format_orbits(scenes.valid_orbits(sc, X.PRE, 10))


def scenes_orbits_in_all_periods(spark, sf):
    return scenes.orbits_in_all_periods(X.scenes(spark, sf), [X.PRE, X.POST[3]], 5, ["aoi_no"])


def scenes_aoi_orbits(spark, sf):
    """Area and orbit pairs out of the text list."""
    sc = X.scenes(spark, sf).withColumnRenamed("aoi_no", "aoi")
    text = scenes.format_orbits(scenes.valid_orbits(sc, X.PRE, 10))
    return scenes.aoi_orbits(scenes.parse_orbits(text))


QUERIES = {
    f.__name__: f
    for f in (
        labels_to_long, labels_site_summary, labels_assign_aoi, labels_decode_class, labels_location_key, labels_last,
        labels_most_severe, labels_first, labels_first_severe, labels_load, stats_label_counts,
        stats_date_distribution, stats_value_counts, stats_class_crosstab, stats_class_shares, stats_distinct,
        split_by_aoi, split_random_all, split_random_per_aoi, split_random_orders, split_apply, split_site_union,
        scenes_radar, scenes_radar_any_platform, scenes_optical, scenes_valid_orbits, scenes_orbits_in_all_periods,
        scenes_aoi_orbits,
    )
}


def _combine_sql(order: str, where: str = "TRUE") -> str:
    return (
        X.with_views("assess", "sites", extra=(_LONG,))
        + "SELECT site_id, ep, damage, date, aoi, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY"
        f" round_even(lon, 6), round_even(lat, 6) ORDER BY {order}) AS rn FROM long WHERE {where}) WHERE rn = 1"
    )


_LAST = _combine_sql("ep DESC, site_id")
_FIRST_SEVERE = _combine_sql("ep, site_id", "damage IN (1, 2)")
_SPLIT = (
    "CASE WHEN row_number() OVER ({p} ORDER BY md5('{seed}:' || {k}), {k})"
    " <= floor(0.2e0 * count(*) OVER ({p})) THEN 'train' ELSE 'test' END AS split"
)
_T0 = "epoch_ms(TIMESTAMP '{}')"
_VALID = (
    X.with_views("scenes")
    + f", v AS (SELECT aoi_no AS aoi, orbit, count(*) AS n FROM scenes WHERE time_start >= {_T0.format(X.PRE[0])}"
    f" AND time_start < {_T0.format(X.PRE[1])} GROUP BY ALL HAVING count(*) >= 10) "
)

ORACLES = {
    "labels_to_long": X.with_views("assess", "sites")
    + "SELECT a.site_id || '_' || a.ep AS label_id, a.site_id, s.aoi, a.ep, a.date, a.damage FROM assess a JOIN sites s ON s.site_id = a.site_id",
    "labels_site_summary": X.with_views("site_summary") + "SELECT a.*, y.* EXCLUDE site_id FROM assess a JOIN site_summary y ON y.site_id = a.site_id",
    "labels_assign_aoi": X.with_views("sites")
    + "SELECT site_id, aoi, area_id FROM sites JOIN (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in AOI_OF.items())
    + ") m(k, area_id) ON m.k = aoi",
    "labels_decode_class": X.with_views("assess")
    + "SELECT site_id, ep, CASE damage WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 11 THEN 'eleven' ELSE 'Unknown' END AS name FROM assess",
    "labels_location_key": X.with_views("sites")
    + "SELECT round_even(lon * 1.5e0, 2) AS kx, round_even(lat * 1.5e0, 2) AS ky, count(*) AS n FROM sites GROUP BY ALL",
    "labels_last": _LAST,
    "labels_most_severe": _combine_sql("damage, site_id, ep"),
    "labels_first": _combine_sql("ep, site_id"),
    "labels_first_severe": _FIRST_SEVERE,
    "labels_load": f"SELECT * FROM ({_LAST}) WHERE damage IN (1, 2) AND aoi IN {TRAIN}",
    "stats_label_counts": f"SELECT aoi, damage, count(*) AS n FROM ({_FIRST_SEVERE}) GROUP BY ALL",
    "stats_date_distribution": X.with_views("site_summary")
    + "SELECT date_first_severe, count(*) AS n FROM site_summary WHERE date_first_severe IS NOT NULL GROUP BY ALL",
    "stats_value_counts": X.with_views("buildings") + "SELECT adm2_name, count(*) AS n FROM buildings GROUP BY ALL",
    "stats_class_crosstab": "SELECT aoi AS municipality, "
    + ", ".join(f'count(*) FILTER (damage = {c}) AS "{n}"' for c, n in P.CLASS_NAMES.items())
    + f", count(*) AS Total FROM ({_LAST}) GROUP BY ALL",
    "stats_class_shares": X.with_views("assess")
    + "SELECT damage, count(*) AS n, count(*) * 100e0 / (SELECT count(*) FROM assess) AS pct FROM assess GROUP BY damage",
    "stats_distinct": X.with_views("obs") + "SELECT count(DISTINCT site_id) AS n_site_id, count(DISTINCT orbit) AS n_orbit FROM obs",
    "split_by_aoi": X.with_views("sites")
    + f"SELECT CASE WHEN aoi IN {TRAIN} THEN 'train' ELSE 'test' END AS split, aoi, count(*) AS n FROM sites WHERE aoi IN {TRAIN + TEST} GROUP BY ALL",
    "split_random_all": X.with_views("obs")
    + f"SELECT site_id, {_SPLIT.format(p='', seed=42, k='site_id')} FROM (SELECT DISTINCT site_id FROM obs)",
    "split_random_per_aoi": X.with_views("sites")
    + f"SELECT aoi, site_id, {_SPLIT.format(p='PARTITION BY aoi', seed=42, k='site_id')} FROM sites",
    "split_random_orders": f"SELECT o_orderkey, {_SPLIT.format(p='', seed=7, k='o_orderkey')} FROM (SELECT DISTINCT o_orderkey FROM orders)",
    "split_apply": X.with_views("obs")
    + f", s AS (SELECT site_id, {_SPLIT.format(p='', seed=42, k='site_id')} FROM (SELECT DISTINCT site_id FROM obs))"
    + " SELECT site_id, orbit, count(*) AS n FROM obs WHERE site_id IN (SELECT site_id FROM s WHERE split = 'train') GROUP BY ALL",
    "split_site_union": X.with_views("obs", "sites") + "SELECT site_id FROM obs UNION SELECT site_id FROM sites",
    "scenes_radar": X.with_views("scenes")
    + f"""SELECT scene_id, mode, platform, orbit, time_start FROM scenes WHERE list_contains(polarisation, 'VV')
 AND list_contains(polarisation, 'VH') AND mode = 'IW' AND platform = 'A' AND orbit = 94
 AND time_start >= {_T0.format(X.PRE[0])} AND time_start < {_T0.format(X.CHANGE)}""",
    "scenes_radar_any_platform": X.with_views("scenes")
    + "SELECT platform, aoi_no, count(*) AS n FROM scenes WHERE list_contains(polarisation, 'HH') AND mode = 'IW' AND aoi_no IN (1, 2) GROUP BY ALL",
    "scenes_optical": """WITH i AS (SELECT o_orderkey AS image_id, o_orderkey % 100 / 1e1 AS B2, o_orderkey % 90 / 1e1 AS B8 FROM orders),
s AS (SELECT o_orderkey AS image_id, o_custkey % 11 / 1e1 AS cs FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT i.image_id, CASE WHEN cs >= 0.6e0 THEN B2 END AS B2, CASE WHEN cs >= 0.6e0 THEN B8 END AS B8,
 CASE WHEN cs >= 0.6e0 THEN cs END AS cs FROM i JOIN s ON s.image_id = i.image_id""",
    "scenes_valid_orbits": _VALID + "SELECT aoi, string_agg(CAST(orbit AS VARCHAR), ',' ORDER BY orbit) AS valid_orbits FROM v GROUP BY aoi",
    "scenes_orbits_in_all_periods": X.with_views("scenes")
    + f"""SELECT aoi_no, orbit, count(*) FILTER (time_start >= {_T0.format(X.PRE[0])} AND time_start < {_T0.format(X.PRE[1])}) AS n_0,
 count(*) FILTER (time_start >= {_T0.format(X.POST[3][0])} AND time_start < {_T0.format(X.POST[3][1])}) AS n_1
FROM scenes GROUP BY aoi_no, orbit HAVING n_0 >= 5 AND n_1 >= 5""",
    "scenes_aoi_orbits": _VALID + "SELECT aoi, orbit FROM v",
}
