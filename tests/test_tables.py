"""Labels, splits, predictions, buildings, pixels: edge cases by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions import names, scalars
from changemap.operators import buildings, features, labels, obs, pixels, predict, scenes, splits, stats, windows

D = dt.date


def test_default_windows_are_the_published_ones():
    w = P.month_windows()
    assert len(w) == 19 and w[0] == (D(2022, 10, 7), D(2022, 12, 6)) and w[6][0] == P.CHANGE_DATE
    assert w[-1] == (D(2025, 10, 7), D(2025, 12, 6))
    assert len(P.COARSE_THRESHOLDS) == 35 and len(P.FINE_THRESHOLDS) == 170 and P.RULE_THRESHOLD == 170


def test_feature_names_nest_band_period_window_reducer():
    n = names.feature_names()
    assert len(n) == 28 and n[0] == "VV_pre_1x1_mean" and n[7] == "VV_post_1x1_mean" and n[14] == "VH_pre_1x1_mean"


def test_overlapping_windows_both_match_and_strays_drop(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 5)), (2, D(2020, 2, 1)), (3, D(2021, 1, 1)), (4, None)], "id int, d date")
    spans = [(D(2020, 1, 1), D(2020, 12, 31)), (D(2020, 1, 1), D(2020, 1, 31)), (D(2020, 2, 1), D(2020, 2, 9))]
    got = {(r.id, r.win) for r in windows.tag(df, "d", spans).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 3)}


def wide(spark):
    rows = [(1, D(2024, 1, 1), 3, D(2024, 5, 1), 1), (2, None, 2, None, None), (3, None, None, None, None), (4, D(2024, 2, 2), 6, D(2024, 3, 3), 11)]
    return spark.createDataFrame(rows, "site_id int, date_1 date, class_1 int, date_2 date, class_2 int")


def test_wide_to_long_and_summary(spark):
    long = labels.to_long(wide(spark), ["site_id"], n_epochs=2)
    assert {r.label_id for r in long.collect()} == {"1_1", "1_2", "2_1", "4_1", "4_2"}
    s = {r.site_id: r for r in labels.site_summary(long).collect()}
    assert (s[1].date_first, s[1].date_first_severe, s[1].date_first_destroyed, s[1].damage_max) == (D(2024, 1, 1), D(2024, 5, 1), D(2024, 5, 1), 1)
    assert (s[2].date_first, s[2].date_first_severe, s[2].damage_max) == (None, None, 2)  # severe, but undated
    assert (s[4].date_first_severe, s[4].damage_max) == (None, 6)


def test_combine_ties_and_order_of_filters(spark):
    rows = [(2, 3, 1, 0.1, 0.2), (1, 3, 2, 0.1000000001, 0.2), (3, 5, 6, 0.1, 0.2), (4, 1, 2, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "site_id int, ep int, damage int, lon double, lat double").withColumn("aoi", F.lit("a"))
    one = lambda how: {r.site_id for r in labels.combine(df, how).collect()}
    assert one("last") == {3, 4} and one("min") == {2, 4} and one("first") == {1, 4} and one("first_severe") == {1, 4}
    # the last epoch of the first place is class 6, so the class filter leaves nothing there
    assert {r.site_id for r in labels.load(df, "a", [1, 2], "last").collect()} == {4}
    with pytest.raises(ValueError):
        labels.combine(df, "median")


def test_scale_truncates_and_decode_defaults(spark):
    r = spark.range(1).select(
        scalars.scale_to_byte(F.lit(0.5)).alias("a"), scalars.scale_to_byte(F.lit(1.0)).alias("b"),
        scalars.decode_class(F.lit(11)).alias("c"), scalars.decode_class(F.lit(None).cast("int")).alias("d"),
        scalars.decode_class(F.lit(9)).alias("e"), scalars.millis_to_date(F.lit(86_399_999)).alias("f"),
    ).first()
    assert tuple(r) == (127, 255, "Unknown/other", "Unknown", "Unknown", D(1970, 1, 1))


@pytest.mark.parametrize("n", [0, 1, 4, 5, 999])
def test_random_split_is_exact_and_disjoint(spark, n):
    df = spark.range(n).select(F.col("id").alias("site_id"), (F.col("id") % 3).alias("aoi"))
    out = {r.site_id: r.split for r in splits.random_all(df.unionByName(df)).collect()}
    assert len(out) == n and sum(v == "train" for v in out.values()) == int(n * 0.2)
    per = splits.random_per_aoi(df).groupBy("aoi").agg(F.count_if(F.col("split") == "train").alias("t"), F.count("*").alias("n"))
    assert all(r.t == int(r.n * 0.2) for r in per.collect())
    assert out == {r.site_id: r.split for r in splits.random_all(df.repartition(7)).collect()}


def test_label_rule_and_windows_without_images(spark):
    o = spark.createDataFrame(
        [(1, 87, D(2020, 1, 5), 1.0, float("nan")), (1, 87, D(2020, 1, 6), 3.0, 4.0), (2, 87, D(2019, 1, 1), 5.0, 6.0), (3, 94, D(2020, 1, 6), 7.0, 8.0)],
        "site_id int, orbit int, obs_date date, VV double, VH double",
    )
    sites = spark.createDataFrame([(1, D(2020, 4, 30)), (2, D(2020, 5, 1)), (3, None)], "site_id int, date_first_severe date")
    pre, post = (D(2020, 1, 1), D(2020, 1, 31)), [(D(2020, 2, 1), D(2020, 2, 29)), (D(2020, 4, 1), D(2020, 4, 30))]
    f = features.build(o, sites, pre, post, change_date=D(2020, 3, 1), with_counts=True)
    got = {(r.site_id, r.win): r for r in f.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (3, 1)}
    r = got[1, 2]
    assert (r.label, r.VV_pre_1x1_mean, r.VH_pre_1x1_mean, r.VH_pre_1x1_stdDev, r.n_tiles_pre, r.n_tiles_post) == (1, 2.0, 4.0, None, 2, 0)
    assert r.VV_post_1x1_mean is None and got[2, 1].VV_pre_1x1_mean is None


def test_wide_predictions_keep_missing_windows_null(spark):
    p = spark.createDataFrame([(1, "a", D(2020, 1, 1), 7), (2, "a", D(2020, 3, 1), 9)], "site_id int, aoi string, start_post date, pred int")
    spans = [(D(2020, 1, 1), D(2020, 2, 1)), (D(2020, 3, 1), D(2020, 4, 1))]
    w = predict.to_wide(p, spans)
    assert [tuple(r) for r in w.collect()] == [(1, "a", 7, None), (2, "a", None, 9)]
    assert predict.to_long(w).count() == 2
    with pytest.raises(ValueError):
        predict.aggregate_orbits(p, method="mode")


def test_pending_tiles(spark):
    want = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "win int, tile string")
    done = spark.createDataFrame([(1, "a")], "win int, tile string")
    assert predict.pending_tiles(want, done).count() == 2
    assert predict.pending_tiles(want, done, only=["a"]).count() == 1
    assert predict.pending_tiles(want, done, force=True).count() == 3


def test_weighted_mean_null_rule(spark):
    o = spark.createDataFrame([("b", 1, 1, 30.0), ("b", 1, 2, 10.0), ("c", 1, 2, 5.0)], "building_id string, row int, col int, area double")
    v = spark.createDataFrame([(1, 1, 1, 100), (1, 1, 2, 20), (2, 1, 1, None), (2, 1, 2, 20)], "start_post int, row int, col int, pred int")
    got = {(r.building_id, r.start_post): (r.weighted_mean, r.max) for r in buildings.weighted_scores(o, v, ["row", "col"]).collect()}
    assert got == {("b", 1): (80.0, 100.0), ("b", 2): (5.0, 20.0), ("c", 1): (20.0, 20.0), ("c", 2): (20.0, 20.0)}


def test_rule_with_missing_values(spark):
    pre, post = D(2020, 1, 1), D(2021, 1, 1)
    rows = [("quiet", pre, 10.0), ("quiet", post, 200.0), ("loud", pre, 180.0), ("loud", post, 200.0), ("nopre", post, 200.0),
            ("gap", pre, None), ("gap", D(2020, 2, 1), 1.0), ("gap", post, 200.0), ("low", pre, 1.0), ("low", post, 169.9)]
    s = spark.createDataFrame(rows, "building_id string, start_post date, weighted_mean double")
    hit = lambda **k: {r.building_id for r in buildings.classify(s, change_date=D(2020, 6, 1), **k).collect() if r.damaged}
    assert hit() == {"quiet", "gap"}
    assert hit(strict=True, n_pre=1) == {"quiet", "gap"} and hit(strict=True, n_pre=2) == set()


def test_most_severe_point_takes_one_whole_row(spark):
    pairs = spark.createDataFrame([("b", 1), ("b", 2), ("b", 3)], "building_id string, point_id int")
    lab = spark.createDataFrame([(1, 2, 1, None), (2, 1, 5, None), (3, 1, 4, D(2024, 1, 1))], "point_id int, damage int, ep int, date date")
    r = buildings.most_severe_point(pairs, lab).first()
    assert (r.label_damage, r.label_id, r.label_date) == (1, 2, None)


def test_mosaic_last_tile_wins_but_not_with_nodata(spark):
    rows = [(1, 0, 0, "q0", 5), (1, 0, 0, "q1", 9), (1, 0, 1, "q0", 5), (1, 0, 1, "q1", 0), (1, 0, 2, "q1", 0), (1, 0, 3, "q0", None)]
    t = spark.createDataFrame(rows, "win int, row int, col int, tile string, pred int")
    assert {(r.col, r.pred) for r in pixels.mosaic(t).collect()} == {(0, 9), (1, 5), (2, 0), (3, 0)}


def test_focal_mean_at_borders_and_gaps(spark):
    p = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 1, None), (5, 5, 7.0)], "row int, col int, v double")
    got = {(r.row, r.col): r.v for r in pixels.focal_mean(p, ["v"]).collect()}
    assert got == {(0, 0): 2.0, (0, 1): 2.0, (1, 1): 2.0, (5, 5): 7.0}


@pytest.mark.parametrize("k, block", [(1, 4), (3, 4), (5, 3), (3, 256), (7, 2)])
def test_focal_mean_across_blocks(spark, k, block):
    r = random.Random(k)
    cells = {(w, i, j): r.choice([None, r.random()]) for w in "ab" for i in range(-9, 8) for j in range(-5, 11) if r.random() < 0.8}
    cells |= {("c", 10**6, -(10**6)): 2.5}
    p = spark.createDataFrame([(*c, v) for c, v in cells.items()], "w string, row int, col int, v double")
    got = {(x.w, x.row, x.col): x.v for x in pixels.focal_mean(p, ["v"], k, ["w"], block).collect()}
    assert got.keys() == cells.keys()
    for (w, i, j), v in got.items():
        near = [cells[w, i + a, j + b] for a in range(-(k // 2), k // 2 + 1) for b in range(-(k // 2), k // 2 + 1) if cells.get((w, i + a, j + b)) is not None]
        assert v == (pytest.approx(sum(near) / len(near)) if near else None)


def test_focal_mean_shuffles_once_and_mosaic_sorts_nothing(spark):
    p = spark.range(100).selectExpr("'t' || (id % 3) AS tile", "1 AS win", "CAST(id AS INT) AS row", "CAST(id AS INT) AS col", "CAST(id AS INT) AS pred")
    plan = pixels.focal_mean(p, ["pred"], 3, ["win"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    plan = pixels.mosaic(p)._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "max(" in plan
    plan = pixels.mosaic(p)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_mosaic_sends_no_cell_by_its_tile(spark):
    """Ranks are broadcast whatever size Spark expects of them: tiles are few, and all cells of one would meet in a task."""
    from changemap.session import settings

    t = spark.createDataFrame([(1, 0, c, x, v) for c in range(4) for x, v in (("a", 5), ("b", c % 2 * 9))], "win int, row int, col int, tile string, pred int")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        out = pixels.mosaic(t)
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
        assert {(r.col, r.pred) for r in out.collect()} == {(0, 5), (1, 9), (2, 5), (3, 9)}


def test_mosaic_of_negative_values_missing_names_and_wide_kinds(spark):
    rows = [("b", 0, -5), ("a", 0, 7), ("a", 1, -3), ("c", 1, 0), (None, 2, 4), ("b", 3, None), ("b", 4, -(2**31)), ("a", 4, 2**31 - 1)]
    p = spark.createDataFrame(rows, "tile string, col int, pred int")
    assert {(r.col, r.pred) for r in pixels.mosaic(p, ["col"]).collect()} == {(0, -5), (1, -3), (2, 0), (3, 0), (4, -(2**31))}
    with pytest.raises(ValueError):
        pixels.mosaic(p.withColumn("pred", F.col("pred").cast("double")), ["col"])


def test_sampling_outside_and_at_the_first_row(spark):
    px = spark.createDataFrame([(1, r, c, r * 10 + c) for r in range(3) for c in range(3)], "win int, row int, col int, pred int")
    pt = spark.createDataFrame([("mid", 15.0, 15.0), ("edge", 1.0, 1.0), ("out", 99.0, 99.0)], "point_id string, x double, y double")
    g = pixels.Grid(10.0)
    full = pixels.fill_samples(pt.select("point_id"), pixels.sample(pt, px, g, "point_id", 3, "max"), [1], "point_id")
    assert {r.point_id: r.pred for r in full.collect()} == {"mid": 22, "edge": 11, "out": 0}
    cut = pixels.sample(pt, px, g, "point_id", 3, "mean", first_cell=(0, 0))
    assert {r.point_id: r.pred for r in cut.collect()} == {"mid": 11.0}
    with pytest.raises(ValueError):
        pixels.sample(pt, px, g, "point_id", 3, "median")


def test_fill_with_mean_leaves_all_null_series(spark):
    o = spark.createDataFrame([(1, 87, 2.0), (1, 87, None), (1, 87, 4.0), (2, 87, None)], "site_id int, orbit int, v double")
    assert sorted((r.site_id, r.v or -1) for r in obs.fill_with_mean(o, ["v"]).collect()) == [(1, 2.0), (1, 3.0), (1, 4.0), (2, -1)]


def test_orbits_text_round_trip(spark):
    df = spark.createDataFrame([("a", "87,94, 160")], "aoi string, valid_orbits string")
    p = scenes.parse_orbits(df)
    assert p.first().valid_orbits == [87, 94, 160] and scenes.format_orbits(p).first().valid_orbits == "87,94,160"
    assert {r.orbit for r in scenes.aoi_orbits(p).collect()} == {87, 94, 160}


def test_admin_tables(spark):
    b = spark.createDataFrame([("a", 60.0, 1, 5.0), ("a", 50.0, 1, 7.0), (None, 99.0, 0, 1.0), ("b", 70.0, 0, None)],
                              "adm2_name string, area_m2 double, damaged int, max_post double")
    adm = spark.createDataFrame([("a",), ("b",), ("c",)], "adm2_name string")
    got = {r.adm2_name: (r.n_buildings, r.n_buildings_damaged, r.perc_damaged) for r in stats.admin_damage(adm, b, b.where("damaged = 1 and area_m2 > 50")).collect()}
    assert got == {"a": (1, 1, 100.0), "b": (1, 0, 0.0), "c": (0, 0, None)}
    cut = {r.adm2_name: (r.n_buildings, r.pct_over) for r in stats.by_admin_cutoff(b, cutoff=6).collect()}
    assert cut == {"a": (2, 50.0), "b": (0, 0.0)}


def test_features_with_one_hot_site(spark):
    """A site holding most rows: its medians are exact, and no task ranks its rows."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id") % 7).alias("site_id"), F.lit(87).alias("orbit"),
        F.date_add(F.lit(D(2020, 1, 1)), (F.col("id") * 7 % 200).cast("int")).alias("obs_date"),
        (F.col("id") * 7919 % 1013).cast("double").alias("VV"), (F.col("id") % 11).cast("double").alias("VH"),
    )
    pre, post = (D(2020, 1, 1), D(2020, 2, 29)), [(D(2020, 3, 1), D(2020, 4, 30)), (D(2020, 5, 1), D(2020, 6, 30))]
    out = features.build(rows, None, pre, post, severe_col=None).select("site_id", "win", "VV_post_1x1_median", "VH_post_1x1_median")
    got = {(r.site_id, r.win): r[2:] for r in out.collect()}
    want = rows.join(F.broadcast(spark.createDataFrame([(i, *s) for i, s in enumerate(post, 1)], "win int, a date, b date")), F.col("obs_date").between(F.col("a"), F.col("b")))
    want = {(r.site_id, r.win): r[2:] for r in want.groupBy("site_id", "win").agg(F.median("VV"), F.median("VH")).collect()}
    assert len(got) == 14 and {k: v for k, v in got.items() if v[0] is not None} == want


def test_focal_mean_of_many_small_scenes_and_large_ones(spark, monkeypatch):
    """Blocks cut over batches, small ones summed together, large ones alone; no Python call a scene."""
    cells = [(w, r, c, float((w * 31 + r * 17 + c * 5) % 23)) for w in range(40) for r in range(-3, 6) for c in range(7) if (w * 7 + r * 5 + c * 3) % 4 and (w % 9 == 0 or r < 0)]
    cells += [(5, 1, 1, None), (5, -1, 2, 8.5)]  # nothing there; a second value of a cell
    p = spark.createDataFrame(cells, "w int, row int, col int, v double")
    monkeypatch.setattr(pixels, "DENSE", 30)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        df = pixels.focal_mean(p, ["v"], 3, ["w"], 4)
        got = {(x.w, x.row, x.col): x.v for x in df.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for w, r, c in {t[:3] for t in cells}:
        near = [t[3] for t in cells if t[0] == w and abs(t[1] - r) <= 1 and abs(t[2] - c) <= 1 and t[3] is not None]
        want[w, r, c] = sum(near) / len(near) if near else None
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()


def test_every_reading_is_smoothed_in_a_scene_of_its_day(spark, sf, monkeypatch):
    from changemap.plans import fixtures, q_features

    seen, mean = [], features.focal_mean
    monkeypatch.setattr(features, "focal_mean", lambda px, values, k, keys: seen.append((px, keys)) or mean(px, values, k, keys))
    out = q_features.features_from_pixels_3x3(spark, sf)
    ((px, keys),) = seen
    o = fixtures.obs(spark, sf)
    assert px.count() == o.count() and px.select("obs_date").distinct().count() == o.select("obs_date").distinct().count()
    assert px.groupBy("row", "col", *keys).count().where("count > 1").isEmpty()
    assert not out.where("vv_post_3x3_kurtosis IS NOT NULL").isEmpty()  # four scenes and more in a window
