import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from changemap import params as P
from changemap.operators import forest, model
from changemap.plans import run as R
from changemap.session import materialise, work_path
from changemap.sources import io

D = dt.date
COLS = ["VV_pre_1x1_mean", "VV_pre_1x1_max", "VV_post_1x1_mean", "VV_post_1x1_max"]
CFG = P.RunConfig(bands=("VV",), reducers=("mean", "max"), model_args={"numTrees": 5, "maxDepth": 4, "minInstancesPerNode": 3})
SPANS = [(D(2020, 1, 1), D(2020, 2, 29)), (D(2020, 3, 1), D(2020, 4, 30))]


@pytest.fixture(scope="module")
def feats(spark):
    rng = random.Random(4)
    rows = []
    for s in range(240):
        for win in (0, 1):
            for orbit in (87, 94):
                shift = 3.0 * win
                v = [rng.gauss(0, 1), rng.gauss(1, 1), rng.gauss(shift, 1), rng.gauss(1 + shift, 1)]
                if s == 7 and orbit == 87:
                    v[2] = None
                rows.append((s, "a" if s % 2 else "b", orbit, win + 1, SPANS[win][0], win, *v))
    df = spark.createDataFrame(rows, "site_id int, aoi string, orbit int, win int, start_post date, label int, " + ", ".join(f"{c} double" for c in COLS))
    return materialise(df, "feats")


def test_unknown_model_raises():
    with pytest.raises(NotImplementedError):
        model.classifier("nearest_neighbour")


def test_run_separates_the_classes(spark, feats):
    tr, te = R.split_features(feats, "aoi", ["a"], ["b"])
    sites = feats.select("site_id").distinct().withColumn("date", F.lit(D(2020, 3, 1)))
    m = R.run(tr, te, sites, SPANS, CFG, D(2020, 3, 1)).first()
    assert m.f1 > 0.9 and m.tp + m.fn == 120 and m.tn + m.fp == 120


@pytest.mark.parametrize("strategy", ["random_all", "random_per_aoi"])
def test_splits_leak_no_site(feats, strategy):
    tr, te = R.split_features(feats, strategy)
    assert tr.join(te, "site_id", "left_semi").count() == 0
    assert tr.select("site_id").distinct().count() == 48
    with pytest.raises(ValueError):
        R.split_features(feats, "by_date")


def test_incomplete_rows_get_null_and_missing_columns_raise(feats):
    m = R.train(feats, CFG)
    s = model.score_or_null(m, feats, COLS)
    assert s.count() == feats.count()
    assert {(r.site_id, r.orbit) for r in s.where("prob IS NULL").collect()} == {(7, 87)}
    with pytest.raises(ValueError):
        model.score_or_null(m, feats.drop(COLS[0]), COLS)


def test_rows_are_read_once_to_be_scored_or_null(feats):
    s = model.score_or_null(R.train(feats, CFG), feats, COLS)
    text = s._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan parquet") == 1 and text.count("ArrowEvalPython") == 1


def test_load_or_fit_reuses_the_saved_model(spark, feats):
    path = work_path(spark, "m")
    a = R.train(feats, CFG, path=path)
    b = R.train(feats.limit(0), CFG, path=path)  # nothing to train on: must be loaded
    pick = lambda m: [r.prob for r in model.score(m, feats.na.drop()).orderBy("site_id", "orbit", "win").limit(20).collect()]
    assert pick(a) == pick(b)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    w = {r.label: r.weight for r in model.balanced_weights(df).distinct().collect()}
    assert w == {0: 8 / 12, 1: 8 / 4}


def test_bootstrap_draws_are_poisson_and_stable(spark):
    df = spark.range(40000).select("id", model.bootstrap_weight(["id"], 3, 1).alias("w"))
    share = {r.w: r["count"] / 40000 for r in df.groupBy("w").count().collect()}
    assert share[0.0] == pytest.approx(0.3679, abs=0.01) and share[2.0] == pytest.approx(0.1839, abs=0.01)
    assert df.agg(F.sum("w")).first()[0] == df.repartition(9).agg(F.sum("w")).first()[0]


def test_oob_error_falls_and_elbow_is_found(spark, feats):
    c = materialise(model.oob_curve(feats, COLS, ["site_id", "orbit", "win"], 5, maxDepth=4), "c")
    err = {r.n_trees: r.oob_error for r in c.collect()}
    assert set(err) == {1, 2, 3, 4, 5} and err[5] <= err[1] and err[5] < 0.15
    fake = spark.createDataFrame([(1, 0.5), (6, 0.3), (11, 0.2999), (16, 0.1)], "n_trees int, oob_error double")
    assert model.oob_elbow(fake).first().n_trees == 6
    assert model.oob_elbow(fake.where("n_trees < 11")).first().n_trees == 6


def test_importance_table(spark, feats):
    t = model.importance(R.train(feats, CFG), COLS, spark)
    rows = t.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4] and rows[0].period == "post"
    roll = {(r.dimension, r.name): r.total for r in model.importance_rollup(t).collect()}
    assert set(roll) == {("period", "pre"), ("period", "post"), ("band", "VV"), ("reducer", "mean"), ("reducer", "max")}
    assert roll["band", "VV"] == pytest.approx(1.0, abs=1e-5)
    assert [r["rank"] for r in model.top_features(t, 2, lowest=True).collect()] == [4, 3]


def test_score_tiles_aggregates_orbits_and_skips_done(spark, feats):
    px = feats.withColumns({"tile": F.col("site_id") % 3, "row": F.col("site_id"), "col": F.lit(0)})
    m = R.train(feats, CFG)
    path = work_path(spark, "t")
    io.write_pixel_preds(R.score_tiles(m, px, COLS), path)
    done = spark.read.parquet(path)
    assert done.count() == 480 and R.score_tiles(m, px, COLS, done=done).count() == 0
    assert R.score_tiles(m, px, COLS, done=done.where("tile > 0")).count() == 160
    assert R.score_tiles(m, px, COLS, done=done, force=True, only=[2]).count() == 160


def test_tiles_are_pending_by_the_ledger_alone(spark, feats):
    px = feats.withColumns({"tile": F.col("site_id") % 3, "row": F.col("site_id"), "col": F.lit(0)})
    m, path = R.train(feats, CFG), work_path(spark, "t")
    assert R.write_tiles(m, px.where("tile < 2 AND orbit = 87"), COLS, path).count() == 4
    left = R.write_tiles(m, px, COLS, path)  # tile 2, and the other orbit of tiles 0 and 1
    assert left.count() == 6 and R.write_tiles(m, px, COLS, path).count() == 0
    both = {(r.win, r.site_id): r.prob for r in model.score(m, px.na.drop()).groupBy("win", "site_id").agg(F.avg("prob").alias("prob")).collect()}
    got = io.read_preds(spark, path).collect()
    assert len(got) == 480 and all(r.pred == int(both[r.win, r.row] * 255 + 1e-9) for r in got if r.row != 7)
    plan = R.ledger.finished(spark, path).select("win", "tile").distinct()._jdf.queryExecution().toString()
    assert "_finished" in plan and "pred" not in plan
    assert R.write_tiles(m, px, COLS, path, only=[1], force=True).count() == 2


def test_ablation_settings():
    base = P.RunConfig()
    assert list(R.band_settings(base)) == ["VV only", "VH only", "VV+VH"]
    assert [len(c.reducers) for c in R.reducer_settings(base).values()] == [2, 3, 5, 6, 7]
    assert [c.model_args["numTrees"] for c in R.tree_settings(base).values()] == [10, 25, 50, 75, 100]


def test_ablation_of_tree_counts_grows_every_tree_once(spark, feats, monkeypatch):
    grown, grow = [], forest.grow
    monkeypatch.setattr(forest, "grow", lambda rows, n, forests, *a: grown.append([(s.first, s.trees) for s in forests]) or grow(rows, n, forests, *a))
    tr, te = R.split_features(feats, "aoi", ["a"], ["b"])
    sites = feats.select("site_id").distinct().withColumn("date", F.lit(D(2020, 3, 1)))
    R.ablate(tr, te, sites, SPANS, R.tree_settings(CFG, (2, 5)), D(2020, 3, 1))
    assert grown == [[(0, 2)], [(2, 3)]]
    grown.clear()
    R.ablate(tr, te, sites, SPANS, R.reducer_settings(CFG), D(2020, 3, 1))  # other features: nothing to grow on but equal ones
    assert {g[0][0] for g in grown} == {0}


def test_forests_on_vectors_have_the_studys_leaf_limit(spark):
    df = spark.range(400).select("id", array_to_vector(F.array(*[(F.col("id") * k % 101).cast("double") for k in (7, 13, 29)])).alias("features"),
                                 (F.col("id") * 7 % 101 > 50).cast("double").alias("label"))
    clf = model.classifier("random_forest", 0, numTrees=5, minInstancesPerNode=3)
    assert (clf.settings.max_leaves, clf.settings.trees, clf.settings.min_leaf) == (10_000, 5, 3)
    m = clf.fit(df)
    said = m.transform(df).select("label", vector_to_array("probability").alias("p")).collect()
    assert len(said) == 400 and all(abs(sum(r.p) - 1) < 1e-12 for r in said)
    assert sum((r.p[1] > 0.5) == (r.label == 1) for r in said) > 380
    small = model.classifier("random_forest", 0, numTrees=5, maxLeaves=4).fit(df)
    assert max(np.bincount(small.fitted.cuts["tree"])) <= 3
