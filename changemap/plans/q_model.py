"""Queries: classifiers and whole runs.  There is no SQL for these; tests check
their properties."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions.names import feature_names
from changemap.operators import evaluate, forest, model
from changemap.plans import fixtures as X
from changemap.plans import run as R
from changemap.plans.q_features import BANDS, feature_table
from changemap.plans.q_predict import site_dates
from changemap.session import materialise, work_path
from changemap.sources import io

# the settings of the study: 50 trees, depth up to the library's largest
CFG = P.RunConfig(bands=BANDS)
COLS = feature_names(BANDS)
KEY = ["site_id", "orbit", "win"]


def _features(spark, sf):
    """Feature rows written once: training reads them several times."""
    return materialise(feature_table(spark, sf), "features")


def _train_test(spark, sf):
    return R.split_features(_features(spark, sf), "aoi", X.TRAIN_AOIS, X.TEST_AOIS)


def model_random_forest(spark, sf):
    tr, te = _train_test(spark, sf)
    return R.predictions(R.train(tr, CFG), te, CFG)


def model_svm(spark, sf):
    tr, te = _train_test(spark, sf)
    cfg = replace(CFG, model_name="svm", model_args={})
    return R.predictions(R.train(tr, cfg), te, cfg)


def model_gradient_trees(spark, sf):
    tr, te = _train_test(spark, sf)
    cfg = replace(CFG, model_name="gradient_trees", model_args={})
    return R.predictions(R.train(tr, cfg), te, cfg)


def model_balanced_weights(spark, sf):
    """Class weights of the feature rows."""
    w = model.balanced_weights(feature_table(spark, sf, reducers=("mean",)))
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight") + 1e-8, 6).alias("weight"))


def model_train_on_all(spark, sf):
    """Balanced forest on both splits, saved and loaded again."""
    tr, te = _train_test(spark, sf)
    cfg = replace(CFG, train_on_all=True, balanced=True)
    path = work_path(spark, "model")
    R.train(tr, cfg, te, path)
    return R.predictions(R.train(tr, cfg, te, path), te, cfg)


def _importance(spark, sf):
    tr, _ = _train_test(spark, sf)
    return model.importance(R.train(tr, CFG), COLS, spark)


def model_importance(spark, sf):
    return _importance(spark, sf)


def model_importance_rollup(spark, sf):
    return model.importance_rollup(_importance(spark, sf))


def model_top_features(spark, sf):
    t = _importance(spark, sf)
    return model.top_features(t, 10).unionByName(model.top_features(t, 5, lowest=True))


def model_embeddings(spark, sf):
    """Forest on the 64 numbers of every embedding; class = parity of its label."""
    e = X.table(spark, sf, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") % 2).cast("double").alias("label")
    )
    clf = model.classifier("random_forest", 0, **CFG.model_args)
    m = clf.fit(e)
    return m.transform(e).select("vec_id", "label", vector_to_array("probability")[1].alias("prob"))


def model_oob_curve(spark, sf):
    tr, _ = _train_test(spark, sf)
    return model.oob_curve(tr, COLS, KEY, counts=P.OOB_COUNTS)


def model_oob_elbow(spark, sf):
    tr, _ = _train_test(spark, sf)
    return model.oob_elbow(materialise(model.oob_curve(tr, COLS, KEY, counts=P.OOB_COUNTS), "curve"))


def model_oob_by_mtry(spark, sf):
    tr, _ = _train_test(spark, sf)
    return model.oob_by_mtry(tr, COLS, KEY)


# a small forest that SQL can state: given bin ends (between any values of the features), given draws
GIVEN_ENDS = {
    "vv_pre_1x1_mean": (46.0123457, 50.0123457, 53.2123457, 55.9123457, 60.9123457),
    "vv_post_1x1_mean": (33.8123457, 45.8123457, 52.8123457, 60.1123457, 71.4123457),
    "vv_post_1x1_stdDev": (15.7123457, 24.7123457, 29.4123457, 33.1123457, 39.4123457),
    "vv_post_1x1_skew": (-1.2123457, -0.4123457, 0.0123457, 0.4123457, 1.2123457),
    "vh_post_1x1_mean": (3.2123457, 4.3123457, 5.0123457, 5.7123457, 6.8123457),
    "vh_post_1x1_max": (5.5, 7.5, 8.5, 9.5),
}
GIVEN_TREES, GIVEN_LEAF = 4, 3
GIVEN = forest.Settings(GIVEN_TREES, "all", GIVEN_LEAF, max_depth=2)
_GIVEN_DRAW = "(site_id * 31 + orbit * 7 + win * 13 + {t} * 17) % 3"


def _given(spark, sf):
    tr, te = _train_test(spark, sf)
    drawn = F.array(*[F.expr(_GIVEN_DRAW.format(t=t)) for t in range(GIVEN_TREES)])
    tr, te = (d.na.drop(subset=list(GIVEN_ENDS)) for d in (tr, te))
    ends = [list(e) for e in GIVEN_ENDS.values()]
    rows = forest.binned(tr, list(GIVEN_ENDS), ends, "label", drawn)
    return rows, next(forest.fit_binned(rows, list(GIVEN_ENDS), ends, [GIVEN])), te


def model_given_cuts(spark, sf):
    """Every cut of a small forest: node, feature, bin, rows and drawn weight of either side."""
    _, f, _ = _given(spark, sf)
    c = f.cuts
    rows = zip(*(v.tolist() for v in (c["tree"], c["node"], c["feature"], c["bin"], c["left_n"], c["right_n"], c["left_w1"], c["right_w1"])))
    named = [(t, n, f.features[j], *rest) for t, n, j, *rest in rows]
    return spark.createDataFrame(named, "tree int, node long, feature string, bin int, left_n long, right_n long, left_w1 double, right_w1 double")


def model_given_scores(spark, sf):
    """What that forest says of every test row."""
    _, f, te = _given(spark, sf)
    return f.transform(te).select(*KEY, F.round(F.col("prob") + 1e-9, 6).alias("prob"))


def model_given_oob(spark, sf):
    """Its out-of-bag error for every number of trees."""
    rows, f, _ = _given(spark, sf)
    return forest.oob_errors(rows, f).select("n_trees", F.round(F.col("oob_error") + 1e-9, 6).alias("oob_error"))


def model_given_importance(spark, sf):
    """Rank and importance of its features."""
    _, f, _ = _given(spark, sf)
    table = model.importance(f, f.features, spark)
    return table.select("rank", "feature", F.round(F.col("importance") + 1e-9, 5).alias("importance"))


def model_given_rollup(spark, sf):
    """Its importances by band, by period and by reducer."""
    _, f, _ = _given(spark, sf)
    table = model.importance_rollup(model.importance(f, f.features, spark))
    return table.select("dimension", "name", F.round(F.col("total") + 1e-9, 4).alias("total"))


def model_given_errors(spark, sf):
    """Test rows and wrong decisions of that forest, by area and window."""
    _, f, te = _given(spark, sf)
    wrong = (F.col("prob") + 1e-9 > 0.5).cast("int") != F.col("label")
    return f.transform(te).groupBy("aoi", "win").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("n_wrong"))


def run_metrics(spark, sf):
    """From features to metrics."""
    tr, te = _train_test(spark, sf)
    return R.run(tr, te, site_dates(spark, sf), X.POST, CFG, X.CHANGE)


def run_compare_splits(spark, sf):
    f = _features(spark, sf)
    return R.compare_splits(f, site_dates(spark, sf), X.POST, cfg=CFG, change_date=X.CHANGE, train_aois=X.TRAIN_AOIS, test_aois=X.TEST_AOIS)


def run_ablate_bands(spark, sf):
    tr, te = _train_test(spark, sf)
    return R.ablate(tr, te, site_dates(spark, sf), X.POST, R.band_settings(CFG), X.CHANGE)


def run_ablate_reducers(spark, sf):
    tr, te = _train_test(spark, sf)
    return R.ablate(tr, te, site_dates(spark, sf), X.POST, R.reducer_settings(CFG), X.CHANGE)


def run_ablate_trees(spark, sf):
    tr, te = _train_test(spark, sf)
    return R.ablate(tr, te, site_dates(spark, sf), X.POST, R.tree_settings(CFG), X.CHANGE)


def run_all_areas(spark, sf):
    """Training areas scored too and appended to the test predictions."""
    tr, te = _train_test(spark, sf)
    return R.predict_all_areas(R.train(tr, CFG), tr, te, CFG)


def _pixel_table(f):
    return f.withColumns(
        {"tile": F.floor(F.col("site_id") / 16).cast("int"), "row": F.floor(F.col("site_id") % 16 / 4).cast("int"), "col": (F.col("site_id") % 4).cast("int")}
    )


def run_score_pixels(spark, sf):
    """Every pixel scored, null where a feature is missing."""
    f = _features(spark, sf)
    tr, _ = R.split_features(f, "aoi", X.TRAIN_AOIS, X.TEST_AOIS)
    return model.score_or_null(R.train(tr, CFG), _pixel_table(f), COLS).select("win", "tile", "orbit", "row", "col", "prob")


def run_score_tiles(spark, sf):
    """All pending tiles scored, written, and read back; a second call finds nothing to do."""
    f = _features(spark, sf)
    tr, _ = R.split_features(f, "aoi", X.TRAIN_AOIS, X.TEST_AOIS)
    m, px, path = R.train(tr, CFG), _pixel_table(f), work_path(spark, "tiles")
    R.write_tiles(m, px, COLS, path)
    again = R.write_tiles(m, px, COLS, path)
    done = io.read_preds(spark, path)
    return done.groupBy("win", "tile").agg(F.count(F.lit(1)).alias("n")).join(
        again.withColumn("again", F.lit(True)), ["win", "tile"], "left").select("win", "tile", "n", F.coalesce("again", F.lit(False)).alias("again"))


def run_given_tiles(spark, sf):
    """Tiles of the small forest, one orbit of them later than the others: all orbits meet in the written bytes."""
    _, f, te = _given(spark, sf)
    px, path = materialise(_pixel_table(te), "px"), work_path(spark, "tiles")
    for part in (px.where("orbit <> 94"), px):
        R.write_tiles(f, part, list(GIVEN_ENDS), path)
    return io.read_preds(spark, path).select("win", "tile", "row", "col", "pred")


def model_scores_checked(spark, sf):
    """Test rows a window, and how many have a probability between 0 and 1."""
    tr, te = _train_test(spark, sf)
    full = te.na.drop(subset=COLS)
    s = model.score(R.train(tr, CFG), full)
    return s.groupBy("win").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prob").between(0, 1)).alias("n_valid"))


def model_importance_sums(spark, sf):
    """Importances add up to one over every part of the names."""
    t = model.importance_rollup(_importance(spark, sf))
    return t.groupBy("dimension").agg(F.round(F.sum("total"), 3).alias("total"))


def run_votes_checked(spark, sf):
    """The votes that metrics of a run count: positives and negatives do not depend on the model."""
    tr, te = _train_test(spark, sf)
    preds = R.predictions(R.train(tr, CFG), te, CFG)
    sites = site_dates(spark, sf).join(X.sites(spark, sf).where(F.col("aoi").isin(*X.TEST_AOIS)).select("site_id"), "site_id")
    hist = evaluate.histogram(preds, sites, X.POST, X.CHANGE)
    return hist.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def run_pending_tiles(spark, sf):
    """Chosen tiles only, less those already scored: what is left to do."""
    f = _features(spark, sf)
    tr, _ = R.split_features(f, "aoi", X.TRAIN_AOIS, X.TEST_AOIS)
    m, px = R.train(tr, CFG), _pixel_table(f).withColumn("tile", F.lpad(F.col("tile").cast("string"), 5, "0"))
    done = px.where("win <= 9 AND tile < '00003'").select("win", "tile")
    left = R.score_tiles(m, px, COLS, done=done, only=["00000", "00001", "00004"])
    return left.groupBy("win", "tile").agg(F.count(F.lit(1)).alias("n"))


def stream_score_model(spark, sf):
    """A fitted forest scores tiles as they arrive; what has come before is skipped."""
    f = _features(spark, sf)
    tr, _ = R.split_features(f, "aoi", X.TRAIN_AOIS, X.TEST_AOIS)
    m, px = R.train(tr, CFG), _pixel_table(f)
    rows = _streamed(spark, px, lambda b: model.score_or_null(m, b, COLS))
    return rows.groupBy("win", "tile").agg(F.count(F.lit(1)).alias("n"))


def _streamed(spark, px, score):
    """Pixels that arrive orbit by orbit, halves of tiles apart, and at last some of them again."""
    from changemap.streaming import score as stream

    src, out, ck = work_path(spark, "in"), work_path(spark, "scored"), work_path(spark, "ck")
    for part in ("orbit <> 94 AND row < 2", "orbit = 94", "orbit <> 94", "tile < 4"):
        px.where(part).write.mode("append").parquet(src)
        s = stream.pixel_source(spark, src, px.schema, max_files=3)
        stream.score_stream(s, score, out, ck).awaitTermination()
    return stream.scored_rows(spark, out)


def stream_given_tiles(spark, sf):
    """The small forest scores the stream; the bytes over all orbits."""
    from changemap.operators import predict

    _, f, te = _given(spark, sf)
    rows = _streamed(spark, _pixel_table(te), f.transform)
    keys = ["win", "tile", "row", "col"]
    return predict.to_byte_pixels(predict.aggregate_orbits(rows, keys)).select(*keys, "pred")


QUERIES = {
    f.__name__: f
    for f in (
        model_random_forest, model_svm, model_gradient_trees, model_balanced_weights, model_train_on_all,
        model_importance, model_importance_rollup, model_top_features, model_embeddings, model_oob_curve,
        model_oob_elbow, model_oob_by_mtry, model_given_cuts, model_given_scores, model_given_oob, model_given_importance,
        model_given_rollup, model_given_errors, run_metrics, run_compare_splits, run_ablate_bands, run_ablate_reducers,
        run_ablate_trees, run_all_areas, run_score_pixels, run_score_tiles, model_scores_checked, model_importance_sums,
        run_votes_checked, run_pending_tiles, run_given_tiles, stream_score_model, stream_given_tiles,
    )
}


def _weights_sql() -> str:
    from changemap.plans.q_features import _features_sql

    return (
        f"WITH f AS ({_features_sql(('mean',))}) SELECT label, count(*) AS n,"
        f" {X.r6('(SELECT count(*) FROM f) / (2 * count(*))')} AS weight FROM f GROUP BY label"
    )


def _grid_sql(select: str) -> str:
    from changemap.plans.q_features import _features_sql

    return f"WITH f AS ({_features_sql()}) {select}"


_TEST = f"aoi IN {X.TEST_AOIS}"


def _given_sql(select: str) -> str:
    """The small forest as SQL: a level is one grouping, running sums, and the best place of each node."""
    names = list(GIVEN_ENDS)
    bins = ", ".join(
        " + ".join(f"CAST({c} > {e} AS INT)" for e in ends) + f" AS b{j}" for j, (c, ends) in enumerate(GIVEN_ENDS.items()))
    full = " AND ".join(f"{c} IS NOT NULL" for c in names)
    lists = "[" + ", ".join(f"b{j}" for j in range(len(names))) + "]"

    def level(k: int, rows: str) -> str:
        score = "(l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)"
        return f"""cell{k} AS (SELECT tree, node, j, bs[j + 1] AS b, count(*) AS n, sum(CASE WHEN label = 0 THEN w ELSE 0e0 END) AS w0,
 sum(CASE WHEN label = 1 THEN w ELSE 0e0 END) AS w1 FROM {rows}, range({len(names)}) g(j) WHERE w > 0 GROUP BY ALL),
run{k} AS (SELECT tree, node, j, b, sum(n) OVER u AS ln, sum(w0) OVER u AS l0, sum(w1) OVER u AS l1, sum(n) OVER p - sum(n) OVER u AS rn,
 sum(w0) OVER p - sum(w0) OVER u AS r0, sum(w1) OVER p - sum(w1) OVER u AS r1 FROM cell{k}
 WINDOW u AS (PARTITION BY tree, node, j ORDER BY b), p AS (PARTITION BY tree, node, j)),
cut{k} AS (SELECT *, s - ((l0 + r0) * (l0 + r0) + (l1 + r1) * (l1 + r1)) / (l0 + r0 + l1 + r1) AS gain
 FROM (SELECT *, {score} AS s FROM run{k} WHERE ln >= {GIVEN_LEAF} AND rn >= {GIVEN_LEAF} AND l0 + r0 > 0 AND l1 + r1 > 0)
 QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY s DESC, j, b) = 1),"""

    def moved(k: int, rows: str) -> str:
        """Where rows are after the cuts of a level, and the share of class 1 there."""
        return f"""SELECT a.* EXCLUDE (node, p), 2 * a.node + CAST(bs[j + 1] > b AS INT) AS node,
 CASE WHEN bs[j + 1] > b THEN r1 / (r0 + r1) ELSE l1 / (l0 + l1) END AS p FROM {rows} a JOIN cut{k} c ON c.tree = a.tree AND c.node = a.node"""

    def stayed(k: int, rows: str) -> str:
        return f"SELECT a.* FROM {rows} a ANTI JOIN cut{k} c ON c.tree = a.tree AND c.node = a.node"

    return _grid_sql("").rstrip() + f""", full_rows AS (SELECT *, {lists} AS bs FROM (SELECT *, {bins} FROM f WHERE {full})),
at0 AS (SELECT site_id, orbit, win, aoi, label, bs, tree, CAST({_GIVEN_DRAW.format(t="tree")} AS DOUBLE) AS w, CAST(1 AS BIGINT) AS node
 FROM full_rows, range({GIVEN_TREES}) g(tree) WHERE aoi IN {X.TRAIN_AOIS}),
root AS (SELECT tree, sum(CASE WHEN label = 1 THEN w ELSE 0e0 END) / sum(w) AS p FROM at0 GROUP BY tree),
{level(1, "at0")}
all0 AS (SELECT d.site_id, d.orbit, d.win, d.aoi, d.label, d.bs, r.tree, CAST((d.site_id * 31 + d.orbit * 7 + d.win * 13 + r.tree * 17) % 3 AS DOUBLE) AS w,
 CAST(1 AS BIGINT) AS node, r.p FROM full_rows d, root r),
all1 AS ({moved(1, "all0")} UNION ALL BY NAME {stayed(1, "all0")}),
at1 AS (SELECT * FROM all1 WHERE aoi IN {X.TRAIN_AOIS} AND node > 1),
{level(2, "at1")}
all2 AS ({moved(2, "all1")} UNION ALL BY NAME {stayed(2, "all1")}),
cuts AS (SELECT * FROM cut1 UNION ALL SELECT * FROM cut2),
names AS (SELECT * FROM (VALUES {", ".join(f"({j}, '{c}')" for j, c in enumerate(names))}) v(j, feature)),
gains AS (SELECT tree, j, sum(gain) AS g FROM cuts GROUP BY tree, j),
imp AS (SELECT names.j, feature, coalesce(sum(g / whole), 0) / (SELECT count(DISTINCT tree) FROM gains) AS importance FROM names
 LEFT JOIN (SELECT *, sum(g) OVER (PARTITION BY tree) AS whole FROM gains) x ON x.j = names.j GROUP BY names.j, feature),
scored AS (SELECT site_id, orbit, win, aoi, label, avg(p) AS prob FROM all2 WHERE {_TEST} GROUP BY ALL)
{select}"""


_GIVEN_ROLLUP = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, split_part(feature, '_', {k}) AS name, round(sum(round(importance, 6)) + 1e-9, 4) AS total FROM imp GROUP BY ALL"
    for d, k in (("band", 1), ("period", 2), ("reducer", 4)))
_GIVEN_TILES = """SELECT win, CAST(site_id // 16 AS INT) AS tile, CAST(site_id % 16 // 4 AS INT) AS row, CAST(site_id % 4 AS INT) AS col,
 CAST(trunc(avg(prob) * 255e0 + 1e-9) AS SMALLINT) AS pred FROM scored GROUP BY site_id, win"""
ORACLES = {
    "model_balanced_weights": _weights_sql(),
    "model_scores_checked": _grid_sql(
        f"SELECT win, count(*) AS n, count(*) AS n_valid FROM f WHERE {_TEST} AND " + " AND ".join(f"{c} IS NOT NULL" for c in COLS) + " GROUP BY win"),
    "model_importance_sums": "SELECT * FROM (VALUES ('band', 1e0), ('period', 1e0), ('reducer', 1e0)) v(dimension, total)",
    "run_votes_checked": X.with_views("site_summary", "sites", windows=X.POST)
    + f"""SELECT CAST(count(*) FILTER (w.start_post >= y.date_first_severe) AS BIGINT) AS n_pos, CAST(count(*) FILTER (w.start_post < DATE '{X.CHANGE}') AS BIGINT) AS n_neg
 FROM site_summary y JOIN sites s ON s.site_id = y.site_id CROSS JOIN windows w WHERE y.date_first_severe IS NOT NULL AND {_TEST}""",
    "model_given_cuts": _given_sql(
        "SELECT CAST(tree AS INT) AS tree, node, feature, CAST(b AS INT) AS bin, CAST(ln AS BIGINT) AS left_n, CAST(rn AS BIGINT) AS right_n,"
        " l1 AS left_w1, r1 AS right_w1 FROM cuts JOIN names USING (j)"),
    "model_given_scores": _given_sql("SELECT site_id, orbit, win, round(prob + 1e-9, 6) AS prob FROM scored"),
    "model_given_oob": _given_sql(
        f"SELECT CAST(k AS INT) AS n_trees, round(avg(CASE WHEN (s > 0.5 * m) <> (label = 1) THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS oob_error FROM"
        f" (SELECT k, site_id, orbit, win, label, sum(p) AS s, count(*) AS m FROM all2, range(1, {GIVEN_TREES + 1}) g(k)"
        f" WHERE aoi IN {X.TRAIN_AOIS} AND w = 0 AND tree < k GROUP BY ALL) GROUP BY k"),
    "model_given_importance": _given_sql(
        "SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank, feature, round(round(importance, 6) + 1e-9, 5) AS importance FROM imp"),
    "model_given_rollup": _given_sql(_GIVEN_ROLLUP),
    "model_given_errors": _given_sql(
        "SELECT aoi, win, count(*) AS n, count(*) FILTER (CAST(prob + 1e-9 > 0.5 AS INT) <> label) AS n_wrong FROM scored GROUP BY aoi, win"),
    "run_score_tiles": _grid_sql(
        "SELECT win, CAST(site_id // 16 AS INT) AS tile, count(DISTINCT site_id) AS n, false AS again FROM f GROUP BY ALL"),
    "run_given_tiles": _given_sql(_GIVEN_TILES),
    "stream_given_tiles": _given_sql(_GIVEN_TILES),
    "run_pending_tiles": _grid_sql(
        "SELECT win, tile, count(DISTINCT site_id) AS n FROM (SELECT *, lpad(CAST(site_id // 16 AS VARCHAR), 5, '0') AS tile FROM f)"
        " WHERE tile IN ('00000', '00001', '00004') AND NOT (win <= 9 AND tile < '00003') GROUP BY win, tile"),
    "stream_score_model": _grid_sql(
        "SELECT win, CAST(site_id // 16 AS INT) AS tile, count(*) AS n FROM f GROUP BY ALL"),
}
