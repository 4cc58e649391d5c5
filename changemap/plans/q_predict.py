"""Queries: prediction tables and their evaluation, on model-free predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from changemap import params as P
from changemap.operators import evaluate, labels, pixels, predict, windows
from changemap.operators.geo import Grid
from changemap.plans import fixtures as X


def scored(spark, sf):
    """Pseudo-probabilities with area and window start; every eleventh is missing."""
    p = X.preds(spark, sf).withColumn("start_post", F.element_at(windows.window_array(X.POST), F.col("win"))["start_post"])
    p = p.withColumn("prob", F.when((F.col("site_id") + F.col("win") * 3) % 11 != 0, F.col("prob")))
    return p.join(X.sites(spark, sf).select("site_id", "aoi"), "site_id")


def site_dates(spark, sf):
    s = labels.site_summary(X.assess(spark, sf))
    return s.select("site_id", F.col("date_first_severe").alias("date"), "damage_max")


def orbit_mean(spark, sf):
    return predict.aggregate_orbits(scored(spark, sf))


_SCORED = (
    "scored AS (SELECT p.site_id, p.orbit, p.win, CASE WHEN (p.site_id + p.win * 3) % 11 <> 0 THEN prob END AS prob, s.aoi, w.start_post FROM preds p JOIN sites s ON s.site_id = p.site_id"
    " JOIN windows w ON w.win = p.win)",
    "sp AS (SELECT site_id, aoi, start_post, avg(prob) AS prob, CAST(trunc(avg(prob) * 255e0 + 1e-9) AS INT) AS pred FROM scored GROUP BY ALL)",
)


def _head(*extra: str) -> str:
    return X.with_views("preds", "sites", "site_summary", windows=X.POST, extra=(*_SCORED, *extra))


def _method(name):
    def q(spark, sf):
        return predict.aggregate_orbits(scored(spark, sf), method=name).withColumns(X.round6("prob"))

    return q


def predict_wide(spark, sf):
    return predict.to_wide(orbit_mean(spark, sf), X.POST)


def predict_long_again(spark, sf):
    return predict.to_long(predict.to_wide(orbit_mean(spark, sf), X.POST))


def predict_attach_labels(spark, sf):
    return predict.attach_labels(
        orbit_mean(spark, sf).drop("prob"), site_dates(spark, sf).where(F.col("damage_max") <= 2), ["site_id"]
    )


def predict_append_train(spark, sf):
    p = orbit_mean(spark, sf).drop("prob")
    test, train = p.where(F.col("aoi").isin(*X.TEST_AOIS)), p.where(F.col("aoi").isin(*X.TRAIN_AOIS))
    both = predict.append_train(test, train.withColumn("date", F.col("start_post")))
    return both.groupBy("aoi").agg(F.count(F.lit(1)).alias("n"), F.count("date").alias("n_dated"))


def predict_pending_tiles(spark, sf):
    px = X.pixels(spark, sf)
    tile = (F.floor(F.col("row") / 10) * 10 + F.floor(F.col("col") / 10)).cast("int").alias("tile")
    wanted = px.select("win", tile).distinct()
    done = px.where(F.col("pred") > 250).select("win", tile).distinct()
    return predict.pending_tiles(wanted, done)


def predict_byte_pixels(spark, sf):
    """Stored byte form of probabilities; missing becomes 0."""
    p = X.preds(spark, sf).withColumn("prob", F.when(F.col("win") % 5 != 0, F.col("prob")))
    return predict.to_byte_pixels(p).select("site_id", "orbit", "win", "pred")


def _eval_args(spark, sf):
    return orbit_mean(spark, sf), site_dates(spark, sf), X.POST


_METRIC_COLS = list(evaluate.METRICS)


def _rounded(df):
    return df.withColumns(X.round6(*_METRIC_COLS))


def eval_metrics(spark, sf):
    return _rounded(evaluate.metrics(*_eval_args(spark, sf), change_date=X.CHANGE))


def eval_metrics_mean(spark, sf):
    return _rounded(evaluate.metrics(*_eval_args(spark, sf), method="date-wise-mean", change_date=X.CHANGE))


def eval_metrics_median(spark, sf):
    return _rounded(evaluate.metrics(*_eval_args(spark, sf), method="date-wise-median", change_date=X.CHANGE))


def eval_metrics_year(spark, sf):
    return _rounded(evaluate.metrics(*_eval_args(spark, sf), change_date=X.CHANGE, pos_year=1998))


def eval_votes(spark, sf):
    return evaluate.votes(*_eval_args(spark, sf), change_date=X.CHANGE)


def eval_report(spark, sf):
    rep = evaluate.report(evaluate.metrics(*_eval_args(spark, sf), change_date=X.CHANGE))
    return rep.withColumns(X.round6("precision", "recall", "f1"))


def eval_sweep_coarse(spark, sf):
    return _rounded(evaluate.sweep(*_eval_args(spark, sf), P.COARSE_THRESHOLDS, X.CHANGE))


def eval_sweep_fine(spark, sf):
    return _rounded(evaluate.sweep(*_eval_args(spark, sf), P.FINE_THRESHOLDS, X.CHANGE))


def _sampled(spark, sf, agg: str):
    """Predictions sampled from 3 x 3 pixels at the labels of classes 1 and 2."""
    lab = X.points(spark, sf).where(F.col("damage").isin(1, 2)).select("point_id", "date", "x", "y")
    s = pixels.sample(lab, X.pixels(spark, sf), Grid(P.PIXEL_M), "point_id", 3, agg)
    s = s.withColumn("start_post", F.element_at(windows.window_array(X.POST), F.col("win"))["start_post"])
    return evaluate.sweep(s, lab.select("point_id", "date"), X.POST, P.FINE_THRESHOLDS, X.CHANGE, on=("point_id",))


def eval_sweep_pixels(spark, sf):
    return _rounded(_sampled(spark, sf, "max"))


def eval_sweep_pixels_mean(spark, sf):
    return _rounded(_sampled(spark, sf, "mean"))


def eval_threshold_pixels(spark, sf):
    """The threshold to run with, from the pixel sweep."""
    return evaluate.best_threshold(_sampled(spark, sf, "max"), "precision", 0.55).withColumns(X.round6("nearest_precision"))


def eval_best_f1(spark, sf):
    return _rounded(
        evaluate.best_f1_at_precision(evaluate.sweep(*_eval_args(spark, sf), P.COARSE_THRESHOLDS, X.CHANGE), 0.4)
    )


def eval_best_threshold(spark, sf):
    out = evaluate.best_threshold(evaluate.sweep(*_eval_args(spark, sf), P.FINE_THRESHOLDS, X.CHANGE), "precision", 0.55)
    return out.withColumns(X.round6("nearest_precision"))


def eval_summarise_runs(spark, sf):
    """One run per area, below the published baseline row."""
    votes = evaluate.votes(*_eval_args(spark, sf), change_date=X.CHANGE).join(
        X.sites(spark, sf).select("site_id", F.col("aoi").alias("run_name")), "site_id"
    )
    t, p = F.col("y_true"), F.col("y_pred")
    runs = votes.groupBy("run_name").agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 0)).alias("tn"),
    ).select("run_name", *evaluate.metric_columns())
    return _rounded(evaluate.summarise_runs(runs)).select("run_name", *_METRIC_COLS)


QUERIES = {
    "predict_orbit_mean": lambda s, sf: orbit_mean(s, sf).withColumns(X.round6("prob")),
    "predict_orbit_max": _method("max"),
    "predict_orbit_min": _method("min"),
    "predict_orbit_median": _method("median"),
    **{
        f.__name__: f
        for f in (
            predict_wide, predict_long_again, predict_attach_labels, predict_append_train, predict_pending_tiles,
            predict_byte_pixels, eval_metrics, eval_metrics_mean, eval_metrics_median, eval_metrics_year, eval_votes,
            eval_report, eval_sweep_coarse, eval_sweep_fine, eval_sweep_pixels, eval_sweep_pixels_mean, eval_threshold_pixels, eval_best_f1, eval_best_threshold, eval_summarise_runs,
        )
    },
}


def _orbit_sql(agg: str) -> str:
    return _head() + f"SELECT site_id, aoi, start_post, {X.r6(f'{agg}(prob)')} AS prob, CAST(trunc({agg}(prob) * 255e0 + 1e-9) AS INT) AS pred FROM scored GROUP BY site_id, aoi, start_post"


# votes: every dated site with every window of its sides, missing predictions 0
_GRID = (
    "grid AS (SELECT y.site_id, y.date_first_severe AS date, w.start_post, sp.pred FROM site_summary y CROSS JOIN windows w"
    " LEFT JOIN sp ON sp.site_id = y.site_id AND sp.start_post = w.start_post WHERE y.date_first_severe IS NOT NULL)"
)


def _sides(where_pos: str = "TRUE") -> str:
    return (
        f"sides AS (SELECT *, 1 AS y_true FROM grid WHERE start_post >= date AND {where_pos}"
        f" UNION ALL SELECT *, 0 AS y_true FROM grid WHERE start_post < DATE '{X.CHANGE}')"
    )


_COUNTS = """count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
 count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn"""
_M = {
    "precision": "CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END",
    "recall": "CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / (tp + fn) END",
    "f1": "CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2 * tp / (2 * tp + fp + fn) END",
    "roc_auc": "CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END",
    "accuracy": "(tp + tn) / nullif(tp + fp + fn + tn, 0)",
}
_MCOLS = ", ".join(f"{X.r6(e)} AS {n}" for n, e in _M.items())
_RAW = ", ".join(f"{e} AS {n}" for n, e in _M.items())
_HIT = "CASE WHEN pred >= {t} * 255e0 THEN 1 ELSE 0 END AS y_pred"


def _metrics_sql(where_pos: str = "TRUE") -> str:
    return (
        _head(_GRID, _sides(where_pos), f"c AS (SELECT {_COUNTS} FROM (SELECT *, {_HIT.format(t='0.5e0')} FROM sides))")
        + f"SELECT tp, fp, fn, tn, {_MCOLS} FROM c"
    )


def _side_metrics_sql(agg: str) -> str:
    # a site without any window on a side still casts one negative vote there
    return (
        _head(
            _GRID, _sides(),
            "pairs AS (SELECT site_id, y_true FROM (SELECT DISTINCT site_id FROM grid), (VALUES (0), (1)) v(y_true))",
            f"v AS (SELECT b.site_id, b.y_true, CASE WHEN {agg}(pred) >= 127.5e0 THEN 1 ELSE 0 END AS y_pred FROM pairs b"
            " LEFT JOIN sides s ON s.site_id = b.site_id AND s.y_true = b.y_true GROUP BY b.site_id, b.y_true)",
            f"c AS (SELECT {_COUNTS} FROM v)",
        )
        + f"SELECT tp, fp, fn, tn, {_MCOLS} FROM c"
    )


def _sweep_cte(ts) -> str:
    vals = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in ts)
    return (
        f"t AS (SELECT threshold FROM (VALUES {vals}) v(threshold)),"
        f" c AS (SELECT threshold, {_COUNTS} FROM (SELECT threshold, y_true, {_HIT.format(t='threshold')} FROM sides CROSS JOIN t) GROUP BY threshold)"
    )


def _sweep_sql(ts, tail: str | None = None) -> str:
    return _head(_GRID, _sides(), _sweep_cte(ts)) + (tail or f"SELECT threshold, tp, fp, fn, tn, {_MCOLS} FROM c")


def _sampled_sql(agg: str, tail: str) -> str:
    """The sweep over k x k pixels sampled at the labels of two classes."""
    return X.with_views("points", "pixels", windows=X.POST, extra=(
        "lab AS (SELECT point_id, date, x, y FROM points WHERE damage IN (1, 2))",
        f"s AS (SELECT point_id, win, {agg}(q.pred) AS pred FROM lab JOIN pixels q ON q.row - CAST(floor(y / 10) AS INT) BETWEEN -1 AND 1"
        " AND q.col - CAST(floor(x / 10) AS INT) BETWEEN -1 AND 1 GROUP BY ALL)",
        "grid AS (SELECT l.point_id, l.date, w.start_post, s.pred FROM lab l CROSS JOIN windows w LEFT JOIN s ON s.point_id = l.point_id AND s.win = w.win)",
        _sides(), _sweep_cte(P.FINE_THRESHOLDS),
    )) + tail


_BEST = """, m AS (SELECT *, {raw}, lead(threshold) OVER (ORDER BY threshold) AS nxt FROM c)
 SELECT CASE WHEN precision > 0.55e0 THEN threshold ELSE coalesce(nxt, threshold) END AS threshold,
 {m} AS nearest_precision FROM m ORDER BY abs(precision - 0.55e0), threshold LIMIT 1"""

_REPORT = """SELECT row, round(precision + CAST(1e-8 AS DOUBLE), 6) AS precision, round(recall + CAST(1e-8 AS DOUBLE), 6) AS recall,
 round(f1 + CAST(1e-8 AS DOUBLE), 6) AS f1, CAST(support AS BIGINT) AS support FROM (
 SELECT row, precision, recall, f1, support FROM l
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM l
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM l)"""

ORACLES = {
    "predict_orbit_mean": _orbit_sql("avg"),
    "predict_orbit_max": _orbit_sql("max"),
    "predict_orbit_min": _orbit_sql("min"),
    "predict_orbit_median": _orbit_sql("median"),
    "predict_wide": _head()
    + "SELECT site_id, aoi, "
    + ", ".join(f"max(pred) FILTER (start_post = DATE '{s}') AS \"pred_{s}\"" for s, _ in X.POST)
    + " FROM sp GROUP BY site_id, aoi",
    "predict_long_again": _head() + "SELECT site_id, aoi, start_post, pred FROM sp WHERE pred IS NOT NULL",
    "predict_attach_labels": _head()
    + "SELECT sp.site_id, aoi, start_post, pred, date_first_severe AS date, damage_max FROM sp LEFT JOIN (SELECT * FROM site_summary WHERE damage_max <= 2) y ON y.site_id = sp.site_id",
    "predict_append_train": _head()
    + f"SELECT aoi, count(*) AS n, count(*) FILTER (aoi IN {X.TRAIN_AOIS}) AS n_dated FROM sp GROUP BY aoi",
    "predict_pending_tiles": X.with_views("pixels")
    + """SELECT DISTINCT win, CAST(row // 10 * 10 + col // 10 AS INT) AS tile FROM pixels
EXCEPT SELECT win, CAST(row // 10 * 10 + col // 10 AS INT) FROM pixels WHERE pred > 250""",
    "predict_byte_pixels": X.with_views("preds")
    + "SELECT site_id, orbit, win, CAST(CASE WHEN win % 5 <> 0 THEN trunc(prob * 255e0 + 1e-9) ELSE 0 END AS SMALLINT) AS pred FROM preds",
    "eval_metrics": _metrics_sql(),
    "eval_metrics_year": _metrics_sql("year(start_post) = 1998"),
    "eval_metrics_mean": _side_metrics_sql("avg"),
    "eval_metrics_median": _side_metrics_sql("median"),
    "eval_votes": _head(_GRID, _sides()) + f"SELECT site_id, start_post, y_true, {_HIT.format(t='0.5e0')} FROM sides",
    "eval_report": _head(
        _GRID, _sides(), f"c AS (SELECT {_COUNTS} FROM (SELECT *, {_HIT.format(t='0.5e0')} FROM sides))",
        """l AS (SELECT 'damaged' AS row, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS support FROM c
 UNION ALL SELECT 'no damage', tn / (tn + fn), tn / (tn + fp), 2 * tn / (2 * tn + fp + fn), tn + fp FROM c)""",
    ) + _REPORT,
    "eval_sweep_coarse": _sweep_sql(P.COARSE_THRESHOLDS),
    "eval_sweep_fine": _sweep_sql(P.FINE_THRESHOLDS),
    "eval_best_f1": _sweep_sql(
        P.COARSE_THRESHOLDS,
        f", m AS (SELECT *, {_RAW} FROM c) SELECT threshold, tp, fp, fn, tn, {', '.join(f'{X.r6(n)} AS {n}' for n in _M)} FROM m"
        " WHERE precision >= 0.4e0 ORDER BY f1 DESC, threshold LIMIT 1",
    ),
    "eval_best_threshold": _sweep_sql(
        P.FINE_THRESHOLDS,
        f""", m AS (SELECT *, {_RAW}, lead(threshold) OVER (ORDER BY threshold) AS nxt FROM c)
 SELECT CASE WHEN precision > 0.55e0 THEN threshold ELSE coalesce(nxt, threshold) END AS threshold,
 {X.r6('precision')} AS nearest_precision FROM m ORDER BY abs(precision - 0.55e0), threshold LIMIT 1""",
    ),
    "eval_sweep_pixels": _sampled_sql("max", f"SELECT threshold, tp, fp, fn, tn, {_MCOLS} FROM c"),
    "eval_sweep_pixels_mean": _sampled_sql("avg", f"SELECT threshold, tp, fp, fn, tn, {_MCOLS} FROM c"),
    "eval_threshold_pixels": _sampled_sql("max", _BEST.format(raw=_RAW, m=X.r6("precision"))),
    "eval_summarise_runs": _head(
        _GRID, _sides(),
        f"c AS (SELECT s.aoi AS run_name, {_COUNTS} FROM (SELECT *, {_HIT.format(t='0.5e0')} FROM sides) v JOIN sites s ON s.site_id = v.site_id GROUP BY s.aoi)",
    )
    + f"SELECT run_name, {_MCOLS} FROM c UNION ALL SELECT 'published baseline', 0.671e0, 0.846e0, 0.749e0, 0.813e0, NULL",
}
