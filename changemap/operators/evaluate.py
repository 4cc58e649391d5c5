"""Date-wise evaluation of window predictions against dated labels.

A site's windows from its label date on are positives, windows before the change
date are negatives.  Votes are never expanded to sites x windows x thresholds:
predictions are bytes (or means of k x k bytes), so all thresholds are answered
from one aggregate with a row per prediction value.  A missing prediction is a vote "below the
threshold", which only needs the expected number of votes per site.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions.scalars import safe_ratio
from changemap.operators.windows import Span, window_array

METRICS = ("precision", "recall", "f1", "roc_auc", "accuracy")


def metric_columns(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> list[Column]:
    """The five metrics from confusion counts.

    Ratios with a zero denominator are 0; the ROC area is that of the 0/1
    predictions and is null when only one class is present.
    """
    t, f, n, u = F.col(tp), F.col(fp), F.col(fn), F.col(tn)
    both = ((t + n) > 0) & ((u + f) > 0)
    return [
        safe_ratio(t, t + f).alias("precision"),
        safe_ratio(t, t + n).alias("recall"),
        safe_ratio(2 * t, 2 * t + f + n).alias("f1"),
        F.when(both, (t / (t + n) + u / (u + f)) / 2).alias("roc_auc"),
        ((t + u) / F.nullif(t + f + n + u, F.lit(0))).alias("accuracy"),
    ]


def _starts_in(window: Column, pos_year: int | None) -> Column:
    return F.lit(True) if pos_year is None else F.year(window) == pos_year


def _expected(spans: Sequence[Span], change_date: dt.date, pos_year: int | None) -> tuple[Column, Column]:
    """Positive and negative votes a site must have, from its date alone."""
    pos = F.size(
        F.filter(
            window_array(spans),
            lambda w: (w["start_post"] >= F.col("date")) & _starts_in(w["start_post"], pos_year),
        )
    )
    neg = sum(s < change_date for s, _ in spans)
    return pos, F.lit(neg)


def _sides(preds: DataFrame, sites: DataFrame, on: Sequence[str], change_date, pos_year) -> DataFrame:
    """Predictions with their vote sides: ``side`` 1 positive, 0 negative.

    One window can be on both sides, when a label date lies before the change.
    """
    dated = sites.where(F.col("date").isNotNull()).select(*on, "date")
    j = preds.select(*on, "start_post", "pred").join(dated, list(on))
    pos = (F.col("start_post") >= F.col("date")) & _starts_in(F.col("start_post"), pos_year)
    neg = F.col("start_post") < F.lit(change_date)
    sides = F.filter(F.array(F.when(pos, 1), F.when(neg, 0)), lambda s: s.isNotNull())
    return j.withColumn("side", F.explode(sides))


def _expected_totals(sites: DataFrame, spans, change_date, pos_year) -> DataFrame:
    pos, neg = _expected(spans, change_date, pos_year)
    return sites.where(F.col("date").isNotNull()).agg(
        F.coalesce(F.sum(pos), F.lit(0)).cast("bigint").alias("n_pos"),
        F.coalesce(F.sum(neg), F.lit(0)).cast("bigint").alias("n_neg"),
    )


def histogram(
    preds: DataFrame,
    sites: DataFrame,
    spans: Sequence[Span],
    change_date: dt.date = P.CHANGE_DATE,
    on: Sequence[str] = ("site_id",),
    pos_year: int | None = None,
) -> DataFrame:
    """Votes per prediction value: ``pred, pos, neg``, missing ones at -1."""
    side = F.col("side")
    seen = (
        _sides(preds.where(F.col("pred").isNotNull()), sites, on, change_date, pos_year)
        .groupBy(F.col("pred").cast("double").alias("pred"))
        .agg(F.sum(side).cast("bigint").alias("pos"), F.sum(1 - side).cast("bigint").alias("neg"))
    )
    expected = _expected_totals(sites, spans, change_date, pos_year)
    # missing votes = expected minus seen, placed below every threshold; an aggregate, as a
    # real-valued prediction may have as many values as there are rows
    due = expected.select(F.col("n_pos").alias("pos"), F.col("n_neg").alias("neg")).unionByName(
        seen.select((-F.col("pos")).alias("pos"), (-F.col("neg")).alias("neg"))
    ).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("pos", "neg")])
    return seen.unionByName(due.select(F.lit(-1.0).alias("pred"), "pos", "neg"))


def sweep(
    preds: DataFrame,
    sites: DataFrame,
    spans: Sequence[Span],
    thresholds: Sequence[float] = P.COARSE_THRESHOLDS,
    change_date: dt.date = P.CHANGE_DATE,
    on: Sequence[str] = ("site_id",),
    pos_year: int | None = None,
) -> DataFrame:
    """Confusion counts and metrics for every threshold, from one pass."""
    hist = histogram(preds, sites, spans, change_date, on, pos_year)
    listed = ", ".join(f"{float(t)!r}D" for t in thresholds)
    # rows are summed by how many thresholds they pass; no more rows than thresholds from here on
    passed = F.size(F.filter(F.expr(f"array({listed})"), lambda t: F.col("pred") >= t * F.lit(float(P.SCALE_MAX))))
    hist = hist.groupBy(passed.alias("passed")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ordered = ", ".join(f"struct({sorted(map(float, thresholds)).index(float(t))} AS rank, {float(t)!r}D AS threshold)" for t in thresholds)
    at = F.col("passed") > F.col("rank")
    counts = (
        hist.select("passed", "pos", "neg", F.expr(f"inline(array({ordered}))"))
        .groupBy("threshold")
        .agg(
            F.sum(F.when(at, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(at, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(at, F.lit(0)).otherwise(F.col("pos"))).alias("fn"),
            F.sum(F.when(at, F.lit(0)).otherwise(F.col("neg"))).alias("tn"),
        )
    )
    return counts.select("*", *metric_columns())


def metrics(
    preds: DataFrame,
    sites: DataFrame,
    spans: Sequence[Span],
    threshold: float = 0.5,
    method: str = "date-wise",
    change_date: dt.date = P.CHANGE_DATE,
    on: Sequence[str] = ("site_id",),
    pos_year: int | None = None,
) -> DataFrame:
    """One row of confusion counts and metrics.

    ``date-wise`` takes one vote per site and window; ``date-wise-mean`` and
    ``date-wise-median`` one per site and side, on the mean or median prediction.
    """
    if method == "date-wise":
        return sweep(preds, sites, spans, [threshold], change_date, on, pos_year).drop("threshold")
    return _from_votes(votes(preds, sites, spans, threshold, method, change_date, on, pos_year))


def _from_votes(v: DataFrame) -> DataFrame:
    t, p = F.col("y_true"), F.col("y_pred")
    counts = v.agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 0) & (p == 0)).alias("tn"),
    )
    return counts.select("*", *metric_columns())


def votes(
    preds: DataFrame,
    sites: DataFrame,
    spans: Sequence[Span],
    threshold: float = 0.5,
    method: str = "date-wise",
    change_date: dt.date = P.CHANGE_DATE,
    on: Sequence[str] = ("site_id",),
    pos_year: int | None = None,
) -> DataFrame:
    """The single votes: ``on, [start_post], y_true, y_pred``."""
    on = list(on)
    dated = sites.where(F.col("date").isNotNull()).select(*on, "date")
    cut = F.lit(threshold * P.SCALE_MAX)
    by_window = preds.where(F.col("pred").isNotNull()).groupBy(*on).agg(
        # one entry per window of the run
        F.collect_list(F.struct("start_post", "pred")).alias("_e")
    )
    starts = F.transform("_e", lambda e: e["start_post"])
    by_window = by_window.select(*on, F.when(F.size(F.array_distinct(starts)) == F.size(starts), F.map_from_entries("_e")).otherwise(
        F.raise_error(F.lit(f"more than one prediction for a window of one {'/'.join(on)}; name all key columns in `on`"))
    ).alias("_p"))
    base = dated.join(by_window, on, "left")
    side_windows = {
        1: F.filter(
            window_array(spans),
            lambda w: (w["start_post"] >= F.col("date")) & _starts_in(w["start_post"], pos_year),
        ),
        0: F.filter(window_array(spans), lambda w: w["start_post"] < F.lit(change_date)),
    }
    if method == "date-wise":
        def single(side: int, arr: Column) -> Column:
            return F.transform(
                arr,
                lambda w: F.struct(
                    w["start_post"].alias("start_post"),
                    F.lit(side).alias("y_true"),
                    F.when(F.try_element_at("_p", w["start_post"]) >= cut, 1).otherwise(0).alias("y_pred"),
                ),
            )

        rows = F.concat(*[single(side, arr) for side, arr in side_windows.items()])
        return base.select(*on, F.inline(rows))
    if method not in ("date-wise-mean", "date-wise-median"):
        raise ValueError(f"unknown method {method!r}")

    def vote(arr: Column) -> Column:
        got = F.filter(F.transform(arr, lambda w: F.try_element_at("_p", w["start_post"])), lambda v: v.isNotNull())
        got = F.transform(got, lambda v: v.cast("double"))
        n = F.size(got)
        if method == "date-wise-mean":
            mid = F.aggregate(got, F.lit(0.0), lambda a, v: a + v) / F.nullif(n, F.lit(0))
        else:
            srt = F.sort_array(got)
            lo, hi = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2 + 1).cast("int")
            mid = F.when(n > 0, (F.try_element_at(srt, lo) + F.try_element_at(srt, hi)) / 2)
        return F.when(mid >= cut, 1).otherwise(0)

    rows = F.array(
        *[
            F.struct(F.lit(side).alias("y_true"), vote(arr).alias("y_pred"))
            for side, arr in side_windows.items()
        ]
    )
    return base.select(*on, F.inline(rows))


def report(counts: DataFrame) -> DataFrame:
    """Per-class precision, recall, f1 and support, with macro and weighted means,
    from one row of confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def line(name, hit, extra, miss):
        return F.struct(
            F.lit(name).alias("row"),
            safe_ratio(hit, hit + extra).alias("precision"),
            safe_ratio(hit, hit + miss).alias("recall"),
            safe_ratio(2 * hit, 2 * hit + extra + miss).alias("f1"),
            (hit + miss).cast("bigint").alias("support"),
        )

    two = counts.select(
        line("no damage", tn, fn, fp).alias("a"), line("damaged", tp, fp, fn).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    n = a["support"] + b["support"]
    names = ("precision", "recall", "f1")
    macro = F.struct(
        F.lit("macro avg").alias("row"), *[((a[m] + b[m]) / 2).alias(m) for m in names], n.alias("support")
    )
    weighted = F.struct(
        F.lit("weighted avg").alias("row"),
        *[((a[m] * a["support"] + b[m] * b["support"]) / n).alias(m) for m in names],
        n.alias("support"),
    )
    return two.select(F.inline(F.array(a, b, macro, weighted)))


def best_f1_at_precision(swept: DataFrame, minimum: float = P.PRECISION_TARGET) -> DataFrame:
    """The row with the highest F1 among those reaching the precision."""
    row = F.struct(*[F.col(c) for c in swept.columns])
    best = swept.where(F.col("precision") >= minimum).agg(
        F.max_by(row, F.struct(F.col("f1"), -F.col("threshold"))).alias("r")
    )
    return best.where(F.col("r").isNotNull()).select("r.*")


def best_threshold(swept: DataFrame, metric: str = "precision", target: float = P.PRECISION_TARGET) -> DataFrame:
    """The threshold whose metric is nearest the target; when that one does not
    exceed the target, the next higher threshold."""
    w = Window.orderBy("threshold")  # one row per threshold
    nxt = swept.select(
        "threshold", F.col(metric).alias("m"), F.lead("threshold").over(w).alias("nxt")
    )
    pick = nxt.agg(
        F.min_by(F.struct("threshold", "m", "nxt"), F.struct(F.abs(F.col("m") - target), F.col("threshold"))).alias("r")
    )
    return pick.select(
        F.when(F.col("r.m") > target, F.col("r.threshold"))
        .otherwise(F.coalesce(F.col("r.nxt"), F.col("r.threshold")))
        .alias("threshold"),
        F.col("r.m").alias(f"nearest_{metric}"),
    )


def summarise_runs(runs: DataFrame, baseline: dict | None = None) -> DataFrame:
    """All runs by F1, best first, under the published baseline row."""
    b = baseline or P.BASELINE_RUN
    types = {"run_name": "string", "model": "string", "split_strategy": "string", "numberOfTrees": "int"}
    base = runs.sparkSession.range(1).select(*[F.lit(v).cast(types.get(k, "double")).alias(k) for k, v in b.items()])
    both = base.withColumn("_first", F.lit(0)).unionByName(runs.withColumn("_first", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("_first", F.desc_nulls_last("f1"), "run_name").drop("_first")
