import datetime as dt

import pytest
from pyspark.sql import functions as F

from changemap.operators import evaluate

D = dt.date
SPANS = [(D(2020, m, 1), D(2020, m, 28)) for m in (1, 2, 3, 4)]
CHANGE = D(2020, 3, 1)


@pytest.fixture(scope="module")
def data(spark):
    preds = spark.createDataFrame(
        [(1, D(2020, 1, 1), 10), (1, D(2020, 2, 1), 200), (1, D(2020, 3, 1), 128), (1, D(2020, 4, 1), 127),
         (2, D(2020, 1, 1), 0), (2, D(2020, 4, 1), 255), (3, D(2020, 4, 1), 255)],
        "site_id int, start_post date, pred int",
    )
    sites = spark.createDataFrame([(1, D(2020, 3, 1)), (2, D(2020, 4, 2)), (3, None)], "site_id int, date date")
    return preds, sites


def counts(r):
    return r.tp, r.fp, r.fn, r.tn


def test_missing_predictions_are_negative_votes(data):
    # site 1: positives 128 hit, 127 miss; negatives 10, 200.  Site 2: no positives,
    # negatives 0 and one missing.  Site 3 has no date.
    r = evaluate.metrics(*data, SPANS, 0.5, change_date=CHANGE).first()
    assert counts(r) == (1, 1, 1, 3)
    assert r.precision == 0.5 and r.recall == 0.5 and r.f1 == 0.5 and r.accuracy == pytest.approx(4 / 6)
    assert r.roc_auc == pytest.approx((0.5 + 0.75) / 2)


def test_votes_agree_with_the_histogram_path(data):
    for t in (0.0, 0.3, 0.5, 0.9):
        v = evaluate.votes(*data, SPANS, t, change_date=CHANGE)
        a = evaluate._from_votes(v).first()
        b = evaluate.metrics(*data, SPANS, t, change_date=CHANGE).first()
        assert counts(a) == counts(b)  # at 0, too, a missing prediction is no hit


def test_mean_and_median_cast_one_vote_per_side(data):
    # site 2 has no positive window and still casts a false positive-side vote
    r = evaluate.metrics(*data, SPANS, 0.4, "date-wise-mean", CHANGE).first()
    assert counts(r) == (1, 1, 1, 1)
    r = evaluate.metrics(*data, SPANS, 0.5, "date-wise-median", CHANGE).first()
    assert counts(r) == (1, 0, 1, 2)
    with pytest.raises(ValueError):
        evaluate.metrics(*data, SPANS, method="site-wise")


def test_one_class_gives_no_auc(spark, data):
    preds, _ = data
    sites = spark.createDataFrame([(1, D(2021, 1, 1))], "site_id int, date date")
    r = evaluate.metrics(preds, sites, SPANS, change_date=CHANGE).first()
    assert r.roc_auc is None and r.recall == 0.0 and r.tp == 0


def test_year_restriction(data):
    r = evaluate.metrics(*data, SPANS, change_date=CHANGE, pos_year=2019).first()
    assert r.tp + r.fn == 0 and r.tn + r.fp == 4


def test_label_before_the_change_puts_windows_on_both_sides(spark, data):
    preds, _ = data
    sites = spark.createDataFrame([(1, D(2020, 2, 1))], "site_id int, date date")
    r = evaluate.metrics(preds, sites, SPANS, change_date=CHANGE).first()
    assert r.tp + r.fn == 3 and r.tn + r.fp == 2


def test_fractional_predictions_meet_exact_thresholds(spark, data):
    _, sites = data
    p = spark.createDataFrame([(1, D(2020, 3, 1), 127.4), (1, D(2020, 4, 1), 127.5)], "site_id int, start_post date, pred double")
    r = evaluate.metrics(p, sites, SPANS, 0.5, change_date=CHANGE).first()
    assert (r.tp, r.fn) == (1, 1)


def test_best_thresholds(spark):
    s = spark.createDataFrame(
        [(0.1, 0.5, 0.9), (0.2, 0.88, 0.8), (0.3, 0.91, 0.7), (0.4, 0.95, 0.7), (0.5, 0.99, 0.1)], "threshold double, precision double, f1 double"
    )
    assert evaluate.best_f1_at_precision(s).first().threshold == 0.3
    assert evaluate.best_threshold(s).first().threshold == 0.3
    assert evaluate.best_threshold(s, target=0.87).first().threshold == 0.2
    assert evaluate.best_threshold(s, target=0.885).first().threshold == 0.3  # nearest lies below: take the next
    assert evaluate.best_f1_at_precision(s, 0.999).count() == 0


def test_report_weights_by_support(data):
    rep = {r["row"]: r for r in evaluate.report(evaluate.metrics(*data, SPANS, change_date=CHANGE)).collect()}
    assert rep["damaged"].support == 2 and rep["no damage"].support == 4
    assert rep["weighted avg"].recall == pytest.approx((0.5 * 2 + 0.75 * 4) / 6)
    assert rep["macro avg"].precision == pytest.approx((0.5 + 0.75) / 2)


def test_runs_sort_under_the_baseline(spark):
    runs = spark.createDataFrame([("a", 0.2), ("b", 0.9), ("c", None)], "run_name string, f1 double")
    assert [r.run_name for r in evaluate.summarise_runs(runs).collect()] == ["published baseline", "b", "a", "c"]


def test_votes_need_all_keys_of_the_predictions(spark):
    """A site in two areas has two predictions a window: the keys must name both."""
    d = dt.date(2021, 3, 1)
    preds = spark.createDataFrame([(1, "a", d, 200), (1, "b", d, 10)], "site_id int, aoi string, start_post date, pred int")
    sites = spark.createDataFrame([(1, "a", d), (1, "b", d)], "site_id int, aoi string, date date")
    spans = [(d, dt.date(2021, 4, 30))]
    got = evaluate.votes(preds, sites, spans, change_date=dt.date(2021, 2, 1), on=("site_id", "aoi")).collect()
    assert sorted((r.aoi, r.y_pred) for r in got) == [("a", 1), ("b", 0)]
    with pytest.raises(Exception, match="more than one prediction"):
        evaluate.votes(preds, sites.select("site_id", "date").distinct(), spans, change_date=dt.date(2021, 2, 1)).collect()
