"""Registered model queries run at the study's settings."""

import pytest

from changemap import params as P
from changemap.operators import evaluate, forest, model
from changemap.plans import q_model


class Stop(Exception):
    pass


def settings_used(monkeypatch, spark, sf, query) -> list[forest.Settings]:
    """The settings that reach the growing of the forests of a query."""
    seen = []

    def grow(rows, features, forests, *_):
        seen.extend(forests)
        raise Stop

    monkeypatch.setattr(forest, "grow", grow)
    with pytest.raises(Stop):
        query(spark, sf)
    return seen


def test_single_forests(monkeypatch, spark, sf):
    for query in (q_model.model_random_forest, q_model.run_metrics):
        (s,) = settings_used(monkeypatch, spark, sf, query)
        assert (s.trees, s.min_leaf, s.max_leaves, s.mtry, s.max_depth) == (50, 3, 10_000, "sqrt", forest.MAX_DEPTH)


def test_out_of_bag_curves(monkeypatch, spark, sf):
    (s,) = settings_used(monkeypatch, spark, sf, q_model.model_oob_curve)
    assert s.trees == 146 and P.OOB_COUNTS == tuple(range(1, 147, 5))
    several = settings_used(monkeypatch, spark, sf, q_model.model_oob_by_mtry)
    assert [s.mtry for s in several] == list(P.MTRY_VALUES) and {s.trees for s in several} == {50} and len(several) == 13


def test_ablations_train_every_number_of_trees(monkeypatch, spark, sf):
    trained = []

    class Untrained:
        columns = ["site_id"]

        def __getattr__(self, name):
            return lambda *a, **k: self

    monkeypatch.setattr(q_model.R, "train", lambda train, cfg, *a: trained.append(cfg))
    monkeypatch.setattr(q_model.R, "predictions", lambda *a: Untrained())
    monkeypatch.setattr(q_model.R, "materialise", lambda df, name: df)
    monkeypatch.setattr(evaluate, "sweep", lambda *a: Untrained())
    for query in (q_model.run_ablate_trees, q_model.run_ablate_bands, q_model.run_ablate_reducers):
        monkeypatch.setattr(q_model, "_train_test", lambda *a: (None, None))
        monkeypatch.setattr(q_model, "site_dates", lambda *a: Untrained())
        query(spark, sf)
    assert [c.model_args["numTrees"] for c in trained[:5]] == [10, 25, 50, 75, 100] and {c.model_args["numTrees"] for c in trained[5:]} == {50}


def test_other_classifiers_take_the_librarys_defaults():
    assert model.classifier("svm").getMaxIter() == 100 and model.classifier("gradient_trees").getMaxIter() == 20
