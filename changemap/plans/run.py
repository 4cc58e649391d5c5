"""Whole runs: train, score, evaluate; comparisons over configurations."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions.names import feature_names
from changemap.operators import evaluate, ledger, model, predict, splits
from changemap.operators.windows import Span
from changemap.session import materialise
from changemap.sources import io


def columns(cfg: P.RunConfig) -> list[str]:
    return feature_names(cfg.bands, cfg.reducers, (cfg.extract_window,))


def train(train_df: DataFrame, cfg: P.RunConfig, test_df: DataFrame | None = None, path: str | None = None, force: bool = False, start=None):
    """Fit by configuration; ``train_on_all`` adds the test rows to the training set. ``start`` is a smaller forest
    of the same configuration to grow on."""
    data = train_df
    if cfg.train_on_all and test_df is not None:
        data = train_df.unionByName(test_df, allowMissingColumns=True)
    args = {"name": cfg.model_name, "seed": cfg.seed, "balanced": cfg.balanced, **cfg.model_args}
    if path:
        return model.load_or_fit(path, data, columns(cfg), force, **args)
    return model.fit(data, columns(cfg), start=start, **args)


def _grows_on(before: P.RunConfig, cfg: P.RunConfig) -> bool:
    """Whether ``cfg`` is ``before`` with more trees: the trees of a forest are the first of a larger one."""
    def other(c):
        return replace(c, model_args={**c.model_args, "numTrees": None})

    counts = [c.model_args.get("numTrees") for c in (before, cfg)]
    return cfg.model_name == "random_forest" and None not in counts and counts[0] <= counts[1] and other(before) == other(cfg)


def predictions(
    fitted, test_df: DataFrame, cfg: P.RunConfig, keys: Sequence[str] = ("site_id", "aoi", "start_post")
) -> DataFrame:
    """Orbit-aggregated predictions of rows with complete features."""
    cols = columns(cfg)
    scored = model.score(fitted, test_df.na.drop(subset=cols))
    return predict.aggregate_orbits(scored, keys, cfg.aggregation)


def predict_all_areas(
    fitted, train_df: DataFrame, test_df: DataFrame, cfg: P.RunConfig, test_preds: DataFrame | None = None
) -> DataFrame:
    """Predictions of the training areas appended to those of the test areas."""
    done = test_preds if test_preds is not None else predictions(fitted, test_df, cfg)
    return predict.append_train(done, predictions(fitted, train_df, cfg))


def run(
    train_df: DataFrame,
    test_df: DataFrame,
    sites: DataFrame,
    spans: Sequence[Span],
    cfg: P.RunConfig = P.RunConfig(),
    change_date: dt.date = P.CHANGE_DATE,
    model_path: str | None = None,
    force: bool = False,
) -> DataFrame:
    """From feature tables to one row of metrics.  ``sites``: ``site_id, date``."""
    fitted = train(train_df, cfg, test_df, model_path, force)
    preds = materialise(predictions(fitted, test_df, cfg), "preds")  # read twice below
    scored_sites = preds.select("site_id").distinct()
    dated = sites.join(scored_sites, "site_id", "left_semi")
    return evaluate.metrics(preds, dated, spans, cfg.threshold, change_date=change_date)


def ablate(
    train_df: DataFrame,
    test_df: DataFrame,
    sites: DataFrame,
    spans: Sequence[Span],
    settings: dict[str, P.RunConfig],
    change_date: dt.date = P.CHANGE_DATE,
) -> DataFrame:
    """``setting, threshold`` and metrics for each configuration; all thresholds of
    a configuration come from one pass over its predictions. A forest that differs from the one before
    by more trees only is grown on from it."""
    out = fitted = before = None
    for name, cfg in settings.items():
        start = fitted if before is not None and _grows_on(before, cfg) else None
        fitted, before = train(train_df, cfg, None, None, False, start), cfg
        preds = materialise(predictions(fitted, test_df, cfg), "preds")
        dated = sites.join(preds.select("site_id").distinct(), "site_id", "left_semi")
        one = evaluate.sweep(preds, dated, spans, cfg.thresholds, change_date).select(F.lit(name).alias("setting"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def band_settings(base: P.RunConfig) -> dict[str, P.RunConfig]:
    """Each band alone, then all."""
    one = {f"{b} only": replace(base, bands=(b,)) for b in base.bands}
    return {**one, "+".join(base.bands): base}


def reducer_settings(base: P.RunConfig) -> dict[str, P.RunConfig]:
    """Reducers added step by step."""
    steps = {"mean+std": 2, "+median": 3, "+min/max": 5, "+skew": 6, "all": len(base.reducers)}
    return {k: replace(base, reducers=tuple(base.reducers[:n])) for k, n in steps.items()}


def tree_settings(base: P.RunConfig, counts: Sequence[int] = P.TREE_COUNTS) -> dict[str, P.RunConfig]:
    return {f"{n} trees": replace(base, model_args={**base.model_args, "numTrees": n}) for n in counts}


def split_features(
    features: DataFrame, strategy: str, train_aois: Sequence[str] = (), test_aois: Sequence[str] = (), seed: int = P.SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one feature table under a split strategy."""
    if strategy == "aoi":
        return features.where(F.col("aoi").isin(*train_aois)), features.where(F.col("aoi").isin(*test_aois))
    if strategy == "random_all":
        s, on = splits.random_all(features, seed), ("site_id",)
    elif strategy == "random_per_aoi":
        s, on = splits.random_per_aoi(features, seed), ("aoi", "site_id")
    else:
        raise ValueError(f"unknown split strategy {strategy!r}")
    s = materialise(s, "split")  # a row a site, joined by every pass over either part
    return splits.apply(features, s, "train", on), splits.apply(features, s, "test", on)


def compare_splits(
    features: DataFrame,
    sites: DataFrame,
    spans: Sequence[Span],
    strategies: Sequence[str] = ("aoi", "random_all", "random_per_aoi"),
    cfg: P.RunConfig = P.RunConfig(),
    change_date: dt.date = P.CHANGE_DATE,
    **areas,
) -> DataFrame:
    """One row of metrics per strategy, under the published baseline."""
    out = None
    for s in strategies:
        tr, te = split_features(features, s, **areas)
        one = run(tr, te, sites, spans, replace(cfg, split_strategy=s), change_date)
        one = one.select(
            F.lit(s).alias("run_name"), F.lit(s).alias("split_strategy"), F.lit(cfg.model_name).alias("model"),
            *evaluate.METRICS,
        )
        out = one if out is None else out.unionByName(one)
    return evaluate.summarise_runs(out)


def score_tiles(
    fitted,
    pixels: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = ("win", "tile", "row", "col"),
    method: str = "mean",
    done: DataFrame | None = None,
    only: Sequence | None = None,
    force: bool = False,
) -> DataFrame:
    """Byte predictions of every pixel of the tiles still to do, over its orbits."""
    todo = pixels
    if done is not None and not force:
        todo = todo.join(done.select("win", "tile").distinct(), ["win", "tile"], "left_anti")
    if only is not None:
        todo = todo.where(F.col("tile").isin(*only))
    scored = model.score_or_null(fitted, todo, features).select(*keys, "prob")
    return predict.to_byte_pixels(predict.aggregate_orbits(scored, keys, method)).select(*keys, "pred")


def write_tiles(
    fitted, pixels: DataFrame, features: Sequence[str], path: str, method: str = "mean", only: Sequence | None = None, force: bool = False
) -> DataFrame:
    """Score and write what is still to do, and return the (window, tile) pairs that was.

    Still to do is a tile with an orbit that the ledger beside ``path`` does not name; it is
    scored over all its orbits. The ledger is read, never the predictions. A run that
    fails before its commit leaves the ledger as it was, and its tiles are written again.
    """
    spark = pixels.sparkSession
    here = pixels if only is None else pixels.where(F.col("tile").isin(*only))
    missing = here.select(*ledger.KEYS).distinct()
    done = None if force else ledger.finished(spark, path)
    if done is not None:
        missing = missing.join(done.select(*ledger.KEYS).distinct(), list(ledger.KEYS), "left_anti")
    tiles = materialise(missing.select("win", "tile").distinct(), "pending")
    todo = here.join(tiles, ["win", "tile"], "left_semi")
    io.write_pixel_preds(score_tiles(fitted, todo, features, method=method), path)
    ledger.commit(todo, path, uuid.uuid4().hex)
    return tiles
