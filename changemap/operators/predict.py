"""Predictions: orbit aggregation, wide form, label dates, pending tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemap.functions.scalars import scale_to_byte

_METHODS = {"mean": F.avg, "max": F.max, "min": F.min, "median": F.median}


def orbit_method(name: str, value: str = "prob") -> Column:
    """Aggregate over orbits by name, nulls skipped; unknown names raise."""
    if name not in _METHODS:
        raise ValueError(f"unknown aggregation method {name!r}; use one of {sorted(_METHODS)}")
    return _METHODS[name](value)


def aggregate_orbits(
    scored: DataFrame,
    keys: Sequence[str] = ("site_id", "aoi", "start_post"),
    method: str = "mean",
    value: str = "prob",
) -> DataFrame:
    """One row per key: ``prob`` over the orbits and ``pred`` on 0..255."""
    out = scored.groupBy(*keys).agg(orbit_method(method, value).alias("prob"))
    return out.withColumn("pred", scale_to_byte("prob"))


def to_wide(
    preds: DataFrame,
    windows: Sequence,
    keys: Sequence[str] = ("site_id", "aoi"),
    value: str = "pred",
    prefix: str = "pred_",
) -> DataFrame:
    """One ``pred_{start}`` column per window; the windows are given, not searched for."""
    starts = [str(s) for s, _ in windows]
    wide = preds.groupBy(*keys).pivot("start_post", [s for s, _ in windows]).agg(F.max(value))
    renamed = [F.col(f"`{s}`").alias(f"{prefix}{s}") for s in starts]
    return wide.select(*keys, *renamed)


def to_long(
    wide: DataFrame, keys: Sequence[str] = ("site_id", "aoi"), prefix: str = "pred_", value: str = "pred"
) -> DataFrame:
    """Wide predictions back to one row per window; missing values drop out."""
    cols = [c for c in wide.columns if c.startswith(prefix)]
    arr = F.array(
        *[
            F.struct(F.lit(c[len(prefix):]).cast("date").alias("start_post"), F.col(f"`{c}`").alias(value))
            for c in cols
        ]
    )
    return wide.select(*keys, F.inline(arr)).where(F.col(value).isNotNull())


def attach_labels(preds: DataFrame, labels: DataFrame, on: Sequence[str] = ("site_id", "aoi")) -> DataFrame:
    """Label date and place on every prediction; predictions without a label stay."""
    return preds.join(labels, list(on), "left")


def append_train(test_preds: DataFrame, train_preds: DataFrame) -> DataFrame:
    """Predictions of both splits in one table."""
    return test_preds.unionByName(train_preds, allowMissingColumns=True)


def pending_tiles(
    wanted: DataFrame,
    done: DataFrame,
    on: Sequence[str] = ("win", "tile"),
    only: Sequence | None = None,
    force: bool = False,
) -> DataFrame:
    """Tiles still to do: wanted minus done.  ``only`` overrides the wanted ids,
    ``force`` keeps finished ones."""
    out = wanted if only is None else wanted.where(F.col(list(on)[-1]).isin(*only))
    return out if force else out.join(done.select(*on).distinct(), list(on), "left_anti")


def complete_or_null(pixels: DataFrame, cols: Sequence[str]) -> Column:
    """True for rows that can be scored; raises when a feature column is missing."""
    missing = [c for c in cols if c not in pixels.columns]
    if missing:
        raise ValueError(f"feature columns missing: {missing}")
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return cond


def to_byte_pixels(preds: DataFrame, prob: str = "prob") -> DataFrame:
    """Stored form of pixel probabilities: 0..255 as a small integer, missing as 0."""
    return preds.withColumn("pred", F.coalesce(scale_to_byte(prob), F.lit(0)).cast("smallint"))
