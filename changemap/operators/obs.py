"""Observation rows: scene values at points, and filling of missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemap.functions.scalars import require_all
from changemap.operators.pixels import focal_mean


def extract_at_points(
    points: DataFrame,
    scene_pixels: DataFrame,
    scenes: DataFrame,
    bands: Sequence[str],
    keep_scene: Sequence[str] = ("orbit", "time_start"),
    k: int = 1,
    cell: Sequence[str] = ("row", "col"),
    scene_key: str = "scene_id",
    required: Sequence[str] = (),
) -> DataFrame:
    """One row per (point, scene covering it): point fields, scene fields, bands.

    Two equi-joins: points to pixels on the cell, pixels to scenes on the id.
    ``k`` = 3 takes the mean of the 3 x 3 pixels, the coarser extraction scale.
    ``required`` bands must be present.
    """
    px = scene_pixels if k == 1 else focal_mean(scene_pixels, bands, k, keys=[scene_key])
    px = px.select(scene_key, *cell, *bands)
    if required:
        px = px.where(require_all(required))
    wanted = scenes.select(scene_key, *keep_scene)
    return px.join(wanted, scene_key).join(points, list(cell)).drop(*cell)


def fill_with_mean(obs: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("site_id", "orbit")) -> DataFrame:
    """Missing band values replaced by the key's mean over time.

    Complete rows pass straight through; only rows with a gap meet the means.
    """
    gap = F.lit(False)
    for b in bands:
        gap = gap | F.col(b).isNull()
    means = obs.groupBy(*keys).agg(*[F.avg(b).alias(f"_m_{b}") for b in bands])
    filled = (
        obs.where(gap)
        .join(means, list(keys), "left")
        .withColumns({b: F.coalesce(F.col(b), F.col(f"_m_{b}")) for b in bands})
        .select(*obs.columns)
    )
    return obs.where(~gap).unionByName(filled)
