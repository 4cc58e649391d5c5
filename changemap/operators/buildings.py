"""Building-level predictions, labels and the damage rule."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions.scalars import area_at_least
from changemap.operators import geo


def project_source(raw: DataFrame, edges: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Public building schema to ours: data set out of the first source, class and
    geometry renamed; with edges also area (m2, ellipsoid) and centroid."""
    out = raw.select(
        F.get_json_object(F.col("sources"), "$[0].dataset").alias("dataset"),
        F.col(key).alias("building_id"),
        F.col("class").alias("osm_class"),
        F.col("geometry").alias("geometry_wkb"),
    )
    if edges is None:
        return out
    size = geo.spheroid_area(edges, "building_id")
    mid = geo.area_centroid(edges, "building_id").select("building_id", F.col("cx").alias("lon"), F.col("cy").alias("lat"))
    return out.join(size, "building_id", "left").join(mid, "building_id", "left")


def within_boundary(
    edges: DataFrame,
    boundary: DataFrame,
    key: str,
    boundary_key: str,
    cell_size: float,
    min_area: float = P.MIN_AREA_M2,
) -> DataFrame:
    """``key, area_m2, cx, cy`` of buildings whose centroid lies in the boundary and
    whose area reaches the minimum.  The cheap area test runs first."""
    b = geo.area_centroid(edges, key).withColumnRenamed("area", "area_m2").where(area_at_least("area_m2", min_area))
    return geo.point_in_polygon(b, boundary, key, boundary_key, cell_size, "left_semi", "cx", "cy")


def most_severe_point(
    pairs: DataFrame, labels: DataFrame, point_key: str = "point_id", building_key: str = "building_id",
    tie: Sequence[str] = ("ep",), carry: Sequence[str] = ("date",),
) -> DataFrame:
    """Per building the most severe label among its points, as one whole row:
    ``label_damage, label_id`` and ``label_{carry}``."""
    rows = pairs.join(geo.shuffled(labels), point_key)
    order = F.struct(F.col("damage"), F.col(point_key), *[F.col(c) for c in tie])
    best = rows.groupBy(building_key).agg(F.min_by(F.struct("damage", point_key, *carry), order).alias("r"))
    return best.select(
        building_key, F.col("r.damage").alias("label_damage"), F.col(f"r.{point_key}").alias("label_id"),
        *[F.col(f"r.{c}").alias(f"label_{c}") for c in carry],
    )


def attach_labels(
    buildings: DataFrame,
    edges: DataFrame,
    labels: DataFrame,
    radius: float = P.LABEL_BUFFER_M,
    cell_size: float = 64.0,
    point_key: str = "point_id",
    building_key: str = "building_id",
    carry: Sequence[str] = ("date",),
    areas: DataFrame | None = None,
    area_key: str = "aoi",
    area_cell: float = 100.0,
) -> DataFrame:
    """All buildings, with the most severe label within ``radius`` metres or null.

    With ``areas`` (edges keyed by ``area_key``, a column of the labels too) a label
    only counts for buildings that touch its own area.
    """
    pairs = geo.within_distance(labels, edges, point_key, building_key, radius, cell_size)
    if areas is not None:
        touching = geo.intersects(edges, areas, building_key, area_key, area_cell)
        pairs = (
            pairs.join(geo.shuffled(labels.select(point_key, area_key)), point_key)
            .join(geo.shuffled(touching), [building_key, area_key], "left_semi")
            .drop(area_key)
        )
    best = most_severe_point(pairs, labels, point_key, building_key, carry=carry)
    return buildings.join(geo.shuffled(best), building_key, "left")


def weighted_scores(
    overlap: DataFrame,
    values: DataFrame,
    on: Sequence[str],
    building_key: str = "building_id",
    win: str = "start_post",
    value: str = "pred",
    scale: float = 1.0,
) -> DataFrame:
    """``building, win, weighted_mean, max``: area-weighted mean and maximum.

    A missing value adds nothing to the numerator while its area still counts, so
    a building with only missing values gets 0.
    """
    j = overlap.join(geo.shuffled(values.select(*on, win, value)), list(on))
    v = F.col(value) / F.lit(scale) if scale != 1.0 else F.col(value).cast("double")
    return j.groupBy(building_key, win).agg(
        (F.coalesce(F.sum(v * F.col("area")), F.lit(0.0)) / F.sum("area")).alias("weighted_mean"), F.max(v).alias("max")
    )


def from_pixels(edges: DataFrame, pixels: DataFrame, grid: geo.Grid, building_key: str = "building_id", **kw) -> DataFrame:
    """Pixel path: squares against footprints."""
    return weighted_scores(geo.grid_overlap(edges, building_key, grid), pixels, ["row", "col"], building_key, **kw)


def from_points(
    points: DataFrame,
    preds: DataFrame,
    edges: DataFrame,
    radius: float = P.POINT_BUFFER_M,
    cell_size: float = 64.0,
    point_key: str = "point_id",
    building_key: str = "building_id",
    **kw,
) -> DataFrame:
    """Point path: disks around prediction points against footprints; values on 0..1."""
    o = geo.disk_overlap(points, edges, point_key, building_key, radius, cell_size)
    return weighted_scores(o, preds, [point_key], building_key, scale=float(P.SCALE_MAX), **kw)


def with_preds(buildings: DataFrame, preds: DataFrame, how: str = "left", key: str = "building_id") -> DataFrame:
    """``left`` keeps buildings without overlap (pixel path), ``right`` drops them
    (point path)."""
    return buildings.join(geo.shuffled(preds), key, how)


def to_wide(scores: DataFrame, starts: Sequence, key: str = "building_id", win: str = "start_post", value: str = "weighted_mean") -> DataFrame:
    """One column per window start, mean of duplicates, from a given window list."""
    return scores.groupBy(key).pivot(win, list(starts)).agg(F.avg(value))


def to_long(wide: DataFrame, starts: Sequence, key: str = "building_id", win: str = "start_post", value: str = "weighted_mean") -> DataFrame:
    """Window columns back to rows; missing values drop out."""
    arr = F.array(*[F.struct(F.lit(s).alias(win), F.col(f"`{s}`").alias(value)) for s in starts])
    return wide.select(key, F.inline(arr)).where(F.col(value).isNotNull())


def max_pre_post(
    scores: DataFrame,
    change_date: dt.date = P.CHANGE_DATE,
    key: str = "building_id",
    win: str = "start_post",
    value: str = "weighted_mean",
) -> DataFrame:
    """``max_pre, max_post`` over the windows before and from the change date."""
    pre = F.col(win) < F.lit(change_date)
    return scores.groupBy(key).agg(
        F.max(F.when(pre, F.col(value))).alias("max_pre"), F.max(F.when(~pre, F.col(value))).alias("max_post")
    )


def classify(
    scores: DataFrame,
    threshold: float = P.RULE_THRESHOLD,
    change_date: dt.date = P.CHANGE_DATE,
    strict: bool = False,
    n_pre: int | None = None,
    key: str = "building_id",
    win: str = "start_post",
    value: str = "weighted_mean",
) -> DataFrame:
    """Quiet before, loud after: ``max_pre, max_post, damaged``.

    A missing value never counts as loud.  ``strict`` also asks for a value in every
    one of the ``n_pre`` windows before the change.
    """
    pre, v = F.col(win) < F.lit(change_date), F.col(value)
    m = scores.groupBy(key).agg(
        F.max(F.when(pre, v)).alias("max_pre"),
        F.max(F.when(~pre, v)).alias("max_post"),
        F.count(F.when(pre, v)).alias("_n_pre"),
    )
    # without any value before the change the comparison fails
    rule = (F.col("max_post") >= threshold) & (F.col("max_pre") < threshold)
    if strict:
        rule = rule & (F.col("_n_pre") == F.lit(n_pre))
    return m.withColumn("damaged", F.when(rule, 1).otherwise(0)).drop("_n_pre")
