"""Pre/post window features per site, orbit and window.

Each observation is tagged with the windows it falls in (the pre period is window
0), and all statistics of a site, orbit and window come out of one shuffle, so the
pre period is computed once instead of once per window.  The window rows of a site
are then folded into one map of at most ``len(post)+2`` entries, so that every
window row, including windows without images, is produced by a row-local explode
instead of two left joins.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions.median import grouped_agg
from changemap.functions.moments import reducer
from changemap.functions.names import feature_name
from changemap.functions.scalars import nan_to_null
from changemap.operators.pixels import focal_mean
from changemap.operators.windows import Span, tag, window_array, window_label


def window_stats(
    obs: DataFrame,
    pre: Span,
    post: Sequence[Span],
    keys: Sequence[str],
    bands: Sequence[str],
    reducers: Sequence[str] = P.REDUCERS,
    date_col: str = "obs_date",
    inclusive_end: bool = True,
) -> DataFrame:
    """``keys, win, n, {band}_{reducer}...``; win 0 is the pre period and -1
    marks keys that have observations outside every window, without values."""
    keys = list(keys)
    values = [nan_to_null(F.col(b).cast("double")).alias(b) for b in bands]
    spans = [pre, *post]
    rows = tag(obs.select(*keys, date_col, *values), date_col, spans, inclusive_end, first=0, outside=-1).drop(date_col)
    rows = rows.withColumns({b: F.when(F.col("win") >= 0, F.col(b)) for b in bands})
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [reducer(r, b).alias(f"{b}_{r}") for b in bands for r in reducers if r != "median"]
    medians = {f"{b}_median": b for b in bands} if "median" in reducers else {}
    return grouped_agg(rows, keys + ["win"], aggs, medians)


def build(
    obs: DataFrame,
    sites: DataFrame | None,
    pre: Span = P.PRE_PERIOD,
    post: Sequence[Span] = (),
    keys: Sequence[str] = ("site_id", "orbit"),
    site_keys: Sequence[str] = ("site_id",),
    bands: Sequence[str] = P.RADAR_BANDS,
    reducers: Sequence[str] = P.REDUCERS,
    extract_window: str = P.EXTRACT_WINDOW,
    change_date: dt.date = P.CHANGE_DATE,
    date_col: str = "obs_date",
    severe_col: str | None = "date_first_severe",
    with_counts: bool = False,
    inclusive_end: bool = True,
    grid_from: str = "obs",
) -> DataFrame:
    """Feature rows for every key and window that passes the label rule.

    ``sites`` holds one metadata row per ``site_keys``; ``severe_col`` in it is
    the date the change was first confirmed.  A window ending after
    ``change_date`` keeps only sites confirmed by its end; ``severe_col=None``
    keeps every window (dense scoring). ``inclusive_end=False`` leaves the last day of a
    window out. ``grid_from="sites"`` also keeps sites without observations, with
    nulls for the keys that only observations have. ``extract_window`` names the
    features; the values must have been taken over it (``from_pixels`` does so).
    """
    if grid_from not in ("obs", "sites") or grid_from == "sites" and sites is None:
        raise ValueError("grid_from is 'obs', or 'sites' where there are sites")
    keys = list(keys)
    post = list(post) or P.month_windows()
    stats = window_stats(obs, pre, post, keys, bands, reducers, date_col, inclusive_end)
    cols = [f"{b}_{r}" for b in bands for r in reducers]
    vec = F.struct(*[F.col(c) for c in cols], F.col("n"))
    if sites is not None:
        # at most orbits x windows rows per site; both the fold and the join below
        # then work on this one partitioning
        stats = stats.repartition(*site_keys)
    folded = stats.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("win"), vec.alias("s")))).alias("_by_win")
    )
    described = folded if sites is None else folded.join(sites, list(site_keys), "left" if grid_from == "obs" else "full")
    grid = described.select("*", F.inline(window_array(post)))
    grid = grid.withColumn("label", window_label(F.col("end_post"), change_date))
    if severe_col:
        grid = grid.where((F.col("label") == 0) | (F.col(severe_col) <= F.col("end_post")))
    grid = grid.withColumns(
        {
            "_pre": F.try_element_at("_by_win", F.lit(0)),
            "_post": F.try_element_at("_by_win", F.col("win")),
        }
    )
    periods = (("pre", "_pre"), ("post", "_post"))
    feats = [
        f"{side}.{b}_{r} AS `{feature_name(b, p, extract_window, r)}`" for b in bands for p, side in periods for r in reducers
    ]
    if with_counts:
        feats += [f"coalesce({side}.n, 0L) AS n_tiles_{p}" for p, side in periods]
    meta = [c for c in sites.columns if c not in site_keys] if sites is not None else []
    return grid.selectExpr(
        *keys, *meta, "win", f"DATE'{pre[0]}' AS start_pre", f"DATE'{pre[1]}' AS end_pre", "start_post", "end_post", "label",
        *feats,
    )


def build_with_pre_window(obs: DataFrame, sites: DataFrame, pre: Span, post: Sequence[Span], **kw) -> DataFrame:
    """All windows of a run, the pre period itself included as a label-0 window."""
    return build(obs, sites, pre, [pre, *post], **kw)


def from_pixels(
    pixels: DataFrame, pre: Span, post: Sequence[Span], keys: Sequence[str] = ("tile", "row", "col", "orbit"),
    bands: Sequence[str] = P.RADAR_BANDS, extract_window: str = P.EXTRACT_WINDOW, date_col: str = "obs_date", scene: Sequence[str] = (), **kw
) -> DataFrame:
    """Feature rows per pixel: the same plan keyed by cell, every window kept.

    With an ``extract_window`` over 1x1 each scene is smoothed first: the mean over the
    window around each of its pixels, those of its own tile. ``scene`` names what tells scenes
    of one date apart. Smoothed values are rounded to 1e-9, so that whether those of a window are all
    equal does not depend on the order in which a mean was summed.
    """
    k = int(extract_window.split("x")[0])
    if k > 1:
        tile = [c for c in keys if c not in ("row", "col")]
        pixels = focal_mean(pixels, list(bands), k, [*tile, date_col, *scene]).withColumns({b: F.round(b, 9) for b in bands})
    return build(pixels, None, pre, post, keys=keys, severe_col=None, bands=bands, extract_window=extract_window, date_col=date_col, **kw)


def drop_incomplete(features: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with every chosen feature present."""
    return features.na.drop(subset=list(cols))


def join_sets(
    first: DataFrame,
    second: DataFrame,
    on: Sequence[str] = ("site_id", "start_post", "orbit"),
    keep_first: Sequence[str] | None = None,
    keep_second: Sequence[str] | None = None,
) -> DataFrame:
    """Inner join of two feature sets; on a name clash the second set's value wins."""
    on = list(on)
    right = [c for c in (keep_second or second.columns) if c not in on]
    left = [c for c in (keep_first or first.columns) if c not in on and c not in right]
    return first.select(*on, *left).join(second.select(*on, *right), on, "inner")
