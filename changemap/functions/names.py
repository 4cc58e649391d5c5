"""Feature names: ``{band}_{pre|post}_{window}_{reducer}``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemap import params as P

PERIODS = ("pre", "post")


def feature_name(band: str, period: str, window: str, reducer: str) -> str:
    return "_".join((band, period, window, reducer))


def feature_names(
    bands: Sequence[str] = P.RADAR_BANDS,
    reducers: Sequence[str] = P.REDUCERS,
    windows: Sequence[str] = (P.EXTRACT_WINDOW,),
) -> list[str]:
    """All names, nested band > period > window > reducer."""
    return [feature_name(b, p, w, r) for b in bands for p in PERIODS for w in windows for r in reducers]


def split_name(feature: Column | str) -> dict[str, Column]:
    """Band, period, window and reducer columns out of a name column."""
    parts = F.split(F.col(feature) if isinstance(feature, str) else feature, "_")
    return {k: parts.getItem(i) for i, k in enumerate(("band", "period", "window", "reducer"))}


def select_bands(features: DataFrame, bands: Sequence[str], keep: Sequence[str], **kw) -> DataFrame:
    """Keys plus the feature columns of the chosen bands."""
    return features.select(*keep, *feature_names(bands, **kw))
