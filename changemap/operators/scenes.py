"""Scene selection and orbit validity."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions.scalars import millis_to_date
from changemap.operators.windows import Span


def acquired(time_col: str = "time_start") -> Column:
    return millis_to_date(time_col)


def select_radar(
    scenes: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    orbit: int | None = None,
    platform: str | None = "A",
    mode: str | None = "IW",
    polarisations: Sequence[str] = P.RADAR_BANDS,
    footprint: Column | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Scenes carrying all polarisations, of one mode and platform, acquired in
    ``[start, end)``; ``None`` switches a filter off."""
    out = scenes
    for p in polarisations:
        out = out.where(F.array_contains("polarisation", p))
    for c, v in (("mode", mode), ("platform", platform), ("orbit", orbit)):
        if v is not None:
            out = out.where(F.col(c) == v)
    millis = lambda d: int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc).timestamp() * 1000)
    if start is not None:
        out = out.where(F.col("time_start") >= millis(start))
    if end is not None:
        out = out.where(F.col("time_start") < millis(end))
    if footprint is not None:
        out = out.where(footprint)
    return out.select(*keep) if keep else out


def select_optical(
    images: DataFrame,
    scores: DataFrame,
    bands: Sequence[str] | str | None = None,
    score: str = "cs",
    minimum: float = P.CLOUD_SCORE_MIN,
    on: Sequence[str] = ("image_id",),
) -> DataFrame:
    """Images joined with their cloud score; every band is null where the score is
    below the minimum.  ``bands`` is a list, ``'all'``, or the default band set."""
    other = [c for c in images.columns if c not in on]
    if bands == "all":
        chosen = other
    else:
        chosen = list(bands) if bands is not None else list(P.OPTICAL_BANDS)
    joined = images.join(scores.select(*on, score), list(on))
    clear = F.col(score) >= minimum
    return joined.select(*on, *[F.when(clear, F.col(b)).alias(b) for b in chosen], F.when(clear, F.col(score)).alias(score))


def valid_orbits(
    scenes: DataFrame,
    pre: Span = P.PRE_PERIOD,
    minimum: int = P.MIN_IMAGES_PRE,
    area: str = "aoi",
    inclusive_end: bool = False,
) -> DataFrame:
    """Per area, the ascending list of orbits with enough images in the pre period."""
    d = acquired()
    inside = (d >= F.lit(pre[0])) & ((d <= F.lit(pre[1])) if inclusive_end else (d < F.lit(pre[1])))
    enough = scenes.where(inside).groupBy(area, "orbit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)
    # one entry per orbit of an area
    return enough.groupBy(area).agg(F.array_sort(F.collect_list("orbit")).alias("valid_orbits"))


def orbits_in_all_periods(
    scenes: DataFrame,
    periods: Sequence[Span],
    minimum: int = P.MIN_IMAGES_EACH,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Orbits with at least ``minimum`` images in every period (ends exclusive)."""
    d = acquired()
    counts = [
        F.count_if((d >= F.lit(s)) & (d < F.lit(e))).alias(f"n_{i}") for i, (s, e) in enumerate(periods)
    ]
    out = scenes.groupBy(*keys, "orbit").agg(*counts)
    for i in range(len(periods)):
        out = out.where(F.col(f"n_{i}") >= minimum)
    return out


def parse_orbits(df: DataFrame, text: str = "valid_orbits") -> DataFrame:
    """``"87,94,160"`` to an array of numbers."""
    return df.withColumn(text, F.transform(F.split(F.col(text), ","), lambda s: F.trim(s).cast("int")))


def format_orbits(df: DataFrame, col: str = "valid_orbits") -> DataFrame:
    """The array back to its text form."""
    return df.withColumn(col, F.concat_ws(",", F.transform(F.col(col), lambda i: i.cast("string"))))


def aoi_orbits(df: DataFrame, area: str = "aoi", col: str = "valid_orbits") -> DataFrame:
    """One row per area and valid orbit."""
    return df.select(area, F.explode(col).alias("orbit"))
