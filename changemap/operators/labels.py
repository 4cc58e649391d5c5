"""Assessment labels: wide to long, site summaries, one epoch per location."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions.scalars import location_key

SUMMARY = ("date_first", "date_first_severe", "date_first_destroyed", "damage_max")


def to_long(
    wide: DataFrame,
    keep: Sequence[str],
    date_cols: Sequence[str] | None = None,
    class_cols: Sequence[str] | None = None,
    n_epochs: int = P.N_EPOCHS,
    site_col: str = "site_id",
) -> DataFrame:
    """One row per site and assessed epoch: ``label_id, keep..., ep, date, damage``.

    Epochs without a class are skipped; a missing date is kept as null.
    """
    eps = range(1, n_epochs + 1)
    dates = date_cols or [f"date_{e}" for e in eps]
    classes = class_cols or [f"class_{e}" for e in eps]
    stacked = F.inline(
        F.filter(
            F.array(
                *[
                    F.struct(
                        F.lit(e).alias("ep"),
                        F.to_date(F.col(d)).alias("date"),
                        F.col(c).cast("int").alias("damage"),
                    )
                    for e, d, c in zip(eps, dates, classes)
                ]
            ),
            lambda s: s["damage"].isNotNull(),
        )
    )
    long = wide.select(*keep, stacked)
    return long.select(F.format_string("%s_%d", F.col(site_col).cast("string"), F.col("ep")).alias("label_id"), "*")


def default_columns(n_epochs: int = P.N_EPOCHS) -> tuple[list[str], list[str]]:
    """Column names of the published wide table: the first epoch has no suffix."""
    tail = [""] + [f"_{e}" for e in range(2, n_epochs + 1)]
    return [f"SensorDate{t}" for t in tail], [f"Main_Damage_Site_Class{t}" for t in tail]


def assign_aoi(df: DataFrame, mapping: Mapping[str, str], name_col: str, aoi_col: str = "aoi") -> DataFrame:
    """District name to area id through a short mapping; unmapped rows drop out."""
    flat = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(aoi_col, F.try_element_at(F.create_map(*flat), F.col(name_col))).where(
        F.col(aoi_col).isNotNull()
    )


def severe(damage: Column | str = "damage", classes: Sequence[int] = P.SEVERE_CLASSES) -> Column:
    return (F.col(damage) if isinstance(damage, str) else damage).isin(*classes)


def site_summary(labels: DataFrame, key: Sequence[str] = ("site_id",)) -> DataFrame:
    """Per site over all epochs: first date, first severe date, first date of
    class 1, and the lowest (most severe) class.  Null dates never count."""
    d, c = F.col("date"), F.col("damage")
    return labels.groupBy(*key).agg(
        F.min(d).alias("date_first"),
        F.min(F.when(severe(c), d)).alias("date_first_severe"),
        F.min(F.when(c == 1, d)).alias("date_first_destroyed"),
        F.min(c).alias("damage_max"),
    )


def with_summary(labels: DataFrame, key: Sequence[str] = ("site_id",)) -> DataFrame:
    """The long table with its site's summary on every row."""
    return labels.join(site_summary(labels, key), list(key), "left")


_ORDER = {
    # epoch to keep -> sort key, smallest wins; ties go to the lowest site, then epoch
    "last": lambda: (-F.col("ep"), F.col("site_id"), F.col("ep")),
    "min": lambda: (F.col("damage"), F.col("site_id"), F.col("ep")),
    "first": lambda: (F.col("ep"), F.col("site_id")),
    "first_severe": lambda: (F.col("ep"), F.col("site_id")),
}


def combine(
    labels: DataFrame, how: str, x: str = "lon", y: str = "lat", classes: Sequence[int] = P.SEVERE_CLASSES
) -> DataFrame:
    """One row per location (coordinates at 6 decimals): the ``last`` epoch, the
    most severe (``min``), the ``first``, or the first severe one.

    An ordered aggregate keeps one candidate per location and map task, so a
    location with very many rows is never sorted in one place.
    """
    if how not in _ORDER:
        raise ValueError(f"unknown epoch rule {how!r}; use one of {sorted(_ORDER)}")
    src = labels.where(severe(classes=classes)) if how == "first_severe" else labels
    kx, ky = location_key(x, y)
    row = F.struct(*[F.col(c) for c in labels.columns])
    best = src.groupBy(kx.alias("_kx"), ky.alias("_ky")).agg(
        F.min_by(row, F.struct(*_ORDER[how]())).alias("_row")
    )
    return best.select("_row.*")


def load(
    labels: DataFrame,
    aoi: str | Sequence[str] | None = None,
    keep: Sequence[int] | None = None,
    combine_epoch: str | None = None,
    **kw,
) -> DataFrame:
    """Epoch rule first, class filter second, area filter last."""
    out = combine(labels, combine_epoch, **kw) if combine_epoch else labels
    if keep is not None:
        out = out.where(F.col("damage").isin(*keep))
    if aoi is not None:
        out = out.where(F.col("aoi").isin(*([aoi] if isinstance(aoi, str) else aoi)))
    return out
