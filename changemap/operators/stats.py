"""Report tables: per-district summaries, shares, crosstabs, curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions.scalars import area_at_least


def percent(cond: Column) -> Column:
    """Share of rows, in percent, where ``cond`` holds (null counts as no)."""
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))) * 100


def by_admin(buildings: DataFrame, key: str = "adm2_name", digits: int = 2) -> DataFrame:
    """Buildings, damaged buildings, percent damaged and mean of the post maximum."""
    return (
        buildings.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count("damaged").alias("n_buildings"),
            F.sum("damaged").alias("n_damaged"),
            F.round(F.avg("damaged") * 100, digits).alias("pct_damaged"),
            F.round(F.avg("max_post"), digits).alias("mean_max_post"),
        )
    )


def by_admin_cutoff(
    buildings: DataFrame,
    value: str = "max_post",
    cutoff: float = P.HALF_THRESHOLD,
    key: str = "adm2_name",
    digits: int = 3,
) -> DataFrame:
    """Count of values, their mean, and the percent above ``cutoff``.

    The count skips nulls while the percentage is of all rows.
    """
    return (
        buildings.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(value).alias("n_buildings"),
            F.round(F.avg(value), digits).alias("mean_damage"),
            F.round(percent(F.col(value) > cutoff), digits).alias("pct_over"),
        )
    )


def admin_damage(
    admins: DataFrame,
    buildings: DataFrame,
    damaged: DataFrame,
    key: str = "adm2_name",
    min_area: float = P.MIN_AREA_M2,
) -> DataFrame:
    """Every unit with its damaged and total building counts and the percentage.

    Units without buildings get zeros and a null percentage.
    """
    total = buildings.where(area_at_least("area_m2", min_area, inclusive=False)).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_buildings")
    )
    hit = damaged.groupBy(key).agg(F.count(F.lit(1)).alias("n_buildings_damaged"))
    out = admins.select(key).distinct().join(hit, key, "left").join(total, key, "left")
    out = out.na.fill(0, ["n_buildings", "n_buildings_damaged"])
    return out.withColumn(
        "perc_damaged", F.col("n_buildings_damaged") * 100.0 / F.nullif(F.col("n_buildings"), F.lit(0))
    )


def temporal_curve(building_preds: DataFrame, key: str = "adm2_name", value: str = "weighted_mean") -> DataFrame:
    """Mean value per unit and window."""
    return building_preds.where(F.col(key).isNotNull()).groupBy(key, "start_post").agg(F.avg(value).alias("mean_value"))


def label_counts(labels: DataFrame, keys: Sequence[str] = ("aoi", "damage")) -> DataFrame:
    return labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys)


def date_distribution(labels: DataFrame, date: str = "date_first_severe") -> DataFrame:
    return labels.where(F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("n")).orderBy(date)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts of one column, most frequent first."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def class_crosstab(
    points: DataFrame,
    key: str = "municipality",
    class_col: str = "damage",
    names: Mapping[int, str] = P.CLASS_NAMES,
) -> DataFrame:
    """Points per unit and class as columns, missing 0, with a total, largest first.

    The listed classes give the columns, so no pass is spent on finding them.
    """
    cols = [
        F.count(F.when(F.col(class_col) == code, F.lit(1))).alias(name) for code, name in names.items()
    ]
    total = F.count(F.when(F.col(class_col).isin(*names), F.lit(1))).alias("Total")
    return points.where(F.col(key).isNotNull()).groupBy(key).agg(*cols, total).orderBy(F.desc("Total"), key)


def class_shares(points: DataFrame, class_col: str = "damage", names: Mapping[int, str] = P.CLASS_NAMES) -> DataFrame:
    """Number and percent of points per listed class, of all points."""
    listed = F.when(F.col(class_col).isin(*names), F.col(class_col)).alias(class_col)
    per = points.groupBy(listed).agg(F.count(F.lit(1)).alias("n"))
    # at most one row per listed class plus one, so one task may hold them all
    whole = F.sum("n").over(Window.partitionBy())
    return (
        per.withColumn("pct", F.col("n") * 100.0 / whole)
        .where(F.col(class_col).isNotNull())
        .orderBy(class_col)
    )


def totals(damaged: DataFrame) -> DataFrame:
    """Rows, damaged rows, undamaged rows and percentages."""
    d = F.col("damaged")
    return damaged.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.sum(d).alias("n_damaged"),
        F.sum(1 - d).alias("n_undamaged"),
        (F.avg(d) * 100).alias("pct_damaged"),
        (F.avg(1 - d) * 100).alias("pct_undamaged"),
    )


def distinct_count(df: DataFrame, *cols: str) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in cols])
