"""Train/test splits at site level, exact in size and free of a global sort.

Sites are ordered by a seeded hash.  To take exactly ``floor(fraction * n)`` of
them, sites are counted per hash prefix (at most 65,536 counts per group), the
prefix in which the quota runs out is found from the running sum of the counts,
and only the sites inside that one prefix are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changemap import params as P


def by_aoi(df: DataFrame, train: Sequence[str], test: Sequence[str], aoi: str = "aoi") -> DataFrame:
    """Split by lists of areas; areas in neither list drop out."""
    split = F.when(F.col(aoi).isin(*train), "train").when(F.col(aoi).isin(*test), "test")
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def site_hash(seed: int, site: str = "site_id"):
    """32 hex digits; their order is the shuffled order of the sites."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(site).cast("string")))


def _exact(ids: DataFrame, groups: list[str], site: str, fraction: float) -> DataFrame:
    ids = ids.withColumn("_b", F.substring("_h", 1, 4))
    per = ids.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_c"))
    part = Window.partitionBy(*groups)
    upto = part.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.select(
        *groups, "_b",
        (F.sum("_c").over(upto) - F.col("_c")).alias("_before"),
        F.col("_c"),
        F.floor(F.sum("_c").over(part) * F.lit(fraction)).alias("_k"),
    )
    left = F.col("_k") - F.col("_before")  # quota left when the prefix starts
    marked = ids.join(per, [*groups, "_b"])
    whole = marked.where((left >= F.col("_c")) | (left <= 0)).select(
        *groups, site, F.when(left > 0, "train").otherwise("test").alias("split")
    )
    rank = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_h", site))
    cut = marked.where((left < F.col("_c")) & (left > 0)).withColumn("_r", rank).select(
        *groups, site, F.when(F.col("_r") <= left, "train").otherwise("test").alias("split")
    )
    return whole.unionByName(cut)


def random_all(
    sites: DataFrame, seed: int = P.SPLIT_SEED, fraction: float = P.TRAIN_FRACTION, site: str = "site_id"
) -> DataFrame:
    """``site, split``: a random share of all sites in train, the rest in test."""
    ids = sites.select(site).distinct().withColumn("_h", site_hash(seed, site)).withColumn("_g", F.lit(0))
    return _exact(ids, ["_g"], site, fraction).drop("_g")


def random_per_aoi(
    sites: DataFrame,
    seed: int = P.SPLIT_SEED,
    fraction: float = P.TRAIN_FRACTION,
    site: str = "site_id",
    aoi: str = "aoi",
) -> DataFrame:
    """The same share within every area."""
    ids = sites.select(aoi, site).distinct().withColumn("_h", site_hash(seed, site))
    return _exact(ids, [aoi], site, fraction)


def apply(features: DataFrame, split: DataFrame, which: str, on: Sequence[str] = ("site_id",)) -> DataFrame:
    """Rows whose site is in the wanted part; the features are built only once."""
    return features.join(split.where(F.col("split") == which).select(*on).distinct(), list(on), "left_semi")


def site_union(*parts: DataFrame, site: str = "site_id") -> DataFrame:
    """Distinct ids over several tables."""
    out = parts[0].select(site)
    for p in parts[1:]:
        out = out.unionByName(p.select(site))
    return out.distinct()
