"""Connected components as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemap.session import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, root)`` for every node of ``edges``; root is the smallest id reachable.

    Alternates two steps until nothing changes: every node hands its larger neighbours
    its smallest neighbour, then its smaller ones. A chain of n links needs about log n
    rounds, and a round never holds more links than the first. Both steps are a
    minimum with map-side combine and an equality join, which adaptive execution
    splits at a hot node. Each round is written to the shared folder.
    Links with a null end and links to itself are ignored; no links, no rows.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = materialise(links.select(u, v).distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")).union(
                links.select("v", "v").distinct()
            ) if state[0] else links.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = state
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).where("e.u <> e.v").select("e.u", "e.v").distinct()
        links = materialise(small, "links")
