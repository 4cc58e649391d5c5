"""Cells that follow density: a quadtree over a square grid, split where points are dense.

A cell that holds more than its share of the points is split in four, and so are its
quarters, ``DEPTH`` times at most. What cannot be split any further (many points at one
place) is dealt out over salts. So a join on leaves has about equal groups by itself,
whatever the session does about skew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemap.functions import geo as G
from changemap.session import materialise

DEPTH = 10
# a leaf holds at most one in this many of a task's average share of points
LEAVES_A_TASK = 4
KEYS = ("level", "gx", "gy", "salt")


@dataclass(frozen=True)
class Leaves:
    """``split[l]``: cells (gx, gy) of level ``l`` that are split; ``salts``: cells of the last
    level with the number of salts they are dealt to."""

    size: float
    split: tuple[DataFrame, ...]
    salts: DataFrame

    def size_at(self, level: Column) -> Column:
        return F.lit(self.size) / F.pow(F.lit(2.0), level)

    def place(self, points: DataFrame, x: Column, y: Column, key: str) -> DataFrame:
        """``points`` with the ``KEYS`` of the one leaf they lie in. Cells that are split are few, by
        the bound stated at ``density_leaves``, and broadcast; the points are not shuffled."""
        p = points.withColumn("level", F.lit(0))
        for level, nodes in enumerate(self.split):
            s = self.size / 2 ** level
            n = nodes.select(F.col("gx").alias("_nx"), F.col("gy").alias("_ny"))
            p = p.join(F.broadcast(n), (G.cell(x, s) == F.col("_nx")) & (G.cell(y, s) == F.col("_ny")), "left")
            p = p.withColumn("level", F.when(F.col("_nx").isNotNull(), level + 1).otherwise(F.col("level"))).drop("_nx", "_ny")
        s = self.size_at(F.col("level"))
        p = p.withColumns({"gx": F.floor(x / s).cast("int"), "gy": F.floor(y / s).cast("int")})
        salt = F.coalesce(F.pmod(F.xxhash64(key), F.col("salts")), F.lit(0)).cast("int")
        return p.join(F.broadcast(self.salts), ["level", "gx", "gy"], "left").withColumn("salt", salt).drop("salts")

    def refine(self, rows: DataFrame, meets: Callable[[float], Column]) -> DataFrame:
        """``rows`` on the cells (gx, gy) of the base grid moved to the leaves, with all ``KEYS``.

        A row of a split cell goes on to those quarters of it for which ``meets``, given the
        size of the quarters, holds."""
        now = rows.withColumn("level", F.lit(0))
        at = F.struct("level", "gx", "gy")
        for level, nodes in enumerate(self.split):
            n = nodes.select(F.col("gx").alias("_nx"), F.col("gy").alias("_ny"))
            now = now.join(F.broadcast(n), (F.col("level") == level) & (F.col("gx") == F.col("_nx")) & (F.col("gy") == F.col("_ny")), "left")
            quarters = F.array(*[
                F.struct(F.lit(level + 1).alias("level"), (F.col("gx") * 2 + i).alias("gx"), (F.col("gy") * 2 + j).alias("gy"))
                for i in (0, 1) for j in (0, 1)])
            cells = F.explode(F.when(F.col("_nx").isNotNull(), quarters).otherwise(F.array(at))).alias("_at")
            now = now.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("gx", "gy")], cells).select("*", "_at.*").drop("_at")
            now = now.where((F.col("level") <= level) | meets(self.size / 2 ** (level + 1)))
        return now

    def salted(self, rows: DataFrame) -> DataFrame:
        """``rows`` on leaves, once for every salt of their leaf."""
        out = rows.join(F.broadcast(self.salts), ["level", "gx", "gy"], "left")
        last = F.coalesce(F.col("salts") - 1, F.lit(0)).cast("int")
        return out.withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("salts")


def density_leaves(points: DataFrame, size: float, x: str = "x", y: str = "y", share: float = 0.1,
                   tasks: int | None = None, depth: int = DEPTH) -> Leaves:
    """Leaves for ``points`` over base cells of ``size``, from the counts of a ``share`` of them, for
    joins of ``tasks`` shuffle partitions (the session's number by default).

    One pass over the points, combined before its shuffle. A cell is split when it holds more than
    1 / (``LEAVES_A_TASK`` * tasks) of the sample, so there are at most that many split cells
    a level: 800 for 200 partitions, at any data size. Points without coordinates count nowhere;
    without points nothing is split. The sample only shapes the cells: results do not depend on it.
    """
    spark = points.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    px, py = F.col(x), F.col(y)
    some = points.select(px, py).where(px.isNotNull() & py.isNotNull())
    some = some.sample(share, seed=7) if share < 1 else some
    finest = size / 2 ** depth
    # as wide integers: the finest cells of large coordinates
    cells = some.select(F.floor(px / finest).alias("fx"), F.floor(py / finest).alias("fy"))
    counts = materialise(cells.groupBy("fx", "fy").agg(F.count("*").alias("n")), "density")
    total = counts.agg(F.sum("n")).first()[0] or 0
    target = max(1, total // (LEAVES_A_TASK * tasks))
    up = counts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    dense = up.groupBy("level", F.expr(f"CAST(shiftright(fx, {depth} - level) AS INT) AS gx"),
                       F.expr(f"CAST(shiftright(fy, {depth} - level) AS INT) AS gy")).agg(F.sum("n").alias("n"))
    hot = dense.where(F.col("n") > target).collect()
    cell = "gx int, gy int"
    levels = [[(r["gx"], r["gy"]) for r in hot if r["level"] == level] for level in range(depth)]
    split = tuple(spark.createDataFrame(rows, cell) for rows in levels if rows)
    salts = [(depth, r["gx"], r["gy"], -(-r["n"] // target)) for r in hot if r["level"] == depth]
    return Leaves(size, split, spark.createDataFrame(salts, f"level int, {cell}, salts long"))
