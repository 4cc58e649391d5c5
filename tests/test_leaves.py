"""Cells that follow density: equal results, and equal tasks without any help from the session."""

import random

import pytest
from pyspark.sql import functions as F

from changemap.operators import geo
from changemap.operators.leaves import KEYS, density_leaves
from tests.test_geo import POLY, edge_frame, inside

SQUARES = {"a": POLY, "b": [(60.0, 60.0, 75.0, 60.0), (75.0, 60.0, 75.0, 75.0), (75.0, 75.0, 60.0, 75.0), (60.0, 75.0, 60.0, 60.0)]}


def crowded(spark, n=4000, same=0):
    """Half of all points in one cell of 10, some with negative coordinates, on borders or at one place."""
    r = random.Random(5)
    rows = [(r.uniform(60, 64), r.uniform(20, 24)) if i % 2 else (r.uniform(-30, 130), float(r.randint(-30, 130))) for i in range(n)]
    rows += [(70.0, 61.0)] * same
    return spark.createDataFrame([(i, *p) for i, p in enumerate(rows)] + [(-1, None, 1.0)], "id long, x double, y double")


@pytest.mark.parametrize("size,share", [(10.0, 0.2), (500.0, 1.0)])
def test_equal_to_brute_force(spark, size, share):
    pts, edges = crowded(spark, same=1000), edge_frame(spark, SQUARES)
    leaves = density_leaves(pts, size, share=share, depth=7)
    assert len(leaves.split) > 2
    got = {(r["id"], r["poly"]) for r in geo.points_in_polygons(pts, edges, "id", "poly", size, leaves=leaves).collect()}
    want = {(r["id"], k) for r in pts.collect() if r["x"] is not None for k, e in SQUARES.items() if inside(r["x"], r["y"], e)}
    assert got == want


def test_overlaps_and_distances_equal_those_of_the_even_grid(spark):
    pts, edges = crowded(spark, same=300), edge_frame(spark, SQUARES)
    leaves = density_leaves(pts, 40.0, share=1.0, depth=6)
    for f, digits in ((geo.disk_overlap, 6), (geo.within_distance, None)):
        even, dense = ([tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in
                        f(pts, edges, "id", "poly", 5.0, 16.0, leaves=x).collect()] for x in (None, leaves))
        assert len(dense) > 100 and sorted(dense) == sorted(even)


@pytest.mark.parametrize("same", [0, 4000])
def test_no_task_gets_three_shares(spark, same):
    """One cell with half of all points, or one place with half of them; no adaptive execution."""
    tasks = 16
    pts = crowded(spark, 8000, same).where("x IS NOT NULL")
    leaves = density_leaves(pts, 100.0, share=0.5, tasks=tasks, depth=6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = leaves.place(pts, F.col("x"), F.col("y"), "id")
        sizes = [r["count"] for r in placed.repartition(tasks, *KEYS).groupBy(F.spark_partition_id()).count().collect()]
        even = pts.repartition(tasks, F.floor(F.col("x") / 100), F.floor(F.col("y") / 100)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    mean = sum(sizes) / tasks
    assert sum(sizes) == pts.count() and max(sizes) <= 3 * mean < max(r["count"] for r in even)


def test_split_cells_are_bounded_and_points_are_not_shuffled(spark):
    pts = crowded(spark, 8000)
    leaves = density_leaves(pts, 100.0, share=1.0, tasks=4, depth=5)
    assert all(s.count() <= 16 for s in leaves.split)
    plan = leaves.place(pts, F.col("x"), F.col("y"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_no_points(spark):
    pts, edges = crowded(spark, 10).where("id < 0"), edge_frame(spark, SQUARES)
    leaves = density_leaves(pts, 10.0)
    assert leaves.split == () and geo.points_in_polygons(pts, edges, "id", "poly", 10.0, leaves=leaves).collect() == []
