"""Reading by box opens few files and finds every row."""

import random

import pytest
from pyspark.sql import functions as F

from changemap.session import work_path
from changemap.sources import boxes

B = ("minx", "miny", "maxx", "maxy")


@pytest.fixture(scope="module")
def table(spark):
    path = work_path(spark, "boxed")
    x, y = (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**6)) / 1000 for k in (1, 2))
    df = spark.range(40_000).select("id", x.alias("minx"), y.alias("miny"), (x + 1.5).alias("maxx"), (y + 0.5).alias("maxy"))
    boxes.write_boxed(df, path, B, 100)
    return df, path


def test_a_box_of_one_percent_reads_under_five_percent_of_the_files(spark, table):
    _, path = table
    files = spark.read.parquet(f"{path}/{boxes.MANIFEST}").count()
    assert files == 400
    for x, y in ((0, 0), (450, 450), (731, 208), (900, 900), (499, 500)):
        assert len(boxes.files_in_box(spark, path, (x, y, x + 100, y + 100))) < 0.05 * files
    plan = boxes.read_boxed(spark, path, (450, 450, 460, 460), B)
    assert len(plan.inputFiles()) <= 4


def test_every_row_in_a_box_is_found(spark, table):
    df, path = table
    r = random.Random(2)
    for _ in range(6):
        x, y, w, h = r.uniform(-50, 1000), r.uniform(-50, 1000), r.uniform(0, 300), r.uniform(0, 300)
        box = (x, y, x + w, y + h)
        met = df.where((F.col("maxx") >= x) & (F.col("maxy") >= y) & (F.col("minx") <= x + w) & (F.col("miny") <= y + h))
        assert {i.id for i in boxes.read_boxed(spark, path, box, B).select("id").collect()} == {i.id for i in met.select("id").collect()}
        within = met.where((F.col("minx") >= x) & (F.col("miny") >= y) & (F.col("maxx") <= x + w) & (F.col("maxy") <= y + h))
        assert boxes.read_boxed(spark, path, box, B, inside=True).count() == within.count()
    assert boxes.read_boxed(spark, path, (5000, 5000, 6000, 6000), B).count() == 0


def test_points_equal_places_and_empty_tables(spark):
    p = ("x", "y", "x", "y")
    for rows, n in (([(1, 2.0, 2.0)] * 5 + [(2, None, 1.0)], 5), ([], 0)):
        path = work_path(spark, "points")
        boxes.write_boxed(spark.createDataFrame(rows, "k int, x double, y double"), path, p, 2)
        assert boxes.read_boxed(spark, path, (0, 0, 3, 3), p).count() == n
        assert spark.read.parquet(path).count() == len(rows)


def test_the_curve_keeps_neighbours_together(spark):
    cells = spark.range(16).select((F.col("id") % 4).cast("double").alias("x"), F.floor(F.col("id") / 4).cast("double").alias("y"))
    order = [(r.x, r.y) for r in cells.orderBy(boxes.z_order(F.col("x"), F.col("y"), (0, 0, 4, 4))).collect()]
    assert order[:8] == [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (3, 0), (2, 1), (3, 1)]


def test_files_of_large_tables_hold_more_rows(spark, table, monkeypatch):
    """The number of files is bounded, and every row is still there."""
    monkeypatch.setattr(boxes, "MAX_FILES", 40)
    df, _ = table
    path = work_path(spark, "boxed")
    boxes.write_boxed(df, path, B, 100)
    assert spark.read.parquet(f"{path}/{boxes.MANIFEST}").agg(F.count("*"), F.sum("n")).first() == (40, 40_000)
    box = (450, 450, 550, 550)
    assert len(boxes.files_in_box(spark, path, box)) < 10
    met = df.where((F.col("maxx") >= 450) & (F.col("maxy") >= 450) & (F.col("minx") <= 550) & (F.col("miny") <= 550))
    assert boxes.read_boxed(spark, path, box, B).exceptAll(met).count() == 0 == met.exceptAll(boxes.read_boxed(spark, path, box, B)).count()
