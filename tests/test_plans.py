"""Plans keep to built-in operators and equality joins, and filters reach the files."""

import pytest
from pyspark.sql import functions as F

from changemap.plans import catalog, q_io, q_model, run
from changemap.session import work_path
from changemap.sources import io

EAGER = set(q_model.QUERIES) | set(q_io.QUERIES)
LAZY = sorted(set(catalog.queries()) - EAGER)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cross_join(spark, sf, name):
    text = plan(catalog.queries()[name](spark, sf))
    for bad in ("PythonUDF", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert bad not in text, bad


def test_nested_box_filter_is_pushed(spark, sf):
    path = work_path(spark, "boxes")
    one = F.lit(1.0)
    box = F.struct(one.alias("minX"), one.alias("minY"), one.alias("maxX"), one.alias("maxY"))
    spark.range(3).select("id", box.alias("bbox")).write.parquet(path)
    text = plan(io.scan_bbox(spark, path, (0, 0, 2, 2)).select("id"))
    assert "GreaterThanOrEqual(bbox.minX" in text and "LessThanOrEqual(bbox.maxY" in text


def test_partition_and_area_filters_are_pushed(spark, sf):
    path = work_path(spark, "b")
    spark.range(9).select("id", (F.col("id") * 20.0).alias("area_m2"), (F.col("id") % 3).alias("adm2_id")).write.partitionBy(
        "adm2_id"
    ).parquet(path)
    df = io.read_buildings(spark, path, 50.0, 1)
    text = plan(df)
    assert "GreaterThanOrEqual(area_m2,50.0)" in text
    assert "PartitionFilters: [isnotnull(adm2_id" in text
    assert {r.id for r in df.collect()} == {4, 7}


def test_feature_scan_reads_only_its_columns(spark, sf):
    text = plan(catalog.queries()["features_build"](spark, sf))
    assert "l_tax" not in text and "l_returnflag" not in text


def test_views_grow_at_constant_density(spark):
    """Ten times the rows: about ten times the cells, places and overlapping pairs."""
    from changemap.plans import fixtures as X
    from changemap.plans import q_geo, q_labels

    sizes = {}
    for sf in ("sf0.01", "sf0.1"):
        path = f"/root/testdata/{sf}"
        sizes[sf] = (
            X.pixels(spark, path).select("row", "col").distinct().count(),
            q_labels.labels_last(spark, path).count(),
            q_geo.geo_disk_overlap(spark, path).count(),
            q_geo.geo_within_distance(spark, path).count(),
        )
    assert all(6 < b / a < 15 for a, b in zip(sizes["sf0.01"], sizes["sf0.1"])), sizes


@pytest.mark.parametrize("name", [
    "geo_area_centroid", "geo_disk_overlap", "geo_intersects", "geo_polygon_overlap", "geo_within_distance", "io_boundary",
    "building_attach_labels", "building_attach_labels_by_area", "building_scores_from_points", "pixel_sample_window_max",
])
def test_exploded_rows_are_not_broadcast(spark, sf, name):
    """Spark's size estimates do not see explodes; only single rows and nations may go through the driver."""
    text = plan(catalog.queries()[name](spark, sf))
    # the nations; the one box of the one boundary, in each reading of its edges
    bounded = {"building_attach_labels": 1, "building_attach_labels_by_area": 1, "io_boundary": 3}
    assert text.count("BroadcastExchange") <= bounded.get(name, 0), text


def test_pixel_partitions_are_not_merged_before_they_grow(spark, sf):
    """Cells become 19 rows each behind their shuffle; a fixed number of ranges would grow with the table."""
    from changemap.plans import fixtures as X

    assert "REPARTITION_BY_NUM" in plan(X.pixels(spark, sf))
    df = q_io.io_pixels_in_box(spark, "/root/testdata/sf0.01")
    assert len(df.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pixel_partitions_grow_with_the_table(spark, sf, monkeypatch):
    from changemap.plans import fixtures as X

    monkeypatch.setattr(X, "SHIPMENTS_A_TASK", 500)
    assert "hashpartitioning(row#" in plan(X.pixels(spark, sf)) and ", 12), REPARTITION_BY_NUM" in plan(X.pixels(spark, sf))


@pytest.mark.parametrize("strategy", ["random_all", "random_per_aoi"])
def test_random_split_is_drawn_once(spark, strategy):
    """Passes over the parts read the sites' split; none ranks them again. A null area is in no part of its own."""
    f = spark.range(400).select((F.col("id") % 40).alias("site_id"), F.when(F.col("id") % 40 != 7, F.col("id") % 4).alias("aoi"), "id")
    parts = run.split_features(f, strategy)
    rows = [{(r.site_id, r.id) for r in p.collect()} for p in parts]
    assert not rows[0] & rows[1] and not {s for s, _ in rows[0]} & {s for s, _ in rows[1]}
    assert len(rows[0] | rows[1]) == (400 if strategy == "random_all" else 390)
    for p in parts:
        assert "Window" not in plan(p)
