import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from changemap.session import shared_dir, work_path
from changemap.sources import io
from changemap.operators import ledger
from changemap.streaming import score as stream


def write_text(spark, lines):
    path = work_path(spark, "txt")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def geojson(coords, kind, **props):
    return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coords}}


SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]


def test_polygons_multipolygons_and_orientation(spark):
    feats = [
        geojson([SQUARE, HOLE], "Polygon", name="a"),
        geojson([[SQUARE[::-1]], [[[9, 9], [10, 9], [10, 10], [9, 9]]]], "MultiPolygon", name="b"),
    ]
    for path, coll in (
        (write_text(spark, [json.dumps(f) for f in feats]), False),
        (write_text(spark, [json.dumps({"type": "FeatureCollection", "features": feats})]), True),
    ):
        e = io.read_polygons(spark, path, ["name"], coll)
        assert e.count() == 8 + 7
        area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
        got = {(r.name, r.part, r.ring): r.a for r in e.groupBy("name", "part", "ring").agg(area.alias("a")).collect()}
        assert got == {("a", 0, 0): 16.0, ("a", 0, 1): -1.0, ("b", 0, 0): 16.0, ("b", 1, 0): 0.5}
        assert io.one_polygon(e, "name", "b").count() == 7


def test_point_labels_with_missing_fields(spark):
    f = geojson([34.5, 31.5], "Point", label_id="1_2", site_id="1", damage="2", ep=2, date=None, aoi="x")
    r = io.read_point_labels(spark, write_text(spark, [json.dumps(f)])).first()
    assert (r.label_id, r.site_id, r.damage, r.date, r.lon, r.lat) == ("1_2", 1, 2, None, 34.5, 31.5)


def test_partition_pruning_of_observations(spark):
    path = work_path(spark, "obs")
    df = spark.range(12).select(F.col("id").alias("site_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("aoi"), (F.col("id") % 3).alias("orbit"))
    io.write_obs(df, path)
    out = io.read_obs(spark, path, ["a"], 0)
    assert {r.site_id for r in out.collect()} == {0, 6}
    assert len({f.split("/orbit=")[0] for f in out.inputFiles()}) <= 2


def test_missing_feature_part_raises(spark):
    path = work_path(spark, "f")
    io.write_features(spark.createDataFrame([(1, "aoi", "train", 1.0, 2.0)], "site_id int, strategy string, split string, VV_pre_1x1_mean double, VV_pre_3x3_mean double"), path)
    assert io.read_features(spark, path, "train", extract_window="3x3").columns == ["site_id", "VV_pre_3x3_mean", "strategy", "split"]
    with pytest.raises(ValueError):
        io.read_features(spark, path, "test")


def test_runs_without_name_take_their_folder(spark):
    base = work_path(spark, "runs")
    io.write_json(spark.createDataFrame([(0.5,)], "f1 double"), f"{base}/run_a")
    io.write_json(spark.createDataFrame([("named", 0.7)], "run_name string, f1 double"), f"{base}/run_b")
    assert {r.run_name: r.f1 for r in io.read_runs(spark, base).collect()} == {"run_a": 0.5, "named": 0.7}


def test_preds_computed_once(spark):
    path, calls = work_path(spark, "p"), []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert io.read_preds(spark, path, compute).count() == 3 and io.read_preds(spark, path, compute).count() == 3
    assert calls == [1]
    with pytest.raises(Exception):
        io.read_preds(spark, work_path(spark, "none"))


def test_shared_dir_comes_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir") == shared_dir(spark)


def test_stream_takes_each_file_once_and_orbits_meet(spark):
    src, out, ck = (work_path(spark, n) for n in ("src", "out", "ck"))
    schema = "win int, tile int, orbit int, row int, col int, v double"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def go():
        s = stream.pixel_source(spark, src, schema)
        stream.score_stream(s, lambda b: b.withColumn("prob", F.col("v")), out, ck).awaitTermination()

    add([(1, 1, 87, 0, 0, 0.2), (1, 1, 87, 0, 1, None)])
    go()
    add([(1, 1, 94, 0, 0, 0.6)])
    go()
    go()  # nothing new
    got = {(r.row, r.col): r.pred for r in stream.scored_pixels(spark, out).collect()}
    assert got == {(0, 0): int(0.4 * 255), (0, 1): 0}


TILE_ROWS = "win int, tile int, orbit int, row int, col int, v double"


def _arrive(spark, src, rows):
    spark.createDataFrame(rows, TILE_ROWS).coalesce(1).write.mode("append").parquet(src)


def _score(spark, src, out, ck, **kw):
    s = stream.pixel_source(spark, src, TILE_ROWS, max_files=1)
    stream.score_stream(s, lambda b: b.withColumn("prob", F.col("v")), out, ck, **kw).awaitTermination()


def _keys(spark, out):
    return sorted((r.win, r.tile, r.orbit, r.row, r.col) for r in stream.scored_rows(spark, out).collect())


def test_a_batch_that_fails_between_writing_and_committing_loses_no_row(spark, monkeypatch):
    src, out, ck = (work_path(spark, n) for n in ("src", "out", "ck"))
    first = [(1, 1, 87, 0, c, 0.5) for c in range(5)]
    second = [(1, 1, 87, 1, c, 0.5) for c in range(4)] + [(1, 2, 94, 0, 0, 0.5)]
    _arrive(spark, src, first)
    _score(spark, src, out, ck)
    _arrive(spark, src, second)
    commit = ledger.commit

    def broken(*args):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(ledger, "commit", broken)
    with pytest.raises(Exception):
        _score(spark, src, out, ck)
    assert _keys(spark, out) == [r[:5] for r in first]  # written, not committed: not to be seen
    monkeypatch.setattr(ledger, "commit", commit)
    _score(spark, src, out, ck)
    assert _keys(spark, out) == sorted(r[:5] for r in first + second)


def test_a_batch_that_runs_again_after_its_commit_changes_nothing(spark):
    import os

    src, out, ck = (work_path(spark, n) for n in ("src", "out", "ck"))
    rows = [(1, t, 87, 0, c, 0.5) for t in range(3) for c in range(3)]
    _arrive(spark, src, rows)
    _score(spark, src, out, ck, done=lambda: ledger.finished(spark, f"{out}/none"))
    for name in ("0", ".0.crc"):  # the batch is written and recorded, Spark's own commit is lost
        os.remove(f"{ck}/commits/{name}")
    _score(spark, src, out, ck)
    assert _keys(spark, out) == sorted(r[:5] for r in rows)
    assert ledger.finished(spark, out).agg(F.sum("n")).first()[0] == len(rows)


def test_late_orbits_and_second_halves_are_scored_and_repeats_are_not(spark):
    src, out, ck = (work_path(spark, n) for n in ("src", "out", "ck"))
    rows = [(1, 1, orbit, r, -c, 0.5) for orbit in (87, 94) for r in (0, 1) for c in (0, 1)]
    _arrive(spark, src, rows[:3])  # a tile cut in the middle of a row
    _arrive(spark, src, rows[3:4])
    _score(spark, src, out, ck)
    _arrive(spark, src, rows[2:])  # the late orbit, and two pixels again
    _arrive(spark, src, [*rows, rows[0]])
    _score(spark, src, out, ck)
    assert _keys(spark, out) == sorted(r[:5] for r in rows)
    assert {(r.orbit, r.n) for r in ledger.finished(spark, out).groupBy("orbit").agg(F.sum("n").alias("n")).collect()} == {(87, 4), (94, 4)}


def test_state_is_one_key_a_cell_on_disk_and_not_rewritten(spark):
    src, out, ck = (work_path(spark, n) for n in ("src", "out", "ck"))
    rows = [(1, 1, 87, r, c, 0.5) for r in range(50) for c in range(8)]  # one tile that keeps growing
    for part in (rows[:200], [*rows[200:], rows[0]], rows):
        _arrive(spark, src, part)
        s = stream.pixel_source(spark, src, TILE_ROWS)
        query = stream.score_stream(s, lambda b: b.withColumn("prob", F.col("v")), out, ck, tasks=2)
        query.awaitTermination()
        state = query.lastProgress["stateOperators"][0]
        assert state["operatorName"] == "dedupe" and state["numShufflePartitions"] == 2
        assert any("rocksdb" in k for k in state["customMetrics"])
    assert state["numRowsUpdated"] == 0 and _keys(spark, out) == sorted(r[:5] for r in rows)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_tiles_of_another_run_are_skipped_by_orbit(spark):
    src, out, ck, other = (work_path(spark, n) for n in ("src", "out", "ck", "other"))
    rows = [(1, t, orbit, 0, 0, 0.5) for t in (1, 2) for orbit in (87, 94)]
    spark.createDataFrame(rows[:1], TILE_ROWS).write.parquet(f"{other}/batch=0")
    ledger.commit(spark.read.parquet(f"{other}/batch=0"), other, 0)
    _arrive(spark, src, rows)
    _score(spark, src, out, ck, done=lambda: ledger.finished(spark, other))
    assert _keys(spark, out) == sorted(r[:5] for r in rows[1:])
    with pytest.raises(FileNotFoundError):
        stream.scored_rows(spark, f"{out}/none")


def test_folder_names_keep_their_kind(spark, tmp_path):
    rows = spark.createDataFrame([("012301", 1, 0, 0, 5), ("120301", 1, 0, 1, 6)], "tile string, win int, row int, col int, pred int")
    io.write_pixel_preds(rows, f"{tmp_path}/p")
    got = {r.tile for r in io.read_preds(spark, f"{tmp_path}/p").collect()}
    assert got == {"012301", "120301"}


def test_only_an_absent_path_is_computed(spark, tmp_path):
    path = f"{tmp_path}/x"
    io.read_preds(spark, path, lambda: spark.range(3).toDF("pred"))
    assert io.read_preds(spark, path, lambda: spark.range(9).toDF("pred")).count() == 3
    with pytest.raises(Exception):
        io.read_preds(spark, f"{tmp_path}/none")


def test_files_of_predictions_follow_rows_and_not_tiles(spark, tmp_path):
    """Two thousand tiles in two windows: few files, one listing that is not a task a folder, and whole replacement of tiles."""
    path = f"{tmp_path}/p"
    rows = spark.range(4000).select(
        F.lpad((F.col("id") % 2000).cast("string"), 6, "0").alias("tile"), (F.floor(F.col("id") / 2000) + 1).cast("int").alias("win"),
        F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(7).alias("pred"))
    io.write_pixel_preds(rows.unionByName(rows.withColumn("col", F.lit(1))), path)
    io.write_pixel_preds(rows.where("win = 2 AND tile < '000003'").withColumn("pred", F.lit(1)), path)
    out = io.read_preds(spark, path)
    assert len(out.inputFiles()) < 100
    assert dict(out.dtypes) == {"tile": "string", "win": "int", "row": "int", "col": "int", "pred": "int"}
    got = {(r.pred, r.n) for r in out.groupBy("pred").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(7, 8000 - 6), (1, 3)}
    assert out.where("win = 2 AND tile = '000002'").count() == 1


def test_a_write_without_its_record_is_not_there(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/p"
    first = spark.createDataFrame([("1", 1, 0, 0, 5), (None, 1, 0, 0, 4)], "tile string, win int, row int, col int, pred int")
    io.write_pixel_preds(first, path)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(ledger, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        io.write_pixel_preds(first.withColumn("pred", F.lit(9)), path)
    assert {r.pred for r in io.read_preds(spark, path).collect()} == {4, 5}
    io.write_pixel_preds(first.withColumn("pred", F.lit(8)), path)
    io.write_pixel_preds(first.limit(0), path)
    assert [r.pred for r in io.read_preds(spark, path).collect()] == [8, 8]


def test_folders_of_any_name_and_with_spaces(spark, tmp_path):
    rows = spark.createDataFrame([("MIDDLE EAST", 7, "007", 1)], "aoi string, year int, tile string, v int")
    rows.write.partitionBy("aoi", "year", "tile").parquet(f"{tmp_path}/a")
    rows.write.partitionBy("aoi").parquet(f"{tmp_path}/b")
    for name in "ab":
        out = io.read_folders(spark, f"{tmp_path}/{name}")
        assert out.select("aoi", "year", "tile", "v").first() == ("MIDDLE EAST", 7, "007", 1)
        assert dict(out.dtypes)["year"] == "int"
    assert spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == "true"
