"""Readers and writers.

Schemas are stated, never inferred.  Tables that grow are partitioned by the
columns jobs select on, so a read touches only its own folders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changemap import params as P
from changemap.functions.scalars import area_at_least
from changemap.operators import ledger
from changemap.operators.labels import combine, default_columns
from changemap.session import settings

LABEL_SCHEMA = (
    "label_id string, site_id bigint, aoi string, damage int, ep int, date date, lon double, lat double,"
    " date_first date, date_first_severe date, date_first_destroyed date, damage_max int"
)
RUN_SCHEMA = (
    "run_name string, f1 double, precision double, recall double, roc_auc double, accuracy double, model string,"
    " numberOfTrees int, split_strategy string, class_weight string, run_suffix string"
)
FEATURE_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "geometry",
            # the nesting depth depends on the geometry type, so keep the text
            T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]),
        ),
    ]
)
# what Spark says of a path with nothing below it
ABSENT = ("PATH_NOT_FOUND",)
RINGS = "array<array<array<double>>>"


# --- labels and polygons ------------------------------------------------------------


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).parquet(path)


def read_features_geojson(spark: SparkSession, path: str, collection: bool = False) -> DataFrame:
    """GeoJSON features: one per line (splittable), or one collection per file."""
    if not collection:
        return spark.read.schema(FEATURE_SCHEMA).json(path)
    doc = T.StructType([T.StructField("features", T.ArrayType(FEATURE_SCHEMA))])
    return spark.read.option("multiLine", True).schema(doc).json(path).select(F.inline("features"))


def read_point_labels(spark: SparkSession, path: str, collection: bool = False) -> DataFrame:
    """Long labels from GeoJSON points, typed as ``LABEL_SCHEMA``."""
    raw = read_features_geojson(spark, path, collection)
    xy = F.from_json("geometry.coordinates", "array<double>")
    place = {"lon": F.try_element_at(xy, F.lit(1)), "lat": F.try_element_at(xy, F.lit(2))}
    fields = T.StructType.fromDDL(LABEL_SCHEMA).fields
    return raw.select(
        *[place.get(f.name, F.col("properties")[f.name]).try_cast(f.dataType).alias(f.name) for f in fields]
    )


def _ring_edges(ring: Column) -> Column:
    pts = F.sequence(F.lit(1), F.size(ring) - 1)
    return F.transform(
        pts,
        lambda i: F.struct(
            F.element_at(F.element_at(ring, i), 1).alias("x1"), F.element_at(F.element_at(ring, i), 2).alias("y1"),
            F.element_at(F.element_at(ring, i + 1), 1).alias("x2"), F.element_at(F.element_at(ring, i + 1), 2).alias("y2"),
        ),
    )


def polygon_edges(features: DataFrame, keep: Sequence[Column]) -> DataFrame:
    """Edges of (multi)polygons: ``keep..., part, ring, x1, y1, x2, y2``.

    Outer rings come out counter-clockwise and holes clockwise whatever the file says.
    """
    text = F.col("geometry.coordinates")
    parts = F.when(F.col("geometry.type") == "MultiPolygon", F.from_json(text, f"array<{RINGS}>")).otherwise(
        F.array(F.from_json(text, RINGS))
    )
    rings = (
        features.select(*keep, F.posexplode(parts).alias("part", "_rings"))
        .select("*", F.posexplode("_rings").alias("ring", "_ring"))
        .drop("_rings")
        .withColumn("_edges", _ring_edges(F.col("_ring")))
    )
    turn = F.aggregate(
        "_edges", F.lit(0.0), lambda a, e: a + (e["x2"] - e["x1"]) * (e["y2"] + e["y1"])
    )  # negative for counter-clockwise
    flip = (F.col("ring") == 0) == (turn > 0)
    rings = rings.withColumn("_flip", flip)
    names = [c for c in rings.columns if c not in ("_ring", "_edges", "_flip")]
    e = rings.select(*names, "_flip", F.inline("_edges"))
    swap = {a: F.when(F.col("_flip"), F.col(b)).otherwise(F.col(a)) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))}
    return e.withColumns(swap).drop("_flip")


def read_polygons(spark: SparkSession, path: str, props: Sequence[str], collection: bool = False) -> DataFrame:
    """Polygon file to an edge table with the chosen properties."""
    f = read_features_geojson(spark, path, collection)
    return polygon_edges(f, [F.col("properties")[p].alias(p) for p in props])


def one_polygon(edges: DataFrame, key: str, value) -> DataFrame:
    """The edges of one polygon, by key."""
    return edges.where(F.col(key) == value)


def read_assessments(spark: SparkSession, path: str, fmt: str = "parquet", n_epochs: int = P.N_EPOCHS) -> DataFrame:
    """Wide multi-epoch assessments under the published column names."""
    dates, classes = default_columns(n_epochs)
    cols = ["site_id bigint", "Governorate string", "Municipality string", "lon double", "lat double"]
    cols += [f"{d} date, {c} int" for d, c in zip(dates, classes)]
    reader = spark.read.schema(", ".join(cols))
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_admin(
    admin: DataFrame,
    level: int,
    parent_col: str | None = None,
    parent: str | None = None,
    name_col: str = "adm2_name",
    spelling: Mapping[str, str] | None = None,
    order: str = "row_no",
) -> DataFrame:
    """Admin units of one parent with fixed spelling and ``admin_id`` = level_row.

    ``order`` is the unit's row number in its source; ids count rows of the whole
    source from 0.
    """
    out = admin.withColumn("admin_id", F.concat(F.lit(f"{level}_"), F.col(order).cast("string")))
    if parent is not None:
        out = out.where(F.col(parent_col).contains(parent))
    return out.replace(dict(spelling), subset=[name_col]) if spelling else out


def read_boundary(edges: DataFrame, name: str = "boundary") -> DataFrame:
    """All units seen as one multi-part polygon under one key."""
    return edges.withColumn("boundary", F.lit(name))


# --- buildings ------------------------------------------------------------------------


def read_buildings(
    spark: SparkSession, path: str, min_area: float | None = P.MIN_AREA_M2, adm=None, adm_col: str = "adm2_id", schema=None
) -> DataFrame:
    """Buildings of at least ``min_area``, of one admin unit if given.  Both filters
    reach the files: the unit as a partition, the area as a pushed predicate."""
    reader = spark.read.schema(schema) if schema else spark.read
    out = reader.parquet(path)
    if adm is not None:
        out = out.where(F.col(adm_col) == adm)
    return out.where(area_at_least("area_m2", min_area)) if min_area is not None else out


def scan_bbox(spark: SparkSession, path: str, box: Sequence[float], names=("minX", "minY", "maxX", "maxY")) -> DataFrame:
    """Rows whose whole nested ``bbox`` lies inside ``(minx, miny, maxx, maxy)``."""
    lo_x, lo_y, hi_x, hi_y = (F.col(f"bbox.{n}") for n in names)
    return spark.read.parquet(path).where(
        (lo_x >= box[0]) & (lo_y >= box[1]) & (hi_x <= box[2]) & (hi_y <= box[3])
    )


# --- observations, features, pixels, predictions ----------------------------------------


def _clustered(df: DataFrame, *cols: str) -> DataFrame:
    """Rows of one folder brought together before a partitioned write, so that tasks do
    not each open every folder; adaptive execution splits folders that are too large
    for one task and merges small ones."""
    return df.hint("rebalance", *cols)


def _replace(df: DataFrame, path: str, *cols: str) -> None:
    """Writes folders by ``cols``. All of an earlier table goes, whatever the session says."""
    writer = _clustered(df, *cols).write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(*cols).parquet(path)


# kinds of the columns that name folders; inference would make numbers of quadkeys
FOLDERS = {
    "aoi": "string", "orbit": "int", "strategy": "string", "split": "string", "batch": "int", "win": "int", "tile": "string", "adm2_id": "string",
}


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """A table with the kinds of ``FOLDERS`` for the columns that its folders name. The
    other columns have the kinds that the files state.

    Folders are listed once, in a few tasks: by default Spark deals out a task a folder.
    """
    few = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism)}
    with settings(spark, few | {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}):
        found = spark.read.parquet(path)
    row = found.select("_metadata.file_path").first()
    inside = set(spark.read.parquet(unquote(row[0]) if row else found.inputFiles()[0]).columns)
    named = [c for c in found.columns if c not in inside]  # strings, for now
    if set(named) <= set(FOLDERS):
        return found.withColumns({c: F.col(c).cast(FOLDERS[c]) for c in named if FOLDERS[c] != "string"})
    with settings(spark, few):
        kinds = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema.fields}
        kinds |= {c: FOLDERS[c] for c in named if c in FOLDERS}
        return spark.read.schema(", ".join(f"`{c}` {k}" for c, k in kinds.items())).parquet(path)


def write_obs(obs: DataFrame, path: str) -> None:
    _replace(obs, path, "aoi", "orbit")


def read_obs(spark: SparkSession, path: str, aoi=None, orbit=None) -> DataFrame:
    """Observation cache; area and orbit select folders."""
    out = read_folders(spark, path)
    for c, v in (("aoi", aoi), ("orbit", orbit)):
        if v is not None:
            out = out.where(F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == v)
    return out


def csv_to_parquet(spark: SparkSession, src: str, dst: str, schema) -> None:
    """Exported CSV with a header row to parquet."""
    spark.read.schema(schema).option("header", True).csv(src).write.mode("overwrite").parquet(dst)


def write_features(features: DataFrame, path: str) -> None:
    _replace(features, path, "strategy", "split")


def read_features(spark: SparkSession, path: str, split: str, strategy: str = "aoi", extract_window: str | None = None) -> DataFrame:
    """One part of a feature set.  Missing parts raise, as an empty training set
    would only fail later."""
    from pyspark.errors import AnalysisException

    try:  # a part is a folder, so that no job has to look for its rows
        spark.read.parquet(f"{path}/strategy={strategy}/split={split}")
    except AnalysisException as e:
        if e.getCondition() not in ABSENT:
            raise
        raise ValueError(f"no features for strategy {strategy!r}, split {split!r}") from e
    out = read_folders(spark, path).where((F.col("strategy") == strategy) & (F.col("split") == split))
    if extract_window:
        out = out.select(*[c for c in out.columns if "_pre_" not in c and "_post_" not in c or f"_{extract_window}_" in c])
    return out


def read_orbits(spark: SparkSession, path: str) -> DataFrame:
    """``aoi, valid_orbits`` with the text list parsed."""
    from changemap.operators.scenes import parse_orbits

    return parse_orbits(spark.read.schema("aoi string, valid_orbits string").option("header", True).csv(path))


def write_orbits(orbits: DataFrame, path: str) -> None:
    from changemap.operators.scenes import format_orbits

    format_orbits(orbits).write.mode("overwrite").option("header", True).csv(path)


def read_pixels(spark: SparkSession, path: str, box: Sequence[float] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Pixel rows, optionally those whose centre lies in a box (pushed to the files)."""
    out = read_folders(spark, path)
    return out.where(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3])) if box else out


def write_pixel_features(pixels: DataFrame, path: str) -> None:
    """Pixel features by window, orbit and tile."""
    _replace(pixels, path, "win", "orbit", "tile")


# the record of written tiles beside predictions, and how many replaced tiles are sent to every task
HELD, FEW_TILES = "_held", 50_000


def write_pixel_preds(preds: DataFrame, path: str) -> None:
    """Byte predictions; only the (window, tile) pairs present in ``preds`` are replaced. One writer at a time.

    A write is a batch: a folder with one folder a window, so that files grow with the rows and not
    with the tiles, and behind it a record of its tiles. Without its record a batch is not there.
    """
    held = ledger.finished(preds.sparkSession, path, HELD)
    last = held.agg(F.max("batch")).first()[0] if held is not None else None
    batch = 0 if last is None else last + 1
    out = f"{path}/batch={batch}"
    rows = _clustered(preds, "win").sortWithinPartitions("win", "tile", "row", "col")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("win").parquet(out)
    ledger.commit(preds.sparkSession.read.schema(preds.schema).parquet(out), path, batch, ("win", "tile"), HELD)


def _newest(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of recorded batches whose tile no later batch holds."""
    batches = [r[0] for r in held.select("batch").distinct().collect()]  # as many as there were writes
    last = F.max("batch").over(Window.partitionBy("win", "tile"))
    old = held.select("batch", "win", "tile").withColumn("_last", last).where(F.col("batch") < F.col("_last")).drop("_last")
    rows, n = rows.where(F.col("batch").isin(batches)), old.count()
    if n:
        old = F.broadcast(old) if n <= FEW_TILES else old.hint("merge")
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("batch", "win", "tile")]
        rows = rows.alias("x").join(old.alias("y"), same, "left_anti")
    return rows.drop("batch")


def read_preds(spark: SparkSession, path: str, compute=None) -> DataFrame:
    """Saved predictions, or the result of ``compute()`` saved first when absent. Of a tile written
    more than once by ``write_pixel_preds`` the last rows count."""
    from pyspark.errors import AnalysisException

    try:
        rows = read_folders(spark, path)
    except AnalysisException as e:
        if compute is None or e.getCondition() not in ABSENT:
            raise
        compute().write.mode("overwrite").parquet(path)
        rows = read_folders(spark, path)
    held = ledger.finished(spark, path, HELD)
    return rows if held is None else _newest(rows, held)


def write_labels_by_aoi(labels: DataFrame, path: str) -> None:
    """Two folders per area: first severe epoch per location, and first epoch of all
    classes."""
    for name, how in (("severe", "first_severe"), ("full", "first")):
        _replace(combine(labels, how), f"{path}/{name}", "aoi")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of all runs below ``path``; a run without a name takes its folder's."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return (
        spark.read.schema(RUN_SCHEMA).option("recursiveFileLookup", True).json(path)
        .withColumn("run_name", F.coalesce("run_name", folder))
        .where(F.col("f1").isNotNull())
    )
