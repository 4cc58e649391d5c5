"""Tables that are read by box: rows along a Z-curve, and a manifest of what each file covers.

Rows near each other in the plane lie in the same files. The manifest, one small row a file, says
which box each file's rows fill; a reader takes the files whose boxes meet its own and never opens
the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_bounds"
ROWS_A_FILE = 2_000_000
MAX_FILES = 4_000  # of a table: with a file every so many rows, shuffle blocks would grow with the square of the rows
_BITS = 16


def _apart(v: Column) -> Column:
    """The bits of a 16-bit number, each followed by a zero."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def z_order(x: Column, y: Column, extent: Sequence[float]) -> Column:
    """Place on the Z-curve over ``extent`` (minx, miny, maxx, maxy); missing coordinates come first."""
    def cell(v, lo, hi):
        share = (v - lo) / (hi - lo) if hi > lo else F.lit(0.0)
        return F.least(F.floor(share * (1 << _BITS)), F.lit((1 << _BITS) - 1)).cast("long")

    return _apart(cell(x, extent[0], extent[2])).bitwiseOR(F.shiftleft(_apart(cell(y, extent[1], extent[3])), 1))


def write_boxed(df: DataFrame, path: str, bounds: Sequence[str], rows_a_file: int = ROWS_A_FILE) -> None:
    """Write ``df`` along the Z-curve of the middles of its rows' boxes, and the manifest.

    ``bounds`` names the columns minx, miny, maxx and maxy; for points the same two twice. Files hold
    about ``rows_a_file`` rows, more where the table would have over ``MAX_FILES`` of them.
    """
    minx, miny, maxx, maxy = (F.col(c) for c in bounds)
    x, y = (minx + maxx) / 2, (miny + maxy) / 2
    *extent, n = df.agg(F.min(x), F.min(y), F.max(x), F.max(y), F.count(F.lit(1))).first()
    z = z_order(x, y, [v if v is not None else 0.0 for v in extent])
    files = min(max(1, -(-n // rows_a_file)), MAX_FILES)
    df.withColumn("_z", z).repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z").write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    covers = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(minx).alias("minx"), F.min(miny).alias("miny"), F.max(maxx).alias("maxx"), F.max(maxy).alias("maxy"), F.count(F.lit(1)).alias("n"))
    covers.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")


def files_in_box(spark: SparkSession, path: str, box: Sequence[float]) -> list[str]:
    """The files with a row whose box may meet ``box``: as many paths as such files."""
    m = spark.read.parquet(f"{path}/{MANIFEST}")
    met = m.where((F.col("maxx") >= box[0]) & (F.col("maxy") >= box[1]) & (F.col("minx") <= box[2]) & (F.col("miny") <= box[3]))
    return [r["file"] for r in met.select("file").collect()]


def read_boxed(spark: SparkSession, path: str, box: Sequence[float], bounds: Sequence[str], inside: bool = False) -> DataFrame:
    """Rows whose box meets ``box``, or lies in it; only files that may hold such rows are read."""
    schema = spark.read.parquet(path).schema
    minx, miny, maxx, maxy = (F.col(c) for c in bounds)
    files = files_in_box(spark, path, box)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    if inside:
        return rows.where((minx >= box[0]) & (miny >= box[1]) & (maxx <= box[2]) & (maxy <= box[3]))
    return rows.where((maxx >= box[0]) & (maxy >= box[1]) & (minx <= box[2]) & (miny <= box[3]))
