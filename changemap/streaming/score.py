"""Incremental scoring of feature tiles as they arrive.

Files are taken once each, as the source's checkpoint remembers. What has been scored is state,
keyed by window, tile, orbit and cell: what has come. It lies in RocksDB on the executors' disks, so that
memory does not grow with it. So an orbit that arrives later is scored, the rest of a tile that is cut over two batches is scored, and what is sent again is
not. The state moves on with the checkpoint only: a batch that runs again sees
what it saw the first time.

A micro-batch writes its rows to a folder named by the batch, then a commit record: one
small row for each (window, tile, orbit) it wrote. Readers take committed batches only. A batch that
fails between the two is run again by Spark and replaces its folder, so no row is lost and none
counts twice. Orbits of one tile meet when the scored rows are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changemap.operators import ledger
from changemap.operators.predict import aggregate_orbits, to_byte_pixels
from changemap.session import settings

_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}.changelogCheckpointing.enabled": "true",  # a batch writes what it adds
    f"{_ROCKS}.boundedMemoryUsage": "true",  # one bound for all partitions of an executor
    f"{_ROCKS}.trackTotalNumberOfRows": "false",  # a read for every write otherwise
}
LEAST_TASKS = 16  # that hold state


def pixel_source(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Stream of rows from parquet files appearing in ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def first_arrivals(source: DataFrame, keys: Sequence[str] = ("win", "tile"), orbit: str = "orbit", cell: Sequence[str] = ("row", "col")) -> DataFrame:
    """The rows of ``source`` whose cell has not come before in that orbit of their window and tile.

    State per window, tile, orbit and cell: its key. A batch adds its new cells and rewrites none of the
    others, whatever the number of cells of a tile. Of equal cells the first to arrive counts.
    """
    return source.dropDuplicates([*keys, orbit, *cell])


def score_stream(
    source: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    keys: Sequence[str] = ("win", "tile", "orbit", "row", "col"),
    done: Callable[[], DataFrame | None] | None = None,
    interval: str | None = None,
    tasks: int | None = None,
):
    """Start scoring.  ``score`` adds ``prob`` to a batch; ``done`` gives what another run has finished
    (any of the columns window, tile, orbit) to skip. This run's own output is skipped by
    its state.  Without ``interval`` it takes what has arrived and stops; with it, it keeps
    polling.  The state is dealt over ``tasks``, fixed when a checkpoint is made: a batch opens and commits a
    store in each of them, however few its rows. By default two a core, at most the session's shuffle partitions."""
    win, tile, orbit, *cell = keys
    spark = source.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = tasks or min(most, max(LEAST_TASKS, 2 * spark.sparkContext.defaultParallelism))

    def write(batch: DataFrame, batch_id: int) -> None:
        finished = done() if done else None
        if finished is not None:
            on = [c for c in (win, tile, orbit) if c in finished.columns]
            batch = batch.join(finished.select(*on).distinct(), on, "left_anti")
        folder = f"{out}/batch={batch_id}"
        score(batch).select(*keys, "prob").write.mode("overwrite").parquet(folder)
        ledger.commit(batch.sparkSession.read.parquet(folder), out, batch_id, (win, tile, orbit))

    writer = first_arrivals(source, (win, tile), orbit, cell).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    with settings(spark, STATE | {"spark.sql.shuffle.partitions": str(tasks)}):  # a query keeps the settings it starts with
        return writer.start()


def scored_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all committed batches."""
    return ledger.committed_rows(spark, out).drop("batch")


def scored_pixels(
    spark: SparkSession, out: str, keys: Sequence[str] = ("win", "tile", "row", "col"), method: str = "mean"
) -> DataFrame:
    """Byte predictions of everything scored so far."""
    return to_byte_pixels(aggregate_orbits(scored_rows(spark, out), keys, method)).select(*keys, F.col("pred"))
