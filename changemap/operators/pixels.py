"""Pixel tables: boxes, focal mean, mosaics, sampling at points.

A pixel row is ``row, col`` on a global grid plus values; neighbourhoods use the
global indices, so tile borders need no halo.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from changemap.operators.geo import Grid, shuffled


def to_boxes(pixels: DataFrame, res: float, x: str = "x", y: str = "y") -> DataFrame:
    """Square around each pixel centre as four coordinates."""
    half = res / 2
    return pixels.withColumns(
        {
            "minx": F.col(x) - half, "miny": F.col(y) - half, "maxx": F.col(x) + half, "maxy": F.col(y) + half,
        }
    )


def centres(pixels: DataFrame, grid: Grid) -> DataFrame:
    left, low, right, high = grid.box(F.col("row"), F.col("col"))
    return pixels.withColumns({"x": (left + right) / 2, "y": (low + high) / 2})


def _offsets(k: int):
    half = k // 2
    return F.sequence(F.lit(-half), F.lit(half))


BLOCK = 256  # cells along the side of a block


def _block_means(k: int, block: int, n_keys: int, values: Sequence[str]):
    """The means of one block: its cells and halo as arrays, summed along the columns, then along the rows."""
    half = k // 2

    def along(a: np.ndarray) -> np.ndarray:
        a = sum(a[:, d:a.shape[1] - k + 1 + d] for d in range(k))
        return sum(a[d:a.shape[0] - k + 1 + d] for d in range(k))

    def means(table: pa.Table) -> pa.Table:
        rows, cols = table.column("row").to_numpy().astype(np.int64), table.column("col").to_numpy().astype(np.int64)
        top, left = rows.min() - half, cols.min() - half  # arrays as large as what is there
        shape = rows.max() - top + half + 1, cols.max() - left + half + 1
        at = (rows - top) * shape[1] + cols - left
        here = np.zeros(shape, bool)
        here.ravel()[at] = True
        row, col = np.nonzero(here[half:shape[0] - half, half:shape[1] - half])
        first = [table.column(c)[0].as_py() * block - o - half for c, o in (("_br", top), ("_bc", left))]
        inner = (row >= first[0]) & (row < first[0] + block) & (col >= first[1]) & (col < first[1] + block)
        row, col = row[inner], col[inner]
        out = {c: table.column(c).take(pa.array(np.zeros(len(row), np.int64))) for c in table.column_names[:n_keys]}
        out |= {"row": pa.array(row + top + half).cast(table.schema.field("row").type), "col": pa.array(col + left + half).cast(table.schema.field("col").type)}
        for i, v in enumerate(values):
            x = table.column(f"_v{i}")
            there = x.is_valid().to_numpy()
            s, n = (np.bincount(at[there], w, here.size).reshape(shape) for w in (x.drop_null().to_numpy(), None))
            s, n = (along(a)[row, col] for a in (s, n))
            out[v] = pa.array(s / np.where(n > 0, n, 1.0), mask=n == 0)
        return pa.table(out)

    return means


DENSE = 4096  # cells from which a block is summed in arrays of its own


def _sparse_means(table: pa.Table, k: int, block: int, keep: Sequence[str], values: Sequence[str]) -> pa.Table:
    """The means of many blocks of few cells at once: cells in order of block, row and column,
    neighbours found by binary search."""
    half, side = k // 2, block + 2 * (k // 2)
    nth = np.cumsum(table.column("_nth").to_numpy() == 1)
    row, col = (table.column(a).to_numpy().astype(np.int64) - table.column(o).to_numpy() * block + half for a, o in (("row", "_br"), ("col", "_bc")))
    cells, first, back = np.unique((nth * side + row) * side + col, return_index=True, return_inverse=True)
    inner = np.flatnonzero(((row >= half) & (row < block + half) & (col >= half) & (col < block + half))[first])
    sums, counts = [], []
    for i in range(len(values)):
        x = table.column(f"_v{i}")
        there = x.is_valid().to_numpy()
        sums.append(np.bincount(back[there], x.drop_null().to_numpy(), len(cells)))
        counts.append(np.bincount(back[there], minlength=len(cells)))
    s, n = np.zeros((len(values), len(inner))), np.zeros((len(values), len(inner)))
    for d in range(-half, half + 1):
        for e in range(-half, half + 1):
            wanted = cells[inner] + d * side + e
            at = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
            found = cells[at] == wanted
            for i in range(len(values)):
                s[i] += np.where(found, sums[i][at], 0.0)
                n[i] += np.where(found, counts[i][at], 0)
    out = table.select(list(keep)).take(pa.array(first[inner]))
    for i, v in enumerate(values):
        out = out.append_column(v, pa.array(s[i] / np.where(n[i] > 0, n[i], 1.0), mask=n[i] == 0))
    return out


def _means_of_blocks(k: int, block: int, n_keys: int, values: Sequence[str]):
    """The means of the blocks of a partition, which come one after the other: large ones in arrays
    of their own, the small ones of a batch together."""
    dense = _block_means(k, block, n_keys, values)

    def whole(table: pa.Table) -> Iterator[pa.Table]:
        """``table`` holds whole blocks."""
        table = table.combine_chunks()
        starts = np.flatnonzero(table.column("_nth").to_numpy() == 1)
        sizes = np.diff(np.append(starts, len(table)))
        large = np.flatnonzero(sizes >= DENSE)
        for i in large:
            yield dense(table.slice(starts[i], sizes[i]))
        small = np.ones(len(table), bool)
        for i in large:
            small[starts[i]:starts[i] + sizes[i]] = False
        if small.any():
            rest = table.filter(pa.array(small)) if len(large) else table
            yield _sparse_means(rest, k, block, [*table.column_names[:n_keys], "row", "col"], values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # what has come of the last block
        for batch in batches:
            table = pa.Table.from_batches([batch])
            starts = np.flatnonzero(table.column("_nth").to_numpy() == 1)
            if len(starts):
                held.append(table.slice(0, starts[-1]))
                ready = pa.concat_tables(held)
                if len(ready):
                    for out in whole(ready):
                        yield from out.to_batches()
                held = [table.slice(starts[-1])]
            else:
                held.append(table)
        if held:
            for out in whole(pa.concat_tables(held)):
                yield from out.to_batches()

    return run


def focal_mean(pixels: DataFrame, values: Sequence[str], k: int = 3, keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Mean over the k x k square around each pixel, over the pixels present.

    Pixels meet in square blocks with a halo of the cells that their squares reach into: one
    shuffle, in which a pixel moves once, and those near a border of blocks up to four times. The sums run
    inside arrays of a block; blocks of few cells share their arrays, so that many small scenes cost by their
    pixels. Means are exact at edges and gaps. Other columns than keys and values are not kept.
    """
    keys, half = list(keys), k // 2

    def blocks_of(axis: str) -> Column:
        """The blocks whose cells or halo hold a pixel."""
        return F.explode(F.sequence(F.floor((F.col(axis) - half) / block), F.floor((F.col(axis) + half) / block)))

    sent = pixels.select(*keys, "row", "col", *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    sent = sent.withColumn("_br", blocks_of("row")).withColumn("_bc", blocks_of("col"))
    # the first row of a block has number 1; the blocks of a partition follow each other
    sent = sent.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_br", "_bc").orderBy("row", "col")))
    schema = StructType([*[pixels.schema[c] for c in [*keys, "row", "col"]], *[StructField(v, DoubleType()) for v in values]])
    return sent.mapInArrow(_means_of_blocks(k, block, len(keys), values), schema)


def mosaic(
    tiles: DataFrame, keys: Sequence[str] = ("win", "row", "col"), order: str = "tile", value: str = "pred", nodata: int = 0
) -> DataFrame:
    """One value per cell where tiles overlap: the last tile in ``order`` wins and
    no-data never overwrites data; cells without data get the no-data value.

    The names in ``order`` are ranked once. Rank and value then fit one long, and the winner is
    its maximum: a hash aggregate of fixed width. Values are whole numbers of 32 bits.
    """
    keys, kind = list(keys), tiles.schema[value].dataType
    if kind.simpleString() not in ("tinyint", "smallint", "int"):
        raise ValueError(f"{value!r} is not a whole number of at most 32 bits")
    has = F.col(value).isNotNull() & (F.col(value) != nodata) & F.col(order).isNotNull()
    # a row a tile, whatever the number of cells; broadcast, as a join by shuffle would send all cells of a tile to one task
    names = tiles.select(order).where(F.col(order).isNotNull()).distinct()
    ranks = names.withColumn("_rank", F.row_number().over(Window.orderBy(order)).cast("long"))
    packed = F.when(has, F.shiftleft("_rank", 32) + F.col(value).cast("long") + F.lit(1 << 31))
    picked = tiles.join(F.broadcast(ranks), order, "left").groupBy(*keys).agg(F.max(packed).alias("_top"))
    back = (F.col("_top").bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).cast(kind)
    return picked.select(*keys, F.coalesce(back, F.lit(nodata).cast(kind)).alias(value))


def sample(
    points: DataFrame,
    pixels: DataFrame,
    grid: Grid,
    point_key: str,
    window: int = 1,
    agg: str = "mean",
    win: str = "win",
    value: str = "pred",
    first_cell: tuple[int, int] | None = None,
    bounds: tuple[int | None, int | None, int | None, int | None] | None = None,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Pixel value per point and time window: ``point_key, win, value``.

    ``window`` > 1 takes the mean or max over a square of pixels, cut off at the
    border.  Points without any pixel give 0 through ``fill_samples``.  With
    ``first_cell`` (row, col), squares reaching over the first row or column give
    nothing, as array slicing with a negative start does. With ``bounds`` (first row, first
    column, last row, last column; None is open) a point outside takes the nearest cell.
    """
    if window > 1 and agg not in ("mean", "max"):
        raise ValueError(f"agg {agg!r} not supported")
    cell = {"row": grid.row(F.col(y)), "col": grid.col(F.col(x))}
    for k, name in enumerate(cell):
        if bounds is not None and bounds[k] is not None:
            cell[name] = F.greatest(cell[name], F.lit(bounds[k]))
        if bounds is not None and bounds[k + 2] is not None:
            cell[name] = F.least(cell[name], F.lit(bounds[k + 2]))
    p = points.select(point_key, *[c.cast("int").alias(name) for name, c in cell.items()])
    if window > 1:
        if first_cell is not None:
            half = window // 2
            p = p.where((F.col("row") - half >= first_cell[0]) & (F.col("col") - half >= first_cell[1]))
        p = (
            p.withColumn("_dr", F.explode(_offsets(window)))
            .withColumn("_dc", F.explode(_offsets(window)))
            .select(point_key, (F.col("row") + F.col("_dr")).alias("row"), (F.col("col") + F.col("_dc")).alias("col"))
        )
    j = p.join(shuffled(pixels.select("row", "col", win, value)), ["row", "col"])
    if window == 1:
        return j.select(point_key, win, value)
    return j.groupBy(point_key, win).agg((F.avg(value) if agg == "mean" else F.max(value)).alias(value))


def fill_samples(points: DataFrame, samples: DataFrame, windows: Sequence, point_key: str, win: str = "win", value: str = "pred") -> DataFrame:
    """Every point and window, 0 where no pixel was found."""
    grid = points.withColumn(win, F.explode(F.array(*[F.lit(w) for w in windows])))
    return grid.join(shuffled(samples), [point_key, win], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))
