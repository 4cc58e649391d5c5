"""Nearest neighbours by inner product: an adaptive scan of dimensions in probed lists.

Scaled by the largest norm and given one more entry that makes all of them unit vectors,
candidates are the nearer to a query (in its last entry zero) the larger the
inner product. All are turned by one random rotation, so any few of their dimensions are a random sample of
the distance. Lists are the cells of k-means centres; the vectors of a list
lie in chunks, each a column block after the other. A query scans the first block of a probed chunk; a
candidate whose partial distance says, by a test of given significance, that the whole
one exceeds the k-th nearest found so far, is abandoned, and so on block by block.
What is left is compared in double precision on the vectors as given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changemap.llm.embeddings import usable
from changemap.session import materialise

NEAREST = 20
LIST_ROWS, MAX_LISTS = 1024, 4096
SAMPLE_BYTES = 32 << 20  # of vectors for the centres, at most
CHUNK_BYTES = 8 << 20  # of vectors in a chunk, about
QUERY_PART = 4096  # queries that meet a chunk in one task, about
TILE = 1 << 19  # pairs of query and candidate looked at together
COLUMNS = 16  # dimensions in a block
SEEDS = 4  # times the wanted number of candidates are compared whole before the others are tested
SIGNIFICANCE = 2.1  # the test's factor over the square root of the dimensions seen
MARGIN = 1e-5  # of squared distances in single precision
AUDIT_QUERIES, AUDIT_RECALL = 128, 0.96
FIRST_PROBES = 16  # the first round asks one list of so many
SEED = 13


def _lengths(x: np.ndarray) -> np.ndarray:
    """Norms, of huge or tiny vectors, too."""
    most = np.abs(x).max(axis=1, keepdims=True)
    return (most * np.linalg.norm(x / most, axis=1, keepdims=True)).ravel()


@dataclass
class Space:
    """The rotation, the largest norm and the centres of the lists (in rotated form)."""

    rotation: np.ndarray
    norm: float
    centres: np.ndarray

    def candidates(self, x: np.ndarray) -> np.ndarray:
        y = x / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.square(y).sum(axis=1, keepdims=True)))
        return (np.hstack((y, rest)) @ self.rotation).astype(np.float32)

    def queries(self, x: np.ndarray) -> np.ndarray:
        return ((x / _lengths(x)[:, None]) @ self.rotation[:-1]).astype(np.float32)

    def to_centres(self, y: np.ndarray) -> np.ndarray:
        """Squared distances to all centres, up to what is equal for all of them."""
        return np.square(self.centres).sum(axis=1) - 2 * (y @ self.centres.T)


def fit(sample: np.ndarray, norm: float, lists: int, seed: int = SEED) -> Space:
    """A random rotation, and centres from a few rounds of k-means over ``sample``."""
    random = np.random.default_rng(seed)
    of = sample.shape[1] + 1
    q, r = np.linalg.qr(random.standard_normal((of, of)))
    space = Space(q * np.sign(np.diag(r)), norm, np.zeros((0, of), np.float32))
    y = space.candidates(sample)
    space.centres = y[random.permutation(len(y))[:lists]].copy()
    for _ in range(8):
        home = np.concatenate([space.to_centres(y[i:i + 4096]).argmin(axis=1) for i in range(0, len(y), 4096)])
        sums, n = np.zeros((len(space.centres), of)), np.bincount(home, minlength=len(space.centres))
        np.add.at(sums, home, y)
        space.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], space.centres).astype(np.float32)
    return space


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row; equal rows give equal bits wherever they stand."""
    return (q * x).sum(axis=1)


def _listed(space: Space):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = space.candidates(_matrix(batch.column("x")))
            home = np.concatenate([space.to_centres(y[i:i + 4096]).argmin(axis=1) for i in range(0, len(y), 4096)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(home), batch.column("ids"), batch.column("x")], names=["list", "ids", "x"])

    return listed


def _probes(space: Space, lo: int, hi: int):
    """The ``lo``-th to the ``hi``-th nearest list of every query."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = space.to_centres(space.queries(_matrix(batch.column("q"))))
            lists = np.argsort(far, axis=1, kind="stable")[:, lo:hi].astype(np.int32)
            for i in range(0, len(lists), 1024):  # a probe carries its query
                part = lists[i:i + 1024]
                rows = pa.array(np.repeat(np.arange(i, i + len(part)), part.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.ravel()), *(batch.column(c).take(rows) for c in ("query", "q", "bound"))],
                    names=["list", "query", "q", "bound"])

    return probes


def _chunk(space: Space):
    """The vectors of one chunk as one row: blocks of rotated columns, then the originals."""

    def chunk(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _matrix(table.column("x"))
        y = space.candidates(x)
        blocks = b"".join(np.ascontiguousarray(y[:, i:i + COLUMNS]).tobytes() for i in range(0, y.shape[1], COLUMNS))
        ids = [np.array(v, np.int64) for v in table.column("ids").to_pylist()]
        return pa.table({
            "list": table.column("list").slice(0, 1), "chunk": table.column("chunk").slice(0, 1),
            "sizes": pa.array([np.array([len(v) for v in ids], np.int32).tobytes()], pa.binary()),
            "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()),
            "blocks": pa.array([blocks], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()),
        })

    return chunk


def survivors(blocks: list[np.ndarray], asked: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test has abandoned.

    ``limit`` holds each query's squared distance to the k-th nearest found elsewhere. The
    distances of the candidates that look nearest after the first block bound it for this chunk, too.
    """
    of, n = asked.shape[1], len(blocks[0])
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, TILE // n)
    norms = np.square(blocks[0]).sum(axis=1)
    for lo in range(0, len(asked), step):
        y, most = asked[lo:lo + step], limit[lo:lo + step].astype(np.float64)
        head = y[:, :blocks[0].shape[1]]
        near = np.maximum(0, np.square(head).sum(axis=1)[:, None] + norms - 2 * (head @ blocks[0].T))
        if n > k:  # one of them may be the query itself
            seeds = min(n, SEEDS * (k + 1))
            first = np.argpartition(near, seeds - 1, axis=1)[:, :seeds]
            whole, at = np.zeros(first.shape), 0
            for b in blocks:
                whole += np.square(b[first] - y[:, None, at:at + b.shape[1]]).sum(axis=2)
                at += b.shape[1]
            most = np.minimum(most, np.partition(whole, k, axis=1)[:, k] + MARGIN)
        at = blocks[0].shape[1]
        alive = near * (of / at) <= most[:, None] * (1 + SIGNIFICANCE / math.sqrt(at)) ** 2 + MARGIN
        q, c = np.nonzero(alive)
        part = near[q, c]
        for b in blocks[1:]:
            part = part + np.square(b[c] - y[q, at:at + b.shape[1]]).sum(axis=1)
            at += b.shape[1]
            slack = (1 + SIGNIFICANCE / math.sqrt(at)) ** 2 if at < of else 1.0
            alive = part * (of / at) <= most[q] * slack + MARGIN
            q, c, part = q[alive], c[alive], part[alive]
        kept.append((q + lo, c))
    return np.concatenate([q for q, _ in kept]), np.concatenate([c for _, c in kept])


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best rows of each query, equal scores by smaller id."""
    order = np.lexsort((ids, -score, query))
    starts = np.searchsorted(query[order], query[order], "left")
    return order[np.arange(len(order)) - starts < k]


FOUND = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _scan(space: Space, k: int):
    """The best candidates of one chunk for the queries that probe it."""

    def scan(chunk: pa.Table, asking: pa.Table) -> pa.Table:
        if not chunk.num_rows or not asking.num_rows:
            return FOUND.empty_table()
        row = chunk.slice(0, 1).to_pylist()[0]
        sizes, ids = np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["ids"], np.int64)
        n, of = len(sizes), len(space.rotation)
        flat, blocks, at = np.frombuffer(row["blocks"], np.float32), [], 0
        for i in range(0, of, COLUMNS):
            wide = min(COLUMNS, of - i)
            blocks.append(flat[at:at + n * wide].reshape(n, wide))
            at += n * wide
        x = np.frombuffer(row["x"], np.float64).reshape(n, -1)
        asking = asking.combine_chunks()
        query, q = asking.column("query").to_numpy(), _matrix(asking.column("q"))
        bound = asking.column("bound").to_numpy()  # least score of use
        limit = np.where(np.isfinite(bound), 2 - 2 * (bound / _lengths(q)) / space.norm + MARGIN, np.inf)
        qi, ci = survivors(blocks, space.queries(q), limit, k)
        starts, out, lo = np.concatenate(([0], np.cumsum(sizes))), [], 0
        while lo < len(qi):  # whole queries, a bounded number of pairs at once but for one query's own
            hi = max(int(np.searchsorted(qi, qi[lo], "right")), int(np.searchsorted(qi, qi[min(len(qi) - 1, lo + TILE // 8)], "left")))
            a, c = qi[lo:hi], ci[lo:hi]
            score = np.concatenate([_products(q[a[i:i + 65536]], x[c[i:i + 65536]]) for i in range(0, len(a), 65536)])
            pair = np.repeat(np.arange(len(a)), sizes[c])
            place = np.arange(len(pair)) - np.repeat(np.cumsum(sizes[c]) - sizes[c], sizes[c]) + starts[c][pair]
            who, got, value = query[a[pair]], ids[place], score[pair]
            keep = (who != got) & (value >= bound[a[pair]])
            who, got, value = who[keep], got[keep], value[keep]
            top = _best(who, value, got, k)
            out.append((who[top], got[top], value[top]))
            lo = hi
        if not out:
            return FOUND.empty_table()
        return pa.table([np.concatenate(v) for v in zip(*out)], schema=FOUND)

    return scan


def _exact(queries: np.ndarray, names: np.ndarray, k: int):
    """The best of every task's candidates for a few queries, all compared."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _matrix(batch.column("x")), [np.array(v, np.int64) for v in batch.column("ids").to_pylist()]
            sizes = np.array([len(v) for v in ids])
            flat, row = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64), np.repeat(np.arange(len(ids)), sizes)
            for name, q in zip(names, queries):
                score = _products(q, x)[row]
                keep = np.flatnonzero(flat != name)
                top = keep[_best(np.zeros(len(keep)), score[keep], flat[keep], k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), name)), pa.array(flat[top]), pa.array(score[top])], schema=FOUND)

    return exact


def _top(found: DataFrame, k: int) -> DataFrame:
    within = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k)


def _as_binary(column: str):
    """Arrays of doubles as binaries, in whose form they move from here on."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            x = batch.column(at)
            flat, ends = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))
            rows = [flat[b - n:b].tobytes() for b, n in zip(ends.tolist(), x.value_lengths().to_pylist())]
            yield batch.set_column(at, pa.field(column, pa.binary()), pa.array(rows, pa.binary()))

    return pack


def nearest(queries: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
            k: int = NEAREST) -> DataFrame:
    """``(query, rank, id, score)``: the ``k`` rows of ``vectors`` found with the largest inner product.

    Ranks start at 1; equal scores go to the smaller id; a query's own id is no candidate;
    fewer rows where there are fewer candidates. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows without an id; only vectors of equal dimension
    meet. Rows repeated under one id are one vector, the smallest. No rows, no results;
    other columns are not read.

    The centres are fitted on a sample of at most ``SAMPLE_BYTES``; every vector is in the index. Of equal
    vectors only the ``k + 1`` smallest ids can ever be among the nearest, so the index holds one
    vector for all of them with those ids. Lists are probed in rounds, nearest centres first, twice as many or
    more each time, until ``AUDIT_QUERIES`` queries compared with all vectors have found ``AUDIT_RECALL``
    of their true neighbours, or no list is left. A list lies in chunks, and the queries that probe
    it in parts, so neither a hot list nor a hot neighbourhood is one task.
    """
    spark = vectors.sparkSession

    def clean(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.where(usable(vector_col) & F.col(id_col).isNotNull() & (F.size(vector_col) > 0))
        return rows.groupBy(F.col(id_col).cast("long").alias(name)).agg(F.min(F.col(vector_col).cast("array<double>")).alias("v"))

    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    few = clean(vectors, "id").withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1)
    one = few.groupBy(F.xxhash64("v").alias("h"), "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    index = materialise(one.select("ids", F.size("v").alias("of"), F.col("v").alias("x")).mapInArrow(
        _as_binary("x"), "ids array<long>, of int, x binary"), "vectors")
    asked = materialise(clean(queries, "query").select("query", F.size("v").alias("of"), F.col("v").alias("q")).mapInArrow(
        _as_binary("q"), "query long, of int, q binary"), "queries")
    out = spark.createDataFrame([], "query long, rank int, id long, score double")
    for r in index.groupBy("of").count().join(asked.select("of").distinct(), "of").orderBy("of").collect():
        out = out.union(_nearest(index.where(F.col("of") == r["of"]).drop("of"), asked.where(F.col("of") == r["of"]).drop("of"), r["of"], r["count"], k))
    return out


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([float(_lengths(_matrix(batch.column("x"))).max(initial=0.0))])], names=["norm"])


def _nearest(index: DataFrame, asked: DataFrame, of: int, n: int, k: int) -> DataFrame:
    norm = index.select("x").mapInArrow(_norms, "norm double").agg(F.max("norm")).first()[0]
    rows = max(1, SAMPLE_BYTES // (8 * of))
    by_hash = F.xxhash64(F.col("ids")[0])
    drawn = index.where(F.pmod(by_hash, F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, 2 * rows / n))).orderBy(by_hash).limit(rows)
    sample = np.frombuffer(b"".join(r[0] for r in drawn.select("x").collect()), np.float64).reshape(-1, of)
    lists = max(1, min(n // LIST_ROWS, MAX_LISTS, len(sample) // 16))
    space = fit(sample, norm, lists)

    listed = materialise(index.mapInArrow(_listed(space), "list int, ids array<long>, x binary"), "listed")
    per_chunk = max(64, CHUNK_BYTES // (8 * of))
    # a row a list, of which there are at most MAX_LISTS
    sizes = materialise(listed.groupBy("list").agg(F.ceil(F.count("*") / per_chunk).cast("int").alias("chunks")), "sizes")
    dealt = listed.join(F.broadcast(sizes), "list").withColumn("chunk", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("chunks")).cast("int"))
    chunks = materialise(dealt.select("list", "chunk", "ids", "x").groupBy("list", "chunk").applyInArrow(
        _chunk(space), "list int, chunk int, sizes binary, ids binary, blocks binary, x binary"), "chunks")

    sampled = asked.orderBy(F.xxhash64("query"), "query").limit(AUDIT_QUERIES).collect()
    names, few = np.array([r["query"] for r in sampled], np.int64), np.frombuffer(b"".join(r["q"] for r in sampled), np.float64).reshape(-1, of)
    truth = {(r["query"], r["id"]) for r in _top(index.mapInArrow(_exact(few, names, k), "query long, id long, score double"), k).collect()}

    best, probed = None, 0
    to = max(1, lists // FIRST_PROBES)
    while True:
        now = asked.withColumn("bound", F.lit(float("-inf")))
        if best is not None:  # a query with k results has no use for worse ones
            bounds = best.where(F.col("rank") == k).select("query", F.col("score").alias("bound"))
            now = asked.join(bounds, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        probes = now.select("query", "q", "bound").mapInArrow(_probes(space, probed, to), "list int, query long, q binary, bound double")
        # again a row a list
        parts = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERY_PART).cast("int").alias("parts")).join(F.broadcast(sizes), "list")
        parts = materialise(parts, "parts")
        sent = probes.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
        sent = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("list", "chunk", "part", "query", "q", "bound")
        there = chunks.join(F.broadcast(parts.select("list", "parts")), "list")
        there = there.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        found = there.groupBy("list", "chunk", "part").cogroup(sent.groupBy("list", "chunk", "part")).applyInArrow(
            _scan(space, k), "query long, id long, score double")
        if best is not None:
            found = found.union(best.select("query", "id", "score"))
        best = materialise(_top(found, k).select("query", "rank", "id", "score"), "best")
        probed = to
        if probed >= lists:
            return best
        if truth:
            got = {(r["query"], r["id"]) for r in best.where(F.col("query").isin([int(v) for v in names])).collect()}
            if len(got & truth) >= AUDIT_RECALL * len(truth):
                return best
        to = min(lists, max(2 * to, probed + 1))
