"""Embedding near-duplicates: a navigable graph per shard, every vector asks every shard."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemap.llm.graph import components
from changemap.llm.hnsw import Graph
from changemap.session import materialise

THRESHOLD = 0.95
# vectors in one graph, and the least number of graphs
SHARD_ROWS, MIN_SHARDS = 50_000, 6
FIRST_BEAM = 24
AUDIT_QUERIES, AUDIT_RECALL = 1024, 0.98
BLOCK = 512  # queries verified at once
MARGIN = 1e-6  # between single precision and the exact check
HOME_MARGIN = 1e-5  # by which a vector must exceed the threshold, in single precision, to join a node unverified


def usable(column: str):
    """Not null, without null or non-finite components, and not zero."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda x: x != 0)


def _units(column: pd.Series) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that tiny or huge ones keep their length."""
    x = np.stack([np.asarray(v, np.float64) for v in column])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _indexed(threshold: float):
    """One shard's vectors and graph as one row."""

    def indexed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        units = _units(rows["vector"])
        g = Graph(units.astype(np.float32), threshold + HOME_MARGIN)
        top = [np.concatenate((nodes[:, None], to), axis=1) for nodes, to in g.upper]
        shape = [(len(t), t.shape[1]) for t in top]
        flat = np.concatenate([t.ravel() for t in top]) if top else np.zeros(0, np.int64)
        return pd.DataFrame([(
            int(rows["shard"].iloc[0]), units.shape[1],
            *_pack(rows["id"].to_numpy(np.int64), units, g.home, g.links, g.nodes, np.array(shape, np.int64), flat.astype(np.int64)),
        )], columns=["shard", "dim", "ids", "units", "home", "links", "nodes", "shape", "upper"])

    return indexed


def _restored(row) -> tuple[np.ndarray, np.ndarray, Graph]:
    ids = np.frombuffer(row["ids"], np.int64)
    units = np.frombuffer(row["units"], np.float64).reshape(len(ids), int(row["dim"]))
    g = Graph.__new__(Graph)
    g.vectors = units.astype(np.float32)
    g.home, g.nodes = np.frombuffer(row["home"], np.int64), np.frombuffer(row["nodes"], np.int64)
    g.links = np.frombuffer(row["links"], np.int32).reshape(len(ids), -1)
    flat, g.upper, at = np.frombuffer(row["upper"], np.int64), [], 0
    for n, k in np.frombuffer(row["shape"], np.int64).reshape(-1, 2):
        part = flat[at:at + n * k].reshape(n, k)
        g.upper.append((part[:, 0], part[:, 1:]))
        at += n * k
    return ids, units, g


def audited_search(g: Graph, queries: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """All nodes found within ``cutoff`` of each query, as pairs (query, node).

    The beam starts at ``FIRST_BEAM``. It doubles for all queries until an audit passes:
    spread-out queries are compared with all nodes, and at least ``AUDIT_RECALL`` of the
    nodes within the cutoff must have been found. It doubles for single queries
    as long as even the last of their beam is within the cutoff.
    """
    audit = np.arange(0, len(queries), max(1, len(queries) // AUDIT_QUERIES))
    exact = queries[audit] @ g.vectors[g.nodes].T >= cutoff
    beam = min(FIRST_BEAM, len(g.nodes))
    while True:
        ids, sims = g.search(queries, beam)
        row, at = np.nonzero(exact)
        full = sims[audit, -1] >= cutoff  # judged when their own beams are wide enough
        keep = ~full[row]
        found = (ids[audit][row[keep]] == g.nodes[at[keep]][:, None]).any(axis=1)
        if not len(found) or found.mean() >= AUDIT_RECALL or beam >= len(g.nodes):
            break
        beam = min(2 * beam, len(g.nodes))
    pairs, todo = [], np.arange(len(queries))
    while True:
        wide = (sims[:, -1] >= cutoff) & (beam < len(g.nodes))
        q, k = np.nonzero((sims >= cutoff) & (ids >= 0) & ~wide[:, None])
        pairs.append((todo[q], ids[q, k]))
        todo = todo[wide]
        if not len(todo):
            return tuple(np.concatenate(x) for x in zip(*pairs))
        beam = min(2 * beam, len(g.nodes))
        if 4 * beam >= len(g.nodes):  # a beam over most of the graph: all nodes, in blocks
            for i in range(0, len(todo), BLOCK):
                q, k = np.nonzero(queries[todo[i:i + BLOCK]] @ g.vectors[g.nodes].T >= cutoff)
                pairs.append((todo[i:i + BLOCK][q], g.nodes[k]))
            return tuple(np.concatenate(x) for x in zip(*pairs))
        ids, sims = g.search(queries[todo], beam)


def linked(left, right, threshold: float) -> pd.DataFrame:
    """Links between the vectors of two shards: rows ``(a, n, b)``.

    With ``n``: ``a`` is linked with n vectors of the other shard. With ``b``: a link; enough
    of them to connect all that is linked. A node and its vectors are linked by how
    they were joined, so a query needs one link for each node whose group it meets.
    Every cosine is verified in double precision, group by group.
    """
    ids, units, own = left
    to_ids, to_units, g = right
    same = to_ids is ids
    cutoff = math.cos(min(math.pi, 2 * math.acos(threshold))) - MARGIN
    q, node = audited_search(g, own.vectors, cutoff)
    if same:  # a vector's own node, whatever the beam found
        q, node = np.concatenate((q, np.arange(len(ids)))), np.concatenate((node, g.home))
        both = np.unique(q * len(ids) + node)
        q, node = both // len(ids), both % len(ids)
    order = np.argsort(node, kind="stable")
    q, node = q[order], node[order]
    members = np.argsort(g.home, kind="stable")
    lo, hi = (np.searchsorted(g.home[members], node, side) for side in ("left", "right"))
    counts, back = np.zeros(len(ids), np.int64), np.zeros(len(to_ids), np.int64)
    a, b = [], []
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    for s, e in zip(starts, np.append(starts[1:], len(node))):
        group = members[lo[s]:hi[s]]
        there = to_units[group]
        for i in range(s, e, BLOCK):
            ask = q[i:min(e, i + BLOCK)]
            for j in range(0, len(group), 16 * BLOCK):
                hit = units[ask] @ there[j:j + 16 * BLOCK].T >= threshold
                n = hit.sum(axis=1)
                counts[ask] += n
                back[group[j:j + 16 * BLOCK]] += hit.sum(axis=0)
                got = np.flatnonzero(n)
                a.append(ids[ask[got]])
                b.append(to_ids[group[j + hit[got].argmax(axis=1)]])
    if same:
        counts -= np.einsum("nd,nd->n", units, units) >= threshold  # itself
        a.append(ids)
        b.append(ids[g.home])
    out = [pd.DataFrame({"a": ids, "n": counts})]
    if not same:
        out.append(pd.DataFrame({"a": to_ids, "n": back}))
    out = pd.concat(out)
    out = out[out["n"] > 0].assign(b=pd.array([pd.NA], dtype="Int64")[0])
    edges = pd.DataFrame({"a": np.concatenate([*a, ids[:0]]), "b": np.concatenate([*b, ids[:0]])})
    edges = edges[edges["a"] != edges["b"]].drop_duplicates().assign(n=0)
    return pd.concat([out, edges])[["a", "n", "b"]].astype({"a": "int64", "n": "int64", "b": "Int64"})


def _met(threshold: float):
    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        one = _restored(left.iloc[0])
        return linked(one, one if int(left["shard"].iloc[0]) == int(right["shard"].iloc[0]) else _restored(right.iloc[0]), threshold)

    return met


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, n_links, component)`` for every row of ``vectors``.

    Vectors of equal dimension whose cosine is at least ``threshold`` are linked; component is
    the smallest id reachable. Unusable vectors (null, zero, with null or non-finite
    components) link with nothing. Rows repeated under one id are one vector, the
    smallest; their rows stay. Rows without an id link with nothing and have no
    component. The graphs are dealt by the hash of the id, ``SHARD_ROWS`` or a few to each
    at most, so no group of copies gathers in one; each pair of shards is one task.
    """
    key = F.col(id_col).alias("id")
    good = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(key, F.col(vector_col).cast("array<double>").alias("vector"))
    good = materialise(good.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector")), "vectors")
    sizes = good.groupBy("dim").agg(F.count("*").alias("n"))
    shards = F.greatest(F.lit(MIN_SHARDS), F.ceil(F.col("n") / SHARD_ROWS)).cast("int")
    # shards are numbered on across the dimensions; few are in use but for one
    dealt = good.join(F.broadcast(sizes.withColumn("of", shards)), "dim").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    index = materialise(dealt.groupBy("dim", "of", "shard").applyInPandas(
        lambda key, rows: _indexed(threshold)(rows).assign(of=int(key[1])),
        "shard int, dim int, of int, ids binary, units binary, home binary, links binary, nodes binary, shape binary, upper binary"), "graphs")
    lower = index.withColumn("other", F.explode(F.sequence(F.col("shard"), F.col("of") - 1)))
    upper = index.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shard"))))
    one = lower.withColumn("x", F.col("shard")).withColumn("y", F.col("other"))
    two = upper.withColumn("x", F.col("other")).withColumn("y", F.col("shard"))
    found = materialise(one.groupBy("dim", "x", "y").cogroup(two.groupBy("dim", "x", "y")).applyInPandas(
        lambda left, right: _met(threshold)(left, right) if len(left) and len(right) else pd.DataFrame(
            {"a": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "b": pd.array([], "Int64")}),
        "a long, n long, b long"), "met")
    counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    out = vectors.select(key).join(counts, "id", "left").join(roots, "id", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component"))
