"""Random forests with a leaf limit, all trees of all forests grown together.

Values become ranks among at most 256 bins of their feature, and a row a few bytes. While nodes hold
many rows, one pass a level counts rows and class weights per (tree, node, feature, bin):
partial sums in the tasks, one hash aggregate over all trees, and the best cut of each node
from its own few counts. Nodes of up to ``LOCAL_ROWS`` rows are then dealt out, rows and all,
and each subtree grows in one task by the same rule, so that where a node
is cut does not depend on where it is grown.

A tree with a leaf limit is grown best first: a cut's turn depends on its gain and on those of the cuts
above it only, through the smallest of them. So trees are grown without order, and the
cuts with the largest such bound are kept. What the driver holds is at most that many cuts a tree,
whatever the number of rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changemap.session import materialise

BINS = 256
LOCAL_ROWS = 100_000  # rows of a node that grows on in one task
BUFFER = 1 << 21  # counts that a task holds before it compacts or sends them
ACCURACY = 100_000  # of the quantiles between bins
DENSE = 8  # cells a key up to which keys are counted in place
MAX_DEPTH = 60  # a node's number is its path from the root, in a long
CUTS = "tree int, node long, feature int, bin int, gain double, bound double, " + ", ".join(
    f"{side}_{what}" for side in ("left", "right") for what in ("n long", "w0 double", "w1 double"))
CUT_COLUMNS = [c.split()[0] for c in CUTS.split(", ")]


@dataclass(frozen=True)
class Settings:
    """How the trees of one forest grow."""

    trees: int = 50
    mtry: int | str = "sqrt"  # features tried at a node
    min_leaf: int = 3  # rows, drawn more than once or not
    max_leaves: int = 10_000
    max_depth: int = MAX_DEPTH
    seed: int = 0
    first: int = 0  # number of the first tree; a tree follows from its number, not from how many there are

    def tried(self, features: int) -> int:
        named = {"sqrt": int(np.sqrt(features)), "log2": int(np.log2(features)), "all": features}
        return min(features, max(1, named.get(self.mtry) or int(self.mtry)))


def _drawn(u: Column) -> Column:
    """A Poisson(1) draw from ``u``, uniform below 2 ** 30."""
    # cumulative probabilities of Poisson(1) for 0..6 draws
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
    w = F.lit(0)
    for s in steps:
        w = w + F.when(u / float(1 << 30) >= s, 1).otherwise(0)
    return w


def _uniform(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30))


def poisson(*key: Column) -> Column:
    """A Poisson(1) draw from a hash of ``key``: the same on every run and executor."""
    return _drawn(_uniform(*key))


def draws(trees: int, row_key: Sequence[str], seed: int = 0, first: int = 0) -> Column:
    """How often a row is drawn for each tree from number ``first`` on. The hash is an array of its own: what a function
    over arrays uses several times it also works out several times."""
    u = F.transform(F.sequence(F.lit(first), F.lit(first + trees - 1)), lambda t: _uniform(F.lit(seed), t, *[F.col(c) for c in row_key]))
    return F.transform(u, _drawn)


# --- rows as bytes ------------------------------------------------------------------


def quantiles(df: DataFrame, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """``feature, ends``: quantiles over all rows, a row a feature by its place, in one pass. Features are
    groups, so that the sketches of all tasks are not merged in one."""
    at = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])  # made once: a call to the JVM a number
    values = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in features])).alias("feature", "value"))
    return values.groupBy("feature").agg(F.percentile_approx("value", at, ACCURACY).alias("ends"))


def edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Upper ends of all bins but the last, per feature."""
    found = dict(quantiles(df, features, bins).collect())
    return [sorted(set(found.get(i) or [])) for i in range(len(features))]


def _to_bins(x: np.ndarray, ends: Sequence[Sequence[float]]) -> np.ndarray:
    """The number of ends below each value: a cut at bin b sends values up to the b-th end left."""
    return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(ends)], axis=1).astype(np.uint8)


def binned(train: DataFrame, features: Sequence[str], ends, label: str, drawn: Column, weight: str | None = None) -> DataFrame:
    """Rows as ``y, w, bins, draws``; those with a missing feature are left out."""
    data = train.na.drop(subset=list(features)).select(
        F.col(label).cast("int").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
        F.transform(drawn, lambda d: d.cast("int")).alias("draws"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(ends))], axis=1)
            times = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (_to_bins(x, ends), times))],
                names=["y", "w", "bins", "draws"])

    return materialise(data.mapInArrow(pack, "y int, w double, bins binary, draws binary"), "binned")


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


# --- cuts ---------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix, the finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tried_at(nodes: np.ndarray, tree: int, seed: int, features: int, mtry: int) -> np.ndarray:
    """The features tried at each node, drawn by hash, in order: (nodes, mtry)."""
    base = _mixed(np.array([seed * 1_000_003 + tree + 1], np.uint64))
    of_node = _mixed(nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + base)
    rank = _mixed(of_node[:, None] + np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.sort(np.argsort(rank, axis=1, kind="stable")[:, :mtry], axis=1)


def best_cuts(group: np.ndarray, feature: np.ndarray, n: np.ndarray, w0: np.ndarray, w1: np.ndarray, min_leaf: int):
    """Of counts sorted by (group, feature, bin): the place of each group's best cut, and what lies left and right.

    The best cut lowers the Gini impurity most; of equal ones, the first. Groups without a valid cut are left out.
    Returns ``place, gain, left (n, w0, w1), right (n, w0, w1)``.
    """
    def starts_of(change):
        return np.flatnonzero(np.concatenate(([True], change))) if len(group) else np.zeros(0, np.int64)

    part = starts_of((group[1:] != group[:-1]) | (feature[1:] != feature[:-1]))
    length = np.diff(np.append(part, len(group)))
    left, right = [], []
    for v in (n, w0, w1):
        run = np.cumsum(v)
        begin = run[part] - v[part]
        left.append(run - np.repeat(begin, length))
        right.append(np.repeat(np.add.reduceat(v, part) if len(part) else v, length) - left[-1])
    (ln, l0, l1), (rn, r0, r1) = left, right
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
    score = np.where((ln >= min_leaf) & (rn >= min_leaf), score, -np.inf)
    at = starts_of(group[1:] != group[:-1])
    size = np.diff(np.append(at, len(group)))
    best = np.maximum.reduceat(score, at) if len(at) else score
    hit = np.flatnonzero(score == np.repeat(best, size))
    place = hit[np.searchsorted(hit, at)] if len(at) else hit
    t0, t1 = l0 + r0, l1 + r1
    place = place[np.isfinite(best) & (t0[place] > 0) & (t1[place] > 0)]
    gain = score[place] - (t0[place] ** 2 + t1[place] ** 2) / (t0[place] + t1[place])
    return place, gain, [v[place] for v in left], [v[place] for v in right]


def _cells(key: np.ndarray, w0: np.ndarray, w1: np.ndarray, size: int, whole: bool):
    """The cells below ``size`` that the rows' keys (rows, tried) name, in order, with their rows and weights.

    Whole numbers add up to the same in any order, so where keys are dense they are counted and not sorted.
    """
    mtry = key.shape[1]
    if whole and size <= DENSE * key.size:
        key = key.ravel()
        n = np.bincount(key, minlength=size)
        cell = np.flatnonzero(n)
        return cell, n[cell], *(np.bincount(key, np.repeat(v, mtry), size)[cell] for v in (w0, w1))
    order = np.argsort(key, axis=None, kind="stable")
    key, row = key.ravel()[order], order // mtry
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.diff(np.append(first, len(key))), np.add.reduceat(w0[row], first), np.add.reduceat(w1[row], first)


def subtree(bins: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, node: int, bound: float, s: Settings) -> dict[str, np.ndarray]:
    """All cuts below (and at) ``node`` that can be among the tree's best; ``w`` holds rows' weights."""
    features = bins.shape[1]
    mtry, out = s.tried(features), []
    at, nodes, bounds = np.zeros(len(y), np.int64), np.array([node], np.int64), np.array([bound])
    w0, w1 = np.where(y == 0, w, 0.0), np.where(y == 1, w, 0.0)
    whole = bool((w == np.floor(w)).all())
    while len(nodes):
        tried = tried_at(nodes, tree, s.seed, features, mtry)
        # tried features are in order, so their places order cells as their numbers would
        key = (at[:, None] * mtry + np.arange(mtry)) << 8 | np.take_along_axis(bins, tried[at], axis=1)
        cell, *counts = _cells(key, w0, w1, len(nodes) * mtry << 8, whole)
        group = (cell >> 8) // mtry
        place, gain, left, right = best_cuts(group, (cell >> 8) % mtry, *counts, s.min_leaf)
        who, cut = group[place], cell[place] & 255
        feature = tried[who, (cell[place] >> 8) % mtry]
        bounds = np.minimum(bounds[who], gain)
        out.append(dict(zip(CUT_COLUMNS, (np.full(len(who), tree), nodes[who], feature, cut, gain, bounds, *left, *right))))
        # rows move on with the children that may be cut again
        number = np.full(len(nodes), -1)
        number[who] = np.arange(len(who))
        mine = number[at]
        go = (mine >= 0)
        go_right = np.zeros(len(at), bool)
        go_right[go] = bins[go, feature[mine[go]]] > cut[mine[go]]
        child = np.where(go, 2 * mine + go_right, 0)
        n, c0, c1 = (np.stack((a, b), axis=1).ravel() for a, b in zip(left, right))
        paths = np.stack((2 * nodes[who], 2 * nodes[who] + 1), axis=1).ravel()
        deep = np.repeat(_depth(nodes[who]) + 1 >= min(s.max_depth, MAX_DEPTH), 2)
        alive = (n >= 2 * s.min_leaf) & (c0 > 0) & (c1 > 0) & ~deep
        renumber = np.cumsum(alive) - 1
        keep = go & (alive[child] if len(alive) else False)
        at = renumber[child[keep]] if len(alive) else at[:0]
        bins, w0, w1 = bins[keep], w0[keep], w1[keep]
        nodes, bounds = paths[alive], np.repeat(bounds, 2)[alive]
    cuts = {c: np.concatenate([o[c] for o in out]) for c in CUT_COLUMNS}
    first = np.lexsort((cuts["node"], -cuts["bound"]))[:s.max_leaves - 1]
    return {c: v[first] for c, v in cuts.items()}


def _depth(nodes: np.ndarray) -> np.ndarray:
    return np.array([int(n).bit_length() - 1 for n in nodes], np.int64)


# --- routing ------------------------------------------------------------------------


@dataclass
class Tree:
    """One tree as arrays: ``feature`` is -1 at a leaf; ``node`` holds the paths."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    node: np.ndarray

    @classmethod
    def of(cls, cuts: dict[str, np.ndarray], root: float) -> Tree:
        """From its cuts; ``root`` is the share of class 1 where there are none."""
        order = np.argsort(cuts["node"])
        inner = cuts["node"][order]
        paths = np.concatenate((inner, 2 * inner, 2 * inner + 1, [1]))
        share = [cuts[f"{s}_w1"][order] / np.maximum(cuts[f"{s}_w0"][order] + cuts[f"{s}_w1"][order], 1e-300) for s in ("left", "right")]
        value = np.concatenate((np.zeros(len(inner)), *share, [root]))
        node, first = np.unique(paths, return_index=True)
        is_cut = np.isin(node, inner)
        feature, cut = np.full(len(node), -1), np.zeros(len(node), np.int64)
        left = right = np.arange(len(node))
        if len(inner):
            feature[is_cut], cut[is_cut] = cuts["feature"][order], cuts["bin"][order]
            left, right = left.copy(), right.copy()
            left[is_cut], right[is_cut] = np.searchsorted(node, 2 * inner), np.searchsorted(node, 2 * inner + 1)
        return cls(feature, cut, left, right, value[first], node)

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The place of each row's leaf in the arrays."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        rows = rows[self.feature[at] >= 0]
        while len(rows):
            here = at[rows]
            at[rows] = np.where(bins[rows, self.feature[here]] <= self.bin[here], self.left[here], self.right[here])
            rows = rows[self.feature[at[rows]] >= 0]
        return at


def _trees_of(cuts: dict[str, np.ndarray], roots: Sequence[float]) -> list[Tree]:
    order = np.argsort(cuts["tree"], kind="stable")
    ends = np.searchsorted(cuts["tree"][order], np.arange(len(roots) + 1))
    return [Tree.of({c: v[order[a:b]] for c, v in cuts.items()}, r) for a, b, r in zip(ends, ends[1:], roots)]


# --- growing ------------------------------------------------------------------------


@dataclass
class _Open:
    """Nodes to be cut, of all trees."""

    tree: np.ndarray
    node: np.ndarray
    n: np.ndarray
    bound: np.ndarray

    def where(self, keep: np.ndarray) -> _Open:
        return _Open(self.tree[keep], self.node[keep], self.n[keep], self.bound[keep])


def _slots(opened: _Open, trees: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per tree the open nodes in order, and their places."""
    out = []
    for t in range(trees):
        mine = np.flatnonzero(opened.tree == t)
        mine = mine[np.argsort(opened.node[mine])]
        out.append((opened.node[mine], mine))
    return out


def _landed(tree: Tree, bins: np.ndarray, slots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The open node each row is in, by place, or -1."""
    nodes, places = slots
    if not len(nodes):
        return np.full(len(bins), -1)
    path = tree.node[tree.route(bins)]
    at = np.minimum(np.searchsorted(nodes, path), len(nodes) - 1)
    return np.where(nodes[at] == path, places[at], -1)


def _counts(plan: list[tuple[Settings, int, int]], trees: list[Tree], opened: _Open, features: int):
    """Each task's counts per cell: (open node, feature, bin) in one long."""
    slots = _slots(opened, len(plan))

    def compact(parts):
        key, *sums = (np.concatenate(v) for v in zip(*parts))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[first], *(np.add.reduceat(v[order], first) for v in sums)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def sent(part):
            return pa.RecordBatch.from_arrays([pa.array(v) for v in part], names=["cell", "n", "w0", "w1"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bins, times = _bytes(batch.column("bins")), _bytes(batch.column("draws"))
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            whole = bool((w == np.floor(w)).all())
            for t, (s, number, _) in enumerate(plan):
                in_bag = np.flatnonzero(times[:, number])
                slot = _landed(trees[t], bins[in_bag], slots[t])
                rows, slot = in_bag[slot >= 0], slot[slot >= 0]
                if not len(rows):
                    continue
                here, place = np.unique(slot, return_inverse=True)
                tried = tried_at(opened.node[here], s.first + number, s.seed, features, s.tried(features))
                mtry = tried.shape[1]
                key = (place[:, None] * mtry + np.arange(mtry)) << 8 | np.take_along_axis(bins[rows], tried[place], axis=1)
                weight, one = times[rows, number] * w[rows], y[rows] == 1
                cell, *sums = _cells(key, np.where(one, 0.0, weight), np.where(one, weight, 0.0), len(here) * mtry << 8, whole)
                node, nth = np.divmod(cell >> 8, mtry)
                parts.append(((here[node] * features + tried[node, nth]) << 8 | cell & 255, *sums))
                size += len(parts[-1][0])
                if size > BUFFER:
                    parts = [compact(parts)]
                    size = len(parts[0][0])
                    if size > BUFFER // 2:
                        yield sent(parts[0])
                        parts, size = [], 0
        if parts:
            yield sent(compact(parts))

    return counts


def _cut_one(features: int, min_leaves: Sequence[int]):
    """The best cut of one open node from its counts."""

    def cut(table: pa.Table) -> pa.Table:
        cell = table.column("cell").to_numpy()
        order = np.argsort(cell)
        cell = cell[order]
        slot = (cell >> 8) // features
        n, w0, w1 = (table.column(c).to_numpy()[order] for c in ("n", "w0", "w1"))
        place, gain, left, right = best_cuts(slot, (cell >> 8) % features, n, w0, w1, min_leaves[int(slot[0])])
        values = (slot[place], (cell[place] >> 8) % features, cell[place] & 255, gain, *left, *right)
        kinds = (pa.int64(), *_KINDS[2:5], *_KINDS[6:])
        return pa.table([pa.array(v).cast(k) for v, k in zip(values, kinds)], names=["slot", "feature", "bin", "gain", *CUT_COLUMNS[6:]])

    return cut


def grow(rows: DataFrame, features: int, forests: Sequence[Settings], local_rows: int | None = None) -> tuple[DataFrame, list[tuple[float, int]]]:
    """The cuts of all trees of all ``forests`` (columns ``CUTS``; trees are numbered on), and
    each tree's share of class 1 and number of rows at the root.

    ``rows`` as of ``binned``; the k-th tree of every forest sees a row as often as its k-th draw says.
    """
    spark = rows.sparkSession
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    plan = [(s, k, f) for f, s in enumerate(forests) for k in range(s.trees)]
    numbers = max(s.trees for s in forests)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, w0, w1 = np.zeros(numbers, np.int64), np.zeros(numbers), np.zeros(numbers)
        for batch in batches:
            if batch.num_rows:
                times = _bytes(batch.column("draws"))[:, :numbers]
                y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
                n += (times > 0).sum(axis=0)
                w0, w1 = w0 + (w * (y == 0)) @ times, w1 + (w * (y == 1)) @ times
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(numbers), pa.int32()), pa.array(n), pa.array(w0), pa.array(w1)], names=["k", "n", "w0", "w1"])

    sums = rows.mapInArrow(totals, "k int, n long, w0 double, w1 double").groupBy("k").agg(F.sum("n"), F.sum("w0"), F.sum("w1"))
    at_root = {r[0]: r[1:] for r in sums.collect()}
    roots = [at_root.get(k, (0, 0.0, 0.0)) for _, k, _ in plan]
    shares = [(w1 / (w0 + w1) if w0 + w1 else 0.0, n) for n, w0, w1 in roots]

    opened = _Open(np.arange(len(plan)), np.ones(len(plan), np.int64), np.array([r[0] for r in roots]), np.full(len(plan), np.inf))
    can = np.array([n >= 2 * s.min_leaf and w0 > 0 and w1 > 0 and s.max_depth > 0 and s.max_leaves > 1 for (n, w0, w1), (s, _, _) in zip(roots, plan)], bool)
    opened = opened.where(can)
    cuts = {c: np.zeros(0, np.int64 if c in ("tree", "node", "feature", "bin", "left_n", "right_n") else float) for c in CUT_COLUMNS}
    waiting = []
    while True:
        waiting.append(opened.where(opened.n <= local_rows))
        opened = opened.where(opened.n > local_rows)
        if not len(opened.tree):
            break
        trees = _trees_of(cuts, [s for s, _ in shares])
        cells = rows.mapInArrow(_counts(plan, trees, opened, features), "cell long, n long, w0 double, w1 double")
        cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
        found = cells.groupBy(F.floor(F.shiftright("cell", 8) / features).alias("slot")).applyInArrow(
            _cut_one(features, [plan[t][0].min_leaf for t in opened.tree]),
            "slot long, feature int, bin int, gain double, left_n long, left_w0 double, left_w1 double, right_n long, right_w0 double, right_w1 double")
        got = found.orderBy("slot").toPandas()  # a row an open node
        slot = got["slot"].to_numpy(np.int64)
        new = {c: got[c].to_numpy() for c in got.columns if c != "slot"}
        new |= {"tree": opened.tree[slot], "node": opened.node[slot], "bound": np.minimum(opened.bound[slot], new["gain"])}
        cuts = {c: np.concatenate((v, new[c])) for c, v in cuts.items()}
        opened = _children(new, plan)
        # a node below a cut that is not among the best cannot be among them itself
        least = _least_bounds(cuts, plan)
        opened = opened.where(opened.bound >= least[opened.tree])
    waiting = _Open(*(np.concatenate([getattr(w, c) for w in waiting]) for c in ("tree", "node", "n", "bound")))
    out = spark.createDataFrame(pa.table({c: pa.array(v) for c, v in cuts.items()})) if len(cuts["tree"]) else spark.createDataFrame([], CUTS)
    out = out.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in CUTS.split(", ")])
    if len(waiting.tree):
        sent = rows.mapInArrow(_dealt(plan, _trees_of(cuts, [s for s, _ in shares]), waiting), "tree int, node long, bound double, y binary, w binary, bins binary")
        out = out.union(sent.groupBy("tree", "node").applyInArrow(_grown(plan, features), CUTS))
    return out, shares


def _least_bounds(cuts: dict[str, np.ndarray], plan) -> np.ndarray:
    """Per tree the smallest bound among as many cuts as it may have, or minus infinity while it has fewer."""
    least = np.full(len(plan), -np.inf)
    for t in np.unique(cuts["tree"]):
        bounds, most = cuts["bound"][cuts["tree"] == t], plan[t][0].max_leaves - 1
        if len(bounds) >= most:
            least[t] = np.partition(bounds, len(bounds) - most)[len(bounds) - most]
    return least


def _children(new: dict[str, np.ndarray], plan) -> _Open:
    sides = []
    for side, bit in (("left", 0), ("right", 1)):
        n, w0, w1 = (new[f"{side}_{c}"] for c in ("n", "w0", "w1"))
        least = np.array([plan[t][0].min_leaf for t in new["tree"]])
        deep = _depth(new["node"]) + 1 >= np.array([min(plan[t][0].max_depth, MAX_DEPTH) for t in new["tree"]])
        keep = (n >= 2 * least) & (w0 > 0) & (w1 > 0) & ~deep
        sides.append((new["tree"][keep], 2 * new["node"][keep] + bit, n[keep], new["bound"][keep]))
    return _Open(*(np.concatenate(v) for v in zip(*sides)))


def _dealt(plan, trees: list[Tree], waiting: _Open):
    """The rows of each waiting node, packed: one row a batch and node."""
    slots = _slots(waiting, len(plan))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, times = _bytes(batch.column("bins")), _bytes(batch.column("draws"))
            y, w = batch.column("y").to_numpy().astype(np.uint8), batch.column("w").to_numpy()
            out = []
            for t, (_, number, _) in enumerate(plan):
                in_bag = np.flatnonzero(times[:, number])
                slot = _landed(trees[t], bins[in_bag], slots[t])
                order = np.argsort(slot, kind="stable")
                here, first = np.unique(slot[order], return_index=True)
                for p, lo, hi in zip(here, first, np.append(first[1:], len(order))):
                    if p >= 0:
                        r = in_bag[order[lo:hi]]
                        out.append((t, waiting.node[p], waiting.bound[p], y[r].tobytes(), (w[r] * times[r, number]).tobytes(), bins[r].tobytes()))
            for lo in range(0, len(out), 64):
                kinds = (pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out[lo:lo + 64]), kinds)],
                                                 names=["tree", "node", "bound", "y", "w", "bins"])

    return dealt


def _grown(plan, features: int):
    def grown(table: pa.Table) -> pa.Table:
        tree, node, bound = (table.column(c)[0].as_py() for c in ("tree", "node", "bound"))
        y, w, bins = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("y", np.uint8), ("w", np.float64), ("bins", np.uint8)))
        s, number, _ = plan[tree]
        cuts = subtree(bins.reshape(-1, features), y, w, s.first + number, node, bound, s) | {"tree": None}
        cuts["tree"] = np.full(len(cuts["node"]), tree)
        return pa.table([pa.array(cuts[c]).cast(k) for c, k in zip(CUT_COLUMNS, _KINDS)], names=CUT_COLUMNS)

    return grown


_KINDS = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in CUTS.split(", ")]


def best_first(cuts: DataFrame, forests: Sequence[Settings]) -> DataFrame:
    """The cuts that a best-first growth up to each tree's leaf limit makes."""
    ends, most = 0, F.lit(0)
    for s in forests:
        most = F.when(F.col("tree") >= ends, s.max_leaves - 1).otherwise(most)
        ends += s.trees
    turn = Window.partitionBy("tree").orderBy(F.desc("bound"), "node")
    top = cuts.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= max(s.max_leaves - 1 for s in forests))
    return top.where(F.col("_turn") <= most).drop("_turn")


# --- a fitted forest ----------------------------------------------------------------


@dataclass
class Forest:
    """A fitted forest: its features, bin ends, trees, and cuts as a table."""

    features: list[str]
    ends: list[list[float]]
    shares: list[float]
    cuts: dict[str, np.ndarray]
    trees: list[Tree] = field(default_factory=list, repr=False)

    def __post_init__(self):
        self.trees = _trees_of(self.cuts, self.shares)

    def votes(self, bins: np.ndarray) -> np.ndarray:
        """Each tree's share of class 1, (rows, trees)."""
        return np.stack([t.value[t.route(bins)] for t in self.trees], axis=1)

    def probability(self, features: Column) -> Column:
        """The mean vote, from a struct of the feature columns in order."""
        ends, trees = self.ends, self.trees

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            bins = _to_bins(np.stack([v.to_numpy(zero_copy_only=False) for v in x.flatten()], axis=1), ends)
            total = np.zeros(len(bins))
            for t in trees:
                total += t.value[t.route(bins)]
            return pa.array(total / len(trees))

        return score(features)

    def transform(self, df: DataFrame, out: str = "prob") -> DataFrame:
        x = F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)])
        return df.withColumn(out, self.probability(x))

    def importances(self) -> list[float]:
        """Each feature's share of the impurity its tree takes away, over trees that take any."""
        total, trees = np.zeros(len(self.features)), 0
        for t in range(len(self.shares)):
            mine = self.cuts["tree"] == t
            gains = np.bincount(self.cuts["feature"][mine], self.cuts["gain"][mine], len(self.features))
            if gains.sum() > 0:
                total, trees = total + gains / gains.sum(), trees + 1
        return (total / max(1, trees)).tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        about = json.dumps({"features": self.features, "ends": self.ends, "shares": self.shares})
        table = spark.createDataFrame(pa.table({c: pa.array(v).cast(k) for (c, v), k in zip(self.cuts.items(), _KINDS)})) if len(
            self.cuts["tree"]) else spark.createDataFrame([], CUTS)
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/cuts")
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
        return cls(**about, cuts=_collected(spark.read.schema(CUTS).parquet(f"{path}/cuts")))


def _collected(cuts: DataFrame) -> dict[str, np.ndarray]:
    """At most the leaf limit of rows a tree."""
    table = cuts.select(*CUT_COLUMNS).toArrow()
    return {c: table.column(c).to_numpy() for c in CUT_COLUMNS}


def fit_binned(rows: DataFrame, features: Sequence[str], ends, forests: Sequence[Settings], local_rows: int | None = None) -> Iterator[Forest]:
    """All forests, grown together, fetched one after the other."""
    cuts, shares = grow(rows, len(features), forests, local_rows)
    cuts = materialise(best_first(cuts, forests), "cuts")
    at = 0
    for s in forests:
        mine = _collected(cuts.where(F.col("tree").between(at, at + s.trees - 1)))
        yield Forest(list(features), ends, [v for v, _ in shares[at:at + s.trees]], mine | {"tree": mine["tree"] - at})
        at += s.trees


def fit(train: DataFrame, features: Sequence[str], settings: Settings = Settings(), label: str = "label", weight: str | None = None,
        row_key: Sequence[str] | None = None, drawn: Column | None = None, bins: Sequence[Sequence[float]] | None = None,
        local_rows: int | None = None, start: Forest | None = None) -> Forest:
    """One forest on the chosen columns.

    A row's draws come from the hash of its ``row_key`` (by default, of all columns), or
    from ``drawn``, an array with a number a tree. ``bins`` gives the bin ends instead of quantiles. Rows with a
    missing feature are left out; without rows the forest says 0. ``start``, a smaller forest of the same rows,
    features and settings, is grown on: its trees and bin ends are taken as they are.
    """
    full = train.na.drop(subset=list(features))
    if start is not None:
        n = len(start.trees)
        if list(features) != start.features or n > settings.trees:
            raise ValueError("a forest is grown on from a smaller one on the same features")
        if n == settings.trees:
            return start
        rest = replace(settings, trees=settings.trees - n, first=settings.first + n)
        drawn = None if drawn is None else F.slice(drawn, n + 1, rest.trees)
        more = fit(train, features, rest, label, weight, row_key, drawn, start.ends, local_rows)
        cuts = {c: np.concatenate((v, more.cuts[c] + n if c == "tree" else more.cuts[c])) for c, v in start.cuts.items()}
        return Forest(start.features, start.ends, [*start.shares, *more.shares], cuts)
    ends = [list(e) for e in bins] if bins is not None else edges(full, features)
    drawn = draws(settings.trees, row_key or train.columns, settings.seed, settings.first) if drawn is None else drawn
    rows = binned(full, features, ends, label, drawn, weight)
    return next(fit_binned(rows, features, ends, [settings], local_rows))


def oob_errors(rows: DataFrame, forest: Forest) -> DataFrame:
    """``n_trees, oob_error`` for every number of trees from 1 on: each row judged by those trees
    among the first that never saw it; rows that all of them saw do not count."""
    n = len(forest.trees)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong, seen = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            if batch.num_rows:
                out = _bytes(batch.column("draws"))[:, :n] == 0
                votes = np.cumsum(np.where(out, forest.votes(_bytes(batch.column("bins"))), 0.0), axis=1)
                voted = np.cumsum(out, axis=1)
                said = votes > 0.5 * voted
                wrong += ((said != (batch.column("y").to_numpy() == 1)[:, None]) & (voted > 0)).sum(axis=0)
                seen += (voted > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, n + 1), pa.int32()), pa.array(wrong), pa.array(seen)], names=["n_trees", "wrong", "seen"])

    sums = rows.mapInArrow(errors, "n_trees int, wrong long, seen long").groupBy("n_trees").agg(F.sum("wrong").alias("wrong"), F.sum("seen").alias("seen"))
    return sums.where(F.col("seen") > 0).select("n_trees", (F.col("wrong") / F.col("seen")).alias("oob_error")).orderBy("n_trees")
