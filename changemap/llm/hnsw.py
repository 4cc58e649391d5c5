"""A hierarchical navigable small-world graph over unit vectors, in numpy.

Everything runs in batches: points are inserted, and queries searched, many at a time,
each step one gather and one product for all of them.
"""

from __future__ import annotations

import numpy as np

NEIGHBOURS, BASE_NEIGHBOURS = 12, 24
BUILD_BEAM = 32
INSERT_BATCH, SEARCH_BATCH = 1024, 1024


def _sims(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Products of each query with its own row of ids; -2 where the id is -1."""
    s = np.matmul(vectors[np.maximum(ids, 0)], queries[:, :, None])[:, :, 0]
    s[ids < 0] = -2.0
    return s


def _best(ids: np.ndarray, sims: np.ndarray, k: int, *more: np.ndarray):
    """The ``k`` highest of each row, highest first."""
    if ids.shape[1] > k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims, more = *(np.take_along_axis(x, at, 1) for x in (ids, sims)), tuple(np.take_along_axis(x, at, 1) for x in more)
    at = np.argsort(-sims, axis=1, kind="stable")
    return [np.take_along_axis(x, at, 1) for x in (ids, sims, *more)]


def _spread(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` neighbours of each row: one is taken if it is nearer to the point than to
    those taken before it; free places go to the nearest of the rest."""
    ids, sims = _best(ids, sims, ids.shape[1])
    n, c = ids.shape
    own = vectors[np.maximum(ids, 0)]
    between = np.matmul(own, own.transpose(0, 2, 1))
    taken, nearest = np.zeros((n, c), bool), np.full((n, c), -2.0, np.float32)
    for j in range(c):
        take = (ids[:, j] >= 0) & (nearest[:, j] < sims[:, j]) & (taken.sum(axis=1) < k)
        taken[:, j] = take
        nearest = np.where(take[:, None], np.maximum(nearest, between[:, :, j]), nearest)
    order = np.argsort(np.where(taken, 0, 1), axis=1, kind="stable")[:, :k]
    out = np.full((n, k), -1, np.int32)
    out[:, :order.shape[1]] = np.take_along_axis(ids, order, 1)
    return out


class Graph:
    """Nodes, and vectors within ``radius`` (a cosine) of a node, which join that node.

    ``vectors``: float32, unit length. ``home[i]``: the node that vector i is or joined.
    """

    def __init__(self, vectors: np.ndarray, radius: float, seed: int = 7):
        self.vectors, self.radius = vectors, radius
        n = len(vectors)
        self.home = np.full(n, -1, np.int64)
        self.level = np.minimum((np.random.default_rng(seed).exponential(1 / np.log(NEIGHBOURS), n)).astype(np.int8), 6)
        self.links = np.full((n, BASE_NEIGHBOURS), -1, np.int32)
        self.nodes = np.zeros(0, np.int64)
        self.upper: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < n:
            size = max(64, min(INSERT_BATCH, at))
            self._insert(np.arange(at, min(n, at + size)))
            at += size

    def _insert(self, batch: np.ndarray) -> None:
        v = self.vectors
        if len(self.nodes):
            ids, sims = self.search(v[batch], BUILD_BEAM)
            near = sims[:, 0] >= self.radius
            self.home[batch[near]] = ids[near, 0]
            batch, ids, sims = batch[~near], ids[~near], sims[~near]
        else:
            ids, sims = np.zeros((len(batch), 0), np.int32), np.zeros((len(batch), 0), np.float32)
        if not len(batch):
            return
        within = v[batch] @ v[batch].T
        np.fill_diagonal(within, -2.0)
        close = within >= self.radius
        new = np.ones(len(batch), bool)
        for i in np.flatnonzero(close.any(axis=1)):  # in order: join the nearest node taken before
            before = np.flatnonzero(close[i, :i] & new[:i])
            if len(before):
                new[i] = False
                self.home[batch[i]] = batch[before[np.argmax(within[i, before])]]
        self.home[batch[new]] = batch[new]
        fresh, ids, sims, within = batch[new], ids[new], sims[new], within[np.ix_(new, new)]
        k = min(BUILD_BEAM, max(0, len(fresh) - 1))
        if k:
            other = np.argpartition(-within, k - 1, axis=1)[:, :k]
            ids = np.concatenate((ids, fresh[other].astype(np.int32)), axis=1)
            sims = np.concatenate((sims, np.take_along_axis(within, other, 1)), axis=1)
        if ids.shape[1]:
            self.links[fresh] = np.concatenate((
                _spread(v, ids, sims, NEIGHBOURS), np.full((len(fresh), BASE_NEIGHBOURS - NEIGHBOURS), -1, np.int32)), axis=1)
            self._link_back(fresh)
        self.nodes = np.concatenate((self.nodes, fresh))
        self._raise()

    def _link_back(self, fresh: np.ndarray) -> None:
        """The neighbours of new nodes link to them too, and drop their least useful links."""
        to = self.links[fresh, :NEIGHBOURS]
        source, target = np.repeat(fresh, NEIGHBOURS)[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        who, first, size = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, size)
        for at in range(0, len(who), INSERT_BATCH):
            some = slice(at, at + INSERT_BATCH)
            lo, hi = first[at], (first[some][-1] + size[some][-1])
            wide = np.full((len(who[some]), size[some].max()), -1, np.int32)
            wide[np.repeat(np.arange(len(who[some])), size[some]), place[lo:hi]] = source[lo:hi]
            ids = np.concatenate((self.links[who[some]], wide), axis=1)
            ids[:, BASE_NEIGHBOURS:][(ids[:, BASE_NEIGHBOURS:, None] == ids[:, None, :BASE_NEIGHBOURS]).any(axis=2)] = -1
            sims = _sims(self.vectors, ids, self.vectors[who[some]])
            ids, sims = _best(ids, sims, min(ids.shape[1], 2 * BASE_NEIGHBOURS))
            self.links[who[some]] = _spread(self.vectors, ids, sims, BASE_NEIGHBOURS)

    def _raise(self) -> None:
        """The levels above: each node with its nearest of the level."""
        self.upper = []
        for level in range(1, int(self.level[self.nodes].max()) + 1):
            nodes = self.nodes[self.level[self.nodes] >= level]
            k = min(NEIGHBOURS, len(nodes) - 1)
            to = np.full((len(nodes), max(1, k)), -1, np.int32)
            for at in range(0, len(nodes) if k else 0, INSERT_BATCH):
                s = self.vectors[nodes[at:at + INSERT_BATCH]] @ self.vectors[nodes].T
                s[np.arange(len(s)), np.arange(at, at + len(s))] = -2.0
                to[at:at + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
            self.upper.append((nodes, to))

    def _enter(self, queries: np.ndarray) -> np.ndarray:
        """Greedy descent through the upper levels."""
        if not self.upper:
            return np.full(len(queries), self.nodes[0])
        at = None
        for level in range(len(self.upper) - 1, -1, -1):
            nodes, to = self.upper[level]
            if at is None:
                at = np.zeros(len(queries), np.int64)
            else:
                at = np.searchsorted(nodes, at)  # nodes ascend on every level
            here = np.einsum("qd,qd->q", self.vectors[nodes[at]], queries)
            active = np.arange(len(queries))
            while len(active):
                near = to[at[active]]
                s = _sims(self.vectors, np.where(near >= 0, nodes[np.maximum(near, 0)], -1), queries[active])
                best = s.argmax(axis=1)
                top = s[np.arange(len(active)), best]
                move = top > here[active]
                active, near, best, top = active[move], near[move], best[move], top[move]
                at[active], here[active] = near[np.arange(len(active)), best], top
            at = nodes[at]
        return at

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes found for each query, best first; -1 fills up."""
        parts = [self._search(queries[i:i + SEARCH_BATCH], beam) for i in range(0, len(queries), SEARCH_BATCH)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(queries)
        ids, sims = np.full((n, beam), -1, np.int32), np.full((n, beam), -2.0, np.float32)
        done = np.ones((n, beam), bool)
        ids[:, 0] = self._enter(queries)
        sims[:, 0] = np.einsum("qd,qd->q", self.vectors[ids[:, 0]], queries)
        done[:, 0] = False
        active = np.arange(n)
        while True:
            active = active[~done[active].all(axis=1)]
            if not len(active):
                return ids, sims
            own, score, seen = ids[active], sims[active], done[active]
            pick = np.where(seen, -3.0, score).argmax(axis=1)
            row = np.arange(len(active))
            seen[row, pick] = True
            near = self.links[own[row, pick]].copy()
            near[(near[:, :, None] == own[:, None, :]).any(axis=2)] = -1
            s = _sims(self.vectors, near, queries[active])
            near[s <= score[:, -1:]] = -1  # the beam is sorted: no better than its last
            s[near < 0] = -2.0
            ids[active], sims[active], done[active] = _best(
                np.concatenate((own, near), axis=1), np.concatenate((score, s), axis=1), beam,
                np.concatenate((seen, near < 0), axis=1))
