"""Forests against a plain recursive version, wherever their nodes are cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changemap.operators import forest as O
from changemap.session import materialise, work_path

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(8)
    rows = []
    for i in range(700):
        x = [r.gauss(0, 1), r.randrange(6), r.random(), round(r.gauss(0, 2))]
        rows.append((i, int(x[0] + 0.4 * x[1] + r.gauss(0, 0.7) > 1), *map(float, x)))
    rows.append((900, 1, None, 1.0, 1.0, 1.0))
    return materialise(spark.createDataFrame(rows, "id long, label int, a double, b double, c double, d double").repartition(3), "t")


def plain_cuts(rows, times, tree, s):
    """Cuts of one tree by plain recursion: ``{node: (feature, bin, gain, left n, right n)}``, then best first."""
    found = {}

    def gini(part):
        w = [sum(times[i] for i in part if rows[i][0] == c) for c in (0, 1)]
        return (w[0] ** 2 + w[1] ** 2) / (w[0] + w[1]), w

    def cut(part, node):
        base, w = gini(part)
        if len(part) < 2 * s.min_leaf or not w[0] or not w[1] or node.bit_length() - 1 >= s.max_depth:
            return
        best = None
        for f in O.tried_at(np.array([node]), tree, s.seed, 4, s.tried(4))[0]:
            for b in sorted({rows[i][1][f] for i in part}):
                left, right = [i for i in part if rows[i][1][f] <= b], [i for i in part if rows[i][1][f] > b]
                if min(len(left), len(right)) >= s.min_leaf:
                    gain = gini(left)[0] + gini(right)[0]
                    if best is None or gain > best[0]:
                        best = gain, int(f), int(b), left, right
        if best:
            found[node] = best[1], best[2], best[0] - base, len(best[3]), len(best[4])
            cut(best[3], 2 * node)
            cut(best[4], 2 * node + 1)

    cut([i for i in range(len(rows)) if times[i]], 1)
    kept, frontier = {}, [1]
    while len(kept) < s.max_leaves - 1 and any(n in found for n in frontier):
        node = max((n for n in frontier if n in found), key=lambda n: (found[n][2], -n))
        kept[node] = found[node]
        frontier = [n for n in frontier if n != node] + [2 * node, 2 * node + 1]
    return kept


@pytest.mark.parametrize("s", [
    O.Settings(4, "all", 3), O.Settings(4, 2, 5, max_leaves=9, seed=3), O.Settings(3, 1, 1, max_depth=4), O.Settings(3, "sqrt", 20)])
def test_trees_equal_plain_ones_wherever_they_grow(table, s):
    ends = O.edges(table, NAMES)
    rows = O.binned(table, NAMES, ends, "label", O.draws(s.trees, ["id"], 1))
    data = [(r.y, np.frombuffer(r.bins, np.uint8), np.frombuffer(r.draws, np.uint8)) for r in rows.collect()]
    assert len(data) == 700
    want = {(t, n): v for t in range(s.trees) for n, v in plain_cuts(data, [int(d[t]) for _, _, d in data], t, s).items()}
    for local in (0, 60, 10**6):  # every cut by the aggregate, some, none
        cuts, _ = O.grow(rows, 4, [s], local)
        got = {(r.tree, r.node): (r.feature, r.bin, pytest.approx(r.gain, abs=1e-6), r.left_n, r.right_n) for r in O.best_first(cuts, [s]).collect()}
        assert got == want


def test_forests_that_grow_together_equal_forests_alone(table):
    several = [O.Settings(3, m, 3, max_leaves=k) for m, k in ((1, 10_000), (2, 12), (4, 10_000))]
    ends = O.edges(table, NAMES)
    rows = O.binned(table, NAMES, ends, "label", O.draws(3, ["id"]))
    together = list(O.fit_binned(rows, NAMES, ends, several, 50))
    for s, f in zip(several, together):
        alone = next(O.fit_binned(rows, NAMES, ends, [s]))
        key = lambda c: sorted(zip(*(c[k].tolist() for k in ("tree", "node", "feature", "bin"))))
        assert key(f.cuts) == key(alone.cuts) and max(np.bincount(f.cuts["tree"])) <= s.max_leaves - 1


def test_scores_follow_the_trees_and_survive_saving(spark, table):
    f = O.fit(table, NAMES, O.Settings(5, "all", 3), row_key=["id"])
    path = work_path(spark, "forest")
    f.save(spark, path)
    again = O.Forest.load(spark, path)
    full = table.na.drop()
    got = {r.id: r.prob for r in f.transform(full).collect()}
    assert got == {r.id: r.prob for r in again.transform(full).collect()} and len(got) == 700
    right = sum((got[r.id] > 0.5) == (r.label == 1) for r in full.collect())
    assert right > 0.85 * 700 and sum(f.importances()) == pytest.approx(1.0)
    assert sorted(f.importances(), reverse=True)[:2] == [f.importances()[0], f.importances()[1]]


def test_given_bins_and_draws(table):
    bins = [[0.0], [2.0, 3.0], [], [-1.0, 1.0]]
    f = O.fit(table, NAMES, O.Settings(2, "all", 3, max_depth=2), drawn=F.array(F.lit(1), F.col("id") % 2), bins=bins)
    assert all(b < len(bins[c]) for c, b in zip(f.cuts["feature"], f.cuts["bin"])) and 2 not in f.cuts["feature"]
    assert f.cuts["left_n"][(f.cuts["node"] == 1) & (f.cuts["tree"] == 1)] + f.cuts["right_n"][(f.cuts["node"] == 1) & (f.cuts["tree"] == 1)] == 350


def test_without_rows_or_with_one_class(spark, table):
    none = table.where("id < 0")
    assert {r.prob for r in O.fit(none, NAMES, O.Settings(2)).transform(table.na.drop()).collect()} == {0.0}
    ones = table.withColumn("label", F.lit(1))
    assert {r.prob for r in O.fit(ones, NAMES, O.Settings(2)).transform(table.na.drop()).collect()} == {1.0}


def test_class_weights_move_the_votes(table):
    heavy = table.withColumn("w", F.when(F.col("label") == 1, 50.0).otherwise(1.0))
    mean = lambda f: f.transform(table.na.drop()).agg(F.avg("prob")).first()[0]
    s = O.Settings(3, "all", 20, max_depth=2)
    assert mean(O.fit(heavy, NAMES, s, weight="w", row_key=["id"])) > mean(O.fit(table, NAMES, s, row_key=["id"])) + 0.1


def test_out_of_bag_errors_by_hand(spark, table):
    s = O.Settings(6, "all", 3)
    ends = O.edges(table, NAMES)
    rows = O.binned(table, NAMES, ends, "label", O.draws(6, ["id"]))
    f = next(O.fit_binned(rows, NAMES, ends, [s]))
    data = rows.collect()
    votes = f.votes(np.stack([np.frombuffer(r.bins, np.uint8) for r in data]))
    for r in O.oob_errors(rows, f).collect():
        wrong = seen = 0
        for i, row in enumerate(data):
            mine = [votes[i, t] for t in range(r.n_trees) if not row.draws[t]]
            if mine:
                seen += 1
                wrong += (sum(mine) / len(mine) > 0.5) != (row.y == 1)
        assert r.oob_error == pytest.approx(wrong / seen)


def test_a_row_is_hashed_once_a_tree(spark):
    """A draw compares one hash with seven steps; the draws are those of ``poisson``, tree by tree."""
    df = spark.range(500).select("id", F.col("id").cast("string").alias("name"))
    drawn = df.select(O.draws(9, ["id", "name"], 5).alias("d"))
    assert drawn._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1
    alone = df.select(F.array(*[O.poisson(F.lit(5), F.lit(t), F.col("id"), F.col("name")) for t in range(9)]).alias("d"))
    assert drawn.collect() == alone.collect()


def test_dense_cells_are_counted_and_equal_sorted_ones():
    """No sort where keys are dense and weights whole; the same cells and sums to the last bit."""
    r = np.random.default_rng(4)
    key = r.integers(0, 3 * 2 << 8, (5000, 2))
    w = r.poisson(1, 5000).astype(float)
    w0, w1 = np.where(key[:, 0] % 3 == 0, 0.0, w), np.where(key[:, 0] % 3 == 0, w, 0.0)
    kinds, argsort = [], np.argsort
    with pytest.MonkeyPatch.context() as m:
        m.setattr(np, "argsort", lambda *a, **k: kinds.append(1) or argsort(*a, **k))
        dense = O._cells(key, w0, w1, 3 * 2 << 8, True)
        assert not kinds
        plain = O._cells(key, w0, w1, 3 * 2 << 8, False)
        assert len(kinds) == 1
        assert len(O._cells(key, w0, w1, 1 << 40, True)[0]) == len(dense[0])  # sparse keys are sorted
    assert all(np.array_equal(a, b) for a, b in zip(dense, plain))


def test_bin_ends_are_quantiles_and_not_merged_in_one_task(spark, table):
    """A row a feature: each feature's sketches meet in a task of their own."""
    full = table.na.drop(subset=NAMES)
    got = O.edges(full, NAMES, 16)
    for c, ends in zip(NAMES, got):
        v = sorted(r[0] for r in full.select(c).collect())
        assert ends == sorted({v[max(0, -(-(i + 1) * len(v) // 16) - 1)] for i in range(15)})
    assert O.edges(full.where("id < 0"), NAMES) == [[], [], [], []]
    assert "SinglePartition" not in O.quantiles(full, NAMES)._jdf.queryExecution().executedPlan().toString()


def test_a_forest_grown_on_equals_one_grown_at_once(table):
    few, many = O.Settings(3, 2, 2, max_leaves=9, seed=5), O.Settings(7, 2, 2, max_leaves=9, seed=5)
    small = O.fit(table, NAMES, few, row_key=["id"])
    whole = O.fit(table, NAMES, many, row_key=["id"], bins=small.ends)
    for local in (100_000, 40):
        grown = O.fit(table, NAMES, many, row_key=["id"], local_rows=local, start=small)
        assert len(grown.trees) == 7 and grown.shares == whole.shares and grown.ends == whole.ends
        for a, b in zip(grown.trees, whole.trees):
            assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("feature", "bin", "node", "value"))
    with pytest.raises(ValueError):
        O.fit(table, NAMES, few, row_key=["id"], start=whole)
