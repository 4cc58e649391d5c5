"""Nearest neighbours against all comparisons, and their edge cases."""

import numpy as np
import pytest

from changemap.llm import ann

KIND = "vec_id long, embedding array<double>"


def plain(rows, queries, k=20):
    """All ids by falling inner product, equal ones by id."""
    clean = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in queries:
        if q in clean:
            near = [(-float((clean[q] * v).sum()), i) for i, v in clean.items() if i != q and len(v) == len(clean[q])]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def ranked(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append((r["id"], r["score"]))
        assert len(out[r["query"]]) == r["rank"]
    return out


@pytest.fixture()
def small(monkeypatch):
    """Many lists, chunks and parts on few rows."""
    for name, value in (("LIST_ROWS", 40), ("CHUNK_BYTES", 64 * 8 * 24), ("QUERY_PART", 16), ("TILE", 512)):
        monkeypatch.setattr(ann, name, value)


def recall(got, want):
    assert got.keys() == want.keys()
    for q, best in got.items():
        assert len(best) == len(want[q]) and best == sorted(best, key=lambda r: (-r[1], r[0]))
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(1, len(want[q])) for q in want])


def test_recall_over_many_lists(spark, small):
    random = np.random.default_rng(3)
    centres = random.standard_normal((12, 24))
    x = centres[random.integers(0, 12, 2000)] + 0.7 * random.standard_normal((2000, 24))
    x *= random.uniform(0.2, 3, (2000, 1))  # no unit vectors: long ones win
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, KIND).repartition(4)
    got = ranked(ann.nearest(table.where("vec_id % 20 = 0"), table))
    want = plain(rows, range(0, 2000, 20))
    assert recall(got, want) >= 0.95
    exact = {q: dict(want_all) for q, want_all in plain(rows, got, len(rows)).items()}
    assert all(abs(exact[q][i] - s) < 1e-12 * max(1, abs(s)) for q, best in got.items() for i, s in best)


def test_a_vector_that_holds_a_third_of_all_rows(spark, small):
    random = np.random.default_rng(5)
    x = random.standard_normal((1200, 16))
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, KIND).repartition(4)
    got, want = ranked(ann.nearest(table.where("vec_id % 20 = 0"), table)), plain(rows, range(0, 1200, 20))
    assert recall(got, want) >= 0.95
    assert all([i for i, _ in got[q]] == [i for i in range(0, 66, 3) if i != q][:20] for q in range(0, 1200, 60))


def test_every_test_of_a_scan_keeps_the_nearest():
    random = np.random.default_rng(9)
    y = random.standard_normal((500, 65)).astype(np.float32)
    asked = random.standard_normal((30, 65)).astype(np.float32)
    blocks = [y[:, i:i + ann.COLUMNS] for i in range(0, 65, ann.COLUMNS)]
    q, c = ann.survivors(blocks, asked, np.full(30, np.inf), 20)
    far = np.square(asked[:, None].astype(np.float64) - y).sum(axis=2)
    kept = set(zip(q.tolist(), c.tolist()))
    true = {(i, j) for i in range(30) for j in np.argsort(far[i])[:20].tolist()}
    assert len(true & kept) >= 0.98 * len(true) and len(kept) < 0.3 * far.size


def test_rows_that_take_no_part(spark):
    v = [0.6, 0.8]
    rows = [(0, v), (1, v), (1, v), (2, [3.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]),
            (20, [0.6, 0.8, 0.0]), (None, v), (9, []), (40, [-1.0, 0.0]), (60, None)]
    table = spark.createDataFrame(rows, KIND)
    for c in ("id", "query", "q", "x", "list", "score", "rank", "v", "of"):
        table = table.withColumn(c, ann.F.lit("x"))
    got = ranked(ann.nearest(table.where("vec_id % 20 = 0"), table))
    assert got == plain(rows, [0, 40]) and [i for i, _ in got[0]] == [2, 1, 40]


def test_empty_tables_and_huge_vectors(spark):
    none = spark.createDataFrame([], KIND)
    some = spark.createDataFrame([(0, [1e150, 0.0]), (1, [1e150, 1e150]), (2, [1e-200, 0.0])], KIND)
    assert ann.nearest(none, none).collect() == [] and ann.nearest(none, some).collect() == [] and ann.nearest(some, none).collect() == []
    assert [i for i, _ in ranked(ann.nearest(some.where("vec_id = 0"), some))[0]] == [1, 2]
