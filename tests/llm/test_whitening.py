"""Whitening against a dense eigendecomposition, and its edge cases."""

import numpy as np
import pytest

from changemap.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    c = (n * x - total) / n
    values, vs = np.linalg.eigh(c.T @ c / n)
    values, vs = values[::-1], vs[:, ::-1].T
    return c, values, vs, [sum(int(v) ** 2 for v in row) for row in (n * x - total).tolist()]


def by_row(rows, k):
    out = {}
    for r in rows:
        out.setdefault(r["id"], [None] * k)[r["component"] - 1] = r["whitened"]
    return out


def test_all_vectors_of_a_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = whitening.whiten(table).collect()
    given = sorted((r["vec_id"], r["embedding"]) for r in table.collect())
    c, values, vs, deviations = plain([v for _, v in given])
    got = by_row(rows, 8)
    assert list(sorted(got)) == [i for i, _ in given] and len(rows) == 8 * len(given)
    w = np.array([got[i] for i, _ in given])
    want = c @ (vs[:8] / np.sqrt(values[:8])[:, None]).T
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-9
    dev = dict(zip([i for i, _ in given], deviations))
    assert all(r["deviation"] == dev[r["id"]] and r["n"] == len(given) and r["identity_error"] < 1e-12 for r in rows)
    share = {r["component"]: r["explained"] for r in rows}
    assert np.allclose([share[i + 1] for i in range(8)], values[:8] / values.sum(), rtol=1e-12)


@pytest.mark.parametrize("scales", [[5] * 12, [9, 9, 9, 4, 4, 1], [100, 1], [7] + [1e-3] * 11, [1] * 4 + [0] * 5])
def test_equal_and_vanishing_spreads(scales):
    random = np.random.default_rng(4)
    q = np.linalg.qr(random.standard_normal((len(scales), len(scales))))[0]
    x = np.linalg.qr(random.standard_normal((60, len(scales))))[0] * scales @ q
    s, vs = whitening.bidiagonalise(lambda w, b: (x.T @ (x @ w), (x @ b.T).T @ (x @ w), float(np.square(x @ w).sum())), len(scales), 8)
    assert np.allclose(s, np.sort(scales)[::-1][:8], atol=1e-10 * max(scales))
    assert np.allclose(vs @ vs.T, np.eye(len(vs)), atol=1e-10)
    assert np.allclose(x.T @ (x @ vs.T), vs.T * s * s, atol=1e-9 * max(scales) ** 2)


def test_rows_left_out_and_rows_that_count(spark):
    random = np.random.default_rng(2)
    good = [(i, random.standard_normal(3).tolist()) for i in range(30)]
    rows = [*good, (3, good[3][1]), (None, good[4][1]), (90, [0.0, 0.0, 0.0]), (91, None), (92, []), (93, [1.0, None, 2.0]), (94, [float("nan"), 1.0, 1.0]),
            (95, [float("inf"), 1.0, 1.0]), (96, [1e300, 0.0, 0.0]), (97, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", whitening.F.lit("x")).withColumn("id", whitening.F.lit("y"))
    got = whitening.whiten(table.repartition(3)).collect()
    assert sorted({r["id"] for r in got if r["id"] is not None}) == [*range(30), 90] and len(got) == 3 * 33
    c, values, _, deviations = plain([v for _, v in rows[:33]])
    assert {r["n"] for r in got} == {33} and {r["deviation"] for r in got if r["id"] == 90} == {deviations[32]}
    assert np.allclose(sorted({r["explained"] for r in got}, reverse=True), values / values.sum(), rtol=1e-12)


def test_without_rows_or_spread(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], kind)).collect() == []


def test_numbers_beyond_a_long(spark):
    rows = [(0, [2.0**50, 0.0]), (1, [0.0, 1.0]), (2, [-(2.0**49), 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in got} == {None} and all(r["identity_error"] < 1e-6 for r in got if r["component"] == 1)
