import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions.median import counted_median, grouped_agg, image
from changemap.functions.moments import moments, reducer


def frame(spark, groups):
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "k string, v double")


def test_seven_statistics_match_pandas(spark):
    rng = random.Random(1)
    groups = {f"n{n}": [rng.gauss(3, 2) for _ in range(n)] for n in (1, 2, 3, 4, 5, 30)}
    got = {r.k: r for r in frame(spark, groups).groupBy("k").agg(*moments("v", prefix="")).collect()}
    for k, vs in groups.items():
        s = pd.Series(vs)
        want = dict(mean=s.mean(), stdDev=s.std(), median=s.median(), min=s.min(), max=s.max(), skew=s.skew(), kurtosis=s.kurt())
        for name, w in want.items():
            g = got[k][name]
            assert (g is None and math.isnan(w)) or g == pytest.approx(w, rel=1e-9), (k, name)


def test_constant_and_all_null_groups(spark):
    df = frame(spark, {"c": [0.1] * 7, "z": [None, None]})
    got = {r.k: r for r in df.groupBy("k").agg(*moments("v", prefix="")).collect()}
    assert (got["c"].skew, got["c"].kurtosis, got["c"].stdDev) == (0.0, 0.0, 0.0)
    assert all(got["z"][r] is None for r in P.REDUCERS)


def test_unknown_reducer_raises():
    with pytest.raises(ValueError):
        reducer("mode", "v")


def test_grouped_agg_is_exact_for_hot_and_small_groups(spark):
    rng = random.Random(2)
    groups = {
        "one": [5.0],
        "even": [1.0, 9.0, 2.0, 4.0],
        "dups": [7.0] * 500 + [1.0] * 499,
        "skewed": [rng.paretovariate(0.5) for _ in range(2001)],
        "nulls": [None, 3.0, None, 8.0, None, None],
        "empty": [None] * 6,
        "signs": [-1e300, -2.5, -2.4, 0.0, -0.0, 1e-9, 3.0, float("inf")],
        None: [1.0, 2.0, 9.0],
    }
    df = frame(spark, groups)
    out = grouped_agg(df, ["k"], [F.count("v").alias("n"), F.max("v").alias("top")], {"mid": "v"})
    got = {r.k: r for r in out.collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs = [v for v in vs if v is not None]
        assert got[k].n == len(vs)
        assert got[k].mid == (pytest.approx(np.median(vs), rel=1e-12) if vs else None)


@pytest.mark.parametrize("small", [0, 40, 10**6])
def test_the_same_medians_counted_and_ranked(spark, small):
    rng = random.Random(6)
    groups = {
        "narrow": [rng.uniform(1000, 1010) for _ in range(400)], "ties": [1.5] * 60 + [2.5] * 60, "tiny": [5e-324, 1e-323, 2.2e-308, -5e-324],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(301)], "ends": [float("-inf"), -1e308, 1e308, float("inf")],
        "zeros": [-0.0, 0.0, -0.0], "one": [3.25], None: [float(x) for x in range(50)], "none": [None] * 50,
    }
    got = {r.k: r.mid for r in grouped_agg(frame(spark, groups), ["k"], [F.count("v").alias("n")], {"mid": "v"}, small).collect()}
    for k, vs in groups.items():
        vs = [v for v in vs if v is not None]
        assert got[k] == (pytest.approx(np.median(vs), rel=1e-12) if vs else None), k


def test_images_keep_the_order_of_doubles(spark):
    rng = np.random.default_rng(3)
    raw = rng.integers(-(2**63), 2**63 - 1, 20_000, np.int64).view(np.float64)
    edges = [0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), *[2.0**e for e in range(-1074, 1024, 7)]]
    near = [np.nextafter(2.0**e, -np.inf) for e in range(-1000, 1024, 9)]
    v = np.concatenate((raw[np.isfinite(raw)], edges, near, np.negative(edges)))
    got = [r._i for r in image(spark.createDataFrame([(float(x),) for x in v], "_v double")).collect()]
    bits = np.abs(v).view(np.int64)
    assert got == np.where(v < 0, -bits, bits).tolist()


def test_no_task_holds_a_hot_group_of_close_values(spark):
    """One group has nearly all rows, between 1000 and 1010: in every stage that reads a shuffle, rows are
    dealt out, or few."""
    n = 40_000
    df = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(99).alias("k"), (1000 + F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e8).alias("v"))
    rows = [r.v for r in df.where("k = 99").collect()]
    values = df.select("k", F.lit(0).alias("_b"), F.col("v").alias("_v")).groupBy("k", "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    most = values.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count"), F.avg("count")).first()
    assert most[0] < 3 * most[1]
    out = grouped_agg(df, ["k"], [F.count("v").alias("n")], {"mid": "v"}, 10_000)
    assert {r.k: r.mid for r in out.collect()}[99] == pytest.approx(np.median(rows), rel=1e-15)
    plan = counted_median(df, ["k"], {"mid": "v"})._jdf.queryExecution().sparkPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 4 and all("sum(_m" in line or "count(1)" in line for line in windows)  # over counts only
    assert "percentile" not in plan


def test_rounds_vanish_where_no_group_is_large(spark):
    df = frame(spark, {"a": [1.0, 2.0, 4.0], "b": [3.0]})
    out = grouped_agg(df, ["k"], [F.count("v").alias("n")], {"mid": "v"})
    assert {r.k: r.mid for r in out.collect()} == {"a": 2.0, "b": 3.0}
    out = grouped_agg(df, ["k"], [F.count("v").alias("n")], {"mid": "v"})
    query = out._jdf.queryExecution()
    query.executedPlan().execute().count()
    final = query.executedPlan().finalPhysicalPlan().toString()
    assert "Window" not in final


def test_median_of_repeated_and_close_values(spark):
    vs = [float(x * x % 997) for x in range(3000)]
    got = {r.k: r.mid for r in grouped_agg(frame(spark, {"a": vs, "b": vs[:7]}), ["k"], [], {"mid": "v"}).collect()}
    assert got == {"a": np.median(vs), "b": np.median(vs[:7])}
