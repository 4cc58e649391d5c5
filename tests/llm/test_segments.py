"""A filter of several segments: equal scores, one segment held at a time; probabilities."""

import numpy as np
from pyspark.sql import functions as F

from changemap.llm import decontaminate, ngram_lm


def test_segments_are_dropped_one_by_one(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i} and {i % 3} more") for i in range(40)], "doc_id long, text string")
    totals, parts = ngram_lm.fit(docs)
    one = {r["doc_id"]: r["lm"] for r in ngram_lm.score(docs, totals, parts).collect()}
    monkeypatch.setattr(ngram_lm, "SEGMENT_BYTES", 400)
    totals, parts = ngram_lm.fit(docs)
    assert totals.segments > 2
    scored = ngram_lm.score(docs.withColumn("x", F.lit(1)), totals, parts)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("scored(") == 1
    for r in scored.collect():
        assert r["lm"]["n_tokens"] == one[r["doc_id"]]["n_tokens"] and r["lm"]["n_known"] == one[r["doc_id"]]["n_known"]
        assert abs(r["lm"]["base"] - one[r["doc_id"]]["base"]) < 1e-9
        assert abs(r["lm"]["score"] - one[r["doc_id"]]["score"]) < 0.05 * r["lm"]["n_tokens"]


def test_scores_are_probabilities(spark):
    """No word has a probability above one, however its counts were rounded, and those of a context add up to about one."""
    docs = spark.createDataFrame([(i, f"{'a b ' * 64}c a b d{i % 7} b e" if i % 2 else "b b b x y") for i in range(64)], "doc_id long, text string")
    totals, parts = ngram_lm.fit(docs)
    seg, memo = ngram_lm._segment(parts, 0, totals.buckets), ngram_lm._Hashes()
    words = sorted({w.encode() for r in docs.collect() for w in r["text"].split()})
    for context in words:
        texts = [ngram_lm.token_hashes(context + b" " + w, memo) for w in words]
        sizes = np.array([len(t) for t in texts])
        _, levels = ngram_lm.look_up(texts, seg, totals)
        logs = ngram_lm.log_probabilities(levels, sizes, totals)
        assert (logs <= 0).all()
        # the word behind the context in each text, and the end behind the context alone
        _, alone = ngram_lm.look_up([ngram_lm.token_hashes(context, memo)], seg, totals)
        end = 10 ** ngram_lm.log_probabilities(alone, np.array([2]), totals)[1]
        assert 0.7 < (10 ** logs[1::3]).sum() + end < 1.4


def test_a_context_always_before_one_word(spark):
    docs = spark.createDataFrame([(i, "q r " * 64 + "r " * (i % 90)) for i in range(64)], "doc_id long, text string")
    totals, parts = ngram_lm.fit(docs)
    seg, memo = ngram_lm._segment(parts, 0, totals.buckets), ngram_lm._Hashes()
    _, levels = ngram_lm.look_up([ngram_lm.token_hashes(b"q r", memo)], seg, totals)
    assert 0.9 < 10 ** ngram_lm.log_probabilities(levels, np.array([3]), totals)[1] <= 1


def test_slices_are_scanned_one_by_one(spark):
    docs = spark.createDataFrame([(i, "some words " * i + f"one two three {i} four") for i in range(6)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"three {i} four") for i in range(6)] + [(9, " ".join(f"w{k}" for k in range(40)))], "item_id long, text string")
    slices = list(decontaminate._slices(bench, "item_id", "text", 5))
    assert len(slices) > 5 and max(map(len, slices)) == 5
    one = decontaminate.scan(docs, bench)
    many = decontaminate.scan(docs, bench, slice_windows=2)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("matched(") == 1
    assert sorted(one.collect()) == sorted(many.collect())
