"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import numpy as np
import pytest

import corpus_pipeline
from changemap.llm import decontaminate, embeddings, html_text, langid, licences, lines, ngram_lm, packing, simhash, toxicity

LONG = "word " * 40_000 + "end."
ROWS = [
    (1, "The quick brown fox, jumps over it. And on.", "en", "a", 40), (1, "The quick brown fox, jumps over it. And on.", "en", "a", 40),
    (2, None, "en", "a", None), (3, "", None, None, 0), (4, LONG, "en", "b", 1), (None, "no id here", "en", "b", 1), (5, " \t\n", "de", "b", 3),
    (6, "\U0001F600 ñ é \u0000 |", "es", "b", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("leak", "lm", "language", "severity", "n_removed", "chunks", "id", "h", "k", "c", "first", "length", "size", "bucket", "marks", "hit",
         "_lines", "_Places", "_place_id", "_no", "_found", "_marks", "_starts", "_gone", "_rest", "_digest", "_of_lines", "_severity", "_toxic", "_raw")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox"), (None, "word word"), (2, None), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


def operators(spark, docs, bench, labels):
    yield lines.dedup_lines(docs), len
    yield simhash.near_duplicates(docs), len
    yield decontaminate.scan(docs, bench), len
    totals, parts = ngram_lm.fit(docs)
    yield ngram_lm.score(docs, totals, parts), len
    yield langid.predict(docs, langid.train(docs)), len
    yield licences.scan(docs, licences.known(spark)), len
    yield toxicity.score(docs, toxicity.train(docs, labels)), len
    yield packing.pack(docs), None


def test_every_row_comes_back(spark, docs, bench, labels):
    for out, rows in operators(spark, docs, bench, labels):
        got = out.collect()
        assert rows is None or len(got) == len(ROWS)


def test_empty_tables(spark, docs, bench, labels):
    none = docs.limit(0)
    for out, _ in operators(spark, none, bench.limit(0), labels.limit(0)):
        assert out.collect() == []
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(vectors).collect() == []
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).where("severity >= 0.2").count() == 0


def test_clashing_columns_pass_through(spark, docs, bench, labels):
    wide = docs
    for c in CLASH:
        wide = wide.withColumn(c, wide["source"])
    kept = set(CLASH) - {"leak", "lm", "language", "severity", "n_removed"}
    for out, rows in operators(spark, wide, bench, labels):
        assert out.count() >= len(ROWS)
        if rows and "text" in out.columns:
            assert kept <= set(out.columns)
            assert len(out.columns) == len(set(out.columns))
            assert out.where("doc_id = 4").select("marks", "hit", "length", "_lines", "_Places", "_severity").first() == ("b",) * 6
    kept = toxicity.drop_toxic(wide, labels)
    assert kept.columns == wide.columns and kept.where("doc_id = 5").select("_severity", "_raw").first() == ("b", "b")


def test_one_of_several_texts_with_an_id_counts(spark):
    rows = [(i, f"{'bad' if i % 2 else 'good'} word number {i}") for i in range(40)]
    more = [(i, f"zzz other text {i} of the same id") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    of = lambda x: toxicity.train(spark.createDataFrame(x, "doc_id long, text string").repartition(3), labels)
    one, two = of(rows), of([*more, *rows])
    assert (one.weights == two.weights).all() and (one.cuts == two.cuts).all()


def test_defined_results(spark, docs, bench, labels):
    leak = {r["doc_id"]: r["leak"] for r in decontaminate.scan(docs, bench).collect()}
    assert leak[2]["n_words"] == leak[3]["n_words"] == leak[5]["n_words"] == 0 and leak[1]["items"] == ["1"]
    assert leak[4]["n_hit"] == 0 and leak[4]["n_words"] == 40_001
    print_of = {r["id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert print_of[2]["fp"] == print_of[3]["fp"] == print_of[5]["fp"] == 0
    assert {print_of[i]["component"] for i in (2, 3, 5)} == {2}
    lang = {r["doc_id"]: r["language"] for r in langid.predict(docs, langid.train(docs)).collect()}
    assert all(lang[i]["lang"] == "und" and lang[i]["score"] == 0 for i in (2, 3, 5))
    totals, parts = ngram_lm.fit(docs)
    lm = {r["doc_id"]: r["lm"] for r in ngram_lm.score(docs, totals, parts).collect()}
    assert lm[2]["n_tokens"] == lm[3]["n_tokens"] == lm[5]["n_tokens"] == 1 and lm[4]["n_tokens"] == 40_002
    packed = packing.pack(docs).collect()
    assert sum(r["length"] for r in packed if r["id"] == 2) == 1


def test_pages_without_text(spark):
    model = html_text.Labeller()
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>"), (4, "<script>var a=1"), (5, "<b <i> & x"), (1, None)], "page_id long, html string")
    got = html_text.extract(pages.withColumn("main_text", pages["html"]), model).collect()
    assert len(got) == 6 and all(r["main_text"] == "" for r in got if r["page_id"] < 5)
    assert html_text.extract(pages.limit(0), model).count() == 0


def test_vectors_that_cannot_be_compared(spark):
    v = [0.6, 0.8]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [0.6, 0.8, 0.0]), (None, v), (9, [])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    by_id = {r["id"]: (r["n_links"], r["component"]) for r in got}
    assert by_id[1] == (1, 1) and by_id[2] == (1, 1) and by_id[None] == (0, None)
    assert all(by_id[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9))


def test_links_just_above_and_below_the_threshold(spark):
    rows = []
    for k, off in enumerate((-1e-8, -1e-12, 1e-8, 1e-6, 3e-5, -3e-5)):
        c = 0.95 + off
        turn = np.eye(16)[2 * k], np.eye(16)[2 * k + 1]
        rows += [(10 * k, turn[0].tolist()), (10 * k + 1, (c * turn[0] + np.sqrt(1 - c * c) * turn[1]).tolist())]
    got = {r["id"]: (r["n_links"], r["component"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for k, near in enumerate((False, False, True, True, True, False)):
        assert got[10 * k] == (int(near), 10 * k) and got[10 * k + 1] == (int(near), 10 * k + (not near))


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    bench = [(1, "quick brown fox")]
    spark.createDataFrame(ROWS, SCHEMA).withColumn("id", np_lit()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names, name
    left = {r["doc_id"] for r in docs.collect()}
    assert 1 not in left and {2, 4, 6, None} <= left and not {3, 5} & left
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == left


def np_lit():
    from pyspark.sql import functions as F

    return F.lit(np.int32(7).item())
