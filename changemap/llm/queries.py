"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changemap.llm import (
    alignment, ann, decontaminate, embeddings, html_text, langid, licences, lines, ngram_lm, packing, simhash, toxicity, whitening,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan(docs, licences.known(spark))
    return found.select("doc_id", "text_licence", F.array_join("line_licences", ",").alias("line_licences"))


def simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return groups.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "text", "n_removed")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    leak = decontaminate.scan(docs, _read(spark, sf_dir, "benchmark")).select("doc_id", "leak")
    return leak.select(
        "doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.extract(pages, html_text.train(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    model = langid.train(docs.where(~F.col("held_out")))
    found = langid.predict(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
        F.col("sequence").alias("sequence_id"), "offset",
    )


def ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).select("doc_id", "severity")
    return scored.withColumn("toxic", F.col("severity") >= toxicity.THRESHOLD)


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)))
    totals, parts = ngram_lm.fit(docs.where(~F.col("held_out")))
    return ngram_lm.score(docs, totals, parts).select(
        "doc_id", "held_out", "lm.n_tokens", "lm.n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"),
        F.col("lm.base").alias("base_score"), "lm.score",
    )


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(_read(spark, sf_dir, "documents"), digest=True)
    return found.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    found = ann.nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors)
    return found.withColumnsRenamed({"query": "query_id", "id": "vec_id"})


QUERIES = {
    "op1_embedding_near_dup": embedding_near_dup,
    "op2_licence_scan": licence_scan,
    "op3_simhash_near_dup": simhash_near_dup,
    "op4_line_dedup": line_dedup,
    "op5_decontamination": decontamination,
    "op6_language_model": language_model,
    "op7_html_main_text": html_main_text,
    "op8_language_id": language_id,
    "op9_best_fit_packing": best_fit_packing,
    "op10_ordinal_toxicity": ordinal_toxicity,
    "op11_embedding_whitening": embedding_whitening,
    "op12_tokenizer_alignment": tokenizer_alignment,
    "op13_nearest_neighbours": nearest_neighbours,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licence_sql() -> str:
    def lines_form(x: str) -> str:
        x = f"translate(chr(10) || {x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        for pattern, new in licences.STEPS:
            x = f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
        for old, new in licences.SPELLINGS:
            x = f"replace({x}, {_quoted(old)}, {_quoted(new)})"
        return x

    whole = r"sha256(trim(regexp_replace({0}, '[ \n]+', ' ', 'g')))"
    rows = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licences.KNOWN)
    return f"""
WITH raw AS (SELECT licence, {lines_form("text")} AS form FROM (VALUES {rows}) v(licence, text)),
known AS (SELECT {whole.format("form")} AS digest, min(licence) AS licence FROM raw GROUP BY 1),
docs AS (SELECT doc_id, {lines_form("text")} AS form FROM documents),
each AS (SELECT doc_id, unnest(string_split(form, chr(10))) AS x FROM docs),
found AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names
          FROM each JOIN known ON digest = sha256(trim(x)) WHERE contains(x, 'licens') OR contains(x, 'permission') GROUP BY doc_id)
SELECT docs.doc_id, known.licence AS text_licence, coalesce(names, '') AS line_licences
FROM docs LEFT JOIN known ON digest = {whole.format("form")} LEFT JOIN found ON found.doc_id = docs.doc_id"""


def _words_sql(table: str) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"SELECT *, coalesce(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM {table}"


DECONTAMINATION_SQL = f"""
WITH b AS ({_words_sql("benchmark")}),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS win
        FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i) WHERE len(ws) > 0),
d AS ({_words_sql("documents")}),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(ws) - n + 2)) t(i)),
hits AS (SELECT doc_id, i, dw.n AS n, CAST(item_id AS VARCHAR) AS item FROM dw JOIN win ON dw.win = win.win AND dw.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.a = vec_id LEFT JOIN links ON links.a = vec_id"""

ORACLES: dict[str, str] = {
    "op1_embedding_near_dup": EMBEDDING_SQL,
    "op2_licence_scan": _licence_sql(),
    "op5_decontamination": DECONTAMINATION_SQL,
}
