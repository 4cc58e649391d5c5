"""Line dedup against the rule of all pairs of lines, and on planted passages."""

import random
import re

from pyspark.sql import functions as F

from changemap.llm import lines, queries

SF = "/root/testdata/sf0.001"


def plain_pairs(docs):
    """Every pair of neighbouring lines that stands earlier too goes, in runs of MIN_LINES and MIN_CHARS."""
    parts = {i: [m[0] for m in re.finditer(lines.LINE, t)] for i, t in docs.items()}
    first, out = {}, {}
    for i in sorted(parts):
        for k, pair in enumerate(zip(parts[i], parts[i][1:])):
            first.setdefault(pair, (i, k))
    for i, p in parts.items():
        hit = [False] * len(p)
        for k, pair in enumerate(zip(p, p[1:])):
            if first[pair] != (i, k):
                hit[k] = hit[k + 1] = True
        runs = []
        for h, x in zip(hit, p):
            if runs and runs[-1][0] == h:
                runs[-1][1].append(x)
            else:
                runs.append((h, [x]))
        out[i] = "".join("".join(c) for h, c in runs if not (h and len(c) >= lines.MIN_LINES and len("".join(c)) >= lines.MIN_CHARS))
    return out


def test_every_repeated_pair_is_found(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = plain_pairs(docs)
    got = {r["doc_id"]: r for r in queries.line_dedup(spark, SF).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_removed"] == len(docs[i]) - len(want[i]) for i, r in got.items())


def test_planted_passages_go_whole(spark):
    """Passages of 51 to 110 words, each in the middle of two texts: the first keeps it, the second loses all of it."""
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    some = lambda n: "".join(f"{words(7)}. " for _ in range(n))
    docs = {}
    for k, n in enumerate(range(51, 111)):
        passage = "".join(f"{words(m)}{r.choice(['. ', ', ', chr(10)])}" for m in (7,) * (n // 7 - 1) + (n - 7 * (n // 7 - 1),))
        docs |= {10 * k + j: (some(2 + j), passage, some(4 - j)) for j in range(2)}
    frame = spark.createDataFrame([(i, "".join(t)) for i, t in docs.items()], "doc_id long, text string")
    out = {x["doc_id"]: x["text"] for x in lines.dedup_lines(frame).collect()}
    for i, (before, passage, after) in docs.items():
        assert out[i] == (before + after if i % 10 else before + passage + after)


def test_a_hash_of_two_texts_is_found(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a. b. c. "), (2, "a. b. d. "), (2, "x. y. "), (3, None)], "id long, text string")
    rows = lines._pairs(docs).selectExpr("id", "posexplode(pairs) AS (k, h)")
    found = lambda rows: docs.join(rows.groupBy("id").agg(F.collect_set(F.struct("k", "h")).alias("_places")), "id", "left")
    assert lines._ambiguous(found(rows)).collect() == []
    # every pair has the same hash
    monkeypatch.setattr(lines.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert [r["h"] for r in lines._ambiguous(found(rows.withColumn("h", F.lit(7).cast("long")))).collect()] == [7]
