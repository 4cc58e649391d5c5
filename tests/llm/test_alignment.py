"""Token alignment against a plain version, with pieces of every size."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest

from changemap.llm import alignment, queries

SF = "/root/testdata/sf0.001"
ODD = [
    (9000, None), (9001, ""), (9002, " "), (9003, "\n x  y "), (9004, "▁ a"), (9005, "<s> <|endoftext|> é́ 漢字 \U0001F600 x </s>"),
    (9006, "a\u0000b c"), (9007, "w" * 3000), (9008, "twice"), (9008, "other"), (9008, "twice"), (None, "no id"), (9009, "ﬁ ½ x"),
    (9010, "x ▁y z  q"), (9011, "Привет мир 世界 です"), (9012, "tab\tand\r\nlines \n\n end. "),
]


@pytest.fixture(scope="module")
def tok():
    return alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def slow():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(f" {text}", add_special_tokens=False).ids


def plain(rows, tok, slow):
    """Every pair of neighbouring tokens looked at, one after the other."""
    found, counts = [], collections.Counter()
    for i, text in rows:
        a, b = (slow(text), tok.b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [tok.bytes_a[x] for x in a], [tok.bytes_b[x] for x in b]
        if not text or b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links, j = [], 0
        for k, x in enumerate(a):
            start = ends_a[k] - len(bytes_a[k])
            while ends_b[j] <= start:
                j += 1
            n = j
            while n < len(b) and ends_b[n] - len(bytes_b[n]) < ends_a[k]:
                links.append((x, b[n]))
                n += 1
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)) if a else ():
            m, n = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
            groups.append(",".join(map(str, a[x:m])) + "|" + ",".join(map(str, b[y:n])))
            x, y = m, n
        counts.update(links)
        found.append((i, len(a), len(b), groups, links))
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(i, a, b, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), ";".join(g)) for i, a, b, g, k in found]


def order(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def results(found):
    return sorted(((r["id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in found.collect()), key=order)


@pytest.mark.parametrize("piece, block", [(7, 40), (64, 500), (1000, 3000), (alignment.PIECE, alignment.BLOCK)])
def test_pieces_of_every_size_give_the_same(spark, tok, slow, piece, block):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40 if piece < 64 else 120).collect()]
    rows = texts + ODD
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("id", "block", "pair", "part", "groups", "n", "row"):
        table = table.withColumn(c, alignment.F.lit("x"))
    assert results(alignment.align(table, piece=piece, block=block)) == sorted(plain(rows, tok, slow), key=order)


def test_the_query_hashes_the_groups(spark, tok, slow):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {w[0]: w for w in plain(rows, tok, slow)}
    got = queries.tokenizer_alignment(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == w[1:7]
        assert r["groups_sha256"] == (hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "")


def test_every_character_is_encoded_as_the_json_file_says(tok, slow):
    text = "".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}" for c in [*range(1, 0x3000), *range(0xA000, 0xA100), *range(0x1F300, 0x1F400)])
    ids, _ = tok.encode([text.replace("▁", "")])[0]
    assert not len(ids) or ids.tolist() == slow(text.replace("▁", ""))
    assert tok.a.encode_ordinary(f" {text}") == slow(text)


def test_diagonals_divide_evenly_and_keep_equal_ends():
    random = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(random.integers(1, 400, random.integers(1, 120))) for _ in range(2))
        end = max(a[-1], b[-1]) + 1
        a, b = np.append(a, end), np.append(b, end)
        step = int(random.integers(2, 50))
        cuts = alignment.diagonals(a, b, step)
        assert cuts[0].tolist() == [0, 0] and cuts[-1].tolist() == [len(a), len(b)]
        work = np.diff(cuts.sum(axis=1))
        assert work.max() <= step + 1 and (work[:-1] >= step - 1).all() and work.sum() == len(a) + len(b)
        for i, j in cuts[1:-1]:
            assert max(a[i - 1] if i else 0, b[j - 1] if j else 0) < min(a[i], b[j])


def test_long_texts_in_windows_and_empty_tables(spark, tok, slow, monkeypatch):
    monkeypatch.setattr(alignment, "WINDOW", 300)
    text = "Some words, here; and there  twice \n" * 200
    ids, _ = tok.encode(["short", text, None])[1]
    assert ids.tolist() == slow(text)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
