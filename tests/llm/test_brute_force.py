"""Every operator against a plain version on small or given data."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from changemap.llm import decontaminate, embeddings, html_text, langid, licences, lines, ngram_lm, packing, queries, simhash, toxicity
from changemap.llm.graph import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


class Union:
    def __init__(self, nodes):
        self.up = {x: x for x in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3), (8, 7)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in [7, 8, *range(200, 260)]) and 5 not in got


def test_simhash_fingerprints(spark, texts):
    got = {r["doc_id"]: r for r in queries.simhash_near_dup(spark, SF).collect()}

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: plain(t) for i, t in texts.items()}
    assert all(got[i]["fingerprint"] == f"{p:016x}" for i, p in prints.items())
    u = Union(prints)
    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                u.link(i, j)
    assert all(got[i]["component_id"] == u.find(i) for i in prints)


def test_simhash_links_at_every_distance(spark):
    r = random.Random(1)
    prints = set()
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(9):
            prints.add(x)
            y = x
            for k in r.sample(range(64), r.choice([1, 2, 3, 4])):
                y ^= 1 << k
            x = y if r.random() < 0.4 else x
            prints.add(y)
    prints = sorted(prints)
    u = Union(prints)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                u.link(a, b)
    rows = [(simhash._signed(x),) for x in prints]
    got = {r["id"] % 2**64: r["root"] % 2**64 for r in components(simhash.links(spark.createDataFrame(rows, "fp long"))).collect()}
    classes, want = collections.defaultdict(set), collections.defaultdict(set)
    for x in prints:
        classes[got.get(x, x)].add(x)
        want[u.find(x)].add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_decontamination(spark, texts):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(t):
        return word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = collections.defaultdict(set)
    for i, t in bench.items():
        w = words(t)
        for k in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[k:k + 10])].add(str(i))
    sizes = {len(w) for w in windows}
    found = 0
    for r in queries.decontamination(spark, SF).collect():
        w, hit, items = words(texts[r["doc_id"]]), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(w[k:k + n])]
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(items), digest, bool(hit))
        found += bool(hit)
    assert found


def test_decontamination_in_slices_and_offsets(spark):
    text = "Éa. Some, WORDS here: one two three; four five six seven -- eight nine ten eleven!"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "some words"), (3, "eleven")], "item_id long, text string")
    for limit in (1, 50_000):
        leak = decontaminate.scan(docs, bench, slice_windows=limit).first()["leak"]
        assert leak["items"] == ["1", "2", "3"] and leak["n_hit"] == 13
        assert [text[s["start"]:s["end"]] for s in leak["spans"]] == ["Some, WORDS", "one two three; four five six seven -- eight nine ten eleven"]


def plain_lines(docs):
    """Lines that go: each is in a pair of neighbours that also stands earlier. Every text is held against
    every place of all texts up to it."""
    parts = {i: [m[0] for m in re.finditer(lines.LINE, t)] for i, t in docs.items()}
    places = collections.defaultdict(list)
    for i in sorted(parts):
        for k in range(len(parts[i]) - 1):
            places[parts[i][k]].append((i, k))
    out = {}
    for i, p in parts.items():
        gone = set()
        for k in range(len(p) - 1):
            if any(at < (i, k) and parts[at[0]][at[1] + 1] == p[k + 1] for at in places[p[k]]):
                gone |= {k, k + 1}
        kept, run = [], []
        for k in range(len(p) + 1):
            if k in gone:
                run.append(p[k])
                continue
            if len(run) < lines.MIN_LINES or len("".join(run)) < lines.MIN_CHARS:
                kept += run
            run = []
            kept += p[k:k + 1]
        out[i] = "".join(kept)
    return out


def test_line_dedup(spark, texts):
    got = {r["doc_id"]: r for r in queries.line_dedup(spark, SF).collect()}
    want = plain_lines(texts)
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_removed"] == len(texts[i]) - len(want[i]) for i, r in got.items())
    assert any(r["n_removed"] for r in got.values())


def test_passages_go_wherever_they_stand(spark):
    """Forty passages of 84 words, each in the middle of three texts: the first text keeps it,
    the others lose nearly all of them in great part, and nothing else."""
    r = random.Random(3)
    sentence = lambda: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(7)) + ". "
    some = lambda n: "".join(sentence() for _ in range(n))
    passages = [some(12) for _ in range(40)]
    docs = {100 * k + j: (some(2 + j), p, some(5 - j)) for k, p in enumerate(passages) for j in range(3)}
    frame = spark.createDataFrame([(i, "".join(t)) for i, t in docs.items()], "doc_id long, text string")
    out = {x["doc_id"]: x["text"] for x in lines.dedup_lines(frame).collect()}
    shares = []
    for i, (before, passage, after) in docs.items():
        if i % 100 == 0:
            assert out[i] == "".join(docs[i])
            continue
        assert out[i].startswith(before) and out[i].endswith(after)
        shares.append(1 - (len(out[i]) - len(before) - len(after)) / len(passage))
    assert np.mean(np.array(shares) > 0) >= 0.95 and np.mean(shares) > 0.6


def test_packing_round_trip(spark, texts):
    rows = queries.best_fit_packing(spark, SF).collect()
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in texts.items()}
    of = collections.defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    assert set(of) == set(texts)
    for i, ps in of.items():
        ps.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in ps] == list(range(len(ps)))
        at = 0
        for p in ps:
            own = np.array(ids[i][at:at + p["length"]], "<u4")
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(own.tobytes()) and (len(ps) == 1 or p["piece"] == 0 or p["length"] == 2048)
            at += p["length"]
        assert at == len(ids[i])
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(sequences) <= -(-total // 2048) * 1.02 + 1


def test_encoder_gives_the_ids_of_the_json_file():
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.ids_of(b"hello <|endoftext|> world", packing.vocabulary_path()).tolist() == [31373, 220, 50256, 995, 0]
    for x in ("<|endoftext|> a", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext|", "  <|endoftext|>  \n x", "a  \n\n b\t", "naïve ñ \U0001F600 ’s 12,3", " ", "x" * 3000):
        assert packing.ids_of(x.encode(), packing.vocabulary_path()).tolist() == [*t.encode(x, add_special_tokens=False).ids, 0]


def test_packing_plan_is_near_the_bound():
    r = np.random.default_rng(0)
    for n in (1, 50, 5000):
        sizes, counts = np.unique(r.integers(1, 2049, n), return_counts=True)
        runs = dict(zip(sizes.tolist(), counts.tolist()))
        plan = packing.plan_runs(runs)
        done, fill = collections.Counter(), collections.defaultdict(list)
        for size, rank, k, sequence, offset in plan:
            assert rank == done[size]
            done[size] += k
            for s in range(sequence, sequence + k):
                fill[s].append((offset, size))
        assert done == runs
        for parts in fill.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at <= 2048
        need = max(-(-int((sizes * counts).sum()) // 2048), sum(c for s, c in runs.items() if s > 1024))
        assert len(fill) <= 1.05 * need + 1


def test_language_model(spark, texts):
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c, pairs = collections.Counter(), collections.Counter()
    for i, w in tokens.items():
        if not held[i]:
            c.update(w)
            pairs.update(zip(["\n", *w], w))
    n, v = sum(c.values()), len(c)
    base = lambda x: (c[x] + 0.1) / (n + 0.1 * (v + 1))
    gain = []
    for r in queries.language_model(spark, SF).collect():
        w = tokens[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(w) and r["train_tokens"] == n
        assert r["n_known"] == sum(c[x] > 0 for x in w)
        assert math.isclose(r["base_score"], sum(math.log10(base(x)) for x in w), rel_tol=1e-9)
        exact = sum(math.log10((pairs[p] + ngram_lm.PRIOR * base(p[1])) / (c[p[0]] + ngram_lm.PRIOR)) for p in zip(["\n", *w], w))
        gain.append((r["score"] - exact) / len(w))
    assert abs(np.mean(gain)) < 0.06  # quantised counts and false answers


def test_language_model_in_segments(spark, texts, monkeypatch):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    one = {r["doc_id"]: r["lm"] for r in ngram_lm.score(docs, *ngram_lm.fit(docs)).collect()}
    monkeypatch.setattr(ngram_lm, "SEGMENT_BYTES", 150_000)
    totals, parts = ngram_lm.fit(docs)
    assert totals.segments > 2
    for r in ngram_lm.score(docs, totals, parts).collect():
        a, b = one[r["doc_id"]], r["lm"]
        assert (a["n_tokens"], a["n_known"]) == (b["n_tokens"], b["n_known"]) and math.isclose(a["base"], b["base"], rel_tol=1e-9)
        assert abs(a["score"] - b["score"]) < 0.1 * b["n_tokens"]


def test_embeddings_with_a_wide_and_a_dense_group(spark):
    r = np.random.default_rng(5)
    x = [*r.normal(size=(300, 24))]
    for spread in (0.02, 0.05, 0.1):  # within the threshold, at its edge, beyond
        centre = r.normal(size=24)
        x += [centre + r.normal(size=24) * spread * np.linalg.norm(centre) / math.sqrt(24) * 2.2 for _ in range(120)]
    x += [x[0]] * 40
    x = np.array(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    near = (sims >= 0.95) & ~np.eye(len(x), dtype=bool)
    sure = (np.abs(sims - 0.95) > 1e-9).all()
    u = Union(range(len(x)))
    for i, j in zip(*np.nonzero(near)):
        u.link(int(i), int(j))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["id"]: r for r in embeddings.near_duplicates(frame).collect()}
    assert sure and sum(r["n_links"] for r in got.values()) >= 0.98 * near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in got)
    assert np.mean([got[i]["component"] == u.find(i) for i in got]) >= 0.98


def test_embeddings_query_recall(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = ((x @ x.T) >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r for r in queries.embedding_near_dup(spark, SF).collect()}
    assert len(got) == len(ids) and sum(r["n_links"] for r in got.values()) >= 0.98 * links.sum()
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_languages_of_texts_held_out(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    lang = {r["doc_id"]: r["lang"] for r in rows}
    got = [r for r in queries.language_id(spark, SF).collect() if r["held_out"]]
    assert got and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_grams_do_not_depend_on_slices(monkeypatch):
    text = "Der Ärger, 12 of the ñandú " * 50
    whole = langid.text_counts(text)
    monkeypatch.setattr(langid, "CHARS", 7)
    assert (langid.text_counts(text) == whole).all()
    assert whole.sum() == 3 * len(text) - 3


def test_page_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in queries.html_main_text(spark, SF).collect()}
    right = 0
    for r in pages.collect():
        blocks = html_text.blocks_of(r["html"])
        want = "\n".join(b.text for b, y in zip(blocks, html_text.weak_labels(blocks)) if y)
        right += got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    assert right >= 0.95 * len(got)


def test_labeller_on_made_pages_it_has_not_seen():
    features, data, labels = html_text.Features(), [], []
    for page, article in html_text.made_pages(500):
        blocks = html_text.blocks_of(page)
        data.append(features.of(blocks))
        labels.append(np.array([float(b.text in article) for b in blocks]))
    net = html_text.Labeller().fit(data, labels)
    wrong = n = 0
    for page, article in html_text.made_pages(60, seed=11):
        blocks = html_text.blocks_of(page)
        p = net.scores([features.of(blocks)])[0]
        wrong += sum((x > 0.5) != (b.text in article) for x, b in zip(p, blocks))
        n += len(blocks)
    assert wrong / n < 0.03


def test_labeller_gradients():
    features = html_text.Features()
    pages = [html_text.blocks_of(p) for p, _ in html_text.made_pages(3)]
    data, labels = [features.of(b) for b in pages], [np.arange(len(b)) % 2.0 for b in pages]
    net = html_text.Labeller()

    def loss():
        p, y = np.concatenate(net.scores(data)), np.concatenate(labels)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net.gradients(data, labels)
    for name in net.w:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = net.w[name][at]
        net.w[name][at] = old + 1e-5
        up = loss()
        net.w[name][at] = old - 1e-5
        down = loss()
        net.w[name][at] = old
        assert math.isclose((up - down) / 2e-5, g[name][at], rel_tol=1e-3, abs_tol=1e-7)


def test_blocks():
    page = "<nav><a href=x>Go &amp; see</a></nav><p>One <b>two\n three</b><p>Four&nbsp;<br>five<!-- x --><script>a<b</script> six<ul><li>a<li>b</ul>tail"
    got = [(b.text, b.links) for b in html_text.blocks_of(page)]
    assert got == [("Go & see", 8), ("One two three", 0), ("Four five six", 0), ("a", 0), ("b", 0), ("tail", 0)]


def test_licences(spark):
    mit = "The MIT Licence (MIT)\n\nCopyright (c) 2020 Some Body\n\n" + licences.MIT.replace('"', "''").replace("\n", " ")
    rows = [(1, mit), (2, "text\nReleased under the MIT  License\nmore"), (3, "We licensed nothing"), (4, licences.APACHE.upper()), (5, licences.ISC + " and more")]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.known(spark)).collect()}
    assert got[1]["text_licence"] == "MIT" and got[4]["text_licence"] == "Apache-2.0"
    assert [got[i]["text_licence"] for i in (2, 3, 5)] == [None] * 3
    assert got[2]["line_licences"] == ["MIT"] and got[3]["line_licences"] == []


def test_toxicity_on_texts_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels, max_train=2000)
    assert (np.diff(model.cuts) > 0).all()
    from pyspark.sql import functions as F

    rest = labels.orderBy(F.xxhash64("doc_id"), "doc_id").offset(2000).select("doc_id", "toxic")
    got = toxicity.score(docs, model).join(rest, "doc_id").select("severity", "toxic").collect()
    bad = [r["severity"] for r in got if r["toxic"]]
    good = [r["severity"] for r in got if not r["toxic"]]
    assert np.mean(np.array(bad) >= toxicity.THRESHOLD) > 0.85 and np.mean(np.array(good) >= toxicity.THRESHOLD) < 0.01


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        g = int(r.integers(0, 3))
        rows.append(np.array([*r.integers(100, 140, 4), *[5] * (g > 0), *[6] * (g > 1)], np.int32))
        grades.append(g)
    model = toxicity.fit(rows, np.array(grades))
    f = np.array([model.weights[x].sum() for x in rows])
    severity = model.severity(f)
    means = [severity[np.array(grades) == g].mean() for g in range(3)]
    assert means[0] < 0.3 < means[1] < 1.5 < means[2] and severity.max() <= 2
