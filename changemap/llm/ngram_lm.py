"""Language-model scores from a log-frequency Bloom filter.

The filter holds every n-gram (of one or two tokens) of the training texts once for each
step of its logarithmic count: an n-gram seen c times is entered with the marks 1 to
1 + log(c). A probe asks for mark after mark until one is missing; the last one found
tells the count, to within a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemap.llm.text import small_batches, as_bytes, spaced_words
from changemap.session import materialise

END = b"\n"  # no word holds white space
ADD = 0.1
# steps of the quantised counts, of words and of pairs
WORD_STEP, PAIR_STEP = 1.2, 2.0
BITS_PER_ENTRY, PROBES = 10, 5  # about one false answer in a hundred probes
PRIOR = 20.0  # weight of the word's own probability against what followed its context
# text in one broadcast segment and in one task that builds a part of it
SEGMENT_BYTES, BUCKET_BYTES = 1 << 30, 16 << 20
FLUSH_TOKENS, SCORE_TOKENS, MEMO = 1_000_000, 200_000, 100_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_TOP = np.uint64(0xFFFF << 48)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of pairs; the first 16 bits are those of the word, which names the segment."""
    return (mixed(before * _C + word) & ~_TOP) | (word & _TOP)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(48)) * np.uint64(segments)) >> np.uint64(16)


def level_of(counts: np.ndarray, step: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(step) + 1e-9).astype(np.int64)


def count_at(levels: np.ndarray, step: float) -> np.ndarray:
    """The middle of the counts of a level; nothing for level 0, one for level 1."""
    low = np.ceil(step ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(step ** levels.astype(float) - 1e-9) - 1)
    return np.where(levels > 0, np.sqrt(low * high), 0.0)


def _places(keys: np.ndarray, level: int, bits: np.ndarray, k: int) -> np.ndarray:
    return mixed(mixed(keys + np.array([level], np.uint64) * _C) + np.array([k], np.uint64) * _B) % bits


def filter_bits(keys: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int]:
    """The packed bits with all marks of all keys, and their number."""
    n = int(levels.sum())
    size = max(64, -(-n * BITS_PER_ENTRY // 8) * 8)
    flags = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        keys, levels = keys[levels >= level], levels[levels >= level]
        for k in range(PROBES):
            flags[_places(keys, level, np.uint64(size), k)] = True
    return np.packbits(flags, bitorder="little"), size


class _Hashes(dict):
    """Word -> 64-bit hash, filled as words come up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def token_hashes(raw: bytes | None, memo: _Hashes) -> np.ndarray:
    """Hashes of the words of a whole text and of the end."""
    words = spaced_words(raw)
    words.append(END)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in a row, and before each the token that precedes it, the end at the start."""
    tokens = np.concatenate(texts)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
    before[starts] = np.uint64(xxhash.xxh64_intdigest(END))
    return tokens, before


@dataclass
class Totals:
    tokens: int
    words: int
    segments: int
    buckets: int

    def base(self, count):
        return (count + ADD) / (self.tokens + ADD * (self.words + 1))


@dataclass
class Segment:
    """What a worker needs of the words whose hashes fall into one segment."""

    number: int
    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    bits: np.ndarray
    first: np.ndarray  # of each bucket's bits
    size: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The levels of n-grams, by probing one after the other until one is missing."""
        levels = np.zeros(len(keys), np.int64)
        at = np.arange(len(keys))
        bucket = (keys % np.uint64(len(self.size))).astype(np.int64)
        first, size = self.first[bucket], self.size[bucket]
        level = 1
        while len(at) and level < 256:
            for k in range(PROBES):
                place = first[at] + _places(keys[at], level, size[at], k)
                there = (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
                at = at[there.astype(bool)]
                if not len(at):
                    break
            levels[at] = level
            level += 1
        return levels.astype(np.uint8)

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Training counts of words of this segment."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)


def _counted(buckets: int):
    """Texts to distinct n-grams with counts: one row a flush and bucket."""

    def rows(kind: int, keys: np.ndarray) -> Iterator[tuple]:
        keys, n = np.unique(keys, return_counts=True)
        bucket = ((mixed(keys) if kind == 0 else keys) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            own = order[ends[b]:ends[b + 1]]
            if len(own):
                yield b, kind, keys[own].tobytes(), n[own].astype(np.uint32).tobytes()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, held, size = _Hashes(), [], 0

        def flush():
            tokens, before = contexts(held)
            out = [*rows(0, tokens), *rows(1, pair_keys(before, tokens))]
            return pd.DataFrame(out, columns=["bucket", "kind", "keys", "counts"])

        for batch in batches:
            for raw in batch["raw"]:
                held.append(token_hashes(raw, memo))
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return counted


def _merged(segments: int):
    """All rows of a bucket to its part of the filter, for each segment."""

    def total(group: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
        own = group[group["kind"] == kind]
        keys = np.frombuffer(b"".join(own["keys"]), np.uint64)
        n = np.frombuffer(b"".join(own["counts"]), np.uint32)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], (np.add.reduceat(n[order].astype(np.int64), first) if len(keys) else np.zeros(0, np.int64))

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        words, counts = total(group, 0)
        pairs, often = total(group, 1)
        out = []
        for s in range(segments):
            w, p = segment_of(words, segments) == s, segment_of(pairs, segments) == s
            if not w.any() and not p.any():
                continue
            bits, size = filter_bits(
                np.concatenate((mixed(words[w]), pairs[p])),
                np.concatenate((level_of(counts[w], WORD_STEP), level_of(often[p], PAIR_STEP))),
            )
            out.append((s, int(group["bucket"].iloc[0]), int(counts[w].sum()), int(w.sum()),
                        words[w].tobytes(), counts[w].tobytes(), bits.tobytes(), size))
        return pd.DataFrame(out, columns=["segment", "bucket", "tokens", "distinct", "words", "counts", "bits", "size"])

    return merged


def fit(texts: DataFrame, text_col: str = "text") -> tuple[Totals, DataFrame]:
    """Totals and the table of filter parts over all rows of ``texts``; null is an empty text.

    Every task counts distinct n-grams of its own texts before anything is shuffled;
    then each bucket of n-gram hashes is summed in one task. There is a bucket for
    every ``BUCKET_BYTES`` of text, and no n-gram's rows exceed one a flush.
    """
    raw = texts.select(as_bytes(F.col(text_col)).alias("raw"))
    size = raw.agg(F.sum(F.length("raw"))).first()[0] or 0
    segments, buckets = 1 + size // SEGMENT_BYTES, max(16, -(-size // BUCKET_BYTES))
    rows = raw.mapInPandas(_counted(buckets), "bucket int, kind int, keys binary, counts binary")
    parts = materialise(rows.groupBy("bucket").applyInPandas(
        _merged(segments),
        "segment int, bucket int, tokens long, distinct long, words binary, counts binary, bits binary, size long"), "filter")
    n, v = parts.agg(F.sum("tokens"), F.sum("distinct")).first()
    return Totals(n or 0, v or 0, segments, buckets), parts


def _segment(parts: DataFrame, number: int, buckets: int) -> Segment:
    """One segment, read part by part."""
    size = np.full(buckets, 64, np.uint64)
    first = np.zeros(buckets, np.uint64)
    bits, words, counts, at = [np.zeros(8, np.uint8)], [], [], 64  # the first 64 bits stand for buckets without entries
    for r in parts.where(F.col("segment") == number).select("bucket", "words", "counts", "bits", "size").toLocalIterator():
        size[r["bucket"]], first[r["bucket"]] = r["size"], at
        bits.append(np.frombuffer(r["bits"], np.uint8))
        words.append(np.frombuffer(r["words"], np.uint64))
        counts.append(np.frombuffer(r["counts"], np.int64).astype(np.uint32))
        at += r["size"]
    words = np.concatenate([*words, np.zeros(0, np.uint64)])
    order = np.argsort(words)
    return Segment(number, words[order], np.concatenate([*counts, np.zeros(0, np.uint32)])[order], np.concatenate(bits), first, size)


def look_up(texts: list[np.ndarray], seg: Segment, totals: Totals) -> tuple[pd.DataFrame, np.ndarray]:
    """What one segment tells: for each text its tokens, known tokens and base log10, and for
    each token two bytes, the levels of the word and of its pair; 0 for words of other segments."""
    tokens, before = contexts(texts)
    words, at = np.unique(tokens, return_inverse=True)
    mine = segment_of(words, totals.segments) == seg.number
    exact, near = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint8)
    exact[mine] = seg.exact(words[mine])
    near[mine] = seg.levels(mixed(words[mine]))
    own = mine[at]
    base = np.where(own, np.log10(totals.base(exact))[at], 0.0)
    levels = np.zeros((len(tokens), 2), np.uint8)
    levels[:, 0] = near[at]
    asked = np.flatnonzero(levels[:, 0])
    levels[asked, 1] = seg.levels(pair_keys(before[asked], tokens[asked]))
    starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
    return pd.DataFrame({
        "n_tokens": [len(t) for t in texts], "n_known": np.add.reduceat((own & (exact[at] > 0)).astype(np.int64), starts),
        "base": np.add.reduceat(base, starts),
    }), levels


def log_probabilities(levels: np.ndarray, sizes: np.ndarray, totals: Totals) -> np.ndarray:
    """log10 of the model's probability of every token, from the levels of all segments.

    A token's context is the one before it, the end (each text's last token) at the start.
    A pair is at most as frequent as its word and its context, so no probability exceeds one.
    """
    words = count_at(levels[:, 0].astype(np.int64), WORD_STEP)
    ends = np.cumsum(sizes)
    context = np.empty_like(words)
    context[1:] = words[:-1]
    context[ends - sizes] = words[ends - 1]
    pairs = np.minimum(count_at(levels[:, 1].astype(np.int64), PAIR_STEP), np.minimum(words, context))
    return np.log10(pairs + PRIOR * np.minimum(totals.base(words), 1.0)) - np.log10(context + PRIOR)


SCORES = "struct<n_tokens:long,n_known:long,base:double,score:double>"
HELD = "struct<n_tokens:long,n_known:long,base:double,levels:binary>"


def _scorer(sent, totals: Totals, last: bool):
    """Adds what one segment tells to what is held; behind the last one the score."""

    def told(held: list[np.ndarray], had: list[bytes | None], seg: Segment) -> pd.DataFrame:
        sizes = np.array([len(t) for t in held])
        rows, levels = look_up(held, seg, totals)
        if had[0] is not None:
            levels |= np.frombuffer(b"".join(had), np.uint8).reshape(-1, 2)
        starts = np.cumsum(sizes) - sizes
        if last:
            return rows.assign(score=np.add.reduceat(log_probabilities(levels, sizes, totals), starts))
        return rows.assign(levels=[levels[a:a + n].tobytes() for a, n in zip(starts, sizes)])

    def scored(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        memo, seg = _Hashes(), sent.value
        for raw, had in batches:
            out, held, before, size = [], [], [], 0
            for x, levels in zip(raw, had["levels"]):
                held.append(token_hashes(x, memo))
                before.append(levels)
                size += len(held[-1])
                if size >= SCORE_TOKENS:
                    out.append(told(held, before, seg))
                    held, before, size = [], [], 0
            if held:
                out.append(told(held, before, seg))
            now = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["n_tokens", "n_known", "base", "score" if last else "levels"])
            for c in ("n_known", "base"):
                now[c] = now[c].to_numpy() + had[c].fillna(0).to_numpy()
            yield now

    return F.pandas_udf(scored, SCORES if last else HELD)


def score(docs: DataFrame, totals: Totals, parts: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lm``: struct of ``n_tokens``, ``n_known``, ``base`` and ``score``.

    ``base`` adds log10 of the smoothed word probabilities, from exact counts. ``score`` is
    the model's: (pairs + PRIOR * P(word)) / (context + PRIOR), counts and P(word) from
    the filter, a pair at most as frequent as its word and its context. The filter is broadcast in segments of
    at most ``SEGMENT_BYTES`` of training text, one pass over the texts after the other. A segment
    adds the levels of its own words, two bytes a token, which are written before the next is sent;
    the last pass turns them into the score, so it does not depend on the number of segments but for false answers.
    Null is an empty text, which has one token, the end. Without
    training tokens all counts are zero. The column replaces one of that name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.withColumn("lm", F.lit(None).cast(HELD))
    for s in range(totals.segments):
        sent = spark.sparkContext.broadcast(_segment(parts, s, totals.buckets))
        last = s + 1 == totals.segments
        out = out.withColumn("lm", _scorer(sent, totals, last)(as_bytes(F.col(text_col)), F.col("lm")))
        if not last:
            # written before the next segment is sent, so no worker holds two
            out = materialise(out, "scores")
            sent.destroy()
    return out
