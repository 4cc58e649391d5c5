"""Benchmark decontamination: one automaton over all test windows, one scan of each text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemap.llm.text import WORDS, as_bytes, plain_words
from changemap.session import materialise

WINDOW_WORDS = 10
# windows in one automaton: about 60 bytes of pattern and 4 kB of nodes each
SLICE_WINDOWS = 50_000

FOUND = "struct<n_words:long,mask:binary,items:array<string>>"
LEAK = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:long,end:long>>>"

# by the broadcast's own key; a worker keeps the last one
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def windows_of(raw: bytes | None, n: int = WINDOW_WORDS) -> list[bytes]:
    """All windows of ``n`` consecutive words; a shorter text is one window, an empty one none."""
    w = plain_words(raw)
    return [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def _slices(bench: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[dict[bytes, set[str]]]:
    """Windows with the items they occur in, in slices of at most ``limit`` windows; a long item may be in several."""
    part: dict[bytes, set[str]] = {}
    for item, raw in bench.select(F.col(id_col).cast("string"), as_bytes(F.col(text_col))).toLocalIterator():
        if item is not None:
            for w in windows_of(bytes(raw) if raw is not None else None):
                part.setdefault(w, set()).add(item)
                if len(part) >= limit:
                    yield part
                    part = {}
    if part:
        yield part


def _automaton(key: str, windows: dict[bytes, list[str]]):
    """Built once in each worker and kept for its other tasks; matches are whole words."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        a = ahocorasick.Automaton()
        for w, items in windows.items():
            a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, items))
        a.make_automaton()
        _AUTOMATA[key] = a
    return _AUTOMATA[key]


def scan_text(raw: bytes | None, automaton) -> tuple[int, np.ndarray, set[str], bytes]:
    """Words of a text, which of them are hit, the items found, and the translated bytes."""
    if not raw:
        return 0, np.zeros(0, bool), set(), b""
    plain = raw.translate(WORDS)
    words = plain.split()
    hit, items = np.zeros(len(words) + 1, np.int64), set()
    line = b" %s " % b" ".join(words)
    ends = None
    for end, (n, found) in automaton.iter(line.decode("latin-1")):
        if ends is None:  # the words that end at or before a place in the line
            ends = np.cumsum(np.frombuffer(line, np.uint8) == 32)
        last = int(ends[end]) - 1
        hit[last - n] += 1
        hit[last] -= 1
        items.update(found)
    return len(words), np.cumsum(hit)[:-1] > 0, items, plain


def spans_of(raw: bytes, plain: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as character offsets ``[start, end)`` in the original text."""
    if not hit.any():
        return []
    inside = np.frombuffer(plain, np.uint8) != 32
    step = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    start, stop = first[np.flatnonzero(run == 1)], last[np.flatnonzero(run == -1) - 1]
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return list(zip(chars[start].tolist(), chars[stop].tolist()))


def scan(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """``docs`` with ``leak``: struct of ``n_words``, ``n_hit``, ``items`` (ids as text,
    sorted) and ``spans`` (character offsets of hit runs in the original text).

    The windows are broadcast in slices of ``slice_windows``; a larger benchmark takes
    more scans over the same rows instead of a larger automaton. What a scan finds is written
    before the next slice is sent, so no worker holds two automata. Null text has no
    words. Items without words or id match nothing; repeated items count once. The
    column replaces one of that name, other columns pass through.
    """
    spark = docs.sparkSession
    text = as_bytes(F.col(text_col))
    out = docs.withColumn("leak", F.lit(None).cast(FOUND))
    sent = None
    for part in _slices(bench, item_col, item_text, slice_windows):
        if sent is not None:
            out = materialise(out, "leaks")
            sent.destroy()
        sent = spark.sparkContext.broadcast({w: sorted(i) for w, i in part.items()})
        out = out.withColumn("leak", _matcher(uuid.uuid4().hex, sent)(text, F.col("leak")))
    return out.withColumn("leak", F.pandas_udf(_finished, LEAK)(text, F.col("leak")))


def _matcher(key: str, sent):
    """Adds the words that one slice hits, as a bit mask, and its items to what was found."""

    def matched(texts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(key, sent.value)
        for raw, had in texts:
            rows = []
            for x, mask, items in zip(raw, had["mask"], had["items"]):
                n, hit, found, _ = scan_text(x, automaton)
                if mask is not None:
                    hit = hit | np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool)
                found = found.union(items if items is not None else ())
                rows.append((n, np.packbits(hit).tobytes() if found else None, sorted(found)))
            yield pd.DataFrame(rows, columns=["n_words", "mask", "items"])

    return F.pandas_udf(matched, FOUND)


def _finished(texts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    for raw, had in texts:
        rows = []
        for x, n, mask, items in zip(raw, had["n_words"], had["mask"], had["items"]):
            n = len(plain_words(x)) if n is None or n != n else int(n)
            if mask is None:
                rows.append((n, 0, [], []))
                continue
            hit = np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool)
            spans = [{"start": s, "end": e} for s, e in spans_of(x, x.translate(WORDS), hit)]
            rows.append((n, int(hit.sum()), list(items), spans))
        yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs."""
    return scan(docs, bench, text_col).where("leak.n_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
