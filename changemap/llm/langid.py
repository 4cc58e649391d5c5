"""Language of whole texts: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemap.llm.text import as_bytes

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTH = 0.5
# rows of the broadcast matrix: 256 kB each
MAX_LANGUAGES = 1000
UNKNOWN = "und"
CHARS = 1 << 20  # of one text that are in work at once

_LETTER = regex.compile(r"\p{L}")


def grams(text: str, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of lower-cased text, and its last characters for the next slice.

    Anything of ASCII that is no letter counts as a space, so digits and marks tell nothing.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c < 128) & ~((c >= 97) & (c <= 122)), np.uint32(32), c)
    new = len(c)
    if tail is not None:
        c = np.concatenate((tail, c))
    out = []
    for n in ORDERS:
        start = max(0, len(c) - new - n + 1)  # n-grams that end in the new part
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1 - start, n, np.uint32)
        for k in range(n):
            h = (h ^ c[start + k:len(c) - n + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append(h % np.uint32(BUCKETS))
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), c[-(max(ORDERS) - 1):]


def text_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in a whole text; long texts go slice by slice."""
    counts, tail = np.zeros(BUCKETS, np.int64), None
    for at in range(0, len(text), CHARS):
        found, tail = grams(text[at:at + CHARS], tail)
        counts += np.bincount(found, minlength=BUCKETS)
    return counts


@dataclass
class Model:
    """Languages, their log shares, and log probabilities of the buckets (buckets x languages)."""

    languages: list[str]
    prior: np.ndarray
    log_p: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its posterior; ``und`` and 0 without a letter or a model."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        log, tail = self.prior.copy(), None
        for at in range(0, len(text), CHARS):
            found, tail = grams(text[at:at + CHARS], tail)
            log += self.log_p[found].sum(axis=0, dtype=np.float64)
        best = int(np.argmax(log))
        return self.languages[best], float(1.0 / np.exp(log - log[best]).sum())


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a task's texts: a row for each language and bucket it has seen."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, raw in zip(batch["lang"], batch["raw"]):
            own = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            own[BUCKETS] += 1  # texts
            text = raw.decode("utf-8") if raw else ""
            if len(text) > 4096:
                own[:BUCKETS] += text_counts(text)
            else:
                np.add.at(own, grams(text)[0], 1)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": own[at]})


def train(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows with a language; null texts count as empty.

    The matrix has ``BUCKETS`` rows and a column a language; more than ``MAX_LANGUAGES``
    raise an error before it is gathered.
    """
    rows = texts.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), as_bytes(F.col(text_col)).alias("raw"))
    counts = rows.mapInPandas(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = counts.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("cells")).orderBy("lang").limit(MAX_LANGUAGES + 1)
    got = by_lang.select("lang", F.col("cells.bucket").alias("at"), F.col("cells.n").alias("n")).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    table = np.zeros((BUCKETS + 1, len(got)))
    for k, r in enumerate(got):
        table[np.array(r["at"], np.int64), k] = r["n"]
    cells, n = table[:BUCKETS] + SMOOTH, table[BUCKETS]
    log_p = np.log(cells / cells.sum(axis=0)) if len(got) else cells
    return Model([r["lang"] for r in got], np.log(n / n.sum()) if len(got) else n, log_p.astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``language``: struct of ``lang`` and ``score``, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0. The column replaces
    one of that name, others pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.log_p))

    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(*sent.value)
        for batch in texts:
            yield pd.DataFrame([m.predict(raw.decode("utf-8") if raw else None) for raw in batch], columns=["lang", "score"])

    return docs.withColumn("language", F.pandas_udf(predicted, "struct<lang:string,score:double>")(as_bytes(F.col(text_col))))
