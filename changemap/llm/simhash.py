"""SimHash near-duplicates, linked by meeting in the middle of two Hamming balls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changemap.llm.graph import components
from changemap.llm.text import as_bytes, spaced_words
from changemap.session import materialise

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
BITS = 64


def fingerprint_of(raw: bytes | None) -> int:
    """The fingerprint of one text: a bit is set if it is in over half the shingle hashes."""
    words = spaced_words(raw)
    if not words:
        return 0
    n, digest, join = SHINGLE_WORDS, xxhash.xxh64_intdigest, b" ".join
    shingles = map(join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else [join(words)]
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, max(1, len(words) - n + 1))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):  # a very long text in slices: 64 bytes a shingle
        bits = np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for raw in texts:
        yield pd.Series(np.array([fingerprint_of(x) for x in raw], dtype=np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """SimHash of whole texts as a signed long; null, empty and blank texts give zero."""
    return F.pandas_udf(_fingerprints, "long")(as_bytes(text))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(value: Column, bits: range | list[int]) -> Column:
    """``value`` itself and with each one of ``bits`` flipped."""
    return F.explode(F.array(value, *(value.bitwiseXOR(F.lit(_signed(1 << b))) for b in bits)))


def _masks(blocks: int) -> list[list[int]]:
    """The bits dealt to ``blocks`` nearly equal blocks."""
    return [list(range(BITS * k // blocks, BITS * (k + 1) // blocks)) for k in range(blocks)]


def links(fps: DataFrame, blocks: int = 3) -> DataFrame:
    """Links ``(a, b)`` that join all fingerprints of ``fps`` (distinct longs, column
    ``fp``) at ``RADIUS`` = 3 or fewer differing bits into the right components.

    Half the radius is one and a half bits. Two fingerprints at distance 2 or less
    share a variant within one bit of both. Those are at most 65 to a variant, so
    each is tied to the smallest, with nothing left to verify. For distance 3 the odd
    bit is absorbed by leaving out one of ``blocks`` blocks of bits, so that again one
    bit on either side meets: about 44 variants in each block's turn instead of the 2081
    of a ball of radius two. There two fingerprints are only candidates, and only those of
    different components of the first step are paired and verified, so that a large
    group of near copies does not meet itself.
    """
    close = (
        fps.select("fp", _variants(F.col("fp"), range(BITS)).alias("variant"))
        .groupBy("variant").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
        .select(F.explode("near").alias("a"), F.array_min("near").alias("b")).where("a <> b").distinct()
    )
    close = materialise(close, "close")
    rooted = fps.join(components(close), fps["fp"] == F.col("id"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")

    keyed = None
    for k, mask in enumerate(_masks(blocks)):
        rest = [b for b in range(BITS) if b not in mask]
        left = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in rest))))
        one = rooted.select(F.lit(k).alias("block"), _variants(left, rest).alias("variant"), "fp", "root")
        keyed = one if keyed is None else keyed.union(one)
    # one shuffle: a variant's rows stay together only where they are of several components
    meet = Window.partitionBy("block", "variant")
    few = materialise(
        keyed.withColumn("lo", F.min("root").over(meet)).withColumn("hi", F.max("root").over(meet))
        .where("lo <> hi").select("block", "variant", "fp", "root"), "candidates",
    )
    x, y = few.alias("x"), few.alias("y")
    far = (
        x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.variant") == F.col("y.variant")) & (F.col("x.root") < F.col("y.root"))
               & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    )
    return close.union(far)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)`` for every row of ``docs``; component is the smallest id
    reachable over links at 3 or fewer differing bits.

    Every row gets a fingerprint from its whole text. Null, empty and blank texts have
    fingerprint zero and link like any other. Repeated rows stay. A null id is never
    the smallest unless its component has no other. Other columns are not read; no
    rows, no result.
    """
    prints = materialise(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")), "prints")
    first = materialise(prints.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    roots = components(links(first.select("fp")))
    grouped = first.join(roots, first["fp"] == roots["id"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component"))
    of_print = materialise(grouped.join(least, "root").select(F.col("fp"), "component"), "classes")
    return prints.join(of_print, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their near-duplicate group.

    Rows repeated under that id stay once. A row without an id is judged by nothing and stays.
    """
    groups = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    kept = groups.where(F.col("id") == F.col("component")).select(F.col("id").alias(id_col)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))
