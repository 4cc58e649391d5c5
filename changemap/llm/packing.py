"""Best-fit packing of token sequences by bulk-synchronous sweeps.

Sizes are whole numbers up to the sequence length, so the range-sorted pieces, and the
range-sorted gaps, are runs of equal size, one run a size. Spark counts the runs and
ranks the rows within them, in parallel however hot a size is. A round then sweeps
over runs instead of rows: each run of pieces finds the next larger gap, runs that chose
the same gap are served by rank, the gaps shrink, and what was not served goes on
to the next round. That state has at most 2048 sizes of either kind at any data size,
so it is kept in plain Python between the two Spark jobs; the rows meet their places in
one join.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changemap.llm.text import as_bytes
from changemap.session import materialise

LENGTH = 2048
END_ID = 0
SALTS = 256
VOCABULARY = "byte_bpe_50k"

_ENCODERS: dict[str, object] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The named vocabulary as a rank file. Its ids are those of the ``.json`` beside it,
    read four times as fast; the tests hold both against each other."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


# Added to the vocabulary beside its ranks: one id wherever the string stands in a text.
ADDED = {"<|endoftext|>": 50256}


def _encoder(path: str):
    """One per worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    return _ENCODERS[path]


def ids_of(raw: bytes | None, path: str) -> np.ndarray:
    """The ids of one whole text and the end id."""
    ids = _encoder(path).encode_to_numpy(raw.decode("utf-8"), allowed_special="all") if raw else ()
    return np.concatenate((np.asarray(ids, np.uint32), [np.uint32(END_ID)]))


def pieces_of(ids: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """``(piece, start, length, crc)``: whole pieces of ``length`` at the end, the rest in front."""
    n = len(ids)
    cuts = [0, *range(n % length or min(length, n), n + 1, length)]
    raw = ids.astype("<u4")
    return [(k, a, b - a, zlib.crc32(raw[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
           vocabulary: str | None = None) -> DataFrame:
    """``(id, piece, start, length, crc)``: the whole texts as ids with an end id, cut
    only where longer than ``length``. A null text is empty: its only id is the end."""
    path = vocabulary or vocabulary_path()

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,crc:long>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([
                [dict(zip(("piece", "start", "length", "crc"), r)) for r in pieces_of(ids_of(raw, path), length)] for raw in batch
            ])

    return docs.select(F.col(id_col).alias("id"), F.explode(cut(as_bytes(F.col(text_col)))).alias("p")).select("id", "p.*")


def plan_runs(runs: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Where each run of equally long pieces goes: ``(size, rank, n, sequence, offset)``.

    ``runs`` maps a size to its number of pieces. Of the pieces of ``size``, the ``n``
    from ``rank`` on go to the sequences from ``sequence`` on, all at ``offset``.

    A round: (1) pieces that no gap takes open sequences, longest first, as many as
    their tokens fill; (2) a sweep over sizes gives every other run its successor among
    the gaps; (3) runs with the same successor share its sequences by rank, longest
    first; (4) the gaps shrink, for the next round to see. Every round places all of a
    run or uses up a gap value, so it ends.
    """
    todo = {size: [0, n] for size, n in sorted(runs.items(), reverse=True) if n}
    gaps: dict[int, deque[list[int]]] = {}
    placed, opened = [], 0
    while todo:
        values = sorted(gaps)
        chosen: dict[int | None, list[int]] = {}
        for size in todo:  # longest first
            at = bisect_left(values, size)
            chosen.setdefault(values[at] if at < len(values) else None, []).append(size)
        now = []
        lost = chosen.pop(None, [])
        seats = max(-(-sum(s * todo[s][1] for s in lost) // length), sum(todo[s][1] for s in lost if 2 * s > length))
        for size in lost:
            rank, n = todo[size]
            n = min(n, seats)
            if n:
                now.append((size, rank, n, opened, 0))
                opened, seats = opened + n, seats - n
        for gap, asking in chosen.items():
            free = gaps[gap]
            for size in asking:
                rank, n = todo[size]
                while n and free:
                    run = free[0]
                    took = min(n, run[1])
                    now.append((size, rank, took, run[0], length - gap))
                    rank, n, run[0], run[1] = rank + took, n - took, run[0] + took, run[1] - took
                    if not run[1]:
                        free.popleft()
            if not free:
                del gaps[gap]
        for size, _, n, sequence, offset in now:
            run = todo[size]
            run[0], run[1] = run[0] + n, run[1] - n
            if not run[1]:
                del todo[size]
            if offset + size < length:
                gaps.setdefault(length - offset - size, deque()).append([sequence, n])
        placed += now
    return placed


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         vocabulary: str | None = None) -> DataFrame:
    """One row per piece: ``(id, piece, start, length, crc, sequence, offset)``.

    Every sequence is gapless from 0 and holds at most ``length`` ids. Repeated rows
    and rows without an id are packed like any other; other columns are not read;
    no rows, no pieces.
    """
    cut = materialise(pieces(docs, id_col, text_col, length, vocabulary), "pieces")
    # ranks within a size without gathering the size: its rows are dealt to SALTS groups by
    # hash, and the group counts, at most SALTS a size, say where each group's ranks begin
    dealt = cut.withColumn("task", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(SALTS)))
    counts = dealt.groupBy("length", "task").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.select("length", "task", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "counts")
    # at most ``length`` sizes, however many rows
    sizes = dict(counts.groupBy("length").agg(F.sum("n")).collect())
    plan = cut.sparkSession.createDataFrame(
        plan_runs(sizes, length), "length long, _from long, _n long, _seq long, offset long")
    within = Window.partitionBy("length", "task").orderBy("id", "piece", "crc")
    ranked = dealt.withColumn("_r", F.row_number().over(within) - 1).join(counts.select("length", "task", "base"), ["length", "task"])
    ranked = ranked.withColumn("_rank", F.col("base") + F.col("_r"))
    return (
        ranked.join(plan, "length").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n")))
        .select("id", "piece", "start", "length", "crc", (F.col("_seq") + F.col("_rank") - F.col("_from")).alias("sequence"), "offset")
    )
