"""Line dedup by pairs of neighbouring lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemap.llm.text import aside
from changemap.session import materialise

# A line ends behind a newline, or within running text behind marks and the space or
# newline after them.
LINE = r"([^.,;:!?\n]*+(?:[.,;:!?]++[ \n]?|\n)|[^.,;:!?\n]++)"
MIN_LINES = 2
MIN_CHARS = 60
_OWN = {"_lines", "_places", "_place_id", "_no", "_found", "_marks", "_starts", "_gone", "_rest"}


def _kept(expr: Column, name: str) -> Column:
    """An array computed once: a generator keeps the optimizer from copying it into
    every lambda that reads it."""
    return F.explode(F.array(expr)).alias(name)


def _named(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def _slice(first: Column, last: Column) -> Column:
    """The text of lines ``first`` to ``last``."""
    return F.array_join(F.slice("_lines", first + 1, F.greatest(last - first + 1, F.lit(0))), "")


def with_lines(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``_lines``, which join to the text again; null for a null text."""
    return docs.select(*_named(docs), _kept(F.regexp_extract_all(text, F.lit(LINE), 1), "_lines"))


def _pairs(docs: DataFrame) -> DataFrame:
    """``(id, pairs)``: for every line of ``docs`` (id, text) but the last, the hash of it and the next."""
    a = with_lines(docs, F.col("text")).select("id", _kept(F.transform("_lines", lambda x: F.xxhash64(x)), "_hashes"))
    h, n = F.col("_hashes"), F.greatest(F.size("_hashes") - 1, F.lit(0))
    return a.select("id", F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda x, y: F.xxhash64(x, y)).alias("pairs"))


def _ambiguous(found: DataFrame) -> DataFrame:
    """``h`` of the ``_places`` (k, h, ..) of ``found`` (text, _places) at which different texts stand."""
    at = with_lines(found.select("text", "_places"), F.when(F.col("_places").isNotNull(), F.col("text")))
    # a row of the same id with other lines has nothing at this place
    line = lambda k: F.get("_lines", k)
    there = F.filter("_places", lambda p: F.xxhash64(F.xxhash64(line(p["k"])), F.xxhash64(line(p["k"] + 1))) == p["h"])
    made = at.select(_kept(F.transform(there, lambda p: F.struct(p["h"].alias("h"), F.concat(line(p["k"]), line(p["k"] + 1)).alias("text"))), "_made"))
    texts = made.select(F.inline("_made")).distinct()
    return texts.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of ``text`` and ``n_removed``, the
    characters that went.

    Every two neighbouring lines are looked at. Two that stand anywhere else in ``docs``
    with equal bytes repeat each other; those with the smallest (id, place) are the
    original. Repeated pairs that overlap or touch form one passage, so a repeated passage
    goes from its first whole line to its last; passages of ``MIN_LINES`` lines and
    ``MIN_CHARS`` characters or more are removed, shorter ones (a stock phrase, a one-line
    notice) stay. Texts without such passages come back as they were, to the byte. A text
    that is all repeated becomes empty; its row stays, as do rows with null text. Rows
    repeated with the same id are one occurrence and stay; rows without an id count as
    originals only. An empty table gives an empty table, and a text of any length is one row's work.
    Other columns pass through, whatever their names; ``n_removed`` replaces a column of that name.

    Pairs are found by hash; the bytes of all that share one are compared by grouping on
    the texts themselves. A hash that different texts share proves nothing, and its pairs stay.
    """
    docs, new, back = aside(docs, _OWN)
    id_col, text_col = new.get(id_col, id_col), new.get(text_col, text_col)
    i, t = F.col(id_col), F.col(text_col)
    own = docs.where(t.isNotNull()).select(i.alias("id"), t.alias("text"))
    pairs = materialise(_pairs(own), "pairs").select("id", F.posexplode("pairs").alias("k", "h"))
    repeated = materialise(
        pairs.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("h", "first"), "repeated")
    places = materialise(pairs.where("id IS NOT NULL").join(repeated, "h").select("id", "k", "h", "first"), "places")
    origin = places.where("id = first").groupBy("h").agg(F.min("k").alias("place"))
    of = places.where("id <> first OR first IS NULL").select("id", "k", "h", F.lit(True).alias("copy")).unionByName(
        places.where("id = first").join(origin, "h").select("id", "k", "h", (F.col("k") != F.col("place")).alias("copy")))
    of = of.groupBy(F.col("id").alias("_place_id")).agg(F.collect_set(F.struct("k", "h", "copy")).alias("_places"))
    cols = [F.col(f"`{c}`") for c in docs.columns if c != "n_removed"]
    found = docs.select(*cols).join(of.hint("shuffle_hash"), i == F.col("_place_id"), "left").drop("_place_id")
    # both uses of ``found`` read the same shuffled texts; one row, empty but for colliding hashes
    no = _ambiguous(found.select(t.alias("text"), "_places")).agg(F.collect_set("h").alias("_no"))
    found = found.crossJoin(F.broadcast(no))
    copies = F.filter("_places", lambda p: p["copy"] & ~F.array_contains("_no", p["h"]))
    marks = F.array_sort(F.array_distinct(F.transform(copies, lambda p: p["k"])))
    found = found.select(*cols, _kept(marks, "_found")).select(*cols, F.when(F.size("_found") > 0, F.col("_found")).alias("_marks"))
    return back(_cut(found, text_col))


def _cut(found: DataFrame, text_col: str) -> DataFrame:
    """``found`` without the passages that its ``_marks``, ascending numbers of the first lines of pairs, make up."""
    t = F.col(text_col)
    cols = [F.col(f"`{c}`") for c in found.columns if c != "_marks"]
    names = [c for c in found.columns if c != "_marks"]
    # rows without marks have nothing to cut: no lines are made of them
    a = with_lines(found, F.when(F.col("_marks").isNotNull(), t))
    m = F.col("_marks")
    at = lambda array, k: array[F.greatest(k, F.lit(0))]
    starts = F.filter(F.transform(m, lambda x, j: F.when((j == 0) | (at(m, j - 1) < x - 2), j)), lambda j: j.isNotNull())
    a = a.select(*cols, "_lines", "_marks", _kept(starts, "_starts"))
    s = F.col("_starts")
    runs = F.transform(s, lambda j, r: F.struct(
        m[j].alias("a"), (m[F.when(r + 1 < F.size(s), s[F.least(r + 1, F.size(s) - 1)] - 1).otherwise(F.size(m) - 1)] + 1).alias("b")))
    gone = F.filter(runs, lambda r: (r["b"] - r["a"] + 1 >= MIN_LINES) & (F.length(_slice(r["a"], r["b"])) >= MIN_CHARS))
    a = a.select(*cols, "_lines", _kept(gone, "_gone"))
    g, n = F.col("_gone"), F.size("_gone")
    kept = F.transform(F.sequence(F.lit(0), n), lambda j: _slice(
        F.when(j > 0, at(g, j - 1)["b"] + 1).otherwise(0),
        F.when(j < n, at(g, F.least(j, n - 1))["a"] - 1).otherwise(F.size("_lines") - 1)))
    a = a.select(*cols, _kept(F.when(n > 0, F.array_join(kept, "")).otherwise(t), "_rest"))
    size = F.coalesce(F.length(t) - F.length("_rest"), F.lit(0)).cast("long")
    return a.select(*[F.col("_rest").alias(c) if c == text_col else F.col(f"`{c}`") for c in names], size.alias("n_removed"))
