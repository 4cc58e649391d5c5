"""Byte-level words, shared by the operators that run inside tasks.

A text reaches Python as UTF-8 bytes. Both tables below keep the byte length, so a
position in the translated bytes is a position in the text.
"""

from __future__ import annotations

# A-Z to lower case; every other byte stays
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# words of ASCII letters, digits and anything beyond ASCII: the rest becomes a space
WORDS = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def spaced_words(raw: bytes | None) -> list[bytes]:
    """Lower-cased runs of anything but ASCII white space (0x20, 0x09-0x0D)."""
    return raw.translate(LOWER).split() if raw else []


def plain_words(raw: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return raw.translate(WORDS).split() if raw else []


def as_bytes(column):
    """A text column as UTF-8 bytes, which Arrow hands over without decoding."""
    return column.cast("binary")


BATCH_BYTES = 8 << 20


def small_batches(spark) -> None:
    """Texts go to Python workers at most ``BATCH_BYTES`` at a time: their number says little about their length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def aside(docs, own: set[str]):
    """``docs`` with columns whose names an operator needs (``own``, in lower case) renamed, the new
    name by the old one, and what gives the columns of a result their names again."""
    taken = {c.lower() for c in docs.columns} | own
    new = {}
    for c in docs.columns:
        if c.lower() in own:
            name = f"{c}_"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            new[c] = name
    back = {v: k for k, v in new.items()}
    return docs.withColumnsRenamed(new), new, lambda out: out.withColumnsRenamed(back)
