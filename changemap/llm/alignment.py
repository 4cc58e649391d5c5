"""Alignment of the tokens that two tokenizers make of the same texts.

A text's bytes are cut by A's tokens and by B's. Merging the two sorted lists of
token ends visits every overlap of an A with a B token once: each distinct end closes one. The texts
of a task stand one after the other, so the ends are two long sorted lists. Binary searches
along diagonals of their merge divide it into pieces of equal work, which need nothing of
each other: neither a long text nor many short ones make a piece larger. A piece emits
its overlaps and the groups that end in it; what it holds of a text that other pieces
share is stitched to the others' parts.

How often an id pair is linked anywhere is counted per block of pieces, then by Spark. Each
block then asks for the counts of its own distinct pairs only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemap.llm.text import as_bytes
from changemap.session import materialise

PIECE = 1 << 18  # ends in a piece
BLOCK = 16 * PIECE  # ends whose overlaps are counted together
WINDOW = 1 << 23  # characters that are encoded at once, about
TOGETHER = 500  # different words encoded as one text

# A space between two of these: neither tokenizer has a token across its left side. A's
# pattern takes a single space with what follows; B has no piece with a space in it but in
# front (held against the vocabulary when it is loaded). So the words are encoded alone.
LETTERS = "[!-~À-ɏЀ-ӿぁ-ヿ一-鿿가-힣]"
BETWEEN = re.compile(f"(?<={LETTERS}) (?={LETTERS})")
OTHER = f"(^|[^{LETTERS[1:]}) | ([^{LETTERS[1:]}|$)"
ENDS = f"(?s)^{LETTERS}(.*{LETTERS})?$"


def byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: visible ones of
    Latin-1 for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """Both tokenizers, and the byte length and decimal form of their ids."""

    path_a: str
    path_b: str

    def __post_init__(self):
        import json

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(self.path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        of = byte_level()
        # special tokens are added to the file apart, so their strings are plain text here
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if all(c in of for c in token)}
        special = {i: token for token, i in vocab.items() if token.startswith("<|") and token.endswith("|>")}
        ranks = {token: i for token, i in ranks.items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = {i: token for token, i in ranks.items()}
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece with a space behind its front: words cannot be encoded alone")
        self.length_a, self.length_b = np.zeros(max(self.bytes_a) + 1, np.int64), np.zeros(len(pieces), np.int64)
        for i, token in self.bytes_a.items():
            self.length_a[i] = len(token)
        self.length_b[:] = [len(t) for t in self.bytes_b]
        if max(len(self.length_a), len(self.length_b)) > 1 << 16:
            raise ValueError("vocabularies of over 65,536 ids")
        self.digits = _digits(max(len(self.length_a), len(self.length_b)))

    def _alone(self, words: list[str], sizes: np.ndarray) -> tuple[list, np.ndarray]:
        """Words of ``sizes`` bytes: for either side the ids of all words in turn and where each begins; and which words
        are odd: their tokens do not spell them. Odd words have no ids."""
        text = " ".join(words)
        want = f" {text}".encode()
        ids = self.a.encode_ordinary(f" {text}"), self.b.encode(text, num_threads=1)
        if any(b"".join(map(spelt.__getitem__, i)) != want for spelt, i in zip((self.bytes_a, self.bytes_b), ids)):
            if len(words) == 1:
                return [(np.zeros(0, "<u2"), np.zeros(2, np.int64))] * 2, np.ones(1, bool)
            return self._all([self._alone([w], n) for w, n in zip(words, sizes[:, None])])
        until = np.concatenate(([0], np.cumsum(sizes + 1)))
        sides = []
        for i, lengths in zip(ids, (self.length_a, self.length_b)):
            i = np.array(i, "<u2")
            sides.append((i, np.searchsorted(np.cumsum(lengths[i]), until, "right")))
        return sides, np.zeros(len(words), bool)

    @staticmethod
    def _all(found: list) -> tuple[list, np.ndarray]:
        sides = []
        for side in (0, 1):
            at = np.cumsum([0, *(len(f[0][side][0]) for f in found)])
            starts = [f[0][side][1][:-1] + n for f, n in zip(found, at)]
            sides.append((np.concatenate([f[0][side][0] for f in found]), np.concatenate([*starts, at[-1:]])))
        return sides, np.concatenate([f[1] for f in found])

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of space and text for each; none where either side does not spell them.

        The texts are cut into words, and each different word is encoded once: most of them many
        as one text, in which every space before one is a place to cut at.
        """
        owners, parts = [], []
        for i, text in enumerate(texts):
            at, text = 0, text or ""
            while at < len(text):
                cut = BETWEEN.search(text, at + WINDOW) if len(text) - at > WINDOW else None
                owners.append(i)
                parts.append(text[at:cut.start() if cut else len(text)])
                at = cut.end() if cut else len(text)
        empty = np.zeros(0, "<u2")
        if not parts:
            return [(empty, empty)] * len(texts)
        whole = pa.array(parts, pa.large_string())
        rare = pc.match_substring_regex(whole, OTHER).to_numpy(zero_copy_only=False)
        split = [pc.split_pattern(whole.filter(pa.array(~rare)), " "),
                 pa.array([BETWEEN.split(p) for p, r in zip(parts, rare) if r], pa.large_list(pa.large_string()))]
        sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in split])
        words = pa.concat_arrays([x.flatten().cast(pa.large_string()) for x in split]).dictionary_encode()
        order = np.concatenate((np.flatnonzero(~rare), np.flatnonzero(rare)))  # of the parts, as they stand now
        different, at = words.dictionary, words.indices.to_numpy()
        plain = pc.match_substring_regex(different, ENDS).to_numpy(zero_copy_only=False)
        turn = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        listed, n = different.take(pa.array(turn)).to_pylist(), int(plain.sum())
        lengths = pc.binary_length(different).to_numpy(zero_copy_only=False).astype(np.int64)[turn]
        groups = [*range(0, n, TOGETHER), *range(n, len(listed) + 1)]
        sides, odd = self._all([self._alone(listed[lo:hi], lengths[lo:hi]) for lo, hi in zip(groups, groups[1:]) if hi > lo])
        place = np.empty(len(turn), np.int64)
        place[turn] = np.arange(len(turn))
        at = place[at]
        until = np.cumsum(sizes)
        met = np.concatenate(([0], np.cumsum(odd[at])))
        bad = {owners[order[i]] for i in np.flatnonzero(met[until] > met[until - sizes])}
        ids: list[list] = [[[], []] for _ in texts]
        for side, (flat, starts) in enumerate(sides):
            many = np.diff(starts)[at]
            ends = np.concatenate(([0], np.cumsum(many)))
            out = flat[np.repeat(starts[:-1][at] - ends[:-1], many) + np.arange(ends[-1])]
            spans = {int(o): (ends[u - s], ends[u]) for o, u, s in zip(order, until, sizes)}
            for i, owner in enumerate(owners):
                ids[owner][side].append(out[slice(*spans[i])])
        return [(empty, empty) if i in bad or not x[0] else tuple(v[0] if len(v) == 1 else np.concatenate(v) for v in x)
                for i, x in enumerate(ids)]


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One a worker."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Tokenizers(path_a, path_b)
    return _LOADED[path_a, path_b]


def _digits(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal forms of 0 to ``n - 1`` as eight bytes with room for a mark, which of them count, and their lengths."""
    text = np.array([str(i) for i in range(n)], "S8")
    lengths = np.char.str_len(text).astype(np.int64)
    counted = np.ascontiguousarray(np.arange(8) <= lengths[:, None])
    return text.view("<u8"), counted.view("<u8").ravel(), lengths


def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Where the merge of two sorted lists is cut every ``step`` ends: rows (places in a, in b).

    Each cut is found by its own binary search along a diagonal, all of them at once. Equal ends
    stay together, in the piece in front.
    """
    at = np.arange(step, len(a) + len(b), step)
    lo, hi = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (lo < hi).any():
        mid = (lo + hi) // 2  # is a[mid] among the first ``at`` of the merge?
        inside = (lo < hi) & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(at - mid - 1, 0, len(b) - 1)])
        lo, hi = np.where(inside, mid + 1, lo), np.where(inside | (lo >= hi), hi, mid)
    i, j = lo, at - lo
    if len(a) and len(b):
        j = j + ((i > 0) & (j < len(b)) & (a[np.maximum(i, 1) - 1] == b[np.minimum(j, len(b) - 1)]))
    cuts = np.stack((np.append(i, len(a)), np.append(j, len(b))), axis=1)
    return np.unique(np.concatenate(([[0, 0]], cuts)), axis=0)


@dataclass
class Overlaps:
    """What one piece emits, in order of offset."""

    pairs: np.ndarray  # of each overlap: A's id << 16 | B's id
    ends: np.ndarray  # its end
    cut_a: np.ndarray  # places, within the piece, of the tokens that end groups
    cut_b: np.ndarray
    cut_at: np.ndarray  # and their ends


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> Overlaps:
    """Merge one piece: its own ends, and the ids of the tokens that end there and of the next one."""
    both = np.concatenate((ends_a, ends_b))
    order = np.argsort(both, kind="stable")  # two sorted runs: a merge
    ends, from_a = both[order], order < len(ends_a)
    first = np.flatnonzero(np.diff(ends, prepend=-1))  # equal ends are one
    before_a = (np.cumsum(from_a) - from_a)[first]
    before_b = first - before_a
    tie = np.diff(first, append=len(ends)) > 1
    pairs = ids_a[before_a].astype(np.uint32) << np.uint32(16) | ids_b[before_b]
    return Overlaps(pairs, ends[first], before_a[tie], before_b[tie], ends[first][tie])


def written(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, digits) -> tuple[bytes, np.ndarray]:
    """Groups as ``a1,a2|b1;`` one after the other, and where each one ends in it."""
    table, counted, lengths = digits
    na, nb = len(ids_a), len(ids_b)
    of_a = np.searchsorted(cut_a, np.arange(na), "left")  # the group of each token
    of_b = np.searchsorted(cut_b, np.arange(nb), "left")
    place_a = np.arange(na) + np.concatenate(([0], cut_b + 1))[of_a]
    place_b = np.arange(nb) + np.append(cut_a + 1, na)[of_b]
    ids, marks = np.empty(na + nb, np.uint16), np.full(na + nb, ord(","), np.uint64)
    ids[place_a], ids[place_b] = ids_a, ids_b
    marks[place_a[cut_a]], marks[place_b[cut_b]] = ord("|"), ord(";")
    size = lengths[ids]
    rows = table[ids] | marks << (8 * size).astype(np.uint64)
    text = rows.view(np.uint8)[counted[ids].view(bool)].tobytes()
    return text, np.cumsum(size + 1)[place_b[cut_b]]


SQUEEZE = zstandard.ZstdCompressor(level=1)


def _squeezed(a: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, compressed."""
    return SQUEEZE.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _loosened(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


PART = "row long, id {}, part int, last boolean, n_a long, n_b long, n_groups long, n_links long, groups string, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>"
BLOCK_ROW = "block long, pairs binary, times binary, sizes binary, ranks binary, counts binary, parts array<struct<{}>>"


def _sha(text: str | None) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def _encoded(tok: Tokenizers, texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of each text, encoded for ``WINDOW`` characters of them at a time."""
    now, size = [], 0
    for text in texts:
        now.append(text)
        size += len(text or "")
        if size >= WINDOW:
            yield from tok.encode(now)
            now, size = [], 0
    yield from tok.encode(now)


def _blocks(paths: tuple[str, str], digest: bool, piece: int, block: int):
    """Texts as blocks of merged pieces: the distinct id pairs with their numbers, and every
    text's part with what it holds of them."""

    def merged(tok: Tokenizers, docs: list, part_of: dict) -> Iterator[dict]:
        ids_a, ids_b = np.concatenate([d[2] for d in docs]), np.concatenate([d[3] for d in docs])
        ends_a, ends_b = np.cumsum(tok.length_a[ids_a]), np.cumsum(tok.length_b[ids_b])
        stop_a, stop_b = np.cumsum([len(d[2]) for d in docs]), np.cumsum([len(d[3]) for d in docs])
        stops = np.concatenate(([0], ends_a))[stop_a]  # where texts end; those without tokens end where the one before does
        cuts = diagonals(ends_a, ends_b, piece)
        spans = list(zip(cuts[:-1], cuts[1:]))
        parts, keys, owners, done = [], [], [], 0
        for n, ((i0, j0), (i1, j1)) in enumerate(spans):
            got = overlaps(ends_a[i0:i1], ends_b[j0:j1], ids_a[i0:i1 + 1], ids_b[j0:j1 + 1])
            text, places = written(ids_a[i0:i1], ids_b[j0:j1], got.cut_a, got.cut_b, tok.digits)
            from_, end = int(max(ends_a[i0 - 1] if i0 else 0, ends_b[j0 - 1] if j0 else 0)), int(got.ends[-1])
            d = int(np.searchsorted(stops, from_, "right"))
            at = from_
            while at < end:
                row, name = docs[d][:2]
                stop = int(stops[d])
                lo, hi = np.searchsorted(got.ends, [at, stop], "right")
                g0, g1 = np.searchsorted(got.cut_at, [at, stop], "right")
                a0, b0 = max(i0, stop_a[d] - len(docs[d][2])) - i0, max(j0, stop_b[d] - len(docs[d][3])) - j0
                a1, b1 = min(i1, stop_a[d]) - i0, min(j1, stop_b[d]) - j0
                last = stop <= end
                p = {"row": row, "id": name, "part": part_of.get(row, 0), "last": last, "n_a": int(a1 - a0), "n_b": int(b1 - b0),
                     "n_groups": int(g1 - g0), "n_links": int(hi - lo), "groups": None,
                     "head_a": None, "head_b": None, "tail_a": None, "tail_b": None}
                begin = int(places[g0 - 1]) if g0 else 0
                if last and not p["part"]:
                    whole = text[begin:int(places[g1 - 1]) - 1].decode()
                    p["groups"] = _sha(whole) if digest else whole
                else:
                    part_of[row] = p["part"] + 1
                    ca, cb = a0, b0  # behind the first group's end, and the last one's
                    if g1 > g0:
                        ca, cb = int(got.cut_a[g0]) + 1, int(got.cut_b[g0]) + 1
                        p["head_a"], p["head_b"] = ids_a[i0 + a0:i0 + ca].tolist(), ids_b[j0 + b0:j0 + cb].tolist()
                        p["groups"] = text[int(places[g0]):int(places[g1 - 1])].decode()
                        ca, cb = int(got.cut_a[g1 - 1]) + 1, int(got.cut_b[g1 - 1]) + 1
                    p["tail_a"], p["tail_b"] = ids_a[i0 + ca:i0 + a1].tolist(), ids_b[j0 + cb:j0 + b1].tolist()
                owners.append(np.full(hi - lo, len(parts), np.int64))
                parts.append(p)
                at, d = min(stop, end), int(np.searchsorted(stops, min(stop, end), "right"))
            keys.append(got.pairs)
            done += i1 - i0 + j1 - j0
            if done >= block or n == len(spans) - 1:
                yield counted(np.concatenate(keys), np.concatenate(owners), parts)
                parts, keys, owners, done = [], [], [], 0

    def counted(keys: np.ndarray, owners: np.ndarray, parts: list[dict]) -> dict:
        pairs, times = np.unique(keys, return_counts=True)
        both, counts = np.unique(owners << 32 | np.searchsorted(pairs, keys), return_counts=True)
        sizes = np.bincount(both >> 32, minlength=len(parts))
        return {"pairs": _squeezed(np.diff(pairs, prepend=np.uint32(0))), "times": _squeezed(times), "sizes": _squeezed(sizes),
                "ranks": _squeezed(np.diff(both & 0xFFFFFFFF, prepend=0)), "counts": _squeezed(counts), "parts": parts}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(*paths)
        task = TaskContext.get().partitionId() << 40
        rows, made, docs, ends, kind, part_of = 0, 0, [], 0, None, {}
        bare: list[dict] = []

        def out(found: dict) -> pa.RecordBatch:
            nonlocal made
            made += 1
            fields = [pa.field("row", pa.int64()), pa.field("id", kind), pa.field("part", pa.int32()), pa.field("last", pa.bool_()),
                      *(pa.field(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.field("groups", pa.string()),
                      *(pa.field(c, pa.list_(pa.int32())) for c in ("head_a", "head_b", "tail_a", "tail_b"))]
            packed = {c: pa.array([found[c]], pa.binary()) for c in ("pairs", "times", "sizes", "ranks", "counts")}
            return pa.RecordBatch.from_pydict({"block": pa.array([task + made], pa.int64()), **packed,
                                               "parts": pa.array([found["parts"]], pa.list_(pa.struct(fields)))})

        for batch in batches:
            kind = batch.column(0).type
            texts = (None if raw is None else raw.decode("utf-8") for raw in batch.column(1).to_pylist())
            for name, (a, b) in zip(batch.column(0).to_pylist(), _encoded(tok, texts)):
                row = task + rows
                rows += 1
                if not len(a):
                    bare.append({"row": row, "id": name, "part": 0, "last": True, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": ""})
                    if len(bare) >= 10_000:
                        yield out(counted(np.zeros(0, np.uint32), np.zeros(0, np.int64), bare))
                        bare = []
                    continue
                docs.append((row, name, a, b))
                ends += len(a) + len(b)
                if ends >= block:
                    for found in merged(tok, docs, part_of):
                        yield out(found)
                    docs, ends = [], 0
        for found in merged(tok, docs, part_of) if docs else ():
            yield out(found)
        if bare:
            yield out(counted(np.zeros(0, np.uint32), np.zeros(0, np.int64), bare))

    return blocks


def _pairs(with_times: bool):
    """The distinct id pairs of each block, with how often they are linked there or with the block."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = pa.array(np.cumsum(_loosened(batch.column("pairs")[i].as_py()), dtype=np.int64))
                if with_times:
                    other = pa.array(_loosened(batch.column("times")[i].as_py()).astype(np.int64))
                else:
                    other = pa.array(np.full(len(keys), batch.column("block")[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([keys, other], names=["pair", "n" if with_times else "block"])

    return pairs


def _summed(block: pa.Table, known: pa.Table) -> pa.Table:
    """The parts of one block with the sums over their overlaps."""
    row = block.combine_chunks()
    parts = pa.Table.from_batches([pa.RecordBatch.from_struct_array(row.column("parts").chunk(0).values)])
    order = np.argsort(known.column("pair").to_numpy())  # as the block's pairs are sorted
    n, top = known.column("n").to_numpy()[order], known.column("top").to_numpy(zero_copy_only=False)[order]
    sizes, counts = _loosened(row.column("sizes")[0].as_py()).astype(np.int64), _loosened(row.column("counts")[0].as_py()).astype(np.int64)
    ranks = np.cumsum(_loosened(row.column("ranks")[0].as_py()).view(np.int32), dtype=np.int64)
    until = np.cumsum(sizes)
    for name, values in (("n_best", counts * top[ranks]), ("count_sum", counts * n[ranks])):
        total = np.concatenate(([0], np.cumsum(values)))
        parts = parts.append_column(name, pa.array((total[until] - total[until - sizes]).astype(np.int64)))
    return parts


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _stitched(digest: bool):
    """The parts of one text as one."""

    def stitched(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda p: p["part"])
        a, b, text = [], [], []
        for p in parts:
            if p["head_a"] is not None:
                text.append(f"{','.join(map(str, a + p['head_a']))}|{','.join(map(str, b + p['head_b']))};{p['groups']}")
                a, b = [], []
            a, b = a + p["tail_a"], b + p["tail_b"]
        whole = "".join(text)[:-1]
        out = {"id": table.column("id").slice(0, 1), "groups": pa.array([_sha(whole) if digest else whole])}
        return pa.table(out | {c: pa.array([sum(p[c] for p in parts)], pa.int64()) for c in SUMS})

    return stitched


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None,
          digest: bool = False, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` for every row of ``docs``.

    A (``path_a``, a byte-level vocabulary) encodes space and text, B (``path_b``, a piece
    model) the text, to which it adds the space; both take the strings of special tokens as
    text. ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids between offsets where tokens of both
    end; with ``digest`` its SHA-256 in hexadecimals. ``n_links`` counts overlaps; an id pair's
    count is the number of its overlaps in all texts, ``count_sum`` adds it over a text's overlaps, and
    ``n_best`` counts those whose pair has the highest count of its B id, ties included.

    Texts that are null, empty, or that the tokens of either side do not spell, have zeros
    and no groups. Repeated rows, and rows without an id, are texts of their own. No rows, no results. Other
    columns are not read. A long text's pieces may lie in several blocks; its parts meet by row.
    """
    import public_tokenizers

    paths = (path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model"))
    part = PART.format(docs.schema[id_col].dataType.simpleString())
    schema = BLOCK_ROW.format(part.replace(" ", ":").replace(",:", ","))
    texts = docs.select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("text"))
    blocks = materialise(texts.mapInArrow(_blocks(paths, digest, piece, block), schema), "blocks")

    counts = materialise(blocks.select("block", "pairs", "times").mapInArrow(_pairs(True), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFF).cast("long"))
    best = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))  # a row an id of B, 65,536 at most
    known = counts.withColumn("b", of_b).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    asked = blocks.select("block", "pairs").mapInArrow(_pairs(False), "pair long, block long").join(known, "pair")
    result = f"{part}, n_best long, count_sum long"
    parts = materialise(blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_summed, result), "parts")

    alone = parts.where((F.col("part") == 0) & F.col("last"))
    shared = parts.where((F.col("part") > 0) | ~F.col("last"))
    names = ["id", *SUMS, "groups"]
    stitched = shared.groupBy("row").applyInArrow(
        _stitched(digest), f"id {docs.schema[id_col].dataType.simpleString()}, groups string, " + ", ".join(f"{c} long" for c in SUMS))
    return alone.select(names).union(stitched.select(names))
