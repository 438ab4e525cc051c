"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

The pieces are those of a public vocabulary file, which is never trained or copied. Where the file
gives merge ranks and no log probabilities, the piece of rank r gets Zipf's: -log(r + 1) less the log
of their sum. A character that no piece covers costs ``unknown`` below the least score and is written
as byte pieces.

Markers: a text gets one in front and each blank is one; decoding turns them back and drops the first.
As no piece crosses a unit (checked), the best path of a text is that of its units, and the best path
of a distinct unit is found once while it is remembered. The units that are new in a group of texts walk the
trie side by side, a step of all at once; long units go alone and aren't remembered. Of paths of one score
the one whose last piece is longest wins.

Defined cases: null and empty texts have no pieces and decode to the empty text; a text that holds
U+2581 itself decodes to a blank in its place and is not a round trip of its bytes; long texts are
encoded whole; rows that repeat are each returned.
"""

from __future__ import annotations

import math
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm import pieces
from linkweave.llm.support import append_columns, small_batches


@dataclass(frozen=True)
class Unigram:
    """model: path of a sentencepiece model on the driver; unknown: penalty of a byte-written character;
    remembered: distinct units that a task keeps, none of over unit_bytes bytes, which bounds its memory."""

    model: str = ""
    unknown: float = 10.0
    remembered: int = 120_000
    unit_bytes: int = 48

    @property
    def path(self) -> str:
        return self.model or public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class DoubleArray:
    """A byte trie in two arrays: the child of s by byte b is base[s] + b + 1 if check there is s.

    value[s] is the piece that ends in s, or -1.
    """

    base: array
    check: array
    value: array

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        """Breadth first; the children of a node go to the first base where all their places are free."""
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for key in sorted(keys):
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = keys[key]
        room = 512
        used = np.zeros(room, dtype=bool)
        base, check, value = [0] * room, [-1] * room, [-1] * room
        used[0] = True
        value[0] = ends[0]
        hint, queue = 1, [(0, 0)]
        for node, place in queue:
            wanted = np.fromiter(children[node], dtype=np.int64) + 1 if children[node] else None
            if wanted is None:
                continue
            while hint < room - 1 and used[hint]:
                hint += 1
            at = first = max(0, hint - int(wanted.min()))
            while True:
                while at + 258 >= room:
                    used = np.concatenate((used, np.zeros(room, dtype=bool)))
                    for a, fill in ((base, 0), (check, -1), (value, -1)):
                        a.extend([fill] * room)
                    room *= 2
                if not used[at + wanted].any():
                    break
                at += 1
            if at - first > 64:  # nearly full below: later nodes start here
                hint = at + int(wanted.min())
            base[place] = at
            for b, child in children[node].items():
                to = at + b + 1
                used[to] = True
                check[to] = place
                value[to] = ends[child]
                queue.append((child, to))
        size = int(np.flatnonzero(used)[-1]) + 258
        # Four bytes a place; they go to every worker.
        return cls(*(array("i", a[:size]) for a in (base, check, value)))


class Codec:
    """Encodes and decodes; built once on the driver and broadcast, about as large as the vocabulary."""

    def __init__(self, p: Unigram):
        sp = sentencepiece.SentencePieceProcessor(model_file=p.path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.bytes = [0] * 256
        self.surface: list[bytes] = [b""] * n
        ordinary: list[int] = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                code = int(name[3:5], 16)
                self.bytes[code] = i
                self.surface[i] = bytes([code])
            elif not special[i]:
                ordinary.append(i)
                self.surface[i] = name.replace(pieces.MARK, " ").encode("utf-8")
        self.separable = pieces.separable([names[i] for i in ordinary])
        total = math.log(sum(1 / (r + 2) for r in range(len(ordinary))))
        self.score = [0.0] * n
        for r, i in enumerate(ordinary):
            self.score[i] = -math.log(r + 2) - total
        self.unknown = min(self.score[i] for i in ordinary) - p.unknown
        self.trie = DoubleArray.build({names[i].encode("utf-8"): i for i in ordinary})
        self.arrays = tuple(np.array(a, dtype=np.int32) for a in (self.trie.base, self.trie.check, self.trie.value, self.bytes))
        self.scores = np.array(self.score)

    def best(self, unit: str) -> list[int]:
        """The pieces of the best path over a unit, which begins with a marker that is not given."""
        raw = (pieces.MARK + unit.replace(" ", pieces.MARK)).encode("utf-8")
        n = len(raw)
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        low = -math.inf
        best = [low] * (n + 1)
        best[0] = 0.0
        back = [0] * (n + 1)
        by = [-1] * (n + 1)
        for i in range(n):
            here = best[i]
            if here == low:
                continue
            lead = raw[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            single = False
            s, j = 0, i
            while j < n:
                to = base[s] + raw[j] + 1
                if check[to] != s:
                    break
                s = to
                j += 1
                piece = value[s]
                if piece >= 0:
                    if j - i == width:
                        single = True
                    if (got := here + score[piece]) > best[j]:
                        best[j], back[j], by[j] = got, i, piece
            if not single and (got := here + self.unknown) > best[i + width]:
                best[i + width], back[i + width], by[i + width] = got, i, -1
        out: list[int] = []
        at = n
        while at:
            i = back[at]
            if by[at] >= 0:
                out.append(by[at])
            else:
                out.extend(self.bytes[b] for b in reversed(raw[i:at]))
            at = i
        out.reverse()
        return out

    def best_many(self, raws: list[bytes]) -> list[bytes]:
        """The pieces of the best paths over units with their markers, as little-endian int32; one step of all at a time.

        Equal to ``best`` for each: scores are added in the same order, and a later path must score more.
        """
        base, check, value, byte_piece = self.arrays
        size = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        n, most = len(raws), int(size.max())
        at = np.concatenate(([0], np.cumsum(size)))
        text = np.zeros((n, most), dtype=np.int32)
        inside = np.arange(most) < size[:, None]
        text[inside] = np.frombuffer(b"".join(raws), dtype=np.uint8)
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0.0
        back = np.zeros((most + 1, n), dtype=np.int32)
        by = np.full((most + 1, n), -1, dtype=np.int32)
        for i in range(most):
            live = np.flatnonzero((size > i) & (best[i] > -np.inf))
            if not len(live):
                continue
            lead = text[live, i]
            width = 1 + (lead >= 0x80) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(n, dtype=bool)
            wide = np.zeros(n, dtype=np.int64)
            wide[live] = width
            now, state = live, np.zeros(len(live), dtype=np.int32)
            for j in range(i, most):
                to = base[state] + text[now, j] + 1
                good = (check[to] == state) & (size[now] > j)
                now, state = now[good], to[good]
                if not len(now):
                    break
                piece = value[state]
                ends = piece >= 0
                unit, piece = now[ends], piece[ends]
                single[unit[wide[unit] == j - i + 1]] = True
                got = best[i, unit] + self.scores[piece]
                more = got > best[j + 1, unit]
                unit = unit[more]
                best[j + 1, unit], back[j + 1, unit], by[j + 1, unit] = got[more], i, piece[more]
            unit = live[~single[live]]
            to = i + wide[unit]
            got = best[i, unit] + self.unknown
            more = got > best[to, unit]
            unit, to = unit[more], to[more]
            best[to, unit], back[to, unit], by[to, unit] = got[more], i, -1
        owner, start, pieces_ = [], [], []
        unit, end = np.arange(n), size.copy()
        while len(unit):
            first, piece = back[end, unit].astype(np.int64), by[end, unit]
            known = piece >= 0
            owner.append(unit[known])
            start.append(first[known])
            pieces_.append(piece[known])
            for k in range(4):
                spelled = ~known & (first + k < end)
                owner.append(unit[spelled])
                start.append(first[spelled] + k)
                pieces_.append(byte_piece[text[unit[spelled], first[spelled] + k]])
            rest = first > 0
            unit, end = unit[rest], first[rest]
        owner, start, flat = np.concatenate(owner), np.concatenate(start), np.concatenate(pieces_)
        flat = flat[np.argsort(at[owner] + start, kind="stable")].astype("<i4").tobytes()
        to = 4 * np.cumsum(np.bincount(owner, minlength=n))
        ends = to.tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of pieces, without the first marker; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


#: Characters of texts whose units are looked up together, unless one text is longer; and units that walk side by side.
GROUP_CHARS = 1_000_000
SIDE_BY_SIDE = 8_192


class Encoder:
    """A codec with a bounded memory of units; for texts of one task."""

    def __init__(self, codec: Codec, p: Unigram):
        self.codec, self.most, self.longest = codec, p.remembered, p.unit_bytes
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> list[str]:
        """Put the pieces of new units among the known ones; returns the long units."""
        known, codec = self.known, self.codec
        head = pieces.MARK.encode("utf-8")
        # A unit that has no other marker, the usual case, needs no replacement.
        raws = [head + (u.replace(" ", pieces.MARK) if " " in u else u).encode("utf-8") for u in new]
        order = sorted((i for i, r in enumerate(raws) if len(r) <= self.longest), key=lambda i: len(raws[i]))
        for lo in range(0, len(order), SIDE_BY_SIDE):
            some = order[lo : lo + SIDE_BY_SIDE]
            known.update(zip([new[i] for i in some], codec.best_many([raws[i] for i in some]), strict=True))
        long = [u for u, r in zip(new, raws, strict=True) if len(r) > self.longest]
        for u in long:
            known[u] = np.array(codec.best(u), dtype="<i4").tobytes()
        return long

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        found = [pieces.units(t) for t in texts] if self.codec.separable else [[t] if t else [] for t in texts]
        every = set().union(*found)
        new = every.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = every
        long = self._learn(list(new))
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, f)), dtype="<i4") for f in found]
        for u in long:
            del self.known[u]
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        group: list[str] = []
        size = 0
        for t in texts:
            if group and size + len(t) > GROUP_CHARS:
                out += self._group(group)
                group, size = [], 0
            group.append(t)
            size += len(t)
        return out + (self._group(group) if group else [])


def encode_decode(docs: DataFrame, p: Unigram = Unigram(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (little-endian int32 ids), round_trip; with_ids: ids array<int>; with_text: decoded string.

    round_trip: decoding the ids gives the text back, its U+2581 read as blanks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(Codec(p))

    def maker():
        codec = shipped.value
        encoder = Encoder(codec, p)
        is_byte = np.zeros(len(codec.surface), dtype=bool)
        is_byte[codec.bytes] = True

        def compute(column: pa.Array) -> list[pa.Array]:
            ids, n_bytes, back, texts = [], [], [], []
            every = [t or "" for t in column.to_pylist()]
            for text, x in zip(every, encoder.encode_all(every), strict=True):
                decoded = codec.decode(x.tolist())
                ids.append(x)
                n_bytes.append(int(is_byte[x].sum()))
                back.append(decoded == text.replace(pieces.MARK, " "))
                texts.append(decoded)
            out = [pa.array([len(x) for x in ids], pa.int64()), pa.array(n_bytes, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(back, pa.bool_())]
            if with_ids:
                at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int32))))
            if with_text:
                out.append(pa.array(texts, pa.string()))
            return out

        return compute

    fields = [T.StructField("n_pieces", T.LongType()), T.StructField("n_byte_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if with_text:
        fields.append(T.StructField("decoded", T.StringType()))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return append_columns(rows, fields, maker, drop=("text",))
