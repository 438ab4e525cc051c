"""Benchmark decontamination with a generalised suffix automaton over normalised test items.

Items become sequences of word numbers and are joined, each behind a separator of its own, in one
automaton. Document words stream through it; at each word the longest suffix that occurs in an item
is known, and a suffix of at least a window's length (or a whole shorter item) is an occurrence.

Only runs of words that all occur in items are streamed; a word that no item has resets the
automaton, so skipping the words between such runs changes nothing.

The automaton is built on the driver and shipped to the tasks. Items are taken in blocks of at most
``block_words`` words (a longer item is a block of its own), one pass of the documents for each block. Each
pass but the last is settled and its automaton destroyed before the next begins, so the driver and a task
hold one automaton at a time however large the benchmark is; hits of several blocks are united.

Defined cases: null or wordless documents have no words and are clean; null or wordless items never
occur; an item of fewer words than a window is one window; a repeated item id counts once; repeated
document rows are each returned; an item with a null id hits words but is not counted or listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.support import append_columns, settle, small_batches, thrifty

#: Lower-cases A-Z and blanks all bytes outside words, which are digits, letters and any byte from 0x80.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Decontam:
    """window: consecutive words; block_words: words of items in one automaton.

    Removal: a document with at least drop_percent of its words hit is dropped, and of the others
    the hit spans are cut out.
    """

    window: int = 10
    block_words: int = 200_000
    drop_percent: int = 80


def item_words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    return raw.translate(_WORD_BYTES).split()


@dataclass
class Automaton:
    """Suffix automaton of items; ``owners[v]`` lists the items that hold a window in state v."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    go: list[dict[int, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    ends: dict[int, set[int]] = field(default_factory=dict)
    whole: dict[int, dict[int, set[int]]] = field(default_factory=dict)
    shortest: int = 0

    @classmethod
    def build(cls, items: list[list[bytes]], window: int) -> Automaton:
        self = cls(window)
        lengths = [len(x) for x in items if x]
        self.shortest = min([window, *lengths])
        last, separator = 0, -1
        tails: list[tuple[int, int, int]] = []
        for number, item in enumerate(items):
            if not item:
                continue
            separator -= 1
            last = self._extend(last, separator)
            for word in item:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                self.ends.setdefault(last, set()).add(number)
            if len(item) < window:
                tails.append((number, last, len(item)))
        # Where an item ends, all states on the suffix path hold it, down to windows' lengths.
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.length[self.link[v]] >= window and v in self.ends:
                self.ends.setdefault(self.link[v], set()).update(self.ends[v])
        for number, v, size in tails:
            while self.length[self.link[v]] >= size:
                v = self.link[v]
            self.whole.setdefault(v, {}).setdefault(size, set()).add(number)
        # Only windows and whole short items are asked for their owners.
        self.ends = {v: owners for v, owners in self.ends.items() if self.length[v] >= window}
        return self

    def _state(self, go: dict[int, int], length: int, link: int) -> int:
        self.go.append(go)
        self.length.append(length)
        self.link.append(link)
        return len(self.go) - 1

    def _extend(self, last: int, symbol: int) -> int:
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and symbol not in self.go[p]:
            self.go[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][symbol]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                twin = self._state(dict(self.go[q]), self.length[p] + 1, self.link[q])
                while p >= 0 and self.go[p].get(symbol) == q:
                    self.go[p][symbol] = twin
                    p = self.link[p]
                self.link[q] = self.link[new] = twin
        return new

    def scan(self, run: list[int]) -> tuple[np.ndarray, set[int]]:
        """Which words of a run of known words lie in an occurrence, and the items that occur."""
        hit = np.zeros(len(run), dtype=bool)
        items: set[int] = set()
        state = size = 0
        go, length, link = self.go, self.length, self.link
        for i, symbol in enumerate(run):
            while state and symbol not in go[state]:
                state = link[state]
                size = length[state]
            state = go[state].get(symbol, 0)
            size = size + 1 if state else 0
            if size < self.shortest:
                continue
            if size >= self.window:
                hit[i - size + 1 : i + 1] = True
                v = state
                while length[link[v]] >= self.window:
                    v = link[v]
                items |= self.ends.get(v, set())
            v = state if self.whole else 0
            while v > 0:
                for n, owners in self.whole.get(v, {}).items():
                    if n <= size:
                        hit[i - n + 1 : i + 1] = True
                        items |= owners
                v = link[v]
        return hit, items


def scan_text(text: bytes, automaton: Automaton) -> tuple[int, np.ndarray, set[int]]:
    """(words, numbers of the hit words, items) of one document."""
    found = text.translate(_WORD_BYTES).split()
    get = automaton.vocabulary.get
    ids = np.fromiter((get(w, -1) for w in found), dtype=np.int32, count=len(found))
    known = np.concatenate(([False], ids >= 0, [False]))
    edge = np.flatnonzero(known[1:] != known[:-1])
    hits, items = [], set()
    for lo, hi in zip(edge[::2], edge[1::2], strict=True):
        if hi - lo >= automaton.shortest:
            hit, owners = automaton.scan(ids[lo:hi].tolist())
            if hit.any():
                hits.append(lo + np.flatnonzero(hit))
                items |= owners
    return len(found), np.concatenate(hits) if hits else np.zeros(0, np.int64), items


def item_blocks(benchmark: DataFrame, p: Decontam, id_col: str, text_col: str) -> Iterator[tuple[list[str | None], Automaton]]:
    """Automata of the distinct items, a block of bounded size at a time; nothing larger is held."""
    ids: list[str | None] = []
    items: list[list[bytes]] = []
    size = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct()
    for row in rows.toLocalIterator():
        words = item_words(row["t"])
        if items and size + len(words) > p.block_words:
            yield ids, Automaton.build(items, p.window)
            ids, items, size = [], [], 0
        ids.append(row["i"])
        items.append(words)
        size += len(words)
    yield ids, Automaton.build(items, p.window)


def occurrences(docs: DataFrame, benchmark: DataFrame, p: Decontam = Decontam(), text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, hit (numbers of hit words, ascending) and items (ids of occurring items)."""
    small_batches(docs.sparkSession)
    out = docs
    sc = docs.sparkSession.sparkContext
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]
    for number, (ids, automaton) in enumerate(item_blocks(benchmark, p, item_id, item_text)):
        shipped = sc.broadcast((ids, automaton))

        def maker(shipped=shipped):
            ids, automaton = shipped.value

            def compute(column: pa.Array) -> list[pa.Array]:
                n, hits, items = [], [], []
                for text in column.cast(pa.binary()).to_pylist():
                    size, hit, owners = scan_text(text or b"", automaton)
                    n.append(size)
                    hits.append(hit)
                    items.append(sorted({ids[x] for x in owners if ids[x] is not None}))
                return [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

            return compute

        if number:
            # One block's pass ends before the next begins.
            out = settle(out).withColumnsRenamed({"hit": "__hit", "items": "__items"})
            before.destroy()
        out = append_columns(out, fields, maker, text_col)
        before = shipped
        if number:
            out = out.withColumns({"hit": F.array_sort(F.array_union("hit", "__hit")), "items": F.array_sort(F.array_union("items", "__items"))}).drop("__hit", "__items")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, p: Decontam = Decontam(), id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs."""
    found = occurrences(docs.select(F.col(id_col).alias("doc_id"), "text"), benchmark, p)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def cut_spans(text: str, hit: list[int]) -> str:
    """The text without its hit words; what stands between two words that follow each other in hit goes too."""
    if not hit:
        return text
    raw = text.encode("utf-8")
    flat = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    h = np.asarray(hit)
    first = h[np.concatenate(([True], np.diff(h) > 1))]
    last = h[np.concatenate((np.diff(h) > 1, [True]))]
    out, at = [], 0
    for a, b in zip(first, last, strict=True):
        out.append(raw[at : start[a]])
        at = int(end[b])
    out.append(raw[at:])
    return b"".join(out).decode("utf-8")


def decontaminated(docs: DataFrame, benchmark: DataFrame, p: Decontam = Decontam()) -> DataFrame:
    """docs without contaminated spans; documents with too large a share hit are dropped.

    Other columns stay; clean rows are unchanged, nulls included.
    """
    hit = "__hit_words"
    taken = [c for c in docs.columns if c.lower() in ("hit", "items", "n_words")]
    if taken:
        moved = {c: f"__own_{c}" for c in taken}
        back = {v: k for k, v in moved.items()}
        return decontaminated(docs.withColumnsRenamed(moved), benchmark, p).withColumnsRenamed(back).select(docs.columns)
    found = occurrences(docs, benchmark, p).withColumnRenamed("hit", hit)
    kept = found.where(F.size(hit) * 100 < F.greatest(F.col("n_words"), F.lit(1)) * p.drop_percent)
    clean = kept.drop("n_words", "items")

    def run(batches):
        for batch in batches:
            at, h = batch.schema.get_field_index("text"), batch.schema.get_field_index(hit)
            hits = batch.column(h).to_pylist()
            if any(hits):
                texts = [t if t is None or not x else cut_spans(t, x) for t, x in zip(batch.column(at).to_pylist(), hits, strict=True)]
                batch = batch.set_column(at, "text", pa.array(texts, pa.string()))
            yield batch.drop_columns([hit])

    out = clean.mapInArrow(thrifty(run), docs.schema)
    return out.select(docs.columns)
