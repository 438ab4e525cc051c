"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

The statistics come from vectorised passes over the UTF-8 buffer and need nothing but the text. Trees
are grown level by level on features cut into quantile bins, for the logistic loss with second-order
gains, and flattened into arrays: a batch walks all trees at once by numpy indexing.

Only rows with known labels that are not held out are learned from, at most about ``sample_rows`` of
them, drawn by a hash of the id. Scoring is a pass over whole texts.

Defined cases: null, empty and wordless texts have the statistics 0 and are scored; without both labels
in the training rows every score is the share of label 1 (1 without any row); repeated document rows
are each scored; of labels that repeat an id, the rounded mean counts; of rows that repeat a labelled id,
the one of the smallest statistics is learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm import hashing
from linkweave.llm.support import append_columns, held_out, settle, small_batches, text_slices, thrifty


@dataclass(frozen=True)
class Quality:
    sample_rows: int = 20_000
    bins: int = 64
    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    ridge: float = 2.0
    least: float = 5.0
    cut: float = 0.3


#: Classes of bytes that are counted; a byte may be in several.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#*$%&<>@^~=_+/\\{}[]",
    "quote": b"\"'()",
    "line": b"\n",
    "other": bytes(range(128, 256)),
}
_TABLES = np.zeros((len(_CLASSES), 256), dtype=np.uint8)
for _row, _members in zip(_TABLES, _CLASSES.values(), strict=True):
    _row[list(_members)] = 1

NAMES = [
    "log_bytes", "log_words", *_CLASSES,
    "word_mean", "word_sd", "word_log_max", "short_words", "capital_words", "marked_words",
    "again", "distinct", "pair_distinct", "top_word", "log_lines", "line_mean", "repeated_lines",
]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[at[1:]] - total[at[:-1]]


def statistics(column: pa.Array) -> np.ndarray:
    """The statistics of each text, rows by NAMES."""
    out = np.zeros((len(column), len(NAMES)), dtype=np.float32)
    for first, to, buffer, offsets in text_slices(column):
        n = to - first
        size = np.maximum(np.diff(offsets), 1).astype(np.float64)
        h, start, end = hashing.words(buffer, offsets)
        at = np.searchsorted(start, offsets)
        words = np.diff(at)
        w = np.maximum(words, 1).astype(np.float64)
        x: list[np.ndarray] = [np.log1p(np.diff(offsets)), np.log1p(words)]
        counts = [_sums(table[buffer], offsets) for table in _TABLES]
        x += [c / size for c in counts]
        length = (end - start).astype(np.float64)
        mean = _sums(length, at) / w
        x += [mean, np.sqrt(np.maximum(_sums(length * length, at) / w - mean * mean, 0))]
        longest = np.zeros(n)
        if len(h):
            full = words > 0
            longest[full] = np.maximum.reduceat(length, at[:-1][full])
        x.append(np.log1p(longest))
        x.append(_sums(length <= 2, at) / w)
        lead = buffer[start] if len(h) else buffer[:0]
        tail = buffer[end - 1] if len(h) else buffer[:0]
        x.append(_sums((lead >= 65) & (lead <= 90), at) / w)
        x.append(_sums(((tail < 48) | ((tail > 57) & (tail < 65)) | ((tail > 90) & (tail < 97)) | ((tail > 122) & (tail < 128))), at) / w)
        same = np.zeros(len(h), dtype=bool)
        same[1:] = h[1:] == h[:-1]
        same[at[:-1][words > 0]] = False
        x.append(_sums(same, at) / w)
        few, pairs, top, lines, again = (np.zeros(n) for _ in range(5))
        line_white = hashing.WHITE.copy()
        line_white[:] = False
        line_white[10] = True
        lh, ls, _ = hashing.words(buffer, offsets, fold=False, white=line_white)
        la = np.searchsorted(ls, offsets)
        for i in range(n):
            own = h[at[i] : at[i + 1]]
            if len(own):
                _, k = np.unique(own, return_counts=True)
                few[i], top[i] = len(k) / len(own), k.max() / len(own)
                two = hashing.windows(own, 2)
                pairs[i] = len(np.unique(two)) / len(two) if len(two) else 1
            mine = lh[la[i] : la[i + 1]]
            lines[i] = len(mine)
            again[i] = 1 - len(np.unique(mine)) / len(mine) if len(mine) else 0
        x += [few, pairs, top, np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), again]
        out[first:to] = np.column_stack(x)
    return out


@dataclass
class Forest:
    """Flattened trees: node arrays side by side, each tree's root at roots; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))[:, None]
        for lo in range(0, len(self.roots), 20):
            node = np.broadcast_to(self.roots[lo : lo + 20], (len(x), len(self.roots[lo : lo + 20]))).copy()
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] > self.cut[node], self.right[node], self.left[node])
            total += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, p: Quality) -> Forest:
    """Boosted trees of logistic loss; nodes split where the second-order gain is largest."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.int64)
    share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    score = np.full(n, start)
    nodes: list[list[float]] = []
    roots = []
    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-score))
        g, hess = q - y, np.maximum(q * (1 - q), 1e-6)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        where = np.full(n, roots[-1])
        live = [roots[-1]]
        for level in range(p.depth + 1):
            slot = {v: i for i, v in enumerate(live)}
            lookup = np.full(len(nodes), -1)
            lookup[live] = np.arange(len(live))
            at = lookup[where]
            on = at >= 0
            a, gg, hh = at[on], g[on], hess[on]
            sg, sh = np.bincount(a, gg, len(live)), np.bincount(a, hh, len(live))
            for v, i in slot.items():
                nodes[v][4] = -p.rate * sg[i] / (sh[i] + p.ridge)
            if level == p.depth:
                break
            best = np.full(len(live), 1e-3)
            pick: list[tuple[int, int] | None] = [None] * len(live)
            for j in range(m):
                k = len(edges[j]) + 1
                if k == 1:
                    continue
                key = a * k + binned[on, j]
                hg = np.bincount(key, gg, len(live) * k).reshape(len(live), k).cumsum(1)[:, :-1]
                hs = np.bincount(key, hh, len(live) * k).reshape(len(live), k).cumsum(1)[:, :-1]
                rest_g, rest_h = sg[:, None] - hg, sh[:, None] - hs
                gain = hg**2 / (hs + p.ridge) + rest_g**2 / (rest_h + p.ridge) - (sg**2 / (sh + p.ridge))[:, None]
                gain[(hs < p.least / 4) | (rest_h < p.least / 4)] = 0
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(len(live)), top] > best):
                    best[i], pick[i] = gain[i, top[i]], (j, int(top[i]))
            following = []
            for v, i in slot.items():
                if pick[i] is None:
                    continue
                j, b = pick[i]
                lower, upper = len(nodes), len(nodes) + 1
                nodes.append([0, np.inf, lower, lower, 0.0])
                nodes.append([0, np.inf, upper, upper, 0.0])
                nodes[v][:4] = [j, edges[j][b], lower, upper]
                mine = where == v
                where[mine] = np.where(binned[mine, j] > b, upper, lower)
                following += [lower, upper]
            live = following
            if not live:
                break
        values = np.array([v[4] for v in nodes])
        score += values[where]
    t = np.array(nodes, dtype=np.float64)
    return Forest(t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4], np.array(roots), p.depth, start)


def _with_statistics(docs: DataFrame) -> DataFrame:
    def maker():
        def compute(column: pa.Array) -> list[pa.Array]:
            x = statistics(column)
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))]

        return compute

    return append_columns(docs, [T.StructField("stats", T.ArrayType(T.FloatType()))], maker, drop=("text",))


def _sampled(labels: DataFrame, p: Quality) -> DataFrame:
    """(doc_id, y) of the labelled rows to learn from."""
    known = settle(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("y")).where(~held_out()))
    total = known.count()
    if total > p.sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < int((1 << 20) * p.sample_rows / total))
    return known


def fit(stats: DataFrame, known: DataFrame, p: Quality) -> Forest:
    """The forest for the statistics of the sampled rows known."""
    rows = stats.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("stats").alias("stats")).orderBy("doc_id").select("y", "stats").toPandas()
    y = rows["y"].to_numpy(dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 1.0, 1e-6), 1 - 1e-6)
        one = np.zeros(1, dtype=np.int64)
        return Forest(one, np.full(1, np.inf), one, one, np.zeros(1), one, 1, float(np.log(share / (1 - share))))
    return grow(np.vstack(rows["stats"].to_list()).astype(np.float64), y, p)


def score(docs: DataFrame, labels: DataFrame, p: Quality = Quality(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stats = settle(_with_statistics(rows))
    shipped = docs.sparkSession.sparkContext.broadcast(fit(stats, _sampled(labels.select("doc_id", "quality"), p), p))

    @F.pandas_udf(T.DoubleType())
    def forest(values):
        x = np.vstack(values.to_list()).astype(np.float64) if len(values) else np.zeros((0, len(NAMES)))
        import pandas as pd

        return pd.Series(shipped.value.score(x))

    return stats.select("doc_id", held_out().alias("held_out"), forest("stats").alias("score")).withColumn("predicted", (F.col("score") >= p.cut).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, p: Quality = Quality()) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    small_batches(docs.sparkSession)
    known = _sampled(labels.select("doc_id", "quality"), p)
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left_semi")
    model = fit(settle(_with_statistics(found)), known, p)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = statistics(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(shipped.value.score(x.astype(np.float64)) >= p.cut))

    return docs.mapInArrow(thrifty(run), docs.schema)
