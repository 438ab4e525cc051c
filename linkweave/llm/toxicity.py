"""Toxicity by weak supervision.

Voters are patterns of words: a whole word, or the first bytes of words, that a text has at least k
times. They come from a public lexicon of insults and from patterns mined in the training rows: those whose
rates in toxic and clean rows are furthest apart in standard errors. A generative label model takes each
voter to fire with one rate in toxic and another in clean texts, and finds the rates, the voters' correlations
inside both classes and the posterior labels together by expectation-maximisation, anchored by the known
labels as one more, imperfect voter. A voter counts in the posterior by one over its summed correlation with
the others, so a family of prefixes counts about once. A linear classifier is then trained on the posteriors.

Only rows with known labels that are not held out are learned from, at most about ``sample_rows`` of
them, drawn by a hash of the id; ``mined`` bounds the voters. Voters are counted and ranked in Spark. Scoring is
a pass over whole texts.

Defined cases: null, empty and wordless texts fire no voter and get the intercept's score; without
both labels in the training rows every score is the share of toxic ones (0 without any); repeated
document rows are each scored; of labels that repeat an id, the rounded mean counts; of rows that repeat a
labelled id, the one of the smallest text is learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm import hashing
from linkweave.llm.support import append_columns, held_out, settle, small_batches, text_slices

#: Common insults of four languages, lower case.
LEXICON = (
    "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown fool jerk creep "
    "garbage filthy vermin degenerate imbecile coward "
    "dumm blöd trottel depp abschaum widerlich arschloch versager dreck "
    "imbécile crétin débile connard abruti ordure minable dégoûtant "
    "imbécil estúpido tonto basura escoria asqueroso cabrón inútil"
).split()

#: Bytes that letters don't have end words.
_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Toxicity:
    """sample_rows: labelled rows to learn from; mined: most voters; prefixes: bytes of word beginnings;
    counts: thresholds of voters; support: toxic rows that a voter fires in; again: rounds of the label
    model between estimates of correlations."""

    sample_rows: int = 10_000
    mined: int = 384
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8, 9, 10)
    counts: tuple[int, ...] = (1, 2, 3, 5)
    support: int = 8
    rounds: int = 30
    again: int = 5
    strength: float = 0.02


def _patterns(buffer: np.ndarray, offsets: np.ndarray, p: Toxicity):
    """(document, pattern hash) of the words and of their beginnings, in pieces by kind."""
    h, start, end = hashing.words(buffer, offsets, white=_BREAK)
    doc = np.searchsorted(offsets, start, side="right") - 1
    yield doc, h
    if not len(h):
        return
    length = end - start
    with np.errstate(over="ignore"):
        value = np.zeros(len(h), dtype=np.uint64)
        for i in range(max(p.prefixes)):
            long = length > i
            byte = hashing.FOLD[buffer[np.minimum(start + i, len(buffer) - 1)]].astype(np.uint64)
            value = value * np.uint64(0x100000001B3) + byte + np.uint64(1)
            if i + 1 in p.prefixes:
                yield doc[long], hashing.mix(value[long] + np.uint64((i + 1) << 56))


def _lexicon_hashes() -> np.ndarray:
    raw = [w.encode("utf-8") for w in LEXICON]
    buffer = np.frombuffer(b" ".join(raw), dtype=np.uint8)
    return hashing.words(buffer, np.array([0, len(buffer)]), white=_BREAK)[0]


def _codes(patterns: np.ndarray, counts: np.ndarray, levels: tuple[int, ...]) -> np.ndarray:
    """One code for each pattern and threshold that its count reaches."""
    out = [hashing.mix(patterns[counts >= k] + np.uint64(k)) for k in levels]
    return np.concatenate(out)


def _voter_column(texts: pa.Array, p: Toxicity, only: np.ndarray | None) -> list[np.ndarray]:
    """Codes that fire in each text; with ``only`` (sorted), their positions in it.

    Training rows alone take this path; scoring looks patterns up without sorting.
    """
    rows: list[np.ndarray] = []
    for first, to, buffer, offsets in text_slices(texts):
        parts = list(_patterns(buffer, offsets, p))
        doc = np.concatenate([d for d, _ in parts])
        pattern = np.concatenate([x for _, x in parts])
        order = np.argsort(doc, kind="stable")
        doc, pattern = doc[order], pattern[order]
        at = np.searchsorted(doc, np.arange(to - first + 1))
        for i in range(to - first):
            found, counts = np.unique(pattern[at[i] : at[i + 1]], return_counts=True)
            codes = _codes(found, counts, p.counts)
            if only is not None:
                where = np.searchsorted(only, codes)
                where[where == len(only)] = 0
                codes = np.sort(where[only[where] == codes]) if len(only) else codes[:0].astype(np.int64)
            rows.append(codes)
    return rows


def _firing(docs: DataFrame, p: Toxicity, only: np.ndarray | None) -> DataFrame:
    def maker():
        kind = pa.int64()
        return lambda column: [pa.array([r.view(np.int64) for r in _voter_column(column, p, only)], pa.list_(kind))]

    return append_columns(docs, [T.StructField("codes", T.ArrayType(T.LongType()))], maker, drop=("text",))


@dataclass
class Model:
    """Sorted voter patterns by kind-free hash, with thresholds and weights of the linear classifier."""

    patterns: np.ndarray
    owner: np.ndarray
    level: np.ndarray
    weight: np.ndarray
    intercept: float

    def score(self, texts: pa.Array, p: Toxicity) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        if len(self.patterns):
            near = np.zeros(1 << 20, dtype=bool)
            near[(self.patterns & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            k = len(self.patterns)
            for first, to, buffer, offsets in text_slices(texts):
                seen = np.zeros(((to - first), k), dtype=np.int32)
                for doc, pattern in _patterns(buffer, offsets, p):
                    maybe = near[(pattern & np.uint64((1 << 20) - 1)).astype(np.int64)]
                    doc, pattern = doc[maybe], pattern[maybe]
                    where = np.searchsorted(self.patterns, pattern)
                    where[where == k] = 0
                    good = self.patterns[where] == pattern
                    np.add.at(seen, (doc[good], where[good]), 1)
                fires = seen[:, self.owner] >= self.level
                out[first:to] += fires @ self.weight
        return 1 / (1 + np.exp(-out))


def correlations(x: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Voters' correlations inside the classes, pooled by the posteriors; those below zero count as zero."""
    pooled = np.zeros((x.shape[1], x.shape[1]))
    for w in (post, 1 - post):
        total = w.sum()
        if total > 0:
            centred = x - (w @ x) / total
            pooled += (centred * w[:, None]).T @ centred
    spread = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    out = np.clip(pooled / spread[:, None] / spread[None, :], 0, 1)
    np.fill_diagonal(out, 1)
    return out


def label_model(fires: np.ndarray, known: np.ndarray, rounds: int, again: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of toxic, weight by correlation) from a rows x voters matrix and the known labels.

    The known label is a voter whose accuracy is estimated with the others. Rates are estimated in each round
    and correlations in every ``again``-th.
    """
    x = fires.astype(np.float64)
    post = known * 0.95 + 0.025
    share = np.ones(x.shape[1])
    for turn in range(rounds):
        if turn % again == 0:
            share = 1 / correlations(x, post).sum(1)
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        rate1 = (x.T @ post + 0.5) / (post.sum() + 1)
        rate0 = (x.T @ (1 - post) + 0.5) / ((1 - post).sum() + 1)
        right1 = np.clip((post @ known + 1) / (post.sum() + 2), 0.6, 0.999)
        right0 = np.clip(((1 - post) @ (1 - known) + 1) / ((1 - post).sum() + 2), 0.6, 0.999)
        odds = np.log(prior / (1 - prior)) + np.where(known > 0.5, np.log(right1 / (1 - right0)), np.log((1 - right1) / right0))
        on = np.log(rate1 / rate0)
        off = np.log((1 - rate1) / (1 - rate0))
        odds = odds + x @ ((on - off) * share) + (off * share).sum()
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done and turn % again == again - 1:
            break
    return post, share


def linear(x: np.ndarray, y: np.ndarray, strength: float) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels with an L2 penalty, by Newton steps."""
    n, m = x.shape
    z = np.column_stack((x, np.ones(n)))
    w = np.zeros(m + 1)
    ridge = np.full(m + 1, strength * n / 100)
    ridge[-1] = 1e-6
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (q - y) + ridge * w
        hess = (z * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _voters(train: DataFrame, n1: float, n0: float, lexicon: np.ndarray, p: Toxicity) -> np.ndarray:
    """The sorted codes of the voters: at most ``mined``, the lexicon's first, then those of most evidence.

    Evidence is how far a code's rates in toxic and clean rows are apart, in standard errors of a smoothed
    difference, and is computed for every code of toxic rows; only the chosen codes come to the driver.
    """
    codes = lambda y: _firing(train.where(f"y = {y}").select("text"), p, None).select(F.explode("codes").alias("code"))
    listed = train.sparkSession.createDataFrame([(int(c),) for c in lexicon.view(np.int64)], "code long").withColumn("listed", F.lit(True))
    support = min(p.support, max(2, int(n1) // 10))
    found = codes(1).groupBy("code").agg(F.count("*").alias("pos")).join(F.broadcast(listed), "code", "left").where((F.col("pos") >= support) | F.col("listed"))
    found = settle(found.select("code", "pos", F.coalesce("listed", F.lit(False)).alias("listed")))
    clean = codes(0).join(found.select("code"), "code", "left_semi").groupBy("code").agg(F.count("*").alias("neg"))
    counted = found.join(clean, "code", "left").withColumn("neg", F.coalesce("neg", F.lit(0)))
    r1, r0 = (F.col("pos") + 0.5) / (n1 + 1), (F.col("neg") + 0.5) / (n0 + 1)
    mean = (F.col("pos") + F.col("neg") + 1) / (n1 + n0 + 2)
    z = (r1 - r0) / F.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
    best = counted.withColumn("z", z).where((F.col("z") > 3) | F.col("listed")).orderBy(F.desc("listed"), F.desc("z"), "code").limit(p.mined).select("code").collect()
    return np.sort(np.array([r["code"] for r in best], dtype=np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, p: Toxicity) -> Model:
    spark = docs.sparkSession
    empty = np.zeros(0, dtype=np.uint64)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("toxic")).cast("int").alias("y")).where(~held_out())
    known = settle(known)
    total = known.count()
    if total > p.sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < int((1 << 20) * p.sample_rows / total))
    train = settle(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")))
    toxic, rows = (train.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first())
    if not toxic or toxic == rows:
        share = min(max(toxic / max(rows, 1), 1e-6), 1 - 1e-6)
        return Model(empty, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    lexicon = np.unique(_codes(_lexicon_hashes(), np.full(len(LEXICON), 10), p.counts))
    only = _voters(train, float(toxic), float(rows - toxic), lexicon, p)
    # Only the chosen voters' firings come to the driver, at most ``mined`` for each sampled row.
    got = _firing(train.select("doc_id", "y", "text"), p, only).orderBy("doc_id").select("y", "codes").collect()
    y = np.array([r["y"] for r in got], dtype=np.float64)
    fires = np.zeros((len(y), len(only)), dtype=bool)
    for i, r in enumerate(got):
        fires[i, r["codes"]] = True
    post, share = label_model(fires, y, p.rounds, p.again)
    weight, intercept = linear(fires.astype(np.float64), post, p.strength)
    # Codes name a pattern and a threshold; the patterns themselves come from the training rows.
    patterns = _known_patterns(train, p, only)
    names = np.sort(np.unique(np.concatenate([patterns, _lexicon_hashes()])))
    owner = np.full(len(only), -1)
    level = np.zeros(len(only), dtype=np.int64)
    for k in p.counts:
        c = hashing.mix(names + np.uint64(k))
        order = np.argsort(c)
        where = np.minimum(np.searchsorted(c[order], only), len(c) - 1)
        good = c[order][where] == only
        owner[good], level[good] = order[where[good]], k
    good = owner >= 0
    return Model(names, owner[good], level[good], weight[good], intercept)


def _known_patterns(train: DataFrame, p: Toxicity, codes: np.ndarray) -> np.ndarray:
    """The patterns behind the chosen codes, read off the toxic training rows."""
    def maker():
        def compute(column: pa.Array) -> list[pa.Array]:
            out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(column)
            for first, to, buffer, offsets in text_slices(column):
                found = np.unique(np.concatenate([x for _, x in _patterns(buffer, offsets, p)]))
                keep = np.zeros(len(found), dtype=bool)
                for k in p.counts:
                    keep |= np.isin(hashing.mix(found + np.uint64(k)), codes)
                out[first] = found[keep].view(np.int64)
            return [pa.array(out, pa.list_(pa.int64()))]

        return compute

    rows = append_columns(train.where("y = 1").select("text"), [T.StructField("p", T.ArrayType(T.LongType()))], maker, drop=("text",)).select(F.explode("p").alias("p")).distinct().collect()
    return np.array([r["p"] for r in rows], dtype=np.int64).view(np.uint64)


def score(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(rows, labels.select("doc_id", "toxic"), p)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def maker():
        return lambda column: [pa.array(shipped.value.score(column, p), pa.float64())]

    out = append_columns(rows, [T.StructField("score", T.DoubleType())], maker, drop=("text",))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
