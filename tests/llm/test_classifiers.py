import numpy as np
import pyarrow as pa
from compare import SF
from fixtures import ROWS, documents

from linkweave.llm import quality, toxicity
from linkweave.llm.support import table

LABELS = "doc_id long, quality int, toxic int, text string, score double"


def labels(spark, rows):
    return spark.createDataFrame([(i, q, t, "own", 0.1) for i, q, t in rows], LABELS)


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held(spark, module, name, sf):
    rows = module.score(table(spark, sf, "documents"), table(spark, sf, "labels")).toPandas().merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    return rows[rows.held_out], rows


def test_quality_on_held_out_rows(spark):
    some, every = held(spark, quality, "quality", SF.replace("0.001", "0.1"))
    assert auc(some.quality.to_numpy(), some.score.to_numpy()) > 0.99
    assert (some.predicted == (some.score >= 0.3)).all() and (some.predicted == some.quality).mean() > 0.98


def test_toxicity_on_held_out_rows(spark):
    some, every = held(spark, toxicity, "toxic", SF.replace("0.001", "0.1"))
    assert auc(some.toxic.to_numpy(), some.score.to_numpy()) > 0.95
    assert some.predicted[some.toxic == 1].mean() > 0.8 and some.predicted[some.toxic == 0].mean() < 0.01


def test_held_out_is_the_crc_of_the_decimal_id(spark):
    import zlib

    rows = quality.score(documents(spark), labels(spark, [(1, 1, 0), (3, 0, 1)])).collect()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_awkward_rows_and_labels(spark):
    for module in (quality, toxicity):
        for known in ([], [(1, 1, 1)], [(1, 1, 0), (1, 0, 1), (None, 1, 1), (5, None, None), (3, 0, 1), (8, 1, 0), (9, 1, 0)]):
            rows = module.score(documents(spark), labels(spark, known)).collect()
            assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert module.score(documents(spark, []), labels(spark, [])).count() == 0


def test_trees_equal_a_walk_by_hand():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    p = quality.Quality(trees=30, depth=3)
    forest = quality.grow(x, y, p)

    def walk(row):
        total = forest.start
        for node in forest.roots:
            for _ in range(forest.depth):
                node = forest.right[node] if row[forest.feature[node]] > forest.cut[node] else forest.left[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    s = forest.score(x)
    assert np.allclose(s, [walk(r) for r in x]) and ((s > 0.5) == y).mean() > 0.97


def test_statistics_by_hand():
    x = dict(zip(quality.NAMES, quality.statistics(pa.array(["Ab cd cd!\nx\nx", None]))[0], strict=True))
    assert np.isclose(x["log_words"], np.log1p(5)) and np.isclose(x["upper"], 1 / 13) and np.isclose(x["again"], 2 / 5 - 1 / 5)
    assert np.isclose(x["distinct"], 4 / 5) and np.isclose(x["repeated_lines"], 1 / 3) and np.isclose(x["shout"], 1 / 13)


def test_label_model_follows_labels_and_discounts_twins():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.2
    fires = np.column_stack([rng.random(4000) < np.where(truth, a, b) for a, b in ((0.8, 0.02), (0.6, 0.05), (0.7, 0.01))])
    post, share = toxicity.label_model(fires, truth.astype(float), 50)
    assert ((post > 0.5) == truth).mean() > 0.99
    twins = np.column_stack([fires, fires[:, :1]])
    assert toxicity.label_model(twins, truth.astype(float), 5)[1][0] < share[0]


def slow_trees(x, y, p):
    """Boosting by trying every cut of every feature at every node; the score of each row."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(m)]
    share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    score = np.full(n, np.log(share / (1 - share)))

    def split(rows, level, g, h):
        sg, sh = g[rows].sum(), h[rows].sum()
        leaf = -p.rate * sg / (sh + p.ridge)
        best = None
        for j in range(m) if level < p.depth else ():
            for cut in edges[j]:
                left = rows[x[rows, j] <= cut]
                lg, lh = g[left].sum(), h[left].sum()
                if lh < p.least / 4 or sh - lh < p.least / 4:
                    continue
                gain = lg**2 / (lh + p.ridge) + (sg - lg) ** 2 / (sh - lh + p.ridge) - sg**2 / (sh + p.ridge)
                if gain > (best[0] + 1e-12 if best else 1e-3):
                    best = (gain, j, cut)
        if best is None:
            return [(rows, leaf)]
        right = x[rows, best[1]] > best[2]
        return split(rows[~right], level + 1, g, h) + split(rows[right], level + 1, g, h)

    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-score))
        for rows, leaf in split(np.arange(n), 0, q - y, np.maximum(q * (1 - q), 1e-6)):
            score[rows] += leaf
    return 1 / (1 + np.exp(-score))


def test_growing_equals_trying_every_cut():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 4, 400), rng.random(400), np.ones(400)])
    y = ((x[:, 0] > 0.3) | (x[:, 1] == 2) | (rng.random(400) < 0.05)).astype(float)
    p = quality.Quality(trees=8, depth=3, bins=16)
    assert np.allclose(quality.grow(x, y, p).score(x), slow_trees(x, y, p), atol=1e-9)


def test_repeated_labelled_ids_learn_from_one_row(spark):
    rows = [(1, t) for t in ("b text", "a text", "c " * 50)] + [(i, f"word{i} " * i) for i in range(2, 40)]
    known = labels(spark, [(i, i % 2, i % 2) for i in range(1, 40)])
    for module in (quality, toxicity):
        one = {(r.doc_id, r.score) for r in module.score(documents(spark, rows), known).collect()}
        assert one == {(r.doc_id, r.score) for r in module.score(documents(spark, rows[::-1]).repartition(3), known).collect()}


def slow_labels(fires, known, rounds, again):
    """The label model with sums by hand."""
    n, m = len(fires), len(fires[0])
    post = [0.975 if k else 0.025 for k in known]
    log, share = np.log, [1.0] * m
    for turn in range(rounds):
        if turn % again == 0:
            pooled = [[0.0] * m for _ in range(m)]
            for w in (post, [1 - q for q in post]):
                mean = [sum(w[i] * fires[i][j] for i in range(n)) / sum(w) for j in range(m)]
                for j in range(m):
                    for k in range(m):
                        pooled[j][k] += sum(w[i] * (fires[i][j] - mean[j]) * (fires[i][k] - mean[k]) for i in range(n))
            share = [1 / sum(1.0 if j == k else max(0.0, pooled[j][k] / (pooled[j][j] * pooled[k][k]) ** 0.5) for k in range(m)) for j in range(m)]
        n1 = sum(post)
        r1 = [(sum(post[i] * fires[i][j] for i in range(n)) + 0.5) / (n1 + 1) for j in range(m)]
        r0 = [(sum((1 - post[i]) * fires[i][j] for i in range(n)) + 0.5) / (n - n1 + 1) for j in range(m)]
        a1 = min(max((sum(post[i] * known[i] for i in range(n)) + 1) / (n1 + 2), 0.6), 0.999)
        a0 = min(max((sum((1 - post[i]) * (1 - known[i]) for i in range(n)) + 1) / (n - n1 + 2), 0.6), 0.999)
        new = []
        for i in range(n):
            odds = log(n1 / (n - n1)) + (log(a1 / (1 - a0)) if known[i] else log((1 - a1) / a0))
            odds += sum(share[j] * (log(r1[j] / r0[j]) if fires[i][j] else log((1 - r1[j]) / (1 - r0[j]))) for j in range(m))
            new.append(1 / (1 + np.exp(-odds)))
        post = new
    return post, share


def test_label_model_equals_sums_by_hand():
    rng = np.random.default_rng(6)
    truth = rng.random(120) < 0.3
    fires = np.column_stack([rng.random(120) < np.where(truth, a, b) for a, b in ((0.8, 0.1), (0.5, 0.05), (0.6, 0.2))])
    fires = np.column_stack([fires, fires[:, 0] ^ (rng.random(120) < 0.1)])
    known = (truth ^ (rng.random(120) < 0.1)).astype(float)
    post, share = toxicity.label_model(fires, known, 4, 2)
    slow, slow_share = slow_labels(fires.astype(float).tolist(), known.tolist(), 4, 2)
    assert np.allclose(post, slow, atol=1e-8) and np.allclose(share, slow_share) and share[0] < share[1]


def test_scores_equal_counting_words_and_beginnings_by_hand(spark):
    import re

    rows = [(i, t) for i, t in ROWS if t is None or len(t) < 5000] + [(300 + i, ("Idiot moronic stupids " if i % 3 == 0 else "kind words ") * (1 + i % 5) + f"text{i}") for i in range(60)]
    known = toxicity.fit(documents(spark, rows).select("doc_id", "text"), labels(spark, [(300 + i, 1, int(i % 3 == 0)) for i in range(60)]).select("doc_id", "toxic"), toxicity.Toxicity())
    assert len(known.weight) > 3

    def names(word):
        raw = np.frombuffer(word, np.uint8)
        return [int(h[0]) for d, h in toxicity._patterns(raw, np.array([0, len(raw)]), toxicity.Toxicity()) if len(h)]

    where = {int(h): i for i, h in enumerate(known.patterns)}
    want = []
    for _, text in rows:
        seen = [0] * len(known.patterns)
        for word in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
            for h in names(word):
                if h in where:
                    seen[where[h]] += 1
        odds = known.intercept + sum(w for o, k, w in zip(known.owner, known.level, known.weight, strict=True) if seen[o] >= k)
        want.append(1 / (1 + np.exp(-odds)))
    assert np.allclose(known.score(pa.array([t for _, t in rows], pa.string()), toxicity.Toxicity()), want)
