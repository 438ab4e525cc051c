import re
import zlib
from collections import Counter

from compare import SF
from fixtures import ROWS, documents

from linkweave.llm import quality_rules, sharding
from linkweave.llm.support import settle, table


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


MORE = [(200, "a b c d e f a b c d e x a b c d e"), (201, "x " * 40), (202, "## one|two <b> &&\n" * 5), (203, "p q r s t p q r s t p q r s t")]


def test_statistics(spark):
    rows = ROWS + MORE
    got = quality_rules.judge(documents(spark, rows)).collect()
    assert sorted(((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)) == sorted((str(i), *brute(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def em(patterns, rounds=25, p=quality_rules.Rules()):
    """The label model in plain Python."""
    import math

    total = sum(patterns.values())

    def rates(weight, good):
        mean, prior = (p.alarm, p.strength * total) if good else (p.detect, p.strength / 10 * total)
        out = []
        for j in range(len(quality_rules.RULES)):
            bad = sum(n * weight[v] for v, n in patterns.items() if v[j] == -1)
            votes = sum(n * weight[v] for v, n in patterns.items() if v[j])
            out.append((bad + mean * prior) / (votes + prior))
        return out

    post = {v: (0.95, 0.3)[v.count(-1)] if v.count(-1) < 2 else 0.05 for v in patterns}
    for _ in range(rounds + 1):
        n = sum(patterns.values())
        pi = min(0.98, max(0.02, sum(patterns[v] * post[v] for v in patterns) / n))
        a, b = rates(post, True), rates({v: 1 - post[v] for v in post}, False)
        for v in patterns:
            x = math.log(pi / (1 - pi))
            for j, vote in enumerate(v):
                x += math.log(a[j] / b[j]) if vote == -1 else math.log((1 - a[j]) / (1 - b[j])) if vote == 1 else 0
            post[v] = 1 / (1 + math.exp(-x))
    return post


def test_label_model_equals_plain_python(spark):
    rows = quality_rules.statistics(table(spark, SF, "documents")).withColumn("votes", quality_rules.votes())
    patterns = rows.groupBy("votes").count().withColumnRenamed("count", "n")
    plain = em({tuple(r.votes): r.n for r in patterns.collect()})
    got = {tuple(r.votes): r.posterior for r in quality_rules.posteriors(patterns, quality_rules.Rules()).collect()}
    assert got.keys() == plain.keys() and all(abs(got[v] - plain[v]) < 1e-6 for v in got)


def test_rates_are_learned_and_not_given(spark):
    """Without labels, the shares of bad votes come near those of labelled texts."""
    sf = SF.replace("0.001", "0.01")
    rows = quality_rules.statistics(table(spark, sf, "documents")).withColumn("votes", quality_rules.votes()).cache()
    found = {r.rule: (r.in_good, r.in_bad) for r in quality_rules.learned(rows.groupBy("votes").count().withColumnRenamed("count", "n")).collect()}
    known = rows.join(table(spark, sf, "labels"), "doc_id").collect()
    for j, (name, _, _) in enumerate(quality_rules.RULES):
        for label, rate in zip((1, 0), found[name], strict=True):
            cast = [r.votes[j] == -1 for r in known if r.quality == label and r.votes[j]]
            assert abs(sum(cast) / len(cast) - rate) < (0.02 if label else 0.2), (name, label)
    assert found["function words"][1] > 0.4 > found["length"][1] and len({round(b, 2) for _, b in found.values()}) > 5


def test_rules_on_empty_table_and_no_python(spark):
    assert quality_rules.judge(documents(spark, [])).count() == 0
    plan = quality_rules.statistics(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_separate_labelled_junk(spark):
    sf = SF.replace("0.001", "0.01")
    rows = quality_rules.judge(table(spark, sf, "documents")).where("NOT base_failed").join(table(spark, sf, "labels"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)] and n[(0, False)] > 2 * n.get((0, True), 0)


def check_shards(rows, got, shards=40):
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    places = Counter()
    for r in got:
        assert 0 <= r["shard"] < shards and r.law == "bytes" and r.grown_shard is None
        places[r["shard"]] += 1
    for s, n in places.items():
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(n))


def test_shards_of_awkward_rows(spark):
    check_shards(ROWS, sharding.shard(documents(spark)).collect())
    assert sharding.shard(documents(spark, [])).count() == 0


def test_shards_balance_and_keep_groups(spark):
    got = sharding.shard(table(spark, SF.replace("0.001", "0.01"), "documents")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() < 1.02 * sizes.min()
    groups = got.groupby(["text_crc32", "size"]).agg(n=("doc_id", "size"), b=("size", "sum"), s=("shard", "nunique"))
    assert (groups.s[(groups.b * 2 * 40 <= got["size"].sum()) & (groups.n * 2 * 40 <= len(got))] == 1).all()


def test_a_hot_group_is_split(spark):
    rows = [(i, "same text " * 20) for i in range(300)] + [(1000 + i, f"other {i} " * 20) for i in range(600)]
    got = sharding.shard(documents(spark, rows)).collect()
    check_shards(rows, got)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= 1.2 * min(sizes.values())


def test_rebalance_moves_little_and_keeps_balance(spark):
    rows = [(i, f"text {i} " * 10) for i in range(2000)]
    first = sharding.deal(sharding.slot_totals(sharding.assign_slots(sharding.records(documents(spark, rows))))).cache()
    assert first.count() == sharding.Sharding().slots
    grown, less = sharding.rebalance(first, 41).collect(), sharding.rebalance(first, 39).collect()
    old = {r.v: r["shard"] for r in first.collect()}
    moved = [r for r in grown if r["shard"] != old[r.v]]
    assert len(grown) == len(less) == len(old) and {r.version for r in grown} == {2}
    assert len(moved) < 0.08 * len(old) and {r["shard"] for r in less} == set(range(39))
    load = Counter()
    for r in grown:
        load[r["shard"]] += r["bytes"]
    assert len(load) == 41 and max(load.values()) < 1.1 * min(load.values())


def loads(got):
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    return sizes


def test_an_older_map_places_all_later_rows(spark, tmp_path):
    first = [(i, f"text {i} " * 10) for i in range(500)]
    later = [(1000 + i, f"later {i} " * 10) for i in range(500)] + [(None, None), (1000, "later 0 " * 10)]
    p = sharding.Sharding(shards=8)
    _, slot_map = sharding.fitted(settle(sharding.records(documents(spark, first))), p)
    sharding.write_map(slot_map, f"{tmp_path}/map")
    sharding.write_map(sharding.rebalance(slot_map, 9, p), f"{tmp_path}/map")
    assert {r.version for r in sharding.read_map(spark, f"{tmp_path}/map", 1).collect()} == {1}
    new = sharding.read_map(spark, f"{tmp_path}/map")
    assert {r.version for r in new.collect()} == {2} and new.count() == p.slots
    rows = settle(sharding.assign_slots(settle(sharding.records(documents(spark, later))), p))
    got = sharding.placed(rows, new).collect()
    assert len(got) == len(later)
    places = {s: sorted(r.slot for r in got if r["shard"] == s) for s in {r["shard"] for r in got}}
    assert set(places) <= set(range(9)) and all(v == list(range(len(v))) for v in places.values())


def test_repeated_rows_and_missing_ids_balance(spark):
    for same in (7, None):
        rows = [(same, "same text " * 20)] * 5000 + [(1000 + i, f"other {i} " * 20) for i in range(5000)]
        got = sharding.shard(documents(spark, rows)).collect()
        check_shards(rows, got)
        sizes = loads(got)
        assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 0.05 * sum(sizes.values()) / 40


def test_groups_just_under_half_a_shard_balance(spark):
    rows = [(k * 1000 + i, f"group {k} " * 20) for k in range(81) for i in range(60)] + [(10**6 + i, f"x{i}") for i in range(50)]
    sizes = loads(sharding.shard(documents(spark, rows)).collect())
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 0.1 * sum(sizes.values()) / 40
