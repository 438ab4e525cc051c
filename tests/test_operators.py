import pytest
from pyspark.sql import functions as F

from linkweave.functions import phonetic, text
from linkweave.operators import blocking, cascade, features, metrics, sampling, validate

RECORD = "entity_id string, business_name string, business_address string, country string"


def prepared(spark, *rows):
    return text.prepared(spark.createDataFrame(list(rows), RECORD), native_only=False)


def test_candidate_identity(spark):
    targets = prepared(spark, ("S2-a", "École Alpha SARL", "123 Rue Victor", "France"), ("S2-b", "Ecole Alpha", "123 Rue Victor", "France"), ("S3-c", "Ecole Alpha", "123 Rue Victor", "France"), ("S3-d", "Unrelated", "999 Elsewhere", "Other"))
    query = prepared(spark, ("S1-q", "Ecole Alpha", "123 Rue Victor", "France"))
    keys = F.concat(blocking.base_keys(), blocking.extra_keys())
    got = blocking.candidates(query, targets, keys).collect()
    assert {r.t for r in got} == {"S2-a", "S2-b", "S3-c"}
    assert {r.t for r in blocking.candidates(query, targets, keys, cap=2).collect()} <= {"S2-a", "S2-b", "S3-c"}
    assert len(blocking.candidates(query, targets, keys, most=1).collect()) == 1


def test_phonetic_keys_cross_scripts_but_not_countries(spark):
    native = "यूनाइटेड कंसल्टेंट्स"
    rows = [("S2-n", native, "", "Novel"), ("S3-n", native, "", "Different"), ("S1-a", "United Consultants", "", "Novel")]
    df = text.prepared(phonetic.forms(spark.createDataFrame(rows, RECORD)), native_only=False)
    left, right = df.where("entity_id = 'S1-a'"), df.where("entity_id <> 'S1-a'")
    assert [r.t for r in blocking.candidates(left, right, blocking.phonetic_keys(), 500, 200).collect()] == ["S2-n"]


def test_cap_is_below_the_join(spark):
    df = prepared(spark, ("S1-a", "A B", "", "X"))
    plan = blocking.candidates(df, df, blocking.base_keys())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("block")


def test_cheap_filter(spark):
    left = text.prepared(spark.createDataFrame([("S1-l", "Acme Corporation", "123 Main Street", "N")], RECORD))
    rights = [("S2-1", "Entirely different name", "123 Main St", "N"), ("S2-2", "Acme Corp", "", "N"), ("S2-3", "Unrelated", "987 Foreign Road", "N")]
    right = text.prepared(spark.createDataFrame(rights, RECORD))
    pairs = spark.createDataFrame([("S1-l", r[0]) for r in rights], "q string, t string")
    kept = {r.t: r.kept for r in features.cheap_scores(features.pair_records(pairs, left, right)).collect()}
    assert kept == {"S2-1": True, "S2-2": True, "S2-3": False}


def test_empty_pair_has_finite_features(spark):
    a, b = prepared(spark, ("S1-x", "", "", "U")), prepared(spark, ("S2-x", "", "", "U"))
    pairs = spark.createDataFrame([("S1-x", "S2-x")], "q string, t string")
    df, names = features.base_features(features.pair_records(pairs, a, b))
    row = df.select(*names).first()
    assert len(names) == 50 and all(v is not None and v == v for v in row)


def test_number_order_features(spark):
    rows = [("S1-x", "Royal Energy", "1040 Grove Court Unit 104", "U"), ("S2-x", "Royal Energy", "1042 Grove Court Unit 104", "U")]
    df = text.prepared(phonetic.forms(spark.createDataFrame(rows, RECORD)))
    pairs = spark.createDataFrame([("S1-x", "S2-x")], "q string, t string")
    got, names = features.phonetic_features(features.pair_records(pairs, df.where("entity_id = 'S1-x'"), df.where("entity_id = 'S2-x'")), [])
    row = got.select(*names).first()
    assert len(names) == 34 and row[20] == 0 and row[21] == 1


def test_rival_raises_its_feature_and_lowers_the_lead(spark):
    refs = text.extended(prepared(spark, ("S1-q", "Acme Plumbing", "1 Road", "U"), ("S1-o", "Other Plumbing", "1 Road", "U")))
    target = text.extended(prepared(spark, ("S2-t", "Other Plumbing", "1 Road", "U")))
    pairs = spark.createDataFrame([("S1-q", "S2-t")], "q string, t string")
    near = spark.createDataFrame([("S1-q", "S1-o")], "q string, t string")
    r = features.rivals(pairs, near, refs, target).first()
    own = features.similarity(features.pair_records(pairs, refs, target)).first()
    assert r.best_combined > own.combined and r.n_neighbours == 1


def test_metric_with_singletons(spark):
    entities = spark.createDataFrame([(q,) for q in "0123"], "q string")
    truth = spark.createDataFrame([("0", "a"), ("0", "b"), ("2", "c")], "q string, t string")
    predicted = spark.createDataFrame([("0", "a"), ("0", "b"), ("0", "x"), ("3", "z")], "q string, t string")
    scored = metrics.per_entity(entities, truth, predicted)
    s = metrics.summary(scored).first()
    assert s.macro_f05 == pytest.approx((5 / 7 + 1 + 0 + 0) / 4) and s.correct_singletons == 1 and s.fp == 2 and s.fn == 1
    p = metrics.paired(scored, scored).first()
    assert p["mean"] == 0 and p.entities == 4


def test_sweep_ties_take_the_higher_threshold(spark):
    entities = spark.createDataFrame([("0",)], "q string")
    pair = spark.createDataFrame([("0", "a")], "q string, t string")
    sweep = metrics.threshold_sweep(entities, pair, pair.withColumn("p", F.lit(0.9)), [0.2, 0.5, 0.95])
    assert metrics.best_threshold(sweep).first().tau == 0.5
    policy = metrics.policy_sweep(entities, pair, pair.withColumn("p", F.lit(0.9)), (0.0, 0.5))
    assert tuple(metrics.best_policy(policy).first())[:2] == (0.0, 0.0)


def test_override_merge(spark):
    e = spark.createDataFrame([("S1-a",), ("S1-b",), ("S1-c",)], "q string")
    old = spark.createDataFrame([("S1-a", "S2-a")], "q string, t string")
    new = spark.createDataFrame([("S1-b", "S3-b")], "q string, t string")
    gated = spark.createDataFrame([("S1-b",)], "q string")
    merged = cascade.override(e, old, new, gated)
    lists = {r.q: r.matches for r in cascade.result_lists(e, merged, merged).collect()}
    assert lists == {"S1-a": "S2-a", "S1-b": "S3-b", "S1-c": ""}


def test_gate_uses_predictions(spark):
    e = spark.createDataFrame([("S1-t",)], "q string")
    native = spark.createDataFrame([("S2-n",)], "entity_id string")
    some = spark.createDataFrame([("S1-t", "S2-n", 0.9)], "q string, t string, score double")
    assert cascade.gate(e, some.limit(0), some, native).first().gated
    assert not cascade.gate(e, some, some, native).first().gated
    with pytest.raises(ValueError):
        cascade.require_gain(spark.createDataFrame([(0.1, -0.1)], "mean double, low double"))


def test_validation_counts_each_rule(spark):
    refs = spark.createDataFrame([("S1-a",), ("S1-b",)], "entity_id string")
    targets = spark.createDataFrame([("S2-a",), ("S3-b",)], "entity_id string")
    good = spark.createDataFrame([("S1-a", "S2-a,S3-b", "S2-a"), ("S1-b", "", "")], "q string, candidates string, matches string")
    assert validate.report(validate.violations(good, refs, targets)).first().verdict == "PASS"
    bad = spark.createDataFrame([("S1-a", "S2-a,S2-a", "S9-z"), ("S1-a", "S1-a", ""), ("S1-x", " S2-a", "")], "q string, candidates string, matches string")
    n = {r.rule: r.n for r in validate.violations(bad, refs, targets).collect()}
    assert n["reference_repeated"] == 1 and n["reference_missing"] == 1 and n["reference_unknown"] == 1
    assert n["list_repeats"] == 1 and n["match_no_candidate"] == 1 and n["self_match"] == 1 and n["target_unknown"] == 3
    assert validate.report(validate.violations(bad, refs, targets)).first().verdict == "FAIL"
    at = spark.createDataFrame([(0, "S1-a"), (1, "S1-x")], "ord int, q string")
    own = spark.createDataFrame([(0, "S1-a"), (1, "S1-b")], "ord int, entity_id string")
    assert validate.same_order(at, own).count() == 1


def test_samples_are_repeatable_and_disjoint(spark):
    rows = spark.createDataFrame([(f"i{i}", "x" if i % 3 else "y") for i in range(60)], "id string, c string")
    one = sampling.bottom_k(rows, "id", 10, 1)
    two = sampling.bottom_k(rows, "id", 10, 1, exclude=one)
    a, b = {r.id for r in one.collect()}, {r.id for r in two.collect()}
    assert len(a) == len(b) == 10 and not a & b
    split = {(r.c, r.split): r["count"] for r in sampling.stratified(rows, "id", ["c"], {"train": 3, "hold": 1}, 5).groupBy("c", "split").count().collect()}
    assert split == {("x", "train"): 30, ("x", "hold"): 10, ("y", "train"): 15, ("y", "hold"): 5}
