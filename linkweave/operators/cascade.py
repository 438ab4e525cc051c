"""Acceptance, correction gates, override merges and result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the Indic scripts and Sinhala.
NATIVE = r"[\x{0900}-\x{0DFF}]"


def accept(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("p") >= threshold)


def accept_by_source(scored: DataFrame, second: float = 0.65, third: float = 0.75) -> DataFrame:
    """Pairs over the threshold of their target's source; what is not of the second is of the third."""
    return scored.where(F.col("p") >= F.when(F.col("t").startswith("S2-"), second).otherwise(third))


def native_script(records: DataFrame) -> DataFrame:
    return records.where(F.col("business_name").rlike(NATIVE))


def gate(entities: DataFrame, matches: DataFrame, supplement: DataFrame, native: DataFrame, score: str = "score", low: float = 0.5, high: float = 0.8) -> DataFrame:
    """(q, suspicious, recoverable, gated) of each entity.

    matches and supplement are (q, t, score) tables of phonetic scores; only native targets count. An
    entity is suspicious if a match scores under low, and recoverable if a candidate that isn't matched
    scores high.
    """
    ids = native.select(F.col("entity_id").alias("t"))
    bad = matches.join(ids, "t", "left_semi").where(F.col(score) < low).select("q").distinct().withColumn("suspicious", F.lit(True))
    good = supplement.join(ids, "t", "left_semi").join(matches.select("q", "t"), ["q", "t"], "left_anti").where(F.col(score) >= high).select("q").distinct().withColumn("recoverable", F.lit(True))
    no = F.lit(False)
    rows = entities.join(bad, "q", "left").join(good, "q", "left").select("q", F.coalesce("suspicious", no).alias("suspicious"), F.coalesce("recoverable", no).alias("recoverable"))
    return rows.withColumn("gated", F.col("suspicious") | F.col("recoverable"))


def empty_gate(entities: DataFrame, matches: DataFrame, gated: DataFrame) -> DataFrame:
    """Entities without a match that are not gated already."""
    return entities.select("q").join(matches.select("q"), "q", "left_anti").join(gated.select("q"), "q", "left_anti")


def override(entities: DataFrame, old: DataFrame, new: DataFrame, gated: DataFrame) -> DataFrame:
    """(q, t): the new pairs of gated entities and the old pairs of the others."""
    chosen = gated.select("q").distinct()
    return old.join(chosen, "q", "left_anti").select("q", "t").union(new.join(chosen, "q", "left_semi").select("q", "t")).join(entities.select("q"), "q", "left_semi")


def result_lists(entities: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """q, candidates and matches of every entity: distinct target ids, sorted and joined by commas."""
    lists = lambda df, name: df.groupBy("q").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias(name))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return entities.select("q").join(lists(candidates, "candidates"), "q", "left").join(lists(matches, "matches"), "q", "left").select("q", text("candidates"), text("matches"))


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label: whether truth has them."""
    return pairs.join(truth.select("q", "t").distinct().withColumn("__y", F.lit(True)), ["q", "t"], "left").withColumn("label", F.coalesce("__y", F.lit(False))).drop("__y")


def output_stats(lists: DataFrame) -> DataFrame:
    """Entities, candidates, matches and entities without a match of a result table."""
    n = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, ",")))
    return lists.agg(F.count("*").alias("entities"), F.sum(n("candidates")).alias("candidates"), F.sum(n("matches")).alias("matches"), F.count_if(F.col("matches") == "").alias("singletons"))


def correction_stats(entities: DataFrame, old: DataFrame, new: DataFrame, gated: DataFrame) -> DataFrame:
    """What a correction of the gated entities changes: reprocessed entities, matches removed and added, entities
    that lose or get their first match, and the matches that result."""
    merged = override(entities, old, new, gated)
    chosen = entities.select("q").join(gated.select("q").distinct(), "q", "left_semi")
    count = lambda pairs, name: pairs.select("q", "t").distinct().groupBy("q").agg(F.collect_set("t").alias(name))
    rows = entities.select("q").join(count(old, "o"), "q", "left").join(count(merged, "m"), "q", "left").join(chosen.withColumn("g", F.lit(True)), "q", "left")
    none = F.array().cast("array<string>")
    rows = rows.select("g", F.coalesce("o", none).alias("o"), F.coalesce("m", none).alias("m"))
    return rows.agg(
        F.count("*").alias("entities"), F.count_if("g").alias("reprocessed"),
        F.count_if((F.size(F.array_except("o", "m")) > 0) | (F.size(F.array_except("m", "o")) > 0)).alias("corrected"),
        F.sum(F.size(F.array_except("o", "m"))).alias("removed"), F.sum(F.size(F.array_except("m", "o"))).alias("added"),
        F.count_if((F.size("o") == 0) & (F.size("m") > 0)).alias("new_nonempty"), F.count_if((F.size("o") > 0) & (F.size("m") == 0)).alias("new_empty"),
        F.sum(F.size("m")).alias("matches"),
    )


def require_gain(report: DataFrame) -> None:
    """Stops unless a paired improvement is positive with its whole interval."""
    row = report.first()
    if row is None or not (row["mean"] > 0 and row["low"] > 0):
        raise ValueError(f"no significant gain: {row}")


def policy_column(second: float, third: float) -> Column:
    return F.when(F.col("t").startswith("S2-"), second).otherwise(third)
