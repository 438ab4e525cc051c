"""Entity scores, confidence intervals, sweeps and inventories.

Truth and predictions are (q, t) pair tables; entities come from a table of all ids, so those without any
pair are scored too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_entity(entities: DataFrame, truth: DataFrame, predicted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """q (and by columns), n_truth, n_pred, good, score: F0.5 of each entity; 1 if both sets are empty.

    predicted may have the by columns, which split it into several predictions; entities must have them too.
    """
    keys = ["q", *by]
    t = truth.select("q", "t").distinct()
    p = predicted.select(*keys, "t").distinct()
    n_truth = t.groupBy("q").agg(F.count("*").alias("n_truth"))
    hits = p.join(t.withColumn("hit", F.lit(1)), ["q", "t"], "left").groupBy(*keys).agg(F.count("*").alias("n_pred"), F.coalesce(F.sum("hit"), F.lit(0)).alias("good"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = entities.join(n_truth, "q", "left").join(hits, keys, "left").select(*entities.columns, zero("n_truth"), zero("n_pred"), zero("good"))
    return rows.withColumn("score", f_half(F.col("good"), F.col("n_truth"), F.col("n_pred")))


def f_half(good: Column, n_truth: Column, n_pred: Column) -> Column:
    empty = (n_truth == 0) & (n_pred == 0)
    return F.when(empty, 1.0).otherwise(1.25 * good / (0.25 * n_truth + F.when(empty, 1).otherwise(n_pred)))


def interval(score: Column, clipped: bool = True) -> dict[str, Column]:
    """mean, low and high of 1.96 standard errors; a single row has no error."""
    mean, n = F.avg(score), F.count(score)
    margin = 1.96 * F.coalesce(F.try_divide(F.stddev_samp(score), F.sqrt(n)), F.lit(0.0))
    low, high = mean - margin, mean + margin
    return {"mean": mean, "low": F.greatest(F.lit(0.0), low) if clipped else low, "high": F.least(F.lit(1.0), high) if clipped else high}


def summary(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro score with its interval, micro precision and recall, and counts, of scored entities."""
    made = interval(F.col("score"))
    tp, pred, true = F.sum("good"), F.sum("n_pred"), F.sum("n_truth")
    one = F.lit(1)
    return scored.groupBy(*by).agg(
        made["mean"].alias("macro_f05"), made["low"].alias("low"), made["high"].alias("high"),
        (tp / F.greatest(one, pred)).alias("micro_precision"), (tp / F.greatest(one, true)).alias("micro_recall"),
        tp.alias("tp"), (pred - tp).alias("fp"), (true - tp).alias("fn"), F.count("*").alias("entities"),
        F.count_if(F.col("n_truth") == 0).alias("singletons"),
        F.count_if((F.col("n_truth") == 0) & (F.col("n_pred") == 0)).alias("correct_singletons"),
    )


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mean difference of two scorings of the same entities with its unclipped interval."""
    both = old.select("q", F.col("score").alias("a")).join(new.select("q", F.col("score").alias("b")), "q")
    made = interval(F.col("b") - F.col("a"), clipped=False)
    return both.agg(made["mean"].alias("mean"), made["low"].alias("low"), made["high"].alias("high"), F.count("*").alias("entities"))


def threshold_sweep(entities: DataFrame, truth: DataFrame, scored_pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """tau and macro_f05 for each threshold; scored_pairs has q, t, p.

    One pass: an entity's counts at each of the given thresholds come from a cumulative sum over the
    thresholds that its pairs reach, instead of one evaluation a threshold.
    """
    grid = sorted(thresholds)
    rows = entities.join(truth.groupBy("q").agg(F.count_distinct("t").alias("n_truth")), "q", "left").select("q", F.coalesce("n_truth", F.lit(0)).alias("n_truth"))
    hits = scored_pairs.join(truth.select("q", "t").distinct().withColumn("hit", F.lit(1)), ["q", "t"], "left")
    counts = hits.groupBy("q").agg(
        F.array(*[F.count_if(F.col("p") >= tau) for tau in grid]).alias("n_pred"),
        F.array(*[F.count_if((F.col("p") >= tau) & F.col("hit").isNotNull()) for tau in grid]).alias("good"),
    )
    zeros = F.array_repeat(F.lit(0).cast("bigint"), len(grid))
    wide = rows.join(counts, "q", "left").select("q", "n_truth", F.coalesce("n_pred", zeros).alias("n_pred"), F.coalesce("good", zeros).alias("good"))
    each = wide.agg(F.array(*[F.avg(f_half(F.col("good")[i], F.col("n_truth"), F.col("n_pred")[i])) for i in range(len(grid))]).alias("m"))
    taus = F.array(*[F.lit(tau) for tau in grid])
    return each.select(F.explode(F.arrays_zip(taus.alias("tau"), F.col("m").alias("m"))).alias("x")).select(F.col("x.tau").alias("tau"), F.col("x.m").alias("macro_f05"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the highest score; of equal ones that of the highest threshold."""
    return sweep.orderBy(F.desc("macro_f05"), F.desc("tau")).limit(1)


def policy_sweep(entities: DataFrame, truth: DataFrame, scored_pairs: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    """s2, s3 and macro_f05 for each pair of thresholds of the two target sources.

    Counts are taken for each source and threshold once; the pairs of thresholds combine them by row.
    """
    hits = scored_pairs.join(truth.select("q", "t").distinct().withColumn("hit", F.lit(1)), ["q", "t"], "left")
    second = F.col("t").startswith("S2-")
    aggs = []
    for name, mine in (("2", second), ("3", ~second)):
        aggs.append(F.array(*[F.count_if(mine & (F.col("p") >= x)) for x in grid]).alias(f"n{name}"))
        aggs.append(F.array(*[F.count_if(mine & (F.col("p") >= x) & F.col("hit").isNotNull()) for x in grid]).alias(f"g{name}"))
    counts = hits.groupBy("q").agg(*aggs)
    n_truth = truth.groupBy("q").agg(F.count_distinct("t").alias("n_truth"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), len(grid))
    rows = entities.select("q").join(n_truth, "q", "left").join(counts, "q", "left").select(F.coalesce("n_truth", F.lit(0)).alias("n_truth"), *[F.coalesce(c, zeros).alias(c) for c in ("n2", "g2", "n3", "g3")])
    k = len(grid)
    cells = [(i, j) for i in range(k) for j in range(k)]
    means = [F.avg(f_half(F.col("g2")[i] + F.col("g3")[j], F.col("n_truth"), F.col("n2")[i] + F.col("n3")[j])) for i, j in cells]
    names = F.array(*[F.struct(F.lit(grid[i]).alias("s2"), F.lit(grid[j]).alias("s3")) for i, j in cells])
    table = rows.agg(F.array(*means).alias("m")).select(F.explode(F.arrays_zip(names.alias("x"), F.col("m").alias("m"))).alias("z"))
    return table.select(F.col("z.x.s2").alias("s2"), F.col("z.x.s3").alias("s3"), F.col("z.m").alias("macro_f05"))


def best_policy(sweep: DataFrame) -> DataFrame:
    """The first best cell in the order of the grid, the second source's threshold outermost."""
    return sweep.orderBy(F.desc("macro_f05"), "s2", "s3").limit(1)


def inventory(records: DataFrame) -> DataFrame:
    """Rows, empty values of each column and countries of each source."""
    empty = lambda c: F.count_if(F.trim(c) == "").alias(f"empty_{c}")
    return records.groupBy("source").agg(F.count("*").alias("n_rows"), *[empty(c) for c in ("business_name", "business_address", "country")], F.count_distinct("country").alias("countries"))


def truth_inventory(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """References, those without a match and their share (the score of predicting nothing), and positive links."""
    n = truth.groupBy("q").agg(F.count_distinct("t").alias("n"))
    return entities.select("q").join(n, "q", "left").agg(F.count("*").alias("n_refs"), F.count_if(F.col("n").isNull()).alias("singletons"), (F.count_if(F.col("n").isNull()) / F.greatest(F.lit(1), F.count("*"))).alias("empty_share"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"))


def error_kinds(pairs: DataFrame) -> DataFrame:
    """The pairs that are accepted without label (kind fp) or labelled and not accepted (fn)."""
    kind = F.when(F.col("accepted") & ~F.col("label"), "fp").when(~F.col("accepted") & F.col("label"), "fn")
    return pairs.withColumn("kind", kind).where("kind IS NOT NULL")


def error_analysis(pairs: DataFrame) -> DataFrame:
    """kind and counts of overlapping conditions among false positives and scored false negatives.

    pairs has label, accepted (booleans), name, addr (scores), missing (target address) and only_l, only_r
    (numbers of one side only).
    """
    return error_kinds(pairs).groupBy("kind").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("missing")).alias("missing_address"),
        F.count_if(F.col("name") >= 0.9).alias("name_high"),
        F.count_if(F.col("addr") >= 0.9).alias("addr_high"),
        F.count_if((F.col("only_l") > 0) & (F.col("only_r") > 0)).alias("numbers_disagree"),
        F.count_if(F.col("name") < 0.5).alias("name_low"),
    )


def examples(pairs: DataFrame, k: int = 12) -> DataFrame:
    """The first k pairs of each kind by query and target."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("q", "t"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def reduction_ratio(n_candidates: Column, n_refs: Column, n_targets: Column) -> Column:
    return 1 - n_candidates / (n_refs * n_targets)
