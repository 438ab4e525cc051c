"""Choice of a model by its tuning score, the final fit, and comparisons of two generations on one holdout."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators import cascade, metrics, model

#: Thresholds that a model is tuned over.
THRESHOLDS = [0.25 + 0.025 * i for i in range(29)]


def choose(
    fit_pairs: DataFrame, tune_pairs: DataFrame, names: list[str], options: list[tuple[int, int]], tune_entities: DataFrame, truth: DataFrame, thresholds: list[float] = THRESHOLDS
) -> tuple[list[dict], dict, GBTClassificationModel]:
    """All trials, the chosen one and its model: the (trees, depth) whose best tuning macro F0.5 is highest.

    Labels of the tuning part alone choose; an equal score doesn't replace an earlier option.
    """
    trials, best, chosen = [], None, None
    truth = truth.join(tune_entities.select("q"), "q", "left_semi")
    for trees, depth in options:
        fitted = model.fit(fit_pairs, names, trees=trees, depth=depth)
        sweep = metrics.threshold_sweep(tune_entities.select("q"), truth, model.predict(fitted, tune_pairs, names), thresholds)
        row = metrics.best_threshold(sweep).first()
        trials.append({"trees": trees, "depth": depth, "threshold": row["tau"], "macro_f05": row["macro_f05"]})
        if best is None or row["macro_f05"] > best["macro_f05"]:
            best, chosen = trials[-1], fitted
    return trials, best, chosen


def refit(pairs: DataFrame, names: list[str], best: dict) -> GBTClassificationModel:
    """The chosen option fitted on the whole supervised sample."""
    return model.fit(pairs, names, trees=best["trees"], depth=best["depth"])


def same_holdout(entities: DataFrame, truth: DataFrame, old: DataFrame, new: DataFrame, gated: DataFrame) -> DataFrame:
    """kind, macro_f05 and the paired gain over the old generation with its interval, of old, new and hybrid.

    old, new and gated are (q, t), (q, t) and (q); the hybrid takes the new pairs of gated entities alone. All are
    scored on the same entities.
    """
    score = lambda pairs: metrics.per_entity(entities, truth, pairs)
    base = score(old)
    parts = []
    for kind, pairs in (("old", old), ("new", new), ("hybrid", cascade.override(entities, old, new, gated))):
        own = score(pairs)
        gain = metrics.paired(base, own).select(F.col("mean").alias("gain"), F.col("low").alias("gain_low"), F.col("high").alias("gain_high"))
        # Both sides are single rows.
        parts.append(own.agg(F.avg("score").alias("macro_f05"), F.count("*").alias("entities")).crossJoin(F.broadcast(gain)).withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, parts)
