"""Deterministic samples: rows in the order of a seeded md5, which any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col), F.lit(f"|{seed}")).cast("binary"))


def bottom_k(rows: DataFrame, id_col: str, k: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """k rows, uniform and repeatable; exclude (id_col) holds ids that earlier samples have used."""
    if exclude is not None:
        rows = rows.join(exclude.select(id_col), id_col, "left_anti")
    return rows.withColumn("__o", seeded(id_col, seed)).orderBy("__o", id_col).limit(k).drop("__o")


def stratified(rows: DataFrame, id_col: str, strata: list[str], shares: dict[str, int], seed: int) -> DataFrame:
    """rows with split: each stratum is dealt in proportion to the shares, in seeded order.

    A row's place is that in its part of the stratum, of which the seeded order gives 4096 even ones, plus the
    rows of the parts before; no task sorts a stratum.
    """
    total = sum(shares.values())
    parted = rows.withColumns({"__o": seeded(id_col, seed), "__b": F.substring(seeded(id_col, seed), 1, 3)})
    before = Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy(*strata, "__b").agg(F.count("*").alias("__k"))
    counts = counts.select(
        *[F.col(c).alias(f"__s{i}") for i, c in enumerate(strata)],
        F.col("__b").alias("__b2"),
        F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__first"),
        F.sum("__k").over(Window.partitionBy(*strata)).alias("__n"),
    )
    same = F.col("__b") == F.col("__b2")
    for i, c in enumerate(strata):
        same &= F.col(c).eqNullSafe(F.col(f"__s{i}"))
    inside = F.row_number().over(Window.partitionBy(*strata, "__b").orderBy("__o", id_col)) - 1
    placed = parted.withColumn("__r", inside).join(counts, same)
    place = (F.col("__first") + F.col("__r")) * total
    split, upto = None, 0
    for name, share in shares.items():
        upto += share
        hit = place < F.col("__n") * upto
        split = F.when(hit, name) if split is None else split.when(hit, name)
    return placed.select(*rows.columns, split.alias("split"))
