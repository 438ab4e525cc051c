"""Blocking keys, capped key joins, votes and rankings.

A record's keys are one array expression, exploded once. Blocks over the cap are removed by a count
before the join, so an over-frequent key never produces pairs. Over-frequent keys are few, so what is joined
away is their list, which Spark broadcasts while it is small, and their postings aren't shuffled; after that
no key has more than ``cap`` targets. A key that many queries share is split by the adaptive skew join. Keys
start with the country, so pairs never cross countries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest(array: Column, k: int) -> Column:
    """The first k strings by (longer first, then code points)."""
    ordered = F.sort_array(F.transform(array, lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t"))))
    return F.transform(F.slice(ordered, 1, k), lambda s: s["t"])


def combinations(array: Column, size: int, sep: str) -> Column:
    """The 2-combinations of an array's strings cut to size characters, each pair sorted and joined."""
    cut = F.transform(array, lambda t: F.substring(t, 1, size))
    return F.flatten(
        F.transform(
            cut,
            lambda x, i: F.transform(
                F.filter(cut, lambda _, j: j > i),
                lambda y: F.concat(F.least(x, y), F.lit(sep), F.greatest(x, y)),
            ),
        )
    )


def crossed(left: Column, right: Column) -> Column:
    """left|right for all pairs of two short arrays."""
    return F.flatten(F.transform(left, lambda t: F.transform(right, lambda z: F.concat(t, F.lit("|"), z))))


def _letters(array: Column, least: int) -> Column:
    return F.filter(array, lambda t: t.rlike(r"^\p{L}+$") & (F.length(t) >= least))


def _cut(array: Column, size: int) -> Column:
    return F.transform(array, lambda t: F.substring(t, 1, size))


def _kind(kind: str, values: Column) -> Column:
    return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.col("c"), F.lit(f"|{kind}|"), v))


def _keys(prefix: str, kinds: list[tuple[str, Column]]) -> Column:
    """Distinct keys country|kind|value of the kinds' non-empty values."""
    return F.array_distinct(F.concat(*[_kind(prefix + kind, values) for kind, values in kinds]))


def base_keys() -> Column:
    """Keys of a prepared record: names whole and by token pairs, addresses, and name tokens with numbers or places."""
    top4 = F.filter(longest(F.col("nt"), 4), lambda t: F.length(t) >= 3)
    strong = longest(_letters(F.col("at"), 4), 2)
    return _keys(
        "",
        [
            ("name", F.array("n")),
            ("core", F.array(F.array_join("nt", " "))),
            ("prefix", F.array(F.array_join(F.sort_array(_cut(F.col("nt"), 4)), " "))),
            ("addr", F.array(F.array_join("at", " "))),
            ("pair", combinations(longest(F.col("nt"), 5), 5, " ")),
            ("num", crossed(_cut(top4, 4), F.slice("nums", 1, 4))),
            ("local", crossed(_cut(top4, 4), _cut(strong, 5))),
        ],
    )


def extra_keys() -> Column:
    """Supplementary keys: names without spaces, and long address words with numbers and with each other."""
    words = longest(_letters(F.col("at"), 4), 4)
    return _keys(
        "extra|",
        [
            ("compact", F.array(F.array_join("nt", ""), F.array_join("plain", ""))),
            ("addrnum", crossed(_cut(F.slice(words, 1, 3), 6), F.slice("nums", 1, 3))),
            ("addrpair", combinations(words, 6, "|")),
        ],
    )


def phonetic_keys() -> Column:
    """Keys of a record with phonetic forms."""
    tokens = longest(F.array_distinct("pt"), 5)
    far = longest(F.array_distinct(_letters(F.split("ra", " "), 5)), 4)
    long = F.length("pc") >= 8
    return _keys(
        "v4|",
        [
            ("pn", F.array("pc")),
            ("ps", F.array(F.array_join(F.sort_array("pt"), ""))),
            ("pt", F.filter(tokens, lambda t: F.length(t) >= 3)),
            ("pp", combinations(tokens, 4, "|")),
            ("pf", F.array(F.when(long, F.substring("pc", 1, 8)).otherwise(""))),
            ("pl", F.array(F.when(long, F.right("pc", F.lit(8))).otherwise(""))),
            ("ap", combinations(far, 64, "|")),
        ],
    )


def postings(records: DataFrame, keys: Column, id_name: str) -> DataFrame:
    """(key, id) of records by their distinct keys."""
    return records.select(F.col("entity_id").alias(id_name), F.explode(keys).alias("key"))


def capped(targets: DataFrame, cap: int) -> DataFrame:
    """Postings of the keys that have at most cap targets; counted by key before anything is joined."""
    over = targets.groupBy("key").agg(F.count("*").alias("block")).where(F.col("block") > cap).select("key")
    return targets.join(over, "key", "left_anti")


def votes(queries: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """(q, t, votes): how many surviving keys a query shares with a target."""
    return queries.join(capped(targets, cap), "key").groupBy("q", "t").agg(F.count("*").alias("votes"))


def top(pairs: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each q; ranked with the row number, which Spark prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(*order))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def candidates(queries: DataFrame, targets: DataFrame, keys: Column, cap: int = 100, most: int = 240) -> DataFrame:
    """(q, t, votes, rank) of each query's best targets by votes, then target id."""
    found = votes(postings(queries, keys, "q"), postings(targets, keys, "t"), cap)
    return top(found, most, F.desc("votes"), F.asc("t"))


def neighbours(reference: DataFrame, keys: Column, score, cap: int = 500, most: int = 120, k: int = 8) -> DataFrame:
    """(q, t, sim, rank): a reference record's most similar other reference records.

    ``score`` maps (q, t, votes) pairs to the same with a column sim.
    """
    near = candidates(reference, reference, keys, cap, most).where("q <> t").drop("rank")
    return top(score(near), k, F.desc("sim"), F.desc("votes"), F.asc("t"))


def seeds(pool: DataFrame, signature: Column, own: Column, most: int = 3) -> DataFrame:
    """(q, t): up to ``most`` strong targets of a query with distinct signatures, none of them the query's own.

    pool has q, t, combined and what the two expressions read.
    """
    first = Window.partitionBy("q", "sig").orderBy(F.desc("combined"), F.desc("t"))
    rows = pool.withColumn("sig", signature).where(F.col("sig") != own).withColumn("__r", F.row_number().over(first)).where("__r = 1")
    return top(rows, most, F.desc("combined"), F.desc("t")).select("q", "t")


def expanded(pool: DataFrame, seed_pairs: DataFrame, target_keys: DataFrame, targets: DataFrame, cap: int, most: int) -> DataFrame:
    """(q, t): a pool united with the candidates of its seeds, two hops from the query."""
    as_queries = seed_pairs.join(target_keys.withColumnRenamed("t", "s"), seed_pairs["t"] == F.col("s")).select(F.concat_ws("\u0001", seed_pairs["q"], "s").alias("q"), "key")
    hop = top(votes(as_queries, targets, cap), most, F.desc("votes"), F.asc("t"))
    return pool.select("q", "t").union(hop.select(F.substring_index("q", "\u0001", 1).alias("q"), "t")).distinct()


def union_of_top(pairs: DataFrame, k: int, rankings: list[Column]) -> DataFrame:
    """The pairs that are among the first k of their query under any ranking, each once.

    One branch for each ranking, so each prunes its window on its own.
    """
    out = None
    for ranking in rankings:
        part = top(pairs, k, ranking.desc(), F.asc("t")).drop("rank")
        out = part if out is None else out.union(part)
    return out.distinct()
