"""Pair features: overlaps, rarity, fuzzy scores, numbers and rivals, as columns of one pair table.

Records' forms are computed once before the join to pairs; all fuzzy scores of a pair come from a few
Arrow calls; everything else stays in built-in functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.functions import fuzzy, phonetic


def overlap(left: Column, right: Column) -> list[Column]:
    """Jaccard, and the intersection over the smaller, the left and the right set; sets are distinct arrays."""
    both = F.size(F.array_intersect(left, right))
    union = F.size(F.array_union(left, right))
    one = F.lit(1)
    sizes = (union, F.least(F.size(left), F.size(right)), F.size(left), F.size(right))
    return [both / F.greatest(one, s) for s in sizes]


def frequencies(reference: DataFrame) -> DataFrame:
    """(c, kind, text, cnt): how many reference records of a country have a text of a kind.

    Kinds: N name, C core tokens, E extended core, A address tokens, n each core token, a each address token.
    """
    one = lambda kind, value: F.array(F.struct(F.lit(kind).alias("kind"), value.alias("text")))
    many = lambda kind, array: F.transform(array, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    every = F.concat(
        one("N", F.col("n")), one("C", F.array_join("nt", " ")), one("E", F.col("core")), one("A", F.array_join("at", " ")),
        many("n", F.col("nt")), many("a", F.col("at")),
    )
    return reference.select("c", F.explode(every).alias("x")).where("x.text <> ''").groupBy("c", F.col("x.kind").alias("kind"), F.col("x.text").alias("text")).agg(F.count("*").alias("cnt"))


#: The texts of a record that are counted, by their kind.
TEXTS = {"N": "n", "C": "array_join(nt, ' ')", "E": "core", "A": "array_join(at, ' ')"}


def counted(records: DataFrame, freq: DataFrame) -> DataFrame:
    """records with cnt: how many references of their country have their text of each kind; joined to records, which are far fewer and smaller than pairs."""
    for kind, text in TEXTS.items():
        own = freq.where(F.col("kind") == kind).select(F.col("c").alias("__c"), F.col("text").alias("__text"), F.col("cnt").alias(f"__cnt_{kind}"))
        records = records.withColumn("__key", F.expr(text)).join(own, (F.col("c") == F.col("__c")) & (F.col("__key") == F.col("__text")), "left").drop("__c", "__text", "__key")
    counts = F.struct(*[F.coalesce(f"__cnt_{kind}", F.lit(0)).alias(kind) for kind in TEXTS])
    return records.withColumn("cnt", counts).drop(*[f"__cnt_{kind}" for kind in TEXTS])


def population(reference: DataFrame) -> DataFrame:
    return reference.groupBy("c").agg(F.count("*").alias("pop"))


def rarity(count: Column, pop: Column) -> Column:
    """Weight of a token: ln(1 + pop / (1 + count)); an unknown country has population 1."""
    return F.log1p(F.coalesce(pop, F.lit(1)) / (1 + F.coalesce(count, F.lit(0))))


def token_weights(records: DataFrame, array: str, kind: str, freq: DataFrame, pop: DataFrame) -> DataFrame:
    """(entity_id, w): array of (t, w) of a record's tokens, missing counts as 0."""
    tokens = records.select("entity_id", "c", F.explode(array).alias("text"))
    weighed = tokens.join(freq.where(F.col("kind") == kind).select("c", "text", "cnt"), ["c", "text"], "left").join(pop, "c", "left")
    # A record's tokens are few, so the list is short whatever the tables hold.
    return weighed.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct(F.col("text").alias("t"), rarity(F.col("cnt"), F.col("pop")).alias("w")))).alias("w"))


def weighted_overlap(left: Column, right: Column) -> list[Column]:
    """Weighted Jaccard, coverage of either side, and the largest weight left only, right only and in both."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["w"])
    most = lambda a: F.coalesce(F.array_max(F.transform(a, lambda x: x["w"])), F.lit(0.0))
    names = lambda a: F.transform(a, lambda x: x["t"])
    common = F.filter(left, lambda x: F.array_contains(names(right), x["t"]))
    left_only = F.filter(left, lambda x: ~F.array_contains(names(right), x["t"]))
    right_only = F.filter(right, lambda x: ~F.array_contains(names(left), x["t"]))
    sl, sr, si = add(left), add(right), add(common)
    floor = F.lit(1e-6)
    return [si / F.greatest(floor, sl + sr - si), si / F.greatest(floor, sl), si / F.greatest(floor, sr), most(left_only), most(right_only), most(common)]


def _at_least(array: Column, k: int) -> Column:
    return F.filter(array, lambda v: F.length(v) >= k)


def number_features(left: Column, right: Column) -> list[Column]:
    """For numbers of at least k digits, k from 1 to 5: how many are left only, right only and common."""
    out = []
    for k in range(1, 6):
        a, b = _at_least(left, k), _at_least(right, k)
        out += [F.size(x).cast("long") for x in (F.array_except(a, b), F.array_except(b, a), F.array_intersect(a, b))]
    return out


def keep(name: Column, address: Column, missing: Column) -> Column:
    """The cheap filter on token-set scores; bounds allow for rounding."""
    e = 1e-7
    return (
        (name >= 0.9 - e)
        | (address >= 0.85 - e)
        | ((name >= 0.35 - e) & (address >= 0.5 - e))
        | (missing & (name >= 0.5 - e))
    )


def sided(records: DataFrame, side: str) -> DataFrame:
    """records with all columns prefixed l_ or r_."""
    return records.select(*[F.col(c).alias(f"{side}_{c}") for c in records.columns])


def _cores(df: DataFrame) -> int:
    """Partitions of what is long to score."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(pairs: DataFrame) -> DataFrame:
    """pairs dealt over all cores: they are small in bytes, so they would be coalesced, but long to score."""
    return pairs.repartition(_cores(pairs), "q", "t")


def known(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs, if all their ids are records; else an error."""
    for side, rows in (("q", left), ("t", right)):
        missing = pairs.select(F.col(side).alias("entity_id")).join(rows.select("entity_id"), "entity_id", "left_anti").first()
        if missing is not None:
            raise KeyError(missing["entity_id"])
    return pairs


def pair_records(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (q, t) joined with both records' forms; left columns are l_, right ones r_."""
    return pairs.join(sided(left, "l"), F.col("q") == F.col("l_entity_id")).join(sided(right, "r"), F.col("t") == F.col("r_entity_id"))


def _hashed(value: int) -> int:
    """Spark's hash of an int, which deals out rows."""
    m = 0xFFFFFFFF
    k = value * 0xCC9E2D51 & m
    k = (k << 15 | k >> 17) * 0x1B873593 & m
    h = 42 ^ k
    h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & m
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@cache
def _cells(n: int) -> list[int]:
    """For each of n partitions an int that is dealt to it."""
    found: dict[int, int] = {}
    value = 0
    while len(found) < n:
        found.setdefault(_hashed(value) % n, value)
        value += 1
    return [found[i] for i in range(n)]


def _side(df: DataFrame) -> int:
    """Rows and columns of the grid of cells."""
    return math.isqrt(_cores(df) - 1) + 1


def _dealt(df: DataFrame, side: int, row: Column | None, column: Column | None) -> DataFrame:
    """df with __cell, dealt out by it; without a row or a column it goes to all of them."""
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    df = df if row is not None and column is not None else df.withColumn("__every", every)
    # Groups by either side's ids must not depend on each other.
    group = lambda c, seed: F.col("__every") if c is None else F.pmod(F.hash(F.lit(seed), c), F.lit(side))
    cell = F.get(F.lit(_cells(side * side)), group(row, 1) * side + group(column, 2))
    return df.withColumn("__cell", cell).drop("__every").repartition(side * side, "__cell")


def _beside(df: DataFrame, records: DataFrame, own: Column, how: str = "inner") -> DataFrame:
    """df joined with records in the same cells by an id; the records are hashed, so df is neither sorted nor dealt out."""
    # Spark reads this when it plans, so it stays set in the session.
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.join(records.withColumnRenamed("__cell", "__c").hint("shuffle_hash"), (F.col("__cell") == F.col("__c")) & own, how).drop("__c")


def in_cells(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (q, t) joined with left and right, whose ids are l_entity_id and r_entity_id; __cell is their cell of a grid.

    Rows of the grid are groups of references, columns groups of targets, and a cell is a partition. A record goes to
    the cells of its group, the root of their number, however many pairs it has; of pairs the ids alone are dealt out.
    """
    side = _side(pairs)
    rows = _dealt(pairs, side, F.col("q"), F.col("t"))
    rows = _beside(rows, _dealt(left, side, F.col("l_entity_id"), None), F.col("q") == F.col("l_entity_id"))
    return _beside(rows, _dealt(right, side, None, F.col("r_entity_id")), F.col("t") == F.col("r_entity_id"))


def scoring_records(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pair_records for fuzzy scores, on all cores, in cells."""
    return in_cells(pairs, sided(left, "l"), sided(right, "r"))


def cheap_scores(pairs: DataFrame) -> DataFrame:
    """pair records with ns, ads (token sets of cores and addresses), compact_ratio and kept (the cheap filter)."""
    core = lambda s: F.array_join(f"{s}_nt", " ")
    return pairs.withColumns(
        {
            "ns": fuzzy.score("token_set", core("l"), core("r")),
            "ads": fuzzy.score("token_set", F.col("l_a"), F.col("r_a")),
        }
    ).withColumn("kept", keep(F.col("ns"), F.col("ads"), (F.col("l_a") == "") | (F.col("r_a") == "")))


def similarity(pairs: DataFrame) -> DataFrame:
    """pair records with name_sim, addr_sim and combined."""
    return pairs.withColumns(
        {"name_sim": fuzzy.score("ratio", F.col("l_compact"), F.col("r_compact")), "addr_sim": fuzzy.score("token_set", F.col("l_a"), F.col("r_a"))}
    ).withColumn("combined", _combined(F.col("name_sim"), F.col("addr_sim")))


def _combined(name: Column, address: Column) -> Column:
    both, union = F.size(F.array_intersect("l_nums", "r_nums")), F.size(F.array_union("l_nums", "r_nums"))
    return 0.45 * name + 0.45 * address + 0.10 * both / F.greatest(F.lit(1), union)


def _flag(c: Column) -> Column:
    return c.cast("double")


def _equal(x: Column, y: Column) -> Column:
    return _flag((x != "") & (x == y))


def _named(names: list[str], values: list[Column]) -> dict[str, Column]:
    assert len(names) == len(values)
    return {n: v.cast("double") for n, v in zip(names, values, strict=True)}


def _add(df: DataFrame, made: dict[str, Column], order: list[str]) -> DataFrame:
    order += list(made)
    return df.withColumns(made)


def base_features(pairs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Pair records with the 50 base features as columns f_*, and their names in order."""
    order: list[str] = []
    df = pairs
    core = {s: F.array_join(f"{s}_nt", " ") for s in "lr"}
    fields = {"name": (F.col("l_n"), F.col("r_n")), "core_name": (core["l"], core["r"]), "address": (F.col("l_a"), F.col("r_a"))}
    df = df.withColumns({f"__{k}": fuzzy.all_scores(x, y) for k, (x, y) in fields.items()})
    for k, (x, y) in fields.items():
        made = {f"f_{k}_{s}": F.col(f"__{k}.{s}") for s in fuzzy.SCORES}
        made |= {f"f_{k}_exact": _equal(x, y), f"f_{k}_length": F.least(F.length(x), F.length(y)) / F.greatest(F.lit(1), F.length(x), F.length(y))}
        df = _add(df, made, order)
    for k, c in (("name_tokens", "nt"), ("address_tokens", "at"), ("numbers", "nums")):
        names = [f"f_{k}_{m}" for m in ("jaccard", "overlap", "left", "right")]
        df = _add(df, _named(names, overlap(F.col(f"l_{c}"), F.col(f"r_{c}"))), order)
    sizes = {f"f_{c}_{s}": F.size(f"{s}_{c}").cast("double") for c in ("nt", "at", "nums") for s in "lr"}
    sizes |= {"f_nums_only_l": F.size(F.array_except("l_nums", "r_nums")).cast("double"), "f_nums_only_r": F.size(F.array_except("r_nums", "l_nums")).cast("double")}
    flags = {"f_same_country": _flag(F.col("l_c") == F.col("r_c"))} | {f"f_missing_{s}_{c}": _flag(F.col(f"{s}_{c}") == "") for c in ("n", "a") for s in "lr"}
    df = _add(df, sizes | flags, order)
    df = df.withColumn("__align", fuzzy.alignments(F.col("l_nt"), F.col("r_nt")))
    df = _add(df, {f"f_align_{s}_{m}": F.col(f"__align.{m}{back}") for s, back in (("lr", ""), ("rl", "_back")) for m in ("least", "mean")}, order)
    return df.drop("__name", "__core_name", "__address", "__align"), order


def context_features(df: DataFrame, order: list[str], rivals: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the 70 context features.

    df has l_wn, l_wa, r_wn and r_wa (token weights), and l_cnt and r_cnt (see counted), all of which are under the
    country of both, since pairs never cross countries; rivals is (o, near) with the neighbours' forms of references, see
    around. These are joined before anything is scored: rows that went through Python have no cell for Spark.
    """
    order = list(order)
    if "__cell" in df.columns:
        df = _beside(df, _dealt(rivals, _side(df), F.col("o"), None), F.col("q") == F.col("o"), "left")
    else:
        df = df.join(rivals, F.col("q") == F.col("o"), "left")
    df = df.withColumns({"__best": _best(F.col("near"), _form("r_")), "__addr": fuzzy.score("token_set", F.col("l_a"), F.col("r_a"))})
    kinds = ("ratio", "partial", "token_sort", "token_set")
    words = {s: F.array_join(f"{s}_words", " ") for s in "lr"}
    fields = {"x_core": (F.col("l_core"), F.col("r_core")), "x_compact": (F.col("l_compact"), F.col("r_compact")), "x_words": (words["l"], words["r"])}
    df = df.withColumns({f"__{k}": fuzzy.all_scores(x, y, kinds) for k, (x, y) in fields.items()})
    df = _add(df, {f"f_{k}_{s}": F.col(f"__{k}.{s}") for k in fields for s in kinds}, order)
    flags = {
        "f_compact_equal": _equal(F.col("l_compact"), F.col("r_compact")),
        "f_acronym_l": _equal(F.col("l_acronym"), F.col("r_compact")),
        "f_acronym_r": _equal(F.col("r_acronym"), F.col("l_compact")),
        "f_nonascii_l": _flag(F.col("l_nonascii")),
        "f_nonascii_r": _flag(F.col("r_nonascii")),
        "f_nonascii_differ": _flag(F.col("l_nonascii") != F.col("r_nonascii")),
    }
    df = _add(df, flags, order)
    parts = ("jaccard", "left", "right", "only_l", "only_r", "common")
    for k, c in (("name", "wn"), ("addr", "wa")):
        df = _add(df, _named([f"f_w_{k}_{m}" for m in parts], weighted_overlap(F.col(f"l_{c}"), F.col(f"r_{c}"))), order)
    for kind in TEXTS:
        counts = {side: F.col(f"{side}_cnt")[kind] for side in "lr"}
        made = {f"f_cnt_{kind}_{s}": F.log1p(counts[s].cast("double")) for s in "lr"} | {f"f_one_{kind}_{s}": _flag(counts[s] == 1) for s in "lr"}
        df = _add(df, made, order)
    names = [f"f_num{k}_{m}" for k in range(1, 6) for m in ("l", "r", "both")]
    df = _add(df, _named(names, number_features(F.col("l_nums"), F.col("r_nums"))), order)
    df = df.withColumn("__num", fuzzy.alignments(F.col("l_nums"), F.col("r_nums")))
    df = _add(df, {"f_num_least": F.col("__num.least"), "f_num_mean": F.col("__num.mean")}, order)
    best = {k: F.col(f"__best.best_{k}") for k in ("name", "addr", "combined")}
    own = {"name": F.col("f_x_compact_ratio"), "addr": F.col("__addr"), "combined": _combined(F.col("f_x_compact_ratio"), F.col("__addr"))}
    df = _add(df, {f"f_rival_{k}": best[k] for k in best} | {f"f_lead_{k}": own[k] - best[k] for k in best} | {"f_neighbours": F.col("__best.n_neighbours").cast("double")}, order)
    return df.drop(*[f"__{k}" for k in fields], "__num", "__best", "__addr", "o", "near"), order


def around(near: DataFrame, reference: DataFrame) -> DataFrame:
    """(o, near): what similarities need of each reference's neighbours; near is (q, t) with at most a handful for each q."""
    others = near.select(F.col("q").alias("o"), "t").join(reference.select(F.col("entity_id").alias("t"), _form("").alias("form")), "t")
    return others.groupBy("o").agg(F.collect_list("form").alias("near"))


def _form(side: str) -> Column:
    return F.struct(F.col(f"{side}compact").alias("compact"), F.col(f"{side}a").alias("a"), F.array_join(f"{side}nums", " ").alias("nums"))


def rivals(pairs: DataFrame, near: DataFrame, reference: DataFrame, targets: DataFrame) -> DataFrame:
    """(q, t, best_name, best_addr, best_combined, n_neighbours): the best similarity of q's neighbours to t.

    near is (q, t) with at most a handful of neighbours for each q.
    """
    rows = in_cells(pairs.select("q", "t"), around(near, reference).withColumnRenamed("o", "l_entity_id"), sided(targets, "r"))
    return rows.select("q", "t", _best(F.col("near"), _form("r_")).alias("best")).select("q", "t", "best.*")


def _best(near: Column, form: Column) -> Column:
    """The best similarities of an array of (compact, a, nums) to one, and how many they are."""
    names = ("best_name", "best_addr", "best_combined")

    @F.arrow_udf(T.StructType([*[T.StructField(n, T.DoubleType()) for n in names], T.StructField("n_neighbours", T.LongType())]))
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        others = x.flatten()
        sims = [_each(score, others.field(i), y.field(i), row) for i, score in enumerate((_of("ratio"), _of("token_set"), _shared))]
        name, addr, shared = sims
        found = []
        for values in (name, addr, 0.45 * name + 0.45 * addr + shared):
            best = np.zeros(len(sizes))
            np.maximum.at(best, row, values)
            found.append(pa.array(best))
        return pa.StructArray.from_arrays([*found, pa.array(sizes)], [*names, "n_neighbours"])

    return run(near, form)


def _of(kind: str) -> Callable[[list[str], list[str]], np.ndarray]:
    return lambda x, y: fuzzy.many((kind,), x, y)[kind]


def _shared(x: list[str], y: list[str]) -> np.ndarray:
    """The part of numbers in combined."""
    sets = {s: frozenset(s.split()) for s in {*x, *y}}
    return np.array([0.10 * len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for a, b in zip(x, y, strict=True)])


def _each(score: Callable[[list[str], list[str]], np.ndarray], x: pa.Array, y: pa.Array, row: np.ndarray) -> np.ndarray:
    """The score of each string of x to the string of y in its row; equal pairs are scored once."""
    x, y = (pc.fill_null(v, "").dictionary_encode() for v in (x, y))
    a, b = x.indices.to_numpy().astype(np.int64), y.indices.to_numpy().astype(np.int64)[row]
    if not len(a):
        return np.zeros(0)
    width = len(y.dictionary)
    pairs, of = np.unique(a * width + b, return_inverse=True)
    left, right = x.dictionary.to_pylist(), y.dictionary.to_pylist()
    return score([left[i] for i in pairs // width], [right[i] for i in pairs % width])[of]


#: The texts whose numbers are read in order, by the column of them.
ORDERED = {"o_addr": "business_address", "o_name": "business_name"}


def numbered(records: DataFrame) -> DataFrame:
    """records with the distinct numbers of their texts in order."""
    return records.withColumns({k: F.array_distinct(phonetic.ordered_numbers(phonetic.romanize(F.col(c)))) for k, c in ORDERED.items()})


def all_features(pairs: DataFrame, around: DataFrame, with_phonetic: bool = True) -> tuple[DataFrame, list[str]]:
    """scoring_records of counted and numbered records with the 120 base and context features, and 34 phonetic ones."""
    df, context = context_features(pairs, [], around)
    df, order = base_features(df)
    return phonetic_features(df, order + context) if with_phonetic else (df, order + context)


def phonetic_features(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds the 34 phonetic and ordered-number features to pair records with phonetic forms; what numbered adds is made if it is missing."""
    order = list(order)
    kinds = ("ratio", "partial", "token_sort", "token_set")
    for c in ("rn", "pn", "pc", "ra"):
        x, y = F.col(f"l_{c}"), F.col(f"r_{c}")
        df = df.withColumn("__p", fuzzy.all_scores(x, y, kinds))
        df = _add(df, {f"f_{c}_{s}": F.col(f"__p.{s}") for s in kinds} | {f"f_{c}_equal": _equal(x, y)}, order).drop("__p")
    for k, c in (("addr", "o_addr"), ("name", "o_name")):
        own = lambda s: F.col(f"{s}_{c}") if f"{s}_{c}" in df.columns else F.array_distinct(phonetic.ordered_numbers(phonetic.romanize(F.col(f"{s}_{ORDERED[c]}"))))  # noqa: B023, E731
        df = df.withColumns({"__x": own("l"), "__y": own("r")})
        x, y = F.try_element_at("__x", F.lit(1)), F.try_element_at("__y", F.lit(1))
        no = lambda c: F.coalesce(c, F.lit(False))
        df = df.withColumn("__r", fuzzy.score("ratio", x, y))
        made = {
            f"f_{k}_first_equal": _flag(no(x == y)),
            f"f_{k}_first_differ": _flag(no(x != y)),
            f"f_{k}_l_in_r": _flag(no(F.array_contains("__y", x))),
            f"f_{k}_r_in_l": _flag(no(F.array_contains("__x", y))),
            f"f_{k}_only_l": F.size(F.array_except("__x", "__y")).cast("double"),
            f"f_{k}_only_r": F.size(F.array_except("__y", "__x")).cast("double"),
            f"f_{k}_first_ratio": F.when(x.isNotNull() & y.isNotNull(), F.col("__r")).otherwise(0.0),
        }
        df = _add(df, made, order).drop("__x", "__y", "__r")
    return df, order
