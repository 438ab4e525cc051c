"""The standard tables read as records of three sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _record(df: DataFrame, key: str, name, address, country) -> DataFrame:
    source = F.concat(F.lit("S"), (F.col(key) % 3 + 1).cast("string"))
    return df.select(
        F.concat_ws("-", source, F.col(key).cast("string")).alias("entity_id"),
        name.alias("business_name"),
        address.alias("business_address"),
        country.alias("country"),
        source.alias("source"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's first six words are the name and the next twelve the address."""
    # Some words more than are used, as a letter may fold to none.
    words = text.tokens(text.fold(text.first_words(F.col("text"), 30), native_only=True))
    df = _table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("w"))
    return _record(df, "doc_id", F.array_join(F.slice("w", 1, 6), " "), F.array_join(F.slice("w", 7, 12), " "), F.col("lang"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few names and many ties."""
    df = _table(spark, sf_dir, "part")
    return _record(df, "p_partkey", F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")), F.lit("part"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in names and addresses; nations are few and broadcast by their size."""
    df = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    address = F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 97).cast("string"), "n_name")
    return _record(df, "c_custkey", F.col("c_name"), address, F.col("n_regionkey").cast("string"))


ADAPTERS = {"documents": documents, "parts": parts, "customers": customers}


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, t): targets of one language with the same folded, space-joined words as a reference.

    References are free of duplicates among themselves, so of those with equal words the first has the matches;
    a target has one reference at most, however many copies there are.
    """
    words = text.words_text(F.col("text"))
    df = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(words.cast("binary")).alias("h"))
    ident = lambda c: F.concat(F.lit("S"), (F.col(c) % 3 + 1).cast("string"), F.lit("-"), F.col(c).cast("string"))
    first = df.where(F.col("doc_id") % 3 == 0).groupBy("lang", "h").agg(F.min("doc_id").alias("q_id"))
    targets = df.where(F.col("doc_id") % 3 != 0).withColumnRenamed("doc_id", "t_id")
    return targets.join(first, ["lang", "h"]).select(ident("q_id").alias("q"), ident("t_id").alias("t"))
