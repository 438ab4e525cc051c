"""Checks of result tables: each rule counts its violations, and all are one UNION ALL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ids(c: str) -> Column:
    return F.filter(F.split(c, ","), lambda x: x != "")


def violations(results: DataFrame, references: DataFrame, targets: DataFrame) -> DataFrame:
    """rule, severity and n of a result table (q, candidates, matches as comma lists).

    references and targets are (entity_id). Rules without a violation are listed with 0.
    """
    r = results.select("q", _ids("candidates").alias("c"), _ids("matches").alias("m"))
    each = r.select("q", F.explode(F.array_union("c", "m")).alias("t"))
    rules: list[tuple[str, str, DataFrame]] = [
        ("reference_repeated", "error", r.groupBy("q").count().where("count > 1")),
        ("reference_missing", "error", references.select(F.col("entity_id").alias("q")).join(r, "q", "left_anti")),
        ("reference_unknown", "error", r.join(references.select(F.col("entity_id").alias("q")), "q", "left_anti")),
        ("list_repeats", "error", r.where((F.size(F.array_distinct("c")) < F.size("c")) | (F.size(F.array_distinct("m")) < F.size("m")))),
        ("match_no_candidate", "error", r.where(F.size(F.array_except("m", "c")) > 0)),
        ("target_prefix", "error", each.where(~F.col("t").rlike("^S[23]-"))),
        ("self_match", "error", each.where(F.col("t") == F.col("q"))),
        ("target_spaces", "error", each.where(F.trim("t") != F.col("t"))),
        ("target_form", "error", each.where(F.col("t").rlike("[^\\x00-\\x7F]") | (F.octet_length("t") > 32))),
        ("target_unknown", "error", each.join(targets.select(F.col("entity_id").alias("t")), "t", "left_anti")),
    ]
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n") for rule, severity, df in rules]
    return reduce(DataFrame.union, parts)


def format_findings(lines: DataFrame, header: str, expected: list[str], references: DataFrame, targets: DataFrame | None = None, candidates: DataFrame | None = None, examples: int = 5) -> DataFrame:
    """severity, rule, n and a few examples of what is wrong with the lines (value) of a result file; order doesn't matter.

    header is the file's first line. A header without a tab but with a comma, or of other columns, ends the check.
    Whether targets exist is checked only with targets, and matches among candidates (q, ids) is a warning.
    """
    spark = lines.sparkSession
    names = [c.strip().lower() for c in header.split("\t")]
    if names != expected:
        rule = "empty" if not header else "comma_separated" if "\t" not in header and "," in header else "header"
        return spark.createDataFrame([("error", rule, 1, [header])], "severity string, rule string, n long, examples array<string>")
    body = lines.where(F.col("value") != header)
    tab = F.instr("value", "\t")
    rest = F.expr("substr(value, instr(value, '\\t') + 1)")
    ids = F.when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ","))
    rows = body.where(tab > 0).select(F.substring_index("value", "\t", 1).alias("q"), ids.alias("ids"))
    required = references.select(F.trim("entity_id").alias("q")).where("q <> ''").distinct()
    each = rows.select("q", F.explode(F.array_distinct("ids")).alias("t"))
    other = each.where(~F.col("t").startswith("S1-"))
    of = lambda df, c: df.select(F.col(c).alias("x"))
    rules: list[tuple[str, str, DataFrame]] = [
        ("error", "malformed_row", of(body.where((tab == 0) & (F.trim("value") != "")), "value")),
        ("error", "reference_repeated", of(rows.groupBy("q").count().where("count > 1"), "q")),
        ("error", "list_repeats", of(rows.where(F.size(F.array_distinct("ids")) < F.size("ids")), "q").distinct()),
        ("error", "self_match", of(each.where(F.col("t").startswith("S1-")), "t").distinct()),
        ("error", "target_prefix", of(other.where(~F.col("t").rlike("^S[23]-")), "t").distinct()),
        ("error", "reference_missing", of(required.join(rows, "q", "left_anti"), "q")),
        ("error", "reference_unknown", of(rows.select("q").distinct().join(required, "q", "left_anti"), "q")),
    ]
    if targets is not None:
        known = targets.select(F.trim("entity_id").alias("t"))
        rules.append(("error", "target_unknown", of(other.where(F.col("t").rlike("^S[23]-")).join(known, "t", "left_anti"), "t").distinct()))
    else:
        rules.append(("warning", "targets_not_checked", spark.range(1).select(F.lit("targets").alias("x"))))
    if candidates is not None:
        outside = rows.join(candidates.select("q", F.col("ids").alias("c")), "q", "left")
        none = F.array().cast("array<string>")
        rules.append(("warning", "match_no_candidate", of(outside.where(F.size(F.array_except("ids", F.coalesce("c", none))) > 0), "q").distinct()))
    parts = []
    for severity, rule, df in rules:
        # The smallest few by a top-k, which is bounded before anything is gathered.
        few = df.orderBy("x").limit(examples).agg(F.sort_array(F.collect_list("x")).alias("examples"))
        n = df.agg(F.count("*").alias("n"))
        parts.append(n.crossJoin(F.broadcast(few)).select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "n", "examples"))
    return reduce(DataFrame.union, parts)


def report(found: DataFrame) -> DataFrame:
    """verdict: PASS unless an error has a violation."""
    return found.agg(F.when(F.coalesce(F.sum(F.when(F.col("severity") == "error", F.col("n"))), F.lit(0)) == 0, "PASS").otherwise("FAIL").alias("verdict"))


def same_order(results: DataFrame, references: DataFrame) -> DataFrame:
    """Rows whose id differs from the reference's at the same place; both have ord and their id."""
    pairs = results.select("ord", "q").join(references.select("ord", F.col("entity_id")), "ord", "full")
    return pairs.where(~F.col("q").eqNullSafe(F.col("entity_id")))
