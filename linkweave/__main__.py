"""Command line: inventory, validate and link tab-separated files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkweave.operators import metrics, validate
from linkweave.plans import linkage
from linkweave.sources import files


def _results(spark: SparkSession, matches: str, candidates: str):
    read = lambda path, name: spark.read.options(sep="\t", header=True).csv(path).toDF("q", name).select("q", F.coalesce(name, F.lit("")).alias(name))
    return read(matches, "matches").join(read(candidates, "candidates"), "q", "full").select("q", F.coalesce("candidates", F.lit("")).alias("candidates"), F.coalesce("matches", F.lit("")).alias("matches"))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="linkweave")
    commands = top.add_subparsers(dest="command", required=True)
    inventory = commands.add_parser("inventory", help="rows, empty values and countries of record files")
    inventory.add_argument("records", nargs="+")
    check = commands.add_parser("validate", help="check result files against their sources")
    for name in ("matches", "candidates", "references"):
        check.add_argument(f"--{name}", required=True)
    check.add_argument("--targets", nargs="+", required=True)
    link = commands.add_parser("link", help="train on one split and link another")
    for name in ("train-references", "truth", "references", "out"):
        link.add_argument(f"--{name}", required=True)
    link.add_argument("--train-targets", nargs="+", required=True)
    link.add_argument("--targets", nargs="+", required=True)
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("linkweave").getOrCreate()
    if args.command == "inventory":
        for row in metrics.inventory(files.read_targets(spark, *args.records)).toJSON().collect():
            print(row)
        return 0
    if args.command == "validate":
        found = validate.violations(_results(spark, args.matches, args.candidates), files.read_records(spark, args.references), files.read_targets(spark, *args.targets)).cache()
        verdict = validate.report(found).first()["verdict"]
        print(json.dumps({"verdict": verdict, "violations": {r["rule"]: r["n"] for r in found.where("n > 0").collect()}}))
        return int(verdict != "PASS")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{args.out}/_checkpoints")
    settle = lambda df: df.checkpoint()
    models = linkage.train(files.read_records(spark, args.train_references), files.read_targets(spark, *args.train_targets), files.read_truth(spark, args.truth), settle=settle)
    lists = settle(linkage.predict(files.read_records(spark, args.references), files.read_targets(spark, *args.targets), models, settle=settle))
    files.write_results(lists, "matches", "matched_entity_ids", f"{args.out}/matching_results")
    files.write_results(lists, "candidates", "candidate_entity_ids", f"{args.out}/candidate_pairs")
    return 0


if __name__ == "__main__":
    sys.exit(main())
