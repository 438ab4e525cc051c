"""Tab-separated records and results, fingerprints and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])


def _tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file with exactly these columns; other headers or widths fail, empty fields are empty strings."""
    rows = spark.read.schema(schema).options(sep="\t", header=True, quote='"', escape='"', enforceSchema=False, mode="FAILFAST", multiLine=True, encoding="UTF-8").csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in schema.names])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of one source with their source, the id's part before the dash."""
    return _tsv(spark, path, RECORD).withColumn("source", F.substring_index("entity_id", "-", 1))


def read_targets(spark: SparkSession, *paths: str) -> DataFrame:
    """All targets: the union of the sources' records."""
    out = read_records(spark, paths[0])
    for p in paths[1:]:
        out = out.unionByName(read_records(spark, p))
    return out


def read_truth(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(q, t) pairs of the truth; ids (q) restricts it, and each of them must be covered."""
    rows = _tsv(spark, path, TRUTH).select(F.col("source1_entity_id").alias("q"), "matched_entity_ids")
    if ids is not None:
        missing = ids.select("q").join(rows, "q", "left_anti").limit(1).count()
        if missing:
            raise ValueError("truth does not cover all ids")
        rows = rows.join(ids.select("q").distinct(), "q", "left_semi")
    return rows.select("q", F.explode(F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")).alias("t"))


def write_results(lists: DataFrame, column: str, header: str, path: str) -> None:
    """One row for each reference in id order: id, tab, comma list, which may be empty.

    Range-partitioned by id, so the parts of the folder concatenate to the ordered file.
    """
    rows = lists.select(F.col("q").alias("source1_entity_id"), F.col(column).alias(header)).orderBy("source1_entity_id")
    rows.write.mode("overwrite").options(sep="\t", header=True, emptyValue="", nullValue="").csv(path)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and modification time of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_stage(df: DataFrame, path: str, inputs: DataFrame) -> DataFrame:
    """Materialise a stage beside a manifest of its inputs; an unchanged manifest reuses what is there."""
    spark = df.sparkSession
    manifest = f"{path}/_manifest"
    if exists(spark, manifest):
        old = spark.read.parquet(manifest)
        if old.exceptAll(inputs).isEmpty() and inputs.exceptAll(old).isEmpty():
            return spark.read.parquet(f"{path}/data")
        raise ValueError("inputs changed; use a fresh path")
    df.write.mode("overwrite").parquet(f"{path}/data")
    inputs.write.mode("overwrite").parquet(manifest)
    return spark.read.parquet(f"{path}/data")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
