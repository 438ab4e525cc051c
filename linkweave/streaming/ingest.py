"""References that arrive as a stream, linked to a static table of target postings.

Each micro-batch is one plan: normalise, explode keys, join the capped postings, vote and rank. Batches are
written under their id with overwrite, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkweave.functions import text
from linkweave.operators import blocking
from linkweave.sources.files import RECORD


def build_postings(targets: DataFrame, keys: Column, cap: int, path: str) -> None:
    """Write the targets' capped postings sorted by key inside partitions of key."""
    posted = blocking.capped(blocking.postings(text.prepared(targets), keys, "t"), cap)
    posted.repartition("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def link_batch(batch: DataFrame, posted: DataFrame, keys: Column, most: int) -> DataFrame:
    """(q, t, votes, rank) of the references of one batch; postings are capped already."""
    queries = blocking.postings(text.prepared(batch), keys, "q")
    found = queries.join(posted, "key").groupBy("q", "t").agg(F.count("*").alias("votes"))
    return blocking.top(found, most, F.desc("votes"), F.asc("t"))


def link_stream(spark: SparkSession, arriving: str, postings: str, out: str, checkpoint: str, keys: Column, most: int = 240) -> StreamingQuery:
    """Start linking the Parquet files that arrive in a folder; the caller awaits the query."""
    stream = spark.readStream.schema(RECORD).parquet(arriving)

    def write(batch: DataFrame, number: int) -> None:
        posted = batch.sparkSession.read.parquet(postings)
        link_batch(batch, posted, keys, most).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
