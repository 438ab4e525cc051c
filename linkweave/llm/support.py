"""What the operators share: checkpoints, Arrow text access and row-wise Arrow maps."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of a vectorised pass takes at once, unless one document is longer.
SLICE_BYTES = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a temporary folder of a local session (tests).

    A cluster must name a folder that all executors share.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="linkweave-")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, which survives lost executors.

    The shuffle files that made it go at once; Spark else keeps them until the driver collects its garbage.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        # A frame keeps the setting that it was made under, and nothing else runs this one.
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(key, own)


def unsettle(df: DataFrame) -> None:
    """Delete the files of a settled frame that nothing reads any more."""
    at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if at.isDefined():
        forget(df.sparkSession, at.get())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, offsets) of a text column without copying; null counts as empty.

    A slice holds at most ``limit`` bytes, or one row that is longer.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1)
        to = min(to, n)
        yield row, to, raw[ends[row] : ends[to]], ends[row : to + 1] - ends[row]
        row = to


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, the function of an Arrow map, which gives freed memory back to the system when a task ends.

    A Python worker serves many tasks; what allocators keep would add up over the stages of a job.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)

    return wrapped


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    maker: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    text: str = "text",
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """df with columns computed from ``text`` by an Arrow map; ``maker`` runs once in each task.

    A column of df whose name is among ``fields`` is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and f.name not in drop]
    names = [f.name for f in kept]
    schema = T.StructType(kept + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = None
        for batch in batches:
            compute = compute or maker()
            got = compute(batch.column(batch.schema.get_field_index(text)))
            old = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(old + got, names + [f.name for f in fields])

    return df.mapInArrow(thrifty(run), schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8_000_000) -> None:
    """Bound the rows and bytes of an Arrow batch, unless the session has smaller bounds; one row may be larger.

    Spark reads these settings when it plans, so they stay set in the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if own <= 0 or own > size:
        spark.conf.set(key, f"{size}b")


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned: crc32 of the id's decimal text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
