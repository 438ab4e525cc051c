"""Sharding by fixed virtual slots, in built-in functions only.

Records hash into ``slots`` virtual slots, whose number never changes. The slots' bytes are aggregated,
and a slot map deals all slots to shards: largest first, each to the shard that is lightest so far; slots
without bytes go round, so that later records of theirs spread. The map is a small table of versions
that is written to a folder. A rebalance adds a version in which only the slots that must move have moved,
and the records of the others stay where they are. Any rows can be placed by any version: a row's slot
follows from the row, and places from the rows' own counts.

Equal texts go to one slot, unless the group's bytes or rows exceed ``whole`` of a shard's mean: such a
group is split over all slots by id, and rows of it that repeat an id (null is an id too) by their ordinal.
If the shards still differ by more than ``even`` of their mean, ``whole`` is made smaller, step by step.

Law of the query: ``bytes``. A row's ``slot`` is its place in its shard, gapless from 0; its virtual slot
is a column of its own. Places are numbered inside parts of virtual slots, and each part's first place
follows from the parts' row counts, so no shard and no slot is sorted as a whole.

Defined cases: null and empty texts have size 16 and crc 0 and form one group; a null id is an id like
others; rows that repeat have places of their own; with fewer rows than shards some shards are empty;
an empty table gives no rows and a map without bytes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.llm.support import settle, shared_folder


@dataclass(frozen=True)
class Sharding:
    """overhead: bytes of a record besides its text; whole: parts of a shard's mean that a group may have
    and still stay together, tried in order until the shards differ by at most ``even`` of their mean;
    parts: of a slot, numbered each on its own; slack: part of the mean by which a rebalance lets a shard
    stay above it."""

    shards: int = 40
    slots: int = 4096
    overhead: int = 16
    whole: tuple[float, ...] = (0.5, 0.2, 0.05)
    even: float = 0.05
    parts: int = 16
    slack: float = 0.0


def records(docs: DataFrame, p: Sharding = Sharding(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, group hash g and ordinal o of each row; the only pass over the texts.

    The ordinal is fixed once the rows are settled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + p.overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.lit(1)).alias("g"),
        F.monotonically_increasing_id().alias("o"),
    )


def assign_slots(rows: DataFrame, p: Sharding = Sharding(), whole: float | None = None) -> DataFrame:
    """settled rows with their virtual slot v and part of it."""
    share = (p.whole[0] if whole is None else whole) / p.shards
    limits = F.broadcast(rows.agg((F.sum("size") * share).alias("most_bytes"), (F.count("*") * share).alias("most_rows")))
    over = (F.col("b") > F.col("most_bytes")) | (F.col("n") > F.col("most_rows"))
    # At most 2 * shards / whole groups can exceed a limit on bytes or on rows, and as many ids inside groups.
    groups = rows.groupBy("g").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where("n > 1")
    hot = F.broadcast(groups.join(limits, over).select("g", F.lit(True).alias("hot")))
    same = rows.join(hot.select("g"), "g", "left_semi").groupBy("g", "doc_id").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where("n > 1")
    hot_ids = F.broadcast(same.join(limits, over).select(F.col("g").alias("g2"), F.col("doc_id").alias("id2"), F.lit(True).alias("hot_id")))
    marked = rows.join(hot, "g", "left").join(hot_ids, (F.col("g") == F.col("g2")) & F.col("doc_id").eqNullSafe(F.col("id2")), "left")
    own = F.when(F.col("hot_id"), F.xxhash64("o", F.lit(3))).otherwise(F.xxhash64("doc_id", F.lit(2)))
    return marked.select(
        *rows.columns,
        F.pmod(F.when(F.col("hot"), own).otherwise(F.col("g")), F.lit(p.slots)).cast("int").alias("v"),
        F.pmod(F.xxhash64(own, F.lit(4)), F.lit(p.parts)).cast("int").alias("part"),
    )


def slot_totals(rows: DataFrame, p: Sharding = Sharding()) -> DataFrame:
    """(v, bytes, n) of all slots, those without rows included."""
    totals = rows.groupBy("v").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = rows.sparkSession.range(0, p.slots, 1, 1).select(F.col("id").cast("int").alias("v"))
    return every.join(totals, "v", "left").select("v", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"))


def _dealt(slots: DataFrame, loads: str, shards: int) -> DataFrame:
    """(v, shard, bytes, n) of slots (v, bytes, n), dealt to shards whose loads are an expression over m.

    One fold in one row, bounded by the fixed number of slots.
    """
    listed = slots.where("bytes > 0").groupBy("m").agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "v", "bytes", "n"))).alias("s"))
    fold = f"""
      aggregate(s, named_struct('load', {loads}, 'to', CAST(array() AS array<int>)),
        (a, x) -> transform(array(array_position(a.load, array_min(a.load)) - 1), k ->
          named_struct('load', transform(a.load, (y, i) -> y + IF(i = k, x.bytes, 0L)), 'to', concat(a.to, array(CAST(k AS int)))))[0])
    """
    heavy = listed.select("s", F.expr(f"({fold}).to").alias("to")).select(F.explode(F.arrays_zip("s", "to")).alias("z"))
    return heavy.select(F.col("z.s.v").alias("v"), F.col("z.to").alias("shard"), F.col("z.s.bytes").alias("bytes"), F.col("z.s.n").alias("n")).unionByName(
        slots.where("bytes = 0").select("v", F.pmod("v", F.lit(shards)).cast("int").alias("shard"), "bytes", "n")
    )


def deal(totals: DataFrame, p: Sharding = Sharding()) -> DataFrame:
    """(v, shard, bytes, n, version): the first version of the slot map."""
    return _dealt(totals.withColumn("m", F.lit(0)), f"array_repeat(0L, {p.shards})", p.shards).withColumn("version", F.lit(1))


def rebalance(slot_map: DataFrame, shards: int, p: Sharding = Sharding()) -> DataFrame:
    """The next version of a slot map for another number of shards, with new totals in its columns.

    Slots leave shards that no longer exist, and shards above their mean with slack, smallest slots first;
    all others keep their shard. What has left is dealt to the lightest shards, largest first.
    """
    mean = slot_map.agg(F.sum("bytes") / shards).first()[0] or 0.0
    by_shard = Window.partitionBy("shard").orderBy(F.desc("bytes"), "v").rowsBetween(Window.unboundedPreceding, 0)
    marked = slot_map.withColumn("upto", F.sum("bytes").over(by_shard))
    old = (slot_map.agg(F.max("shard")).first()[0] or 0) + 1
    # Slots without bytes weigh nothing: of them, new shards get their part of the round.
    fits = F.when(F.col("bytes") > 0, F.col("upto") <= mean * (1 + p.slack)).otherwise(F.pmod("v", F.lit(shards)) < old)
    stays = (F.col("shard") < shards) & fits
    kept = marked.where(stays).select("v", "shard", "bytes", "n")
    loads = kept.groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("m0"))
    # A map is no key of a group; as an array of loads it is one.
    wide = loads.select(F.expr(f"transform(sequence(0, {shards - 1}), i -> CAST(coalesce(m0[i], 0L) AS bigint))").alias("m"))
    moved = marked.where(~stays).select("v", "bytes", "n").crossJoin(F.broadcast(wide))
    version = (slot_map.agg(F.max("version")).first()[0] or 0) + 1
    return kept.unionByName(_dealt(moved, "m", shards)).withColumn("version", F.lit(version))


def write_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version of the map to a folder; a version that is there is replaced."""
    for row in slot_map.select("version").distinct().collect():
        slot_map.where(F.col("version") == row["version"]).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={row['version']}")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of the map in a folder, the last one by default."""
    every = spark.read.parquet(folder)
    wanted = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == wanted)


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows (with v and part) with shard and place in the shard, by any version of the map that has all slots."""
    to = slot_map.select("v", "shard")
    counts = rows.groupBy("v", "part").agg(F.count("*").alias("k"))
    before = Window.partitionBy("shard").orderBy("v", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.join(F.broadcast(to), "v").select("v", "part", "shard", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("v", "part").orderBy("doc_id", "g", "o"))
    # At most slots * parts rows.
    return rows.withColumn("r", inside).join(F.broadcast(firsts), ["v", "part"]).withColumn("slot", (F.col("first") + F.col("r") - 1).cast("long")).drop("r", "first")


def _spread(slot_map: DataFrame, p: Sharding) -> float:
    """How far the heaviest and the lightest shard are apart, in parts of the mean."""
    loads = slot_map.groupBy("shard").agg(F.sum("bytes").alias("b"))
    row = loads.agg(F.max("b"), F.min("b"), F.count("*"), F.sum("b")).first()
    if not row[3]:
        return 0.0
    return (row[0] - (row[1] if row[2] == p.shards else 0)) * p.shards / row[3]


def fitted(rows: DataFrame, p: Sharding = Sharding()) -> tuple[DataFrame, DataFrame]:
    """Settled rows with slots, and the slot map, for the largest part ``whole`` that gives even shards."""
    best = None
    for whole in p.whole:
        slotted = settle(assign_slots(rows, p, whole))
        slot_map = settle(deal(slot_totals(slotted, p), p))
        apart = _spread(slot_map, p)
        if best is None or apart < best[0]:
            best = (apart, slotted, slot_map)
        if apart <= p.even:
            break
    return best[1], best[2]


def shard(docs: DataFrame, p: Sharding = Sharding(), id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and virtual_slot of each row of docs.

    The slot map is written to ``folder`` (a new one in the shared folder by default) and read from there.
    """
    spark = docs.sparkSession
    rows, slot_map = fitted(settle(records(docs, p, id_col, text_col)), p)
    folder = folder or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    write_map(slot_map, folder)
    return placed(rows, read_map(spark, folder)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("v").alias("virtual_slot"),
    )
