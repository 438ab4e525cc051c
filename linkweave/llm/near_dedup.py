"""MinHash near-duplicate groups by a signature-coordinate inverted join.

Every class of equal shingle sets is posted under its (coordinate, value) pairs. Two classes whose
similarity reaches the limit agree on at least ``threshold`` of ``coordinates`` values but for a
chance of about 1e-5 at the limit itself, so they share a posting among the ``coordinates -
threshold + 1`` rarest of each (prefix). Collisions are counted from the signatures of pairs that
met in a prefix posting (skip), and what stays is confirmed on the full shingle sets.

Each class also has a parity sketch: bit i tells whether an odd number of its shingles falls into cell
i. Two sets differ in at least as many shingles as their sketches differ in bits, so pairs whose
sketches differ too much are left out inside the join, and no link is lost by that.

Inside a posting all members are first compared with one pivot. Links found so are contracted to
components, and only members of different components are compared after that, so a group of copies
costs a star and not all its pairs. A large posting is then cut into blocks, and each two blocks meet
under a key of their own, so no task holds a whole posting.

Rows are told apart by id and two hashes of the text, so ids may be missing or repeat: full sets are read
again by all three, and neither rows without an id nor rows of one id meet each other.

Defined cases: null or wordless text has an empty set and is linked with nothing; a text of fewer
words than a shingle is one shingle; rows that repeat an id are each returned; a null id is never
the smallest of a component that has other ids, and a component of null ids alone has component_id
null and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm import hashing
from linkweave.llm.support import settle, small_batches, text_slices, thrifty, unsettle


@dataclass(frozen=True)
class NearDedup:
    """words: of a shingle; percent: least similarity; cells: bits of the parity sketch, a multiple of
    64; pivots: star rounds before all remaining pairs of a posting between components are compared;
    block: classes of a large posting that meet those of another block under one key; hot: a class of over
    one in so many rows is hot; broadcast_rows: most dropped rows that are broadcast, 40 MB."""

    words: int = 4
    percent: int = 80
    coordinates: int = 40
    threshold: int = 20
    cells: int = 1024
    pivots: int = 1
    block: int = 8192
    hot: int = 1000
    broadcast_rows: int = 400_000

    @property
    def prefix(self) -> int:
        return self.coordinates - self.threshold + 1


def _families(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(0xD0C5)
    return rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    for first, to, buffer, offsets in text_slices(column):
        h, start, _ = hashing.words(buffer, offsets)
        at = np.searchsorted(start, offsets)
        for i in range(to - first):
            yield hashing.shingle_set(h[at[i] : at[i + 1]], words)


def _class_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set: two sums over differently mixed members, and its size mixed in."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(shingles))
        a = hashing.mix(hashing.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + n)
        b = hashing.mix(hashing.mix(shingles + np.uint64(0x1234567890ABCDEF)).sum(dtype=np.uint64) ^ (n << np.uint64(32)))
    return a.tobytes() + b.tobytes()


def _parity(shingles: np.ndarray, cells: int) -> np.ndarray:
    odd = np.bincount((shingles >> np.uint64(17)).astype(np.int64) % cells, minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, h1 and h2: two hashes of the text that tell rows of one id apart."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))


def signatures(docs: DataFrame, p: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h1, h2, n_shingles, class, sig, parity) of each row; the last three are null for empty sets."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = _families(p.coordinates)
        for batch in batches:
            sizes, keys, sigs, odds = [], [], [], []
            for s in _sets(batch.column(1), p.words):
                sizes.append(len(s))
                if not len(s):
                    keys.append(None)
                    sigs.append(None)
                    odds.append(None)
                    continue
                keys.append(_class_key(s))
                sig = np.full(p.coordinates, 2**64 - 1, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for lo in range(0, len(s), 4096):
                        part = s[lo : lo + 4096, None] * mult + add
                        part ^= part >> np.uint64(29)
                        part *= np.uint64(0xBF58476D1CE4E5B9)
                        np.minimum(sig, (part >> np.uint64(32)).min(axis=0), out=sig)
                sigs.append(sig.astype(np.uint32).view(np.int32))
                odds.append(_parity(s, p.cells))
            made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array(odds, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *made], ["id", "h1", "h2", "n_shingles", "class", "sig", "parity"])

    small_batches(docs.sparkSession)
    return _hashed(docs, id_col, text_col).mapInArrow(thrifty(run), f"id {kind}, h1 long, h2 long, n_shingles long, class binary, sig array<int>, parity array<long>")


def _same_row(names: tuple[str, str, str]):
    """That the row (id, h1, h2) is the one of these columns; a null id equals a null id."""
    i, a, b = names
    return F.col("id").eqNullSafe(F.col(i)) & (F.col("h1") == F.col(a)) & (F.col("h2") == F.col(b))


def _full_sets(docs: DataFrame, wanted: DataFrame, p: NearDedup, id_col: str, text_col: str) -> DataFrame:
    """(class, shingles) of the wanted (class, one) rows, read again from the texts."""
    ones = wanted.select("class", F.col("one.id").alias("i1"), F.col("one.h1").alias("a1"), F.col("one.h2").alias("b1"))
    found = _hashed(docs, id_col, text_col).join(ones, _same_row(("i1", "a1", "b1"))).select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = [(k, s.view(np.int64)) for k, s in zip(keys, _sets(batch.column(1), p.words), strict=True) if len(s) and _class_key(s) == k]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.list_(pa.int64()))], ["class", "shingles"]
            )

    # Rows that repeat with their id and text yield one class several times.
    return found.mapInArrow(thrifty(run), "class binary, shingles array<long>").dropDuplicates(["class"])


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, p: NearDedup) -> DataFrame:
    """The pairs (a, b) of classes that collide often enough and whose full sets are similar enough."""
    c = classes.select("class", "sig")
    counted = (
        pairs.join(c.select(F.col("class").alias("a"), F.col("sig").alias("sa")), "a")
        .join(c.select(F.col("class").alias("b"), F.col("sig").alias("sb")), "b")
        .where(F.expr(f"aggregate(zip_with(sa, sb, (x, y) -> IF(x = y, 1, 0)), 0, (n, x) -> n + x) >= {p.threshold}"))
        .select("a", "b")
    )
    both = F.size(F.array_intersect("x", "y"))
    return settle(
        counted.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
        .where(both * 100 >= p.percent * (F.size("x") + F.size("y") - both))
        .select("a", "b")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of (a, b) edges; root is the smallest node of its component.

    Alternating large and small stars; each pass halves what is left of a component's depth, and a
    pass is two grouped minima and joins, so no neighbourhood is ever collected. An edge's a is the
    greater node, and no step makes more edges than it gets. A settled frame goes when the next is there.
    """
    e = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = e.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        ends = settle(both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")))
        # At the end every node but a root has one edge, and to a root.
        if ends.where("low < a AND low <> high").isEmpty():
            unsettle(e)
            return ends.select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        least = ends.select(F.col("a"), F.least("a", "low").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        new = settle(small.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).where("a <> b").distinct())
        unsettle(e)
        unsettle(ends)
        e = new


def _mixed(postings: DataFrame, root: DataFrame | None) -> DataFrame:
    """The postings of keys whose classes are in several components.

    head is the key's pivot: the class that shares most coordinates with others, as an original does with
    its changed copies, and of several the greatest.
    """
    now = postings.drop("head", "members")
    if root is not None:
        now = now.drop("root").join(root.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    ends = now.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max(F.struct("shared", "class")).alias("head"), F.count("*").alias("members"))
    ends = ends.withColumn("head", F.col("head.class"))
    return settle(now.join(ends.where("r0 <> r1").drop("r0", "r1"), "key"))


def _linked(docs: DataFrame, p: NearDedup, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signatures of docs, and (class, own, copies, root, rep): each class's smallest id and rows, its component and that one's smallest id."""
    rows = settle(signatures(docs, p, id_col, text_col))
    classes = settle(
        rows.where("class IS NOT NULL")
        .groupBy("class")
        .agg(
            F.min("id").alias("rep"), F.min(F.struct("h1", "h2", "id")).alias("one"), F.count("*").alias("copies"),
            F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("parity").alias("parity"),
        )
    )
    posted = classes.select("class", F.posexplode("sig").alias("at", "value")).select("class", F.expr("shiftleft(bigint(at), 32) | (bigint(value) & 4294967295L)").alias("key"))
    counts = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(counts, "key").select("class", "key", "n")
    # A class has at most one posting for each coordinate, so these lists are short.
    lists = shared.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("l"))
    # What no other class has is rarest of all and takes the first places of the prefix.
    firsts = settle(
        lists.select("class", F.size("l").alias("shared"), F.expr(f"transform(slice(l, 1, greatest(0, {p.prefix} - ({p.coordinates} - size(l)))), x -> x.key)").alias("keys"))
    )
    prefix = firsts.select("class", "shared", F.explode("keys").alias("key"))
    met_by = prefix.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    open_ = settle(prefix.join(met_by, "key").select("key", "class", "shared"))
    wanted = open_.select("class").distinct().join(classes, "class").select("class", "one")
    sets = settle(_full_sets(docs, wanted, p, id_col, text_col))

    now = open_.join(classes.select("class", "n", "parity"), "class").withColumn("root", F.col("class"))

    links: list[DataFrame] = []
    tried: list[DataFrame] = []
    root = None
    last = open_
    for turn in range(p.pivots + 1):
        now = _mixed(now, root)
        unsettle(last)
        last = now
        if now.isEmpty():
            break
        other = now.select(F.col("key").alias("key2"), F.col("class").alias("b"), F.col("root").alias("r2"), F.col("n").alias("n2"), F.col("parity").alias("p2"), F.col("head").alias("head2"), "members")
        differ = reduce(lambda x, y: x + y, [F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("p2")[i])) for i in range(p.cells // 64)])
        near = differ * (100 + p.percent) <= (F.col("n") + F.col("n2")) * (100 - p.percent)
        met = [F.col("key") == F.col("key2"), F.col("root") != F.col("r2"), near]
        if turn < p.pivots:
            pairs = now.join(other.where("b = head2").drop("members"), met)
            left = now.where("class <> head")
        else:
            # A pair is taken under its least common key alone. If that key's pivot was one of the pair, it has
            # been compared there before and is not under the key any more.
            blocks = F.ceil(F.col("members") / p.block).cast("int")
            own = now.join(firsts.select("class", "keys"), "class").withColumn("i", F.pmod(F.xxhash64("class"), blocks).cast("int"))
            # Block i meets itself and every later block j.
            own = own.withColumn("j", F.explode(F.sequence("i", blocks - 1)))
            theirs = other.join(firsts.select(F.col("class").alias("b"), F.col("keys").alias("k2")), "b").withColumn("j2", F.pmod(F.xxhash64("b"), blocks).cast("int"))
            theirs = theirs.withColumn("i2", F.explode(F.sequence(F.lit(0), "j2"))).drop("members")
            once = (F.col("i") < F.col("j")) | (F.col("class") < F.col("b"))
            least_common = F.array_min(F.array_intersect("keys", "k2")) == F.col("key")
            pairs = own.join(theirs, [met[0], F.col("i") == F.col("i2"), F.col("j") == F.col("j2"), *met[1:], once, least_common])
            left = now.limit(0)
        pairs = pairs.select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b")).distinct()
        if tried:
            pairs = pairs.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
        pairs = settle(pairs)
        tried.append(pairs)
        got = _confirmed(pairs, classes, sets, p)
        if not got.isEmpty():
            links.append(got)
            root = components(reduce(DataFrame.union, links))
        now = left

    named = classes.select("class", F.col("rep").alias("own"), "copies", F.col("class").alias("root"), "rep")
    if root is not None:
        moved = named.drop("root", "rep").join(root.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        named = moved.join(moved.groupBy("root").agg(F.min("own").alias("rep")), "root").select("class", "own", "copies", "root", "rep")
    named = settle(named)
    for done in (classes, firsts, sets, last, *tried, *links):
        unsettle(done)
    return rows, named


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (see the module's cases)."""
    rows, named = _linked(docs, p, id_col, text_col)
    mine = rows.where("class IS NOT NULL").select("id", "n_shingles", "class")
    # At most ``hot`` classes have more than that part of the rows; theirs are joined where they are.
    total = rows.agg(F.count("*").alias("total"))
    hot = F.broadcast(named.join(F.broadcast(total), F.col("copies") * p.hot > F.col("total")).select("class", "rep"))
    component = {
        "alone": rows.where("class IS NULL").select("id", "n_shingles", F.col("id").alias("rep")),
        "hot": mine.join(hot, "class").select("id", "n_shingles", "rep"),
        "others": mine.join(hot, "class", "left_anti").join(named.select("class", "rep"), "class").select("id", "n_shingles", "rep"),
    }
    return reduce(DataFrame.union, component.values()).select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("rep").alias("component_id"),
        F.col("id").eqNullSafe(F.col("rep")).alias("kept"),
    )


def deduplicated(docs: DataFrame, p: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each component, and every row whose text has an empty set.

    The row has the component's smallest id; of several classes under that id it is of the smallest key, of
    several texts of that class it has the smallest hash, and of rows that repeat both any one stays. Ids
    need not be unique or known.
    """
    rows, named = _linked(docs, p, id_col, text_col)
    sets = rows.where("class IS NOT NULL").select("id", "h1", "h2", "class")
    first = named.where(F.col("own").eqNullSafe(F.col("rep"))).groupBy("root").agg(F.min("class").alias("c1"), F.first("rep").alias("i1")).drop("root")
    texts = sets.join(first, (F.col("class") == F.col("c1")) & F.col("id").eqNullSafe(F.col("i1"))).groupBy("c1", "i1", "h1", "h2").agg(F.count("*").alias("n"))
    kept = texts.groupBy("c1", "i1").agg(F.min(F.struct("h1", "h2", "n")).alias("k")).select("i1", F.col("k.h1").alias("a1"), F.col("k.h2").alias("b1"), F.col("k.n").alias("n"))
    kept = settle(kept)
    goes = sets.select("id", "h1", "h2").distinct().join(kept.where("n = 1"), _same_row(("i1", "a1", "b1")), "left_anti")
    goes = settle(goes.select(F.col("id").alias("i1"), F.col("h1").alias("a1"), F.col("h2").alias("b1")))
    unsettle(rows)
    unsettle(named)
    text = F.col(text_col)
    marked = docs.select(*docs.columns, F.col(id_col).alias("__i"), F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(7), text).alias("__b"))
    same = lambda i, a, b: F.col("__i").eqNullSafe(F.col(i)) & (F.col("__a") == F.col(a)) & (F.col("__b") == F.col(b))
    gone = goes.select(F.col("i1").alias("__i1"), F.col("a1").alias("__a1"), F.col("b1").alias("__b1"))
    out = marked.join(F.broadcast(gone) if gone.count() <= p.broadcast_rows else gone, same("__i1", "__a1", "__b1"), "left_anti").select(docs.columns)
    repeated = kept.where("n > 1").select(F.col("i1").alias("__i1"), F.col("a1").alias("__a1"), F.col("b1").alias("__b1"))
    if repeated.isEmpty():
        return out
    # Rows of one id and text: an aggregate, as they may be a large part of all rows.
    one = marked.join(repeated, same("__i1", "__a1", "__b1")).groupBy("__i1", "__a1", "__b1").agg(F.first(F.struct(*docs.columns)).alias("__row"))
    return out.unionByName(one.select("__row.*"))
