import glob
import os
import random
import time

import pytest
from compare import SF, canon, connect
from fixtures import ROWS, documents, near, prose

from linkweave.llm.near_dedup import NearDedup, components, deduplicated, near_duplicates
from linkweave.llm.sql_near_dedup import SQL
from linkweave.llm.support import settle, table


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\x0b", " ").replace("\x0c", " ")
    for c in "\t\n\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=4, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = doc if not sets[i] else min(ids, default=None)
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


def check(spark, rows, p=NearDedup()):
    got = sorted([tuple(r) for r in near_duplicates(documents(spark, rows), p).collect()], key=str)
    assert got == brute(rows, p.words, p.percent)


def test_awkward_rows(spark):
    check(spark, ROWS)


@pytest.mark.parametrize(("pivots", "block"), [(0, 7), (2, 512)])
def test_chains_and_borderline_families(spark, pivots, block):
    """Families of copies whose mutual similarity lies around the limit, and chains of small changes."""
    rnd = random.Random(5)
    rows, base = [], prose(11, 90)
    for i in range(70):
        text = base
        for _ in range(rnd.randint(1, 4)):
            text = near(text, rnd.randrange(88)).replace("changed", f"x{rnd.randrange(10**6)}")
        rows.append((i, text))
    chain = prose(12, 60)
    for i in range(12):
        rows.append((100 + i, chain))
        chain = near(chain, 5 * i).replace("changed", f"c{i}")
    check(spark, rows, NearDedup(pivots=pivots, block=block, hot=20))


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in components(edges).collect()}
    assert {got[bytes([i])] for i in range(41)} == {b"\x00"} and got[b"\xf1"] == b"\xf0"


def test_equals_sql(spark):
    con = connect(SF)
    assert canon(near_duplicates(table(spark, SF, "documents")).toPandas()) == canon(con.sql(SQL).df())


@pytest.mark.parametrize("same", [None, 5])
def test_many_rows_without_an_id_or_of_one(spark, same):
    """Rows of one id don't meet each other: three thousand of them take no longer than others."""
    rows = [(same, prose(500 + i // 2, 40)) for i in range(3000)] + [(9, near(prose(500, 40), 3))]
    got = near_duplicates(documents(spark, rows)).collect()
    nine = 5 if same else 9  # a near copy of the first two
    assert len(got) == len(rows) and all(r.component_id == (nine if r.doc_id == 9 else same) or r.component_id == nine for r in got)
    assert sum(r.component_id == nine for r in got) == (len(rows) if same else 3)


def files_of(spark):
    """The shuffle files that the session's disk holds, and the folders of its checkpoints."""
    sc = spark.sparkContext
    local = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = {f for d in local for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    folder = sc._jsc.sc().getCheckpointDir()
    return shuffled, set(glob.glob(folder.get().removeprefix("file:") + "/rdd-*")) if folder.isDefined() else set()


def test_what_is_settled_leaves_no_shuffle_files(spark):
    before, _ = files_of(spark)
    frame = settle(spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count())
    for _ in range(50):  # executors delete them a moment later
        left = files_of(spark)[0] - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and frame.count() == 7
    assert frame.groupBy("count").count().count() == 2
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_frames_that_nothing_reads_go(spark):
    """Of the frames that are settled on the way, rows, names and each turn's components stay."""
    _, before = files_of(spark)
    out = near_duplicates(documents(spark, [(i, near(prose(i // 4, 60), i % 4)) for i in range(40)]))
    assert len(files_of(spark)[1] - before) <= 4
    assert out.where("kept").count() == 10


def test_kept_rows_need_no_signatures(spark):
    """What goes and what repeats stays settled, and each turn's components."""
    _, before = files_of(spark)
    out = deduplicated(documents(spark, [(i, near(prose(i // 4, 60), i % 4)) for i in range(40)] + [(0, near(prose(0, 60), 0))]))
    assert len(files_of(spark)[1] - before) <= 4
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 40, 4))


def test_a_pass_of_components_makes_few_shuffles(spark):
    """A star that is one already needs its distinct edges and its ends, and no pass."""
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    edges = settle(spark.createDataFrame([(bytes([i + 1]), b"\x00") for i in range(20)], "a binary, b binary"))
    before = jobs()
    assert components(edges).where("root = X'00'").count() == 21
    assert jobs() - before <= 8
