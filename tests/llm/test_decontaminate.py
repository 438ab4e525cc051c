import hashlib
import random
import re

from compare import SF, canon, connect
from fixtures import ROWS, documents

from linkweave.llm.decontaminate import Automaton, Decontam, contamination, decontaminated, item_words, scan_text
from linkweave.llm.sql_decontaminate import SQL
from linkweave.llm.support import table


def split(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(text, items, window=10):
    w, hit, found = split(text), set(), set()
    for name, item in items:
        v = split(item)
        n = min(window, len(v))
        for i in range(len(v) - n + 1):
            for j in range(len(w) - n + 1) if n else ():
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    found |= {name} - {None}
    return len(w), sorted(hit), sorted(found)


def test_automaton_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(150):
        word = lambda: rnd.choice("abcd")
        items = [(str(k), " ".join(word() for _ in range(rnd.randint(0, 9)))) for k in range(4)]
        text = " ".join(rnd.choice("abcde") for _ in range(40))
        automaton = Automaton.build([item_words(t) for _, t in items], 4)
        n, hit, found = scan_text(text.encode(), automaton)
        assert (n, hit.tolist(), sorted(items[x][0] for x in found)) == brute(text, items, 4)


ITEMS = [(1, "Alpha beta Gamma delta"), (2, None), (3, ""), (20, ROWS[0][1][:200]), (3, "wörter Straße"), (None, "one two"), (20, ROWS[0][1][:200])]


def test_awkward_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = []
    names = [(None if i is None else str(i), t) for i, t in ITEMS]
    for doc, text in ROWS:
        n, hit, found = brute(text, names)
        want.append((doc, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    for words in (400_000, 3):  # one block, and a block for each item
        got = [tuple(r) for r in contamination(documents(spark), items, Decontam(block_words=words)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(documents(spark, []), items).count() == 0
    assert not any(r.contaminated for r in contamination(documents(spark), items.limit(0)).collect())


def test_spans_are_cut_and_columns_stay(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = documents(spark, [(1, f"Before, {passage}; after it " + "z " * 30), (2, passage), (3, None), (4, "clean")])
    out = decontaminated(docs, items)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == {1, 3, 4} and rows[1].text.startswith("Before, ; after it") and rows[4].hit == 7 and rows[3].text is None


def test_equals_sql(spark):
    con = connect(SF)
    assert canon(contamination(table(spark, SF, "documents"), table(spark, SF, "benchmark")).toPandas()) == canon(con.sql(SQL).df())
