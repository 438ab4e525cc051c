import hypothesis.strategies as st
from hypothesis import given, settings
from pyspark.sql import functions as F

from linkweave.constants import PHONETIC_LEGAL
from linkweave.functions import phonetic, text

RECORD = "entity_id string, business_name string, business_address string, country string"


def records(spark, *rows):
    return spark.createDataFrame([(f"S1-{i}", *r) for i, r in enumerate(rows)], RECORD)


def test_norm(spark):
    values = ["École & Co.", "123 Main Street", "Straße ½ ﬁ", "", "A_b  C", "यूनाइटेड", "Ｆｕｌｌ ² width"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(text.norm(F.col("s"))).collect()]
    assert got == [text.norm_string(v) for v in values]
    assert got[0] == "ecole and co" and got[1] == "123 main st"


def test_native_fold_equals_the_string_fold(spark):
    values = [chr(c) for c in range(0x20, 0x250)] + ["é", "İstanbul"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert [r[0] for r in df.select(text.fold(F.col("s"), native_only=True)).collect()] == [text.fold_string(v) for v in values]


def test_prepared_falls_back_to_legal_words(spark):
    r = text.prepared(records(spark, ("Ltd", "d301 Main Road 301 44", "X"), ("Acme Corp", "", "X"))).orderBy("entity_id").collect()
    assert r[0].nt == ["ltd"] and r[0].nums == ["301", "44"] and r[0].at == ["301", "44", "d301", "main", "rd"]
    assert r[1].nt == ["acme"] and r[1].at == []


def test_legal_punctuation_and_decoration(spark):
    rows = text.extended(text.prepared(records(spark, ("Acme LLC", "", "X"), ("Acme L.L.C.", "", "X"), ("Mr. www.acme.com 1234567", "", "X")))).orderBy("entity_id").collect()
    assert [r.compact for r in rows] == ["acme"] * 3
    assert rows[0].acronym == "a" and not rows[0].nonascii


def test_phonetics(spark):
    rows = phonetic.forms(records(spark, ("Royal Energy", "", "X"), ("United Consultants Private Limited", "", "India"), ("यूनाइटेड कंसल्टेंट्स प्राइवेट लिमिटेड", "", "India"))).orderBy("entity_id").collect()
    assert "rl" in rows[0].pt
    assert rows[1].pc == rows[2].pc != ""
    assert phonetic.romanize_string("Société") == "societe"
    assert "candra" not in phonetic.romanize_string("फॉर्चून")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="acehkpqstvwxyz", min_size=1, max_size=12), min_size=1, max_size=20))
def test_phonetic_columns_equal_strings(spark, words):
    df = spark.createDataFrame([(w,) for w in words + PHONETIC_LEGAL], "w string")
    assert [r[0] for r in df.select(phonetic.phonetic_word(F.col("w"))).collect()] == [phonetic.phonetic_string(w) for w in words + PHONETIC_LEGAL]


def test_ordered_numbers(spark):
    df = spark.createDataFrame([("1040 grove ct unit 104b 12",)], "s string")
    assert df.select(phonetic.ordered_numbers(F.col("s"))).first()[0] == ["1040", "104b", "12"]


def test_words_text_is_the_joined_tokens(spark):
    texts = ["  Plain, ASCII  text-1 ", "Straße ÆON été", "नमस्ते दुनिया 12", "", "--", None, "áb İstanbul ß", "x\ty\nz_w"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select(text.words_text(F.col("s")).alias("x"), F.array_join(text.tokens(text.fold(F.col("s"), native_only=True)), " ").alias("y")).collect()
    assert [r.x for r in rows] == [r.y for r in rows]
