import pytest
from pyspark.sql import functions as F

from linkweave.operators import blocking
from linkweave.sources import files
from linkweave.streaming import ingest


def test_tsv_records(spark, tmp_path):
    path = tmp_path / "s1.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-a\t"Say ""Hi"" Ltd"\t\tFrance\nS1-b\t"two\nlines"\tx\t\n', encoding="utf-8")
    rows = files.read_records(spark, str(path)).orderBy("entity_id").collect()
    assert rows[0].business_name == 'Say "Hi" Ltd' and rows[0].business_address == "" and rows[0].source == "S1"
    assert rows[1].business_name == "two\nlines" and rows[1].country == ""
    path.write_text("entity_id\tname\tbusiness_address\tcountry\na\tb\tc\td\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_records(spark, str(path)).collect()


def test_truth_and_results(spark, tmp_path):
    path = tmp_path / "truth.tsv"
    path.write_text("source1_entity_id\tmatched_entity_ids\nS1-a\tS2-a,S3-b\nS1-b\t\n")
    truth = files.read_truth(spark, str(path), spark.createDataFrame([("S1-a",)], "q string"))
    assert sorted(r.t for r in truth.collect()) == ["S2-a", "S3-b"]
    with pytest.raises(ValueError):
        files.read_truth(spark, str(path), spark.createDataFrame([("S1-z",)], "q string"))
    lists = spark.createDataFrame([("S1-b", ""), ("S1-a", "S2-a")], "q string, matches string").coalesce(1)
    files.write_results(lists, "matches", "matched_entity_ids", str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines()[0] == "source1_entity_id\tmatched_entity_ids"
    assert "S1-a\tS2-a" in text and "S1-b\t\n" in text


def test_fingerprints_and_stages(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.txt").write_text("abc")
    assert files.digests(spark, str(tmp_path / "f")).first().sha256.startswith("ba7816bf")
    inputs = files.fingerprint(spark, str(tmp_path / "f"))
    first = files.write_stage(spark.range(3), str(tmp_path / "stage"), inputs)
    again = files.write_stage(spark.range(9), str(tmp_path / "stage"), inputs)
    assert first.count() == again.count() == 3
    with pytest.raises(ValueError):
        files.write_stage(spark.range(3), str(tmp_path / "stage"), inputs.withColumn("length", F.col("length") + 1))


def test_stream_equals_batch(spark, tmp_path):
    schema = "entity_id string, business_name string, business_address string, country string"
    targets = spark.createDataFrame([("S2-a", "Acme Pumps", "1 Long Road", "X"), ("S3-b", "Other", "2 Way", "X")], schema)
    refs = spark.createDataFrame([("S1-a", "Acme Pumps", "1 Long Road", "X")], schema)
    keys = blocking.base_keys()
    ingest.build_postings(targets, keys, 100, str(tmp_path / "post"))
    refs.write.parquet(str(tmp_path / "in"))
    ingest.link_stream(spark, str(tmp_path / "in"), str(tmp_path / "post"), str(tmp_path / "out"), str(tmp_path / "cp"), keys).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).select("q", "t").collect()
    assert [tuple(r) for r in got] == [("S1-a", "S2-a")]
