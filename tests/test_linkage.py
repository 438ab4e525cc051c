from compare import SF
from pyspark.sql import functions as F

from linkweave.operators import cascade
from linkweave.plans import linkage
from linkweave.sources import adapters


def test_whole_cascade(spark, tmp_path):
    """Train and predict on one small table: lists are complete, matches are candidates, most truth is found."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    settle = lambda df: df.checkpoint()
    records = adapters.documents(spark, SF).where("country IN ('fr', 'de')")
    left, right = records.where("source = 'S1'"), records.where("source <> 'S1'")
    truth = adapters.truth(spark, SF).join(left.select(F.col("entity_id").alias("q")), "q", "left_semi")
    s = linkage.Settings(pool=20, trees=3, depth=2)
    models = linkage.train(left, right, truth, s, settle)
    assert len(models.first_names) == 120 and len(models.second_names) == 154
    lists = linkage.predict(left, right, models, s, settle).cache()
    assert lists.count() == left.count()
    split = lambda c: set(filter(None, c.split(",")))
    assert all(split(r.matches) <= split(r.candidates) for r in lists.collect())
    report = linkage.evaluate(left.select(F.col("entity_id").alias("q")), truth, lists).first()
    assert report.entities == left.count() and report.macro_f05 > 0.5
    assert cascade.output_stats(lists).first().entities == left.count()
