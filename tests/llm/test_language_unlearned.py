"""The language stage where no language can be learned."""

from pyspark.sql import functions as F

from jobloom.llm import language


def test_texts_stay_when_nothing_is_learned(spark):
    rows = [(1, "clean text", None), (2, None, None), (3, "1 2 !", None), (4, "漢字", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for frame, held_out in ((docs, F.lit(False)), (docs.withColumn("lang", F.lit("en")), F.lit(True))):
        kept = language.drop_rejected(frame, held_out)
        assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {1, 4}
