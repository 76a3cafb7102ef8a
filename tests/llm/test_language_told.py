"""The language stage keeps texts whose language the network can tell."""

import random

from pyspark.sql import functions as F

from jobloom.llm import language

ALPHABETS = {"aa": "abcdef ", "bb": "mnopqr ", "cc": "uvwxyz "}


def test_texts_of_no_language_go(spark):
    rng = random.Random(8)
    prose = lambda lang, n: "".join(rng.choice(ALPHABETS[lang]) for _ in range(n))
    rows = [(i, prose(lang, 200), lang) for i, lang in enumerate(list(ALPHABETS) * 60)]
    mixed = "".join(prose(lang, 640) for lang in ALPHABETS)
    rows += [(1000, mixed, None), (1001, mixed, "aa"), (1002, prose("bb", 6400) + prose("cc", 640), None), (1003, "1 2", "aa"), (1004, None, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("__held_out", F.lit("clash"))
    held_out = F.col("doc_id") >= 1000
    kept = language.drop_rejected(docs, held_out)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(180), 1002}
    assert {r["doc_id"] for r in language.drop_rejected(docs, held_out, least=0.0).collect()} == {*range(180), 1000, 1001, 1002}
    network = language.train(docs.where(~held_out))[1]
    scores = {r["doc_id"]: r["score"] for r in language.identify(docs, held_out).collect()}
    assert network.typical > 0.7 and {i for i, s in scores.items() if s >= 0.5 * network.typical} == {*range(180), 1002}
