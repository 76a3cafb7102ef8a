"""Keys that a third of all rows have."""

import numpy as np
from pyspark.sql import functions as F

from jobloom.llm import decontaminate, ppm, token_files


def test_all_frequent_codes_find_a_place():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 40, 300_000))
    rng.shuffle(codes)
    values = rng.random(len(codes)).astype(np.float32)
    table = ppm.Frequent(codes, values)
    asked = np.concatenate([codes[:1000], rng.integers(1 << 41, 1 << 42, 1000), codes[-1000:]])
    got, missing = table.find(asked)
    assert missing.tolist() == list(range(1000, 2000))
    assert np.array_equal(got[:1000], values[:1000]) and np.array_equal(got[2000:], values[-1000:]) and not got[1000:2000].any()
    got, missing = ppm.Frequent(np.empty(0, np.int64), np.empty(0, np.float32)).find(codes[:5])
    assert not got.any() and missing.tolist() == list(range(5))


def test_a_window_that_very_many_documents_hold(spark):
    words = "these thirteen words of every form stand at the top of each page".split()
    assert len(words) == 13
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(" ".join(words))).otherwise(F.concat(F.lit("other words "), F.col("id").cast("string"))).alias("text"))
    items = spark.createDataFrame([(n, " ".join(words)) for n in range(40)] + [(99, "x y z")], "item_id long, text string")
    found = {r["doc_id"]: (r["n_hit"], len(r["items"])) for r in decontaminate.hits(docs, items).collect()}
    assert len(found) == 600 and all(found[i] == ((13, 40) if i % 3 == 0 else (0, 0)) for i in range(600))


def test_ids_that_very_many_rows_share(spark, tmp_path):
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(5).cast("long")).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") * 7919 % 1000).cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    try:
        token_files.write_ids(docs, str(tmp_path / "ids"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert len(got) == 900 and [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in docs.collect()))
    assert [r["doc_id"] for r in got] == [d if there else None for there, d, _ in rows]
    spread = spark.read.parquet(str(tmp_path / "ids")).where(F.array_contains("doc_ids", 5)).select("shard").distinct().count()
    assert spread > 1
    codec = token_files.encoder(token_files.default_path())
    assert [bytes(r["ids"]) for r in got[:400]] == [np.append(codec.texts([t])[0], 0).astype("<u4").tobytes() for _, _, t in rows[:400]]
