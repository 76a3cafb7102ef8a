"""Every operator over documents, and the pipeline, on a table without rows and on one of nothing but nulls."""

import pytest
from pyspark.sql import functions as F

from jobloom.llm import decontaminate, exact_dedup, language, lexical, licenses, near_dedup, packing, periodic, ppm, secrets, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def items(spark):
    return spark.createDataFrame([(1, "some words of a benchmark item")], "item_id long, text string")


OPERATORS = {
    "packing": lambda spark, docs, path: packing.pack(docs, capacity=64, end_id=1),
    "secrets": lambda spark, docs, path: secrets.scan(docs),
    "redact": lambda spark, docs, path: secrets.redact(docs),
    "language": lambda spark, docs, path: language.identify(docs, F.lit(False)),
    "scoring": lambda spark, docs, path: ppm.score(docs, F.lit(False), order=5),
    "near": lambda spark, docs, path: near_dedup.near_groups(docs),
    "contamination": lambda spark, docs, path: decontaminate.hits(docs, items(spark)),
    "exact": lambda spark, docs, path: exact_dedup.exact_groups(docs),
    "licenses": lambda spark, docs, path: licenses.scan(docs),
    "periodic": lambda spark, docs, path: periodic.periodic_runs(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_without_rows_and_with_nulls(spark, tmp_path, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert OPERATORS[name](spark, empty, str(tmp_path)).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, SCHEMA)
    assert OPERATORS[name](spark, nulls, str(tmp_path)).count() == 2


def test_search_and_files(spark, tmp_path):
    empty, nulls = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(None, None, None, None, None)] * 2, SCHEMA)
    assert lexical.rank_documents(empty, items(spark)).collect() == [] and lexical.rank_documents(nulls, items(spark)).collect() == []
    for name, docs, n in (("a", empty, 0), ("b", nulls, 2)):
        token_files.write_ids(docs, str(tmp_path / name))
        assert token_files.read_ids(spark, str(tmp_path / name)).count() == n


def test_pipeline_without_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
