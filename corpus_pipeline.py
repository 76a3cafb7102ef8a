"""The corpus pipeline over ``documents``: language, copies, near copies, benchmarks, packing.

Each stage takes all that its predecessor kept, stored as Parquet; all but the last return the
columns of ``documents``. Null and empty texts are dropped by the first stage, as their
language is undetermined; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import decontaminate, exact_dedup, language, near_dedup, packing
from jobloom.llm.common import documents, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; learns from the labelled ones that aren't held out.

    Null texts and those without a letter go, and those whose score is under half of what texts of a known language have in training;
    where nothing can be learned, all with a letter stay. Repeated rows stay or go together.
    """
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return language.drop_rejected(docs, held_out)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the one with the smallest id, and all rows that share that id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id, and all rows that share it.

    Two words a shingle, as the contract of the MinHash operator has it, whose stage this is.
    """
    return near_dedup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a twentieth or more of their words shares with the benchmark; those without words stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; a null text is one end token, repeated rows are packed each."""
    return packing.pack(docs, capacity=2048, end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The first stage's network and the last stage's tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result stored and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
