"""Exact deduplication by a 128-bit content hash, with the bytes compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import SPACE, text_of


def normalised(text: Column) -> Column:
    """``text`` with each run of white space replaced by one space."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


def content_hash(text: Column) -> Column:
    """The 128-bit content hash."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Every row of ``docs`` with its group of equal texts.

    Rows are grouped by the content hash *and* the normalised text itself, so that Spark's
    aggregation compares the bytes of texts whose hashes are equal: a collision gives two
    groups. Equal texts are combined in each map task before the shuffle, so a group of any
    size costs one row per map task. Groups are joined back by the hash and the SHA-256 that
    is returned anyway, never by the text; Spark may split a hot hash, as the join is a plain one.

    Returns id, keep_id, group_size, kept, text_sha256, one row per input row. Null text is
    empty. A null id never wins over another one; rows that share an id and a text are all
    kept or dropped alike. An empty table gives an empty result; other columns are ignored.
    """
    norm = docs.select(F.col(id_col).alias("id"), normalised(text_of(text_col)).alias("norm"))
    groups = (
        norm.withColumn("h", hash_of(F.col("norm")))
        .groupBy("h", "norm")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
    )
    rows = norm.select("id", hash_of(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("sha"))
    return rows.join(groups, ["h", "sha"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies: of equal texts, the row with the smallest id stays.

    All columns are returned. Rows that share an id are one document here.
    """
    keep = exact_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("kept_id"))
    return docs.join(keep, docs[id_col].eqNullSafe(keep["kept_id"]), "left_semi")
