"""Intermediate tables in the folder that a session's executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: As many rows are sent to all tasks at most.
FEW = 100_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset on one machine, under a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="jobloom-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join to which both sides come by their keys, so that neither is collected in the driver to be sent to all tasks.

    Spark tells a table's size by its files', and those of ids and repeated names are a hundredth of what their rows are in memory: tables that it would take for
    small ones fill a driver. For joins of two sides that both grow with the ledger.
    """
    return df.hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written there and read again, so that nothing before it is computed twice."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(table: DataFrame) -> DataFrame:
    """A stored table as a side of joins: its rows, not the size of its files, tell whether all tasks may have it."""
    return by_key(table) if table.count() > FEW else table
