"""A ledger as bucketed tables: what belongs to one job lies in one bucket, so that joins by job need no exchange."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.sources.storage import shared_path

#: The column that has a row's job.
JOB = {"job_queue": "id", "job_attempts": "job_id", "job_events": "job_id", "job_logs": "job_id", "job_dead_letters": "job_id"}


def write_keyed(ledger: Mapping[str, DataFrame], spark: SparkSession, database: str, buckets: int = 64, path: str | None = None) -> None:
    """Writes the ledger's tables that belong to jobs as tables of ``database``, dealt to buckets by job; in a new shared folder unless ``path`` names one.

    A bucket is one file, whose rows are in the order of their jobs. All tables have the same buckets, so their number should suit the largest.
    """
    path = path or shared_path(spark, "keyed")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{path}'")
    for name, key in JOB.items():
        ledger[name].repartition(buckets, F.col(key)).write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{name}").mode("overwrite").format("parquet").saveAsTable(f"{database}.{name}")


def read_keyed(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The tables of ``write_keyed``."""
    return {name: spark.table(f"{database}.{name}") for name in JOB}


def forget_keyed(spark: SparkSession, database: str) -> None:
    """Drops the database and its tables' entries; files stay until the shared folder is cleared."""
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
