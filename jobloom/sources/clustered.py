"""Rows laid out in the order of their pages, so that a page far down opens a few files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.predicates import before_cursor, check_page

#: Rows a slice, at about. At this size an index of a million slices is a table of 10^12 rows.
SLICE_ROWS = 1 << 20


def write(rows: DataFrame, path: str, slice_rows: int = SLICE_ROWS) -> None:
    """Writes rows (created_at, id and others) newest first in slices of about ``slice_rows``, each a folder, and an index of the slices' ranges.

    Rows without a time come first, as on a page. The index is a table of one row a slice.
    """
    n = -(-rows.count() // slice_rows)
    order = (F.desc_nulls_first("created_at"), F.desc("id"))
    ranged = rows.repartitionByRange(max(1, n), *order).withColumn("slice", F.spark_partition_id())
    ranged.sortWithinPartitions("slice", *order).write.partitionBy("slice").parquet(f"{path}/rows")
    key = F.struct("created_at", "id")
    kept = rows.sparkSession.read.schema(ranged.schema).parquet(f"{path}/rows")
    least = F.min(F.struct(F.col("created_at").isNull().alias("none"), "created_at", "id"))
    kept.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), least.alias("least"), F.max(key).alias("most"), F.count_if(F.col("created_at").isNull()).alias("without")).coalesce(1).write.parquet(f"{path}/index")


def page(spark: SparkSession, path: str, condition: Column | None = None, after: tuple[str, int] | None = None, limit: int = 100) -> DataFrame:
    """The ``limit`` rows next to a cursor (created_at, id), newest first, that meet a condition.

    The index tells which slices lie after the cursor. One is read, then twice as many as before while rows are missing; only these slices' folders are opened, at any depth.
    """
    check_page(limit)
    rows = spark.read.parquet(f"{path}/rows")
    seen = rows.where(before_cursor(*after) if after else F.lit(True)).where(F.lit(True) if condition is None else condition)
    index = spark.read.parquet(f"{path}/index")
    if after:
        index = index.where(~F.col("least.none") & (F.struct("least.created_at", "least.id") < F.struct(F.lit(after[0]).cast("timestamp_ntz").alias("created_at"), F.lit(after[1]).cast("long").alias("id"))))
    found, last, take = [], -1, 1
    while len(found) < limit:
        slices = [r[0] for r in index.where(F.col("slice") > last).orderBy("slice").limit(take).select("slice").collect()]
        if not slices:
            break
        part = seen.where(F.col("slice").isin(slices)).drop("slice").orderBy(F.desc_nulls_first("created_at"), F.desc("id"))
        found += part.limit(limit - len(found)).collect()  # a page's rows at most
        last, take = slices[-1], 2 * take
    return spark.createDataFrame(found, rows.drop("slice").schema)
