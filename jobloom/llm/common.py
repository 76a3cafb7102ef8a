"""What the corpus operators share: shared storage, and the text of a row."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: For ``bytes.translate``: only A-Z change.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The column's text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors reach.

    It lies in ``spark.checkpoint.dir``. Where that is unset on one machine, as in tests, it
    lies in a temporary folder, which the session then also uses for checkpoints; a
    cluster without that setting is an error, as its executors share no temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="jobloom-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/jobloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again.

    Cuts the lineage: lost executors cost no recomputation of what came before. The table
    stays until ``discard``, or until the shared folder is cleared.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more: what was made from them is stored itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_values(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner", parts: int = 1 << 15) -> DataFrame:
    """``rows`` joined with ``table``, which has each ``key`` once and in ``weight`` how many rows have it.

    Keys with more than one in ``parts`` of all these rows are at most ``parts``: their entries go to all tasks,
    and their rows stay where they are. All others are joined by a shuffle, in which no
    key stands out. ``table`` is read more than once, so it should be a stored one.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) > F.lit(total // parts)
    few = F.broadcast(table.where(hot).drop(weight))
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(table.where(~hot).drop(weight), key, how))


def among(rows: DataFrame, keys: DataFrame, key: str, bits: int, also: Column | None = None) -> DataFrame:
    """``rows`` whose ``key`` (a long) may be one of ``keys``, and those of which ``also`` holds; few others, unless the keys are very many.

    Keys set bits of a set of ``bits`` bits, whatever their number; its words of 64 bits that aren't zero, at most
    bits / 64, go to all tasks. So what has no partner isn't shuffled; a join decides on what is left.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    word, place = F.shiftright(F.col("bit"), 6), F.col("bit").bitwiseAND(F.lit(63)).cast("int")
    words = keys.select(bit.alias("bit")).groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("set"))
    tested = rows.withColumn("bit", bit).withColumn("word", word).join(F.broadcast(words), "word", "inner" if also is None else "left")
    found = F.coalesce(F.getbit("set", place) == 1, F.lit(False))
    return tested.where(found if also is None else found | also).drop("bit", "word", "set")
