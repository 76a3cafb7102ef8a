"""Connected components of a graph as Spark joins: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import discard, stored, with_values


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each end of ``links`` (a, b); the component is its smallest node.

    A large star links each larger neighbour of a node to the smallest of its neighbourhood,
    a small star the smaller ones; repeated until nothing changes, every component is a
    star about its smallest node. Neighbourhoods are only ever reduced to their minimum, so a
    node of any degree is safe. Links of a node to itself and nulls are ignored; no links
    give an empty result.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(ordered.where(links["a"].isNotNull() & links["b"].isNotNull() & (F.col("a") > F.col("b"))).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"), F.count(F.lit(1)).alias("degree")))
        large = stored(with_values(both.where("b > a"), least, "a", "degree").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        small = stored(large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("degree")))
        hung = with_values(large, small, "a", "degree").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = stored(hung.unionByName(small.select("a", F.col("low").alias("b"))).distinct())
        discard(now, least, large, small)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple[int, int]:
    """How many links, and a sum of their hashes, by which two sets of links are told apart."""
    row = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], row[1]
