"""Exact percentiles of groups of any size, by selecting ranks over histograms of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.sources.storage import stored

#: Bins that a range of values is cut to, and parts that a group's values are dealt to when they meet its ranges.
BINS, SALT = 1024, 32


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """For each group its percentiles of ``value``, interpolated between neighbours: keys, and a double for each name of ``shares``. Nulls count for nothing; NaN isn't a value.

    Values are counted first, so that equal ones are one row. Each wanted rank starts with its group's whole range, which is cut into bins; bins' counts,
    summed in order over at most ``bins`` rows, tell which bin has the rank, and its least and greatest value are the next range, until they are equal. So one pass over the
    range that is left follows another, a thousandth of it each; no task ever holds a group's values, and a group that has most of the rows is spread over all tasks.
    """
    number = F.col(value).cast("double")
    counts = stored(rows.select(*keys, number.alias("v")).where("v IS NOT NULL AND NOT isnan(v)").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")))
    groups = stored(counts.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total")))
    named = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
    place = F.col("share") * (F.col("total") - 1)
    asked = groups.select(*keys, "total", "low", "high", F.explode(named).alias("name", "share")).withColumn("place", place)
    both = F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank")
    # one row for each rank of a group: the range it lies in, and how many rows are below that
    open_ = stored(asked.select(*keys, "low", "high", both).distinct().withColumn("below", F.lit(0).cast("long")))
    same = lambda a, b, names: [a[c].eqNullSafe(b[f"_{c}"]) for c in names]
    done = open_.where("low = high")
    open_ = open_.where("low <> high")
    while not open_.isEmpty():
        ranges = open_.select(*keys, "low", "high", "below").distinct()
        salted = ranges.select(*(F.col(c).alias(f"_{c}") for c in keys), "low", "high", "below", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
        dealt = counts.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
        match = F.lit(True)
        for c in same(dealt, salted, keys):
            match = match & c
        inside = dealt.join(salted, match & (F.col("salt") == F.col("_salt"))).where("v >= low AND v <= high")
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves: the difference of two doubles may be none
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")
        per = inside.groupBy(*keys, "low", "high", "below", bin_).agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        order = Window.partitionBy(*keys, "low", "high", "below").orderBy("bin")
        summed = per.withColumn("upto", F.col("below") + F.sum("n").over(order)).withColumn("start", F.col("upto") - F.col("n"))
        cells = summed.select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("low").alias("_low"), F.col("high").alias("_high"), "least", "most", "start", "upto")
        match = (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("upto"))
        for c in same(open_, cells, [*keys, "low", "high"]):
            match = match & c
        after = stored(open_.join(cells, match).select(*keys, F.col("least").alias("low"), F.col("most").alias("high"), "rank", F.col("start").alias("below")))
        done = done.unionByName(after.where("low = high"))
        open_ = after.where("low <> high")
    found = done.select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("rank"), F.col("low").alias("value"))
    wanted = asked.withColumn("_group", F.lit(True))
    match = F.lit(True)
    for c in same(wanted, found, keys):
        match = match & c
    near = wanted.join(found, match & ((F.col("rank") == F.floor("place")) | (F.col("rank") == F.ceil("place"))))
    ends = near.groupBy(*keys, "name").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.first(F.col("place") - F.floor("place")).alias("part"))
    each = ends.withColumn("value", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")))
    return each.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares))
