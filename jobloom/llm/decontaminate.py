"""Benchmark decontamination by a hash set of normalised test n-grams, in Spark SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import among, lower_ascii, stored, text_of, with_values

#: Words of lower-cased text: all but ASCII controls, white space, punctuation and capitals.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the hash set of windows that goes to all tasks: 8 MB, whatever the benchmark.
SET_BITS = 1 << 26


def words_of(text: Column) -> Column:
    """The words of a text after lower-casing A-Z."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def hash_of(hashes: Column) -> Column:
    """The 64-bit hash of a window, given the hashes of its words."""
    return F.xxhash64(hashes)


def hashes_of(words: Column) -> Column:
    """The hash of each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def test_windows(benchmark: DataFrame, size: int = 13, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each distinct window of the items: its words joined, how many, its hash, and the items that have it.

    A window is ``size`` consecutive words; an item of fewer, but not none, is one window.
    """
    words = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(text_of(text_col)).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(size))
    each = words.select("item", n.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))).alias("w"))
    return each.groupBy(F.concat_ws(" ", "w").alias("window"), "len").agg(F.collect_set("item").alias("items"), F.first(hash_of(hashes_of(F.col("w")))).alias("hash"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", set_bits: int = SET_BITS) -> DataFrame:
    """Which words of each document lie inside an occurrence of a test window.

    The windows' 64-bit hashes go to the tasks as a hash set of ``set_bits`` bits, of whatever size the
    benchmark is. Only document windows in it are shuffled, to be verified by their words; the
    documents themselves are in no join. The more windows, the more others pass the set; none is lost.

    Returns one row per document row: id, n_words, n_hit, items (sorted), spans of words
    ((start, len), sorted), contaminated (n_hit > 0 and at least a twentieth of the words).
    Null text has no words and so no hits; a null item id names no item; an empty benchmark
    hits nothing; a null document id is kept; repeated rows give a row each. Other columns are ignored.
    """
    windows = stored(test_windows(benchmark, size))
    lengths = sorted((r[0] for r in windows.select("len").distinct().collect()), reverse=True)  # at most `size`
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = texts.select("id", F.md5("text").alias("key"), words_of(F.col("text")).alias("words")).withColumn("hashes", hashes_of(F.col("words")))

    def of_length(n: int) -> Column:
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), hash_of(F.slice("hashes", i + 1, n)).alias("hash")))

    #: one such entry a row, so that each document comes through and repeated rows can be told
    itself = F.array(F.lit(None).cast("struct<start:int,len:int,hash:bigint>"))
    each = rows.select("id", "key", "words", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(itself, *map(of_length, lengths))).alias("w")).select("id", "key", "words", "n_words", "w.*")
    passed = among(each, windows.select("hash"), "hash", set_bits, also=F.col("len").isNull())
    table = stored(passed.select("id", "key", "n_words", "start", "len", "hash", F.when(F.col("len").isNotNull(), F.concat_ws(" ", F.slice("words", F.col("start") + 1, F.col("len")))).alias("window")))

    # windows by how many document windows have their words: those that very many have are sent to all tasks
    seen = table.where("len is not null").groupBy("window").agg(F.count(F.lit(1)).alias("times"))
    named = stored(windows.select("window", "items").join(seen, "window"))
    sure = with_values(table.where("len is not null"), named, "window", "times").select("id", "key", "n_words", "start", "len", "items")
    itself = table.where("len is null").select("id", "key", "n_words", "start", "len", F.lit(None).cast("array<string>").alias("items"))
    found = sure.unionByName(itself).groupBy("id", "key", "n_words").agg(
        F.count_if(F.col("len").isNull()).alias("rows"),
        F.array_sort(F.collect_set(F.when(F.col("len").isNotNull(), F.struct("start", "len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["start"] + s["len"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["upto"], s["start"]))).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    counted = found.withColumn("n_hit", covered).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return counted.select(F.col("id").alias(id_col), "key", "n_words", "n_hit", "items", "spans", "contaminated", F.explode(F.expr("array_repeat(0, cast(rows as int))")).alias("_")).drop("_")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, those without words being none; all columns are returned.

    Of rows that share an id, those go whose own text is contaminated; repeated rows go or stay together.
    """
    gone = hits(docs, benchmark, size, id_col, text_col).where("contaminated").select(F.col(id_col).alias("gone"), "key")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone"]) & (F.md5(text_of(text_col)) == gone["key"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of test windows cut out of their texts; what lies between words stays.

    All columns and rows are returned, repeated ones and those with a null id too; null text stays null. Rows that share an id are cut by their own texts' spans.
    """
    found = hits(docs, benchmark, size, id_col, text_col).where("n_hit > 0").select(F.col(id_col).alias("__id"), F.col("key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__key"])
    word = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")  # of text as it is
    joined = docs.join(found, docs[id_col].eqNullSafe(found["__id"]) & (F.md5(text_of(text_col)) == found["__key"]), "left")
    hit = lambda i: F.exists("__spans", lambda s: (s["start"] <= i) & (i < s["start"] + s["len"]))
    words = F.regexp_extract_all(F.col(text_col), F.lit(word), F.lit(0))
    gaps = F.split(F.col(text_col), word, -1)
    rest = F.transform(F.arrays_zip(gaps.alias("gap"), words.alias("word")), lambda x, i: F.concat(x["gap"], F.when(x["word"].isNull() | hit(i), F.lit("")).otherwise(x["word"])))
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.array_join(rest, ""))).select(*docs.columns)
