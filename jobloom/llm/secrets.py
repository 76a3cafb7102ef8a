"""Secret scans in Spark SQL functions alone: patterns, and a battery of randomness tests.

Patterns give the base spans. The method adds spans of kind ``random``: of each long token an
encoding is inferred (decimal, hex, base32, base64), and three tests ask whether its symbols
could be drawn evenly from that encoding's alphabet: chi-squared uniformity, runs about the
middle, lag-1 serial correlation. The three p-values give one (Bonferroni). Discoveries are secrets, and the
share of ordinary strings among them is held down within each class of length and encoding, over all tokens of the corpus: random strings have
p-values spread as the tests' law has it, ordinary ones gather near 0. From those over a half the number of random strings follows, so
from any bound how many over it are not; claimed are all p-values down to the least bound at which these are at most a given share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import stored, text_of

#: The kinds in their order, and their patterns with the least length of a group.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: Tokens for the randomness tests.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: (encoding, what its strings are made of, its symbols in the order of their values)
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64url", r"^[A-Za-z0-9_-]*[_-][A-Za-z0-9_-]*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("both", r"[+/].*[_-]|[_-].*[+/]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
    ("base64", r"^", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: What must stand shortly before a decimal number that is to be a secret: such numbers are random in most texts anyway.
CONTEXT = r"(?i)(?:key|secret|token|passw|passphrase|credential|auth)[^\n]{0,16}$"
SPAN = "array<struct<start:int,rank:int,end:int>>"
BINS_AN_OCTAVE = 8
#: Bins of p-values over a half, and the last one of p-values that may be claimed at all (0.001).
HALF, LAST = BINS_AN_OCTAVE - 1, 79


def located(text: Column, pattern: str, rank: int, also: Column | None = None) -> Column:
    """Spans of all matches of ``pattern``, in code points: what ``split`` leaves lies between them.

    ``also`` is an array with a flag for each match; where it is false, the match is dropped.
    """
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.arrays_zip(gaps.alias("gap"), lengths.alias("len"), *([also.alias("use")] if also is not None else []))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["len"]
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        use = x["len"].isNotNull() if also is None else x["len"].isNotNull() & x["use"]
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(use, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    return F.aggregate(parts, start, add, lambda s: s["found"])


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start and then kind."""
    none = F.array().cast(SPAN)
    long = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8)
    found = (
        F.when(text.rlike(ASSIGN), located(text, ASSIGN, 0, long)).otherwise(none),
        F.when(text.contains("AKIA"), located(text, r"AKIA[A-Z0-9]{12,}", 1)).otherwise(none),
        F.when(text.rlike(HEX), located(text, HEX, 2)).otherwise(none),
    )
    return F.array_sort(F.concat(*found))


def _beyond(z: Column) -> Column:
    """The chance of a standard normal value over ``z`` (Abramowitz and Stegun 26.2.17)."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _values(token: Column) -> Column:
    """The alphabet's size and the values of the token's symbols, for the encoding it seems to have."""
    bare = F.regexp_replace(token, "=+$", "")
    chosen = None
    for _, made_of, symbols in ENCODINGS:
        own = F.struct(F.lit(len(symbols)).alias("k"), F.transform(F.split(bare, ""), lambda c: F.greatest(F.lit(0), F.instr(F.lit(symbols), c) - 1)).alias("v"))
        chosen = F.when(bare.rlike(made_of), own) if chosen is None else chosen.when(bare.rlike(made_of), own)
    return chosen


def _tests(x: Column) -> Column:
    """The p-value of a token (k, v) under randomness, by the three tests together."""
    k, v, size = x["k"], x["v"], F.size(x["v"])
    n = size.cast("double")
    squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, d: a + F.pow(F.size(F.filter(v, lambda y: y == d)), F.lit(2)))
    chi = (k / n * squares - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
    high = F.transform(v, lambda y: F.when(2 * y >= k, 1).otherwise(0))
    n1 = F.aggregate(high, F.lit(0), lambda a, b: a + b)
    changes = F.aggregate(F.zip_with(F.slice(high, 2, size), F.slice(high, 1, size - 1), lambda a, b: F.abs(a - b)), F.lit(0), lambda a, b: a + b)
    cross = 2.0 * n1 * (n - n1)
    spread = F.sqrt(F.greatest(F.lit(1e-9), cross * (cross - n) / (n * n * (n - 1.0))))
    runs = F.when(n1.between(1, n - 1), (changes - cross / n) / spread).otherwise(F.lit(37.0))
    mean = (k - 1) / 2.0
    lagged = F.aggregate(F.zip_with(F.slice(v, 2, size), F.slice(v, 1, size - 1), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, b: a + b)
    serial = lagged / (F.sqrt(n - 1.0) * (k * k - 1.0) / 12)
    least = F.least(_beyond(chi), 2 * _beyond(F.abs(runs)), 2 * _beyond(F.abs(serial)))
    return F.greatest(F.lit(1e-300), F.least(F.lit(1.0), 3 * least))


def share_over(bin_: Column) -> Column:
    """The part of random strings whose p-value lies in this bin or one of more: three times the least of three even values, cut at 1."""
    return F.pow(1 - F.pow(F.lit(2.0), -(bin_ + 1) / BINS_AN_OCTAVE) / 3, F.lit(3))


def limits(counts: DataFrame, alpha: float) -> DataFrame:
    """(class, bin): the last bin of each class whose p-values are claimed, from counts (class, bin, count).

    ``alpha``: the share of ordinary strings among a class's claims, as the mixture of both has it. Where none lies over a half, a
    single string over ``LAST`` is claimed, as nothing speaks against it.
    """
    down = Window.partitionBy("class").orderBy("bin")
    whole = Window.partitionBy("class")
    random = F.sum(F.when(F.col("bin") <= HALF, F.col("count")).otherwise(0)).over(whole)
    number = random / share_over(F.lit(HALF))
    over = F.sum("count").over(down)
    good = (F.col("bin") <= HALF) | (over - number * share_over(F.col("bin")) <= alpha * over) | ((random == 0) & (over == 1))
    return counts.withColumn("good", good & (F.col("bin") <= LAST)).where("good").groupBy("class").agg(F.max("bin").alias("bin"))


def scan(docs: DataFrame, alpha: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All secret spans of each document.

    Returns one row per document row: id, base and spans: arrays of (start, kind, end), in
    code points, end exclusive, by start and then kind. ``base`` has the patterns' spans,
    ``spans`` also those of kind ``random`` that lie in no base span. Null text is empty and
    has none; repeated rows give a row each; a null id is kept. Other columns are ignored.

    The corpus is scanned once, and what was found is stored in the shared folder. The false-discovery control
    needs only counts of p-values by class of length and bin: a table of bounded size.
    """
    found = _spans(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), alpha)
    return found.select(F.col("id").alias(id_col), "base", "spans")


def _spans(docs: DataFrame, alpha: float) -> DataFrame:
    """base and spans of each row (id, text), and md5 of its text."""
    base = docs.select("id", "text")
    text = F.col("text")
    none = F.array().cast(SPAN)
    located_once = base.select("id", "text", base_spans(text).alias("base"), F.when(text.rlike(TOKEN), located(text, TOKEN, 3)).otherwise(none).alias("tokens"))
    free = located_once.withColumn("tokens", F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"]))))
    told = lambda t: ~F.substring(text, t["start"] + 1, t["end"] - t["start"]).rlike("^[0-9]+$") | F.substring(text, F.greatest(F.lit(1), t["start"] - 31), F.least(t["start"], F.lit(32))).rlike(CONTEXT)
    free = free.withColumn("tokens", F.filter("tokens", told))
    valued = free.select("id", F.md5("text").alias("md5"), "base", F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _values(F.substring("text", t["start"] + 1, t["end"] - t["start"])).alias("x"))).alias("tokens"))
    kind = lambda t: F.floor(F.log2(F.size(t["x"]["v"]))).cast("int") * 128 + t["x"]["k"]
    tested = valued.select("id", "md5", "base", F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), kind(t).alias("class"), _bin(_tests(t["x"])).alias("bin"))).alias("tokens"))
    table = stored(tested)

    counts = table.select(F.explode("tokens").alias("t")).groupBy(F.col("t.class").alias("class"), F.col("t.bin").alias("bin")).count()
    limit = {r[0]: r[1] for r in limits(counts, alpha).collect()}  # a row for each class: an encoding and a doubling of length, of which a text of 2^31 characters has 31
    passed = F.filter("tokens", lambda t: F.coalesce(t["bin"] <= F.element_at(F.create_map(*(F.lit(x) for pair in limit.items() for x in pair)), t["class"]), F.lit(False)) if limit else F.lit(False))
    random = F.transform(passed, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end")))
    named = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind"), s["end"].alias("end")))
    return table.select("id", "md5", named(F.col("base")).alias("base"), named(F.array_sort(F.concat("base", random))).alias("spans"))


def _bin(p: Column) -> Column:
    """The bin of a p-value: 0 for 1, more for less."""
    return F.floor(-F.log2(p) * BINS_AN_OCTAVE).cast("int")


def redact(docs: DataFrame, mask: str = "*", alpha: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text of each document row, each character of a secret replaced by ``mask``. Null text stays null.

    Spans belong to an id and a text: rows that share an id and differ in text are masked by their own spans alone.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.md5(text_col).alias("md5"))
    found = _spans(keyed.where("text IS NOT NULL"), alpha).where(F.size("spans") > 0).select(F.col("id").alias("hit"), F.col("md5").alias("of"), "spans").dropDuplicates(["hit", "of"])
    joined = keyed.join(found, keyed["id"].eqNullSafe(found["hit"]) & (keyed["md5"] == found["of"]), "left")
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"])), F.repeat(F.lit(mask), F.greatest(F.lit(0), s["end"] - F.greatest(a["at"], s["start"])))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    return joined.select(F.col("id").alias(id_col), F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut).alias(text_col))
