"""The registered queries of the corpus operators, and DuckDB SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import decontaminate, exact_dedup, html_text, language, lexical, licenses, near_dedup, packing, periodic, ppm, secrets, token_files, vectors
from jobloom.llm.common import documents, shared_dir


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, each in one piece of one sequence of up to 2048."""
    return packing.pack(documents(spark, sf_dir), capacity=2048, end_id=1)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base secrets by kind, their digest, and all spans, for each document."""
    found = secrets.scan(documents(spark, sf_dir))
    joined = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _remainder(by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % by


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, learned from those that aren't held out."""
    return language.identify(documents(spark, sf_dir), held_out=_remainder(4) == 2)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores of each document, by a model of those that aren't held out."""
    return ppm.score(documents(spark, sf_dir), held_out=_remainder(10) == 0, order=5)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of near copies on two-word shingles at 0.8."""
    return near_dedup.near_groups(documents(spark, sf_dir), size=2, percent=80)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a benchmark item's 13 words, and which items these are."""
    found = decontaminate.hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of equal texts."""
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences of each document, and the licences whose rules they fulfil."""
    return licenses.scan(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written as planes in ascending doc_id order and read back: where each document's lie, and their checksum."""
    path = f"{shared_dir(spark)}/ids"
    token_files.write_ids(documents(spark, sf_dir), path, end_id=0)
    return token_files.read_ids(spark, path, with_ids=False)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def tiled(text: bytes, h: int) -> list[bytes]:
    """The words of a text; where h is divisible by ten, those from a place on repeat a first few of them."""
    words = text.split()
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of runs, its longest run, and digests of all runs and of the text without repeats."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    found = periodic.periodic_runs(documents(spark, sf_dir), key=crc, words_of=tiled)
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    start, period = (-F.col("first")["col2"], -F.col("first")["col3"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("first", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), F.col("first")["length"].alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * F.col("first")["length"] / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest others found for every twentieth vector."""
    return vectors.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), asks=F.col("vec_id") % 20 == 0, k=20)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return lexical.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


def _licenses_sql() -> str:
    """SQL for op8: identifiers by position, joined to a sequence, from which each rule in turn takes its matches."""
    ids, rules = licenses.known()
    text = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({text(s)}, {text(i)})" for s, i in ids.items())
    single = ", ".join(f"({text(s)}, {text(next(name for name, rule in rules if rule == f' {i} '))})" for s, i in ids.items() if any(rule == f" {i} " for _, rule in rules))
    steps = "SELECT r, seq, [] :: VARCHAR[] AS hits FROM seqs"
    for name, rule in rules:
        steps = f"SELECT r, replace(seq, {text(rule)}, ' | ') AS seq, CASE WHEN contains(seq, {text(rule)}) THEN list_append(hits, {text(name)}) ELSE hits END AS hits FROM ({steps})"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    unnumbered = f"regexp_replace(t, {text(licenses.NUMBERS)}, '\\1', 'g')"

    def plain(part: str) -> str:
        part = f"trim(regexp_replace({part}, {text(licenses.BETWEEN)}, ' ', 'g'))"
        for pattern, by in licenses.SLOTS:
            part = f"regexp_replace({part}, {text(pattern)}, {text(by)}, 'g')"
        return part

    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {lower} AS t FROM documents), telling AS (SELECT r FROM d WHERE {" OR ".join(f"contains(lower(text), {text(w)})" for w in licenses.telling_words(list(ids)))}),
        known(s, id) AS (VALUES {known}), single(s, licence) AS (VALUES {single}),
        parts AS (SELECT r, unnest(regexp_split_to_array({unnumbered}, {text(licenses.CUT)})) AS part, generate_subscripts(regexp_split_to_array({unnumbered}, {text(licenses.CUT)}), 1) AS place FROM d JOIN telling USING (r)),
        found AS (SELECT r, place, id, place - coalesce(lag(place) OVER (PARTITION BY r ORDER BY place), 0) - 1 AS others FROM parts JOIN known ON known.s = {plain("part")}),
        seqs AS (SELECT r, ' ' || string_agg(CASE WHEN others > {licenses.MOST_BETWEEN} THEN '| ' ELSE '' END || id || ' ', '' ORDER BY place) AS seq FROM found GROUP BY r),
        named AS (SELECT r, count(*) AS n, string_agg(id, ' ' ORDER BY place) AS ids FROM found GROUP BY r),
        matched AS ({steps}),
        notices AS (SELECT r, list(licence) AS own FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d JOIN telling USING (r)) JOIN single ON single.s = {plain("line")} GROUP BY r),
        joined AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, list_sort(list_distinct(list_concat(coalesce(hits, []), coalesce(own, [])))) AS licences
            FROM d LEFT JOIN named USING (r) LEFT JOIN matched USING (r) LEFT JOIN notices USING (r))
        SELECT doc_id, n_sentences, sentence_ids, CAST(len(licences) AS BIGINT) AS n_licenses, array_to_string(licences, ',') AS licenses FROM joined
    """


QUERIES = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_language": op3_language,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_minhash": op5_minhash,
    "op6_decontamination": op6_decontamination,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_licenses": op8_licenses,
    "op9_token_files": op9_token_files,
    "op10_html": op10_html,
    "op11_periodic": op11_periodic,
    "op12_neighbours": op12_neighbours,
    "op13_lexical": op13_lexical,
}

ORACLE_SQL = {
    "op6_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), win AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS t
            FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
        ), size AS (
            SELECT DISTINCT n FROM win
        ), pos AS (
            SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size WHERE len(w) >= n
        ), hit AS (
            SELECT p.doc_id, p.i, p.n, win.item_id
            FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM pos) p JOIN win ON win.n = p.n AND win.t = p.t
        ), cover AS (
            SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id
        ), item AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(cover.n_hit, 0) AS n_hit, coalesce(item.n_items, 0) AS n_items,
               sha256(coalesce(item.s, '')) AS items_sha256,
               coalesce(cover.n_hit, 0) > 0 AND 20 * coalesce(cover.n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN item USING (doc_id)
    """,
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
               sha256(norm) AS text_sha256
        FROM t
    """,
    "op8_licenses": _licenses_sql(),
    "op13_lexical": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
        ), q AS (
            SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark
        ), size AS (
            SELECT count(*) FILTER (WHERE len(t) > 0) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d
        ), term AS (
            SELECT i, t, count(*) AS times FROM (SELECT i, unnest(t) AS t FROM q) GROUP BY i, t
        ), posting AS (
            SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM term) GROUP BY r, t
        ), weight AS (
            SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM posting, size GROUP BY t, n
        ), score AS (
            SELECT i, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.t) * n) // l)))) AS BIGINT) AS score
            FROM posting JOIN weight USING (t) JOIN term USING (t) JOIN d USING (r), size GROUP BY i, r
        ), ranked AS (
            SELECT i, r, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS rank FROM score JOIN d USING (r) WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN q USING (i) JOIN d USING (r) WHERE rank <= 20
    """,
}
