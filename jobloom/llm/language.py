"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from jobloom.llm.gru import PAD, Network

#: Bytes that the network reads at a time.
WINDOW = 64
#: The bounded sample that it is trained on: windows of a language, of all languages, and of a document.
SAMPLE = 6000
WHOLE_SAMPLE = 600_000
OF_A_DOCUMENT = 8
UNDETERMINED = "und"
#: The part of the probability that right languages had in training, that ``drop_rejected`` asks for.
TOLD = 0.5


def windows(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All texts cut into windows (time, window), filled with PAD, and how many windows each has."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // width)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) * width
    flat = np.full(int(counts.sum()) * width, PAD, np.uint16)
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = 0
    for start, size in zip(starts.tolist(), sizes.tolist()):
        flat[start : start + size] = data[at : at + size]
        at += size
    return np.ascontiguousarray(flat.reshape(-1, width).T), counts


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, hidden: int = 16, epochs: int = 6) -> tuple[list[str], Network | None]:
    """The languages and the network learned from ``docs``, rows without language or text left out.

    The sample: of each language, documents chosen by the hash of their id and text, about sample / OF_A_DOCUMENT of
    them, fewer where many languages would make more than WHOLE_SAMPLE windows; of each document up to
    OF_A_DOCUMENT windows, spread over its whole text. Equal texts of a language count once there, however often
    they and their ids are repeated. Only these windows come to the driver. Every language that occurs is learned.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) > 0))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # a row a language
    languages = sorted(counts)
    if not languages:
        return [], None
    each = min(sample, max(OF_A_DOCUMENT, WHOLE_SAMPLE // len(languages))) / OF_A_DOCUMENT
    shares = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, each / counts[k]))))
    drawn = labelled.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("sample")), F.lit(1_000_000_000)) < 1_000_000_000 * F.element_at(shares, F.col(lang_col)))
    chosen = drawn.select(lang_col, text_col).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, part = [], []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                starts = range(0, max(1, len(data) - WINDOW // 2), WINDOW)
                for i in np.unique(np.linspace(0, len(starts) - 1, OF_A_DOCUMENT).astype(int)).tolist():
                    lang.append(own)
                    part.append(data[starts[i] : starts[i] + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(part, pa.binary())], ["lang", "part"])

    got = chosen.select(lang_col, text_col).mapInArrow(cut, "lang string, part binary").orderBy("lang", "part").toArrow()
    x, _ = windows(got.column("part").to_pylist())
    if not x.shape[1]:
        return [], None
    network = Network(len(languages), hidden)
    network.fit(x, np.searchsorted(languages, got.column("lang").to_pylist()), epochs)
    return languages, network


def predict(docs: DataFrame, languages: list[str], network: Network | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), at_once: int = 1024) -> DataFrame:
    """``keep`` of each row of ``docs``, with lang_pred and score.

    Every byte of the text is labelled, in windows that are read ``at_once``; the probabilities
    of the letters' bytes are averaged. A null text, one without a letter, and any text when
    nothing was learned, gives ``und`` with score 0.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((languages, network))
    kept = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = StructType([*kept.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, network = sent.value
        for batch in batches:
            lang, score = _labels(batch.column(batch.num_columns - 1).to_pylist(), languages, network, at_once)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return kept.mapInArrow(label, schema)


def _labels(texts: list[str | None], languages: list[str], network: Network | None, at_once: int = 1024) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    usable = [k for k, t in enumerate(texts) if network and t and any(map(str.isalpha, t))]
    for group in _groups(usable, texts):
        x, counts = windows([texts[k].encode() for k in group])
        sums, weights = zip(*(network.pooled(x[:, i : i + at_once]) for i in range(0, x.shape[1], at_once)))
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(np.concatenate(sums), firsts) / np.maximum(np.add.reduceat(np.concatenate(weights), firsts), 1)[:, None]
        for k, best, value in zip(group, mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist()):
            lang[k], score[k] = languages[best], min(1.0, value)
    return lang, score


def _groups(rows: list[int], texts: list[str], most: int = 1 << 20) -> Iterator[list[int]]:
    """``rows`` in lists of about ``most`` characters."""
    held, size = [], 0
    for k in rows:
        held.append(k)
        size += len(texts[k])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predicts the language of every document; learns only from text and language of those that aren't held out.

    Returns one row per document row: id, held_out, lang_pred, score. Language and id are no
    inputs of a prediction. Repeated rows give a row each, a null id is kept, other
    columns are ignored.
    """
    base = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col), held_out.alias("held_out"))
    learned = train(base.where(~F.col("held_out")), lang_col, id_col, text_col)
    return predict(base, *learned, text_col=text_col, keep=(id_col, "held_out"))


@F.arrow_udf(BooleanType())
def has_letter(text: pa.Array) -> pa.Array:
    """Whether a text has a letter, by the rule of ``predict``; a null one has none."""
    return pa.array([t is not None and any(map(str.isalpha, t)) for t in text.to_pylist()], pa.bool_())


def drop_rejected(docs: DataFrame, held_out: Column, least: float | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without those of undetermined language, and those scored under ``least``; all columns are returned.

    The score is the answer's mean probability over a text's letters. By default it must be half of the probability that the right language had
    over the letters that the network learned from (geometric mean, last epoch): near 0.5 for one that has learned well, less for one that had few texts.
    When nothing was learned, every text with a letter is kept, as no language can be told from another. Null texts and those without a letter go;
    repeated rows stay or go alike, whatever their ids. Only texts go to Python.
    """
    learned = train(docs.where(~held_out), lang_col, id_col, text_col)
    if learned[1] is None:
        return docs.where(has_letter(F.col(text_col)))
    least = TOLD * learned[1].typical if least is None else least
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    @F.arrow_udf(DoubleType())
    def told(text: pa.Array) -> pa.Array:
        return pa.array([None if lang == UNDETERMINED else score for lang, score in zip(*_labels(text.to_pylist(), *sent.value))], pa.float64())

    return docs.where(told(F.col(text_col)) >= least)
