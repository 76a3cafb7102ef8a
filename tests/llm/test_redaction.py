"""Redaction of rows that share an id, and of repeated rows."""

from jobloom.llm import secrets


def test_rows_that_share_an_id(spark):
    rows = [(1, "password = abcdefgh12 and more"), (1, "x password = zyxwvuts98"), (1, "x password = zyxwvuts98"), (1, None), (None, "token: 1234567890"), (2, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in secrets.redact(docs).collect()), key=repr)
    want = [(1, "*" * 21 + " and more"), (1, "x " + "*" * 21), (1, "x " + "*" * 21), (1, None), (None, "*" * 17), (2, "plain")]
    assert got == sorted(want, key=repr)
    assert secrets.redact(docs.where("false")).count() == 0
