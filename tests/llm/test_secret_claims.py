"""Claims of random strings against labelled ones: how many are found, and how many claims are wrong."""

import random

import pytest
from pyspark.sql import functions as F

from jobloom.llm import secrets

B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WORDS = "account archive balance button channel client color config context control counter current cursor customer database default device document element engine event factory feature filter format gateway handler header history image index input item label layer layout library listener loader manager margin message method model module monitor network object option order output package panel parser pattern payload plugin policy process profile project provider query queue reader record region render request resource response result router schedule schema screen script section server service session setting shadow signal socket source state status storage stream string style subject summary support switch system table target template theme thread timer token topic tracker transfer update upload user value vector version view widget window worker wrapper".split()


def ordinary(rng):
    w = lambda n: [rng.choice(WORDS) for _ in range(n)]
    kind = rng.randrange(6)
    if kind == 0:
        first, *rest = w(rng.randint(3, 5))
        return first + "".join(map(str.capitalize, rest))
    if kind == 1:
        return "_".join(w(rng.randint(3, 6)))
    if kind == 2:
        return "/".join(w(rng.randint(3, 7)))
    if kind == 3:
        return "-".join(w(rng.randint(3, 7)))
    if kind == 4:
        return f"{rng.choice(WORDS)}-service-{rng.randint(1, 20)}-{rng.randint(0, 9)}-{rng.randint(0, 9)}-build{rng.randint(100, 9999)}"
    return "".join(rng.choice("0123456789") for _ in range(22))


@pytest.mark.parametrize(("n_random", "recall", "wrong"), [(200, 0.9, 0.05), (10, 0.6, 0.25), (0, 0, 5)])
def test_labelled_tokens(spark, n_random, recall, wrong):
    rng = random.Random(n_random)
    tokens = [(False, t) for t in (ordinary(rng) for _ in range(1200)) if len(t) >= 20]
    tokens += [(True, "".join(rng.choice(B64 if n % 2 else "0123456789ABCDEF") for _ in range(rng.choice([32, 40, 44, 64])))) for n in range(n_random)]
    docs = spark.createDataFrame([(n, f"see {t} there", is_random) for n, (is_random, t) in enumerate(tokens)], "doc_id long, text string, secret boolean").repartition(4)
    found = secrets.scan(docs).select("doc_id", F.exists("spans", lambda s: s["kind"] == "random").alias("claimed"))
    claims = [r["secret"] for r in found.join(docs, "doc_id").where("claimed").collect()]
    right, false = sum(claims), len(claims) - sum(claims)
    assert right >= recall * n_random and false <= (wrong * len(claims) if n_random else wrong), (right, false)


def test_numbers_need_a_context(spark):
    rng = random.Random(5)
    number = lambda: "".join(rng.choice("0123456789") for _ in range(24))
    rows = [(n, f"order {number()} was sent") for n in range(40)] + [(100 + n, f"the auth value is {number()}") for n in range(40)] + [(200, None), (201, "")]
    found = {r["doc_id"]: len(r["spans"]) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(found[n] for n in range(40)) and sum(found[100 + n] for n in range(40)) >= 34 and found[200] == found[201] == 0


def test_limits(spark):
    """By hand: 58 over a half mean a hundred random ones, of which 88 lie over an eighth; more than those are ordinary."""
    frame = lambda rows: spark.createDataFrame(rows, "class int, bin int, count long")
    limit = lambda rows: {r["class"]: r["bin"] for r in secrets.limits(frame(rows), 0.05).collect()}
    assert limit([(1, 7, 58), (1, 23, 30), (1, 60, 12), (1, 79, 1)]) == {1: 79}
    assert limit([(1, 7, 58), (1, 23, 30), (1, 60, 300), (1, 300, 5000)]) == {1: 23}
    assert limit([(1, 300, 5000)]) == {} and limit([(1, 30, 1), (1, 300, 9)]) == {1: 30} and limit([(1, 30, 2), (1, 300, 9)]) == {}
    assert limit([]) == {}
