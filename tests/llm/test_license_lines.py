"""Licence notices in comments, with code before and after."""

from jobloom.llm import licenses


def test_notices_in_code(spark):
    apache = next(t for name, t in licenses.TEXTS if name == "Apache-2.0" and "Unless" in t)
    header = apache.replace(" You may", "\n# You may").replace(" at http", " at\n#\n#     http").replace("-2.0 Unless", "-2.0\n#\n# Unless")
    rows = [
        (1, "# SPDX-License-Identifier: MIT\nimport os"),
        (2, "int a\n/* SPDX-License-Identifier: BSD-3-Clause */\nint b"),
        (3, f"#!/bin/sh\n# Copyright 2020 X\n#\n{'# ' + header}\nimport os"),
        (4, "x\n * Copyright 2020 X\n *\n * Licensed under the Apache License, Version 2.0\n */\nint b"),
        (5, "the spdx license identifier is MIT here"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["licenses"] for i, r in got.items()} == {1: "MIT", 2: "BSD-3-Clause", 3: "Apache-2.0", 4: "Apache-2.0", 5: ""}
    assert got[3]["n_sentences"] == len(licenses.known_sentences(apache))


def test_names_of_holders_and_numbers(spark):
    bsd = next(t for name, t in licenses.TEXTS if name == "BSD-3-Clause" and "Redistribution" in t)
    named = bsd.replace("the copyright holder nor the names of its", "ACME Corp nor the names of its").replace("PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "PROVIDED BY ACME CORP").replace("SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE", "SHALL ACME CORP BE")
    lettered = named.replace("1. ", "\n  (a) ").replace("2. ", "\n  (b) ").replace("3. ", "\n  (c) ")
    unlicense = next(t for name, t in licenses.TEXTS if name == "Unlicense")
    rows = [(1, named), (2, lettered), (3, "No warranty.\n1. Mix flour. 2. Add eggs. 3. Bake."), (4, unlicense.split(". ")[0] + "."), (5, "word"), (6, None)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["licenses"] for i, r in got.items()} == {1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: "", 4: "", 5: "", 6: ""}
    assert got[3]["n_sentences"] == 0 and got[4]["n_sentences"] == 1


def test_own_texts_need_no_telling_words(spark):
    docs = spark.createDataFrame([(1, "Use it as you like. It is yours."), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs, texts=[("Own", "Use it as you like. It is yours.")]).collect()}
    assert got == {1: "Own", 2: ""} and licenses.scan(docs.where("false")).count() == 0
