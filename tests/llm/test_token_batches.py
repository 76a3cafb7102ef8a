"""Columns of texts are encoded by their different pieces, with the library's ids."""

import random

import numpy as np
import pyarrow as pa
import pytest

from jobloom.llm.tokens import Encoder, default_path

PARTS = [*"aZ'. \n\t\r\x1c!?-_09é×÷ÀñÃ\x85\xa0 ᠎ ​‌  　“漢あ🙂ßª½İ", "<|endoftext|>", "'s", "'ll", "  ", "don't", "word."]


@pytest.mark.parametrize("special", [True, False])
def test_columns_have_the_ids_of_the_library(special):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(6000)] + ["", "a " * 9000]
    own = Encoder(default_path(), most=300, special=special)
    expected = [own.tokenizer.encode(t, add_special_tokens=False).ids + [7] for t in texts]
    for at_once in (50, 1000, 1 << 20):
        for kind in (pa.string(), pa.large_string()):
            ids, lengths = own.column(pa.array(["cut off", *texts], kind)[1:], 7, at_once)
            assert lengths.tolist() == list(map(len, expected))
            assert ids.dtype == np.uint32 and ids.tolist() == [k for x in expected for k in x]
            assert len(own.known) <= 300
    assert [len(x) for x in own.column(pa.array([], pa.string()), 7)] == [0, 0]


def test_a_piece_is_encoded_once_and_rare_ones_arent_remembered():
    own, asked = Encoder(default_path()), []
    word = own._word
    own._word = lambda w: asked.append(w) or word(w)
    texts = pa.array(["some word. some word, some\nword some", *(f"x{k} some" for k in range(50))])
    first = own.column(texts)
    assert sorted(asked) == sorted({"some", " some", " word", "word", ".", ",", "\n"} | {f"x{k}" for k in range(50)})
    assert set(own.known.to_pylist()) == {b" some", b" word"}
    asked.clear()
    again = own.column(texts)
    assert " some" not in asked and all((a == b).all() for a, b in zip(first, again))
