"""The operators' ids are those of the tokenizer as loaded."""

from tokenizers import Tokenizer

from jobloom.llm import tokens


def test_special_tokens():
    library = Tokenizer.from_file(tokens.default_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|>\ny don't", "<|endoftext", "plain words here"]
    got = tokens.encoder(tokens.default_path()).texts(texts)
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0].tolist() == [64, 220, 50256, 275]
