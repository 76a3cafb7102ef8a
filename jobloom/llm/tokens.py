"""Tokens of whole texts by the tokenizers library, inside tasks."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Characters that a vocabulary's pre-tokenizer may take for white space, in UTF-8.
_SPACES = [c.encode() for c in map(chr, range(0x3001)) if re.match(r"[\s\u180e\u200b]", c)]
#: Classes of bytes: white space of one byte, ASCII punctuation, ASCII letters.
_WHITE, _PUNCTUATION, _LETTER = (np.zeros(256, bool) for _ in range(3))
_WHITE[[c[0] for c in _SPACES if len(c) == 1]] = True
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
#: White space of more bytes, by the first one: the numbers that the others make.
_WIDE = {c[0]: [int.from_bytes(x[1:]) for x in _SPACES if x[0] == c[0]] for c in _SPACES if len(c) > 1}
#: Words whose pre-tokens are found here: no white space or control inside, and only
#: characters whose Unicode class all versions agree on. The library does all others.
_PLAIN = re.compile(r" ?[!-~\u00a1-\u04ff]*")
#: The pre-tokens of byte-level BPE, as published with the vocabulary.
_PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: itself if it can be seen, else from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()

_loaded: dict[str, "Encoder"] = {}


def default_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where in ``data`` (the UTF-8 of texts with these bounds) a piece begins that may be encoded apart: a flag a byte, and one more.

    The byte-level pre-tokenizer makes a pre-token of a single line feed between two characters that aren't white space, and
    begins one with such a space; one ends between a letter and punctuation. Letters here are ASCII ones and those whose first byte is C3.
    """
    white, letter = _WHITE[data], _LETTER[data]
    for lead, codes in _WIDE.items():
        at = np.flatnonzero(data == lead)
        if len(at):
            rest = data[at + 1].astype(np.int32)
            if lead >= 0xE0:
                rest = rest * 256 + data[at + 2]
            at = at[np.isin(rest, codes)]
            for k in range(2 + (lead >= 0xE0)):
                white[at + k] = True
    at = np.flatnonzero(data == 0xC3) + 1
    letter[at] = (data[at] != 0x97) & (data[at] != 0xB7)  # but for the signs of multiplication and division
    starts = np.zeros(len(data) + 1, bool)
    np.logical_and(_PUNCTUATION[data[1:]], letter[:-1], out=starts[1:-1])
    at = np.flatnonzero((data == 32) | (data == 10))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds[:-1]] = edge[bounds[1:] - 1] = True
    at = at[~edge[at]]
    at = at[~(white[at - 1] | white[at + 1])]
    starts[at] = True
    starts[at[data[at] == 10] + 1] = True
    starts[bounds] = True
    return starts


class Encoder:
    """Encodes texts and remembers the ids of pieces of them: words with the space before them, and what follows a word.

    A batch is cut into pieces at once; each different one is looked up or encoded once. The memory only saves work: it has short
    pieces that occurred more than once in a batch, and begins anew when it would hold more than ``most``. With ``special``, strings
    of added tokens are these tokens, as in the tokenizer as loaded; else they are ordinary text.
    """

    def __init__(self, path: str, most: int = 500_000, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.most = most
        self._begin(pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(0, np.int32))
        kind = json.loads(self.tokenizer.to_str())
        self.byte_level = kind["normalizer"] is None and (kind["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not kind["pre_tokenizer"]["add_prefix_space"] and kind["post_processor"] is None
        self.model = self.tokenizer.model
        added = [t["content"] for t in kind["added_tokens"]]
        self.whole = [x for x in added if x] if special else []  # texts that have one of these the library does whole

    def _begin(self, known: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remembers these pieces alone: the ids of all of them, and how many each has."""
        self.known, self.ids, self.sizes = known, ids, sizes

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int]:
        """The ids of a pre-token."""
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))]

    def _word(self, word: str) -> list[int]:
        """The ids of a piece: a plain one's by its pre-tokens, any other's as it is."""
        letters = word[1:] if word[:1] == " " else word
        if letters.isascii() and letters.isalpha():
            return self._piece(word)
        if not _PLAIN.fullmatch(word) or any(x in word for x in self.whole):
            return self._encode(word)
        if letters.isalpha():
            return self._piece(word)
        return [k for piece in _PIECE.findall(word) for k in self._piece(piece)]

    def _cut(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """``column`` of texts of bounded size together."""
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, size = int(bounds[0]), int(bounds[-1] - bounds[0])
        bounds = (bounds - first).astype(np.int32)
        buffer = texts.buffers()[2].slice(first, size) if size else pa.py_buffer(b"")
        starts = _starts(np.frombuffer(buffer, np.uint8), bounds)
        for x in self.whole:
            for k in np.flatnonzero(pc.match_substring(texts, x).to_numpy(zero_copy_only=False)).tolist():
                starts[bounds[k] + 1 : bounds[k + 1]] = False
        starts[-1] = True
        at = np.flatnonzero(starts).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), buffer]).dictionary_encode()
        words, codes = pieces.dictionary, pieces.indices.to_numpy()
        ids, begins, sizes = self._ids(words, codes)
        upto = np.searchsorted(at, bounds)  # pieces before each text
        if end_id is not None:
            ids, begins, sizes = np.append(ids, np.uint32(end_id)), np.append(begins, np.int32(len(ids))), np.append(sizes, np.int32(1))
            codes = np.insert(codes, upto[1:], len(words))
            upto += np.arange(len(upto))
        times = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(times)])
        places = np.repeat(begins[codes] - ends[:-1].astype(np.int32), times)
        places += np.arange(len(places), dtype=np.int32)
        return ids[places], np.diff(ends[upto])

    def _ids(self, words: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where among them those of each of the ``words`` begin and how many these are; ``codes`` tell how often words occur."""
        found = pc.index_in(words, value_set=self.known)
        old = found.is_valid().to_numpy(zero_copy_only=False)
        place = found.fill_null(-1).to_numpy()
        new = [self._word(w) for w in words.filter(pa.array(~old)).cast(pa.string()).to_pylist()]
        place = np.where(old, place, len(self.known) + np.cumsum(~old) - 1)
        ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(new), np.uint32)])
        all_sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), np.int32)])
        begins = (np.cumsum(all_sizes) - all_sizes).astype(np.int32)
        begins, sizes = begins[place], all_sizes[place]
        lasting = (np.bincount(codes, minlength=len(words)) > 1) & (pc.binary_length(words).to_numpy() <= 64)
        more, kept = lasting & ~old, self.known
        if len(kept) + more.sum() > self.most:  # anew, with what occurs here
            more, kept = lasting & (np.cumsum(lasting) <= self.most), kept[:0]
        if more.any():
            times = sizes[more]
            places = np.repeat(begins[more] - (np.cumsum(times) - times).astype(np.int32), times) + np.arange(times.sum(), dtype=np.int32)
            before = (self.ids, self.sizes) if len(kept) else (self.ids[:0], self.sizes[:0])
            self._begin(pa.concat_arrays([kept, words.filter(pa.array(more))]), np.concatenate([before[0], ids[places]]), np.concatenate([before[1], times]))
        return ids, begins, sizes

    def column(self, texts: pa.Array, end_id: int | None = None, at_once: int = 16 << 20) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts one after another, each text's followed by ``end_id`` if there is one; and how many each has.

        Texts are taken together up to about ``at_once`` bytes.
        """
        if not self.byte_level:  # where the rules above needn't hold
            end = [] if end_id is None else [end_id]
            each = [self._encode(text) + end for text in texts.to_pylist()]
            return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64)
        texts = texts.cast(pa.large_string())
        sums = np.cumsum(pc.binary_length(texts).to_numpy())
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(sums // at_once)) + 1, [len(texts)]])
        ids, lengths = zip(*(self._cut(texts[a:b], end_id) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if a < b or not len(texts)))
        return np.concatenate(ids), np.concatenate(lengths)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, lengths = self.column(pa.array(texts, pa.string()))
        ends = np.cumsum(lengths).tolist()
        return [ids[e - n : e] for e, n in zip(ends, lengths.tolist())]


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path, special=True)
    return _loaded[path]
