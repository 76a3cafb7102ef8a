"""What Python workers keep between tasks is small, as they stay while other stages run."""

import tracemalloc

from jobloom.llm.tokens import Encoder, default_path


def test_words_that_occur_once_take_no_lasting_memory():
    own = Encoder(default_path())
    words = [[f"{chr(97 + k % 26)}{k:x}q" for k in range(n, n + 40_000)] for n in (0, 40_000)]
    own.texts([" ".join(words[0][:100])])
    tracemalloc.start()
    for some in words:
        own.texts([" ".join(some)])
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 4 << 20 and own.known.nbytes + own.ids.nbytes + own.sizes.nbytes < 4 << 20
