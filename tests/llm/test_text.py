"""Words and tokens against regular expressions and the tokenizer library."""

import random

import numpy as np
import pyarrow as pa
from cases import TEXTS, tokenizer, words
from tokenizers import Tokenizer

from millrace.llm._bpe import Encoder
from millrace.llm._words import pieces, shingles

ALPHABET = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "!", "''", " ", " ", "日", "😀", "\x1c", "\x85", "_", "\x00", "٣"]


def strings(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_words_equal_the_pattern():
    texts = [*strings(3000, 1), *(t for _, t, *_ in TEXTS)]
    for limit in (1, 50, 1 << 20):
        got = []
        for p in pieces(pa.array(texts), limit):
            raw = p.text.tobytes()
            found = [raw[a:b] for a, b in zip(p.starts.tolist(), p.ends.tolist(), strict=True)]
            got += [found[a:b] for a, b in zip(p.first[:-1].tolist(), p.first[1:].tolist(), strict=True)]
        assert got == [words(t) for t in texts]


def test_hashes_tell_words_and_shingles_apart():
    texts = [t or "" for _, t, *_ in TEXTS]
    (p,) = pieces(pa.array(texts), 1 << 30)
    every = [w for t in texts for w in words(t)]
    assert len(set(p.hashes.tolist())) == len(set(every))
    h, at = shingles(p.hashes, p.first)
    sizes = [max(len(words(t)) - 4, min(1, len(words(t)))) for t in texts]
    assert np.diff(at).tolist() == sizes


def test_ids_equal_the_library():
    library, own = Tokenizer.from_file(tokenizer()), Encoder(tokenizer(), slots=1 << 10)
    texts = [*strings(6000, 2), "a<|endoftext|>b", "", None, "   ", *(t for _, t, *_ in TEXTS)]
    got = []
    for lo, hi, _, _, ids, at in own.encode(pa.array(texts, pa.string())):
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(hi - lo)]
    assert got == [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
