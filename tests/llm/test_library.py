"""Ids and counts equal the tokenizers library on every code point and on mixed texts."""

import random
import sys

import pytest
from tokenizers import Tokenizer

from ledgerlake.llm import queries as Q
from ledgerlake.llm.token_count import TokenCounter
from ledgerlake.llm.token_output import IdEncoder

#: Every code point of the planes in use; planes 3 to 16, all of one kind to both sides, at every 17th.
POINTS = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x30000 or 0xE0000 <= c < 0xE1000 or c % 17 == 0)]
SHAPES = ["a{}b c", "H{} {}É x"]
rng = random.Random(11)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(Q.vocabulary())


@pytest.fixture(scope="module")
def own():
    return IdEncoder(Q.vocabulary()), TokenCounter(Q.vocabulary())


def differing(library, own, texts):
    """Texts whose ids or whose counts are not the library's."""
    out = []
    for i in range(0, len(texts), 1 << 15):
        part = texts[i:i + (1 << 15)]
        ids = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        got = [memoryview(b).cast("I").tolist() for b in own[0].encode(part)]
        n = own[1].counts(part).tolist()
        out += [t for t, a, b, k in zip(part, ids, got, n, strict=True) if a != b or len(a) != k]
    return out


@pytest.mark.parametrize("shape", SHAPES)
def test_every_code_point(library, own, shape):
    points = POINTS if shape == SHAPES[0] else [c for c in POINTS if c < 0x3100]
    assert differing(library, own, [shape.format(*[chr(c)] * shape.count("{}")) for c in points]) == []


def test_mixed_texts(library, own):
    kinds = [[*range(32, 127)], [*range(0, 33), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0xFEFF], [*range(0xC0, 0x250)],
             [*range(0x300, 0x370)], [*range(0x370, 0x530)], [*range(0x2070, 0x20A0)], [*range(0x1E00, 0x2000)],
             [*range(0xAC00, 0xAC80), *range(0x1100, 0x1200)], [0x3A3, 0x130, 0x1E9E, 0x212A, 0x212B, 0x331], POINTS]
    texts = ["".join(chr(rng.choice(rng.choice(kinds))) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts += [t[:9] + rng.choice(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'LL 's"]) + t[9:] for t in texts[:500]]
    assert differing(library, own, texts) == []
