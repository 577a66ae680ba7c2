"""Token ids of whole texts by the tokenizers library, asked once for each distinct chunk.

For vocabulary files with the plain byte-level split (no normalizer), a text
may be cut before white space that follows something else, and before ASCII
punctuation that follows a letter: the split pattern begins a new word there
whatever stands around, so the chunks' ids in a row are the text's. Texts with
white space outside ASCII or with special strings go to the library whole, as do
all texts of other files.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

from ledgerlake.llm.textkit import runs, span_hashes

#: The table of known chunks is emptied at this many bytes (time only, no result depends on it).
TABLE_BYTES = 48 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_TAIL = np.zeros(256, bool)  # second bytes of the letters U+00C0 to U+00FF
_TAIL[0x80:0xC0] = True
_TAIL[[0x97, 0xB7]] = False
_ODD_SPACE = "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))


def chunk_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    new = np.zeros(len(buf) + 1, bool)
    if len(buf) > 1:
        letter = _LETTER[buf]
        letter[1:] |= _TAIL[buf[1:]] & (buf[:-1] == 0xC3)
        new[1:-1] = _SPACE[buf[1:]] & ~_SPACE[buf[:-1]] | _MARK[buf[1:]] & letter[:-1]
    new[offs] = True
    new[len(buf)] = False
    return np.flatnonzero(new)


class ByteEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        level = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space")
        special = "".join("|" + re.escape(t["content"]) for t in spec["added_tokens"])
        self.odd = re.compile(f"[{_ODD_SPACE}]{special}") if plain else re.compile("")
        self.clear()

    def clear(self) -> None:
        self.key, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.whole.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (uint32)."""
        out: list[np.ndarray | None] = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if self.odd.search(t)]
        for i in odd:
            out[i] = np.array(self.ids([texts[i]])[0], np.uint32)
        left = [i for i in range(len(texts)) if out[i] is None]
        raw = [texts[i].encode("utf-8") for i in left]
        offs = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=offs[1:])
        data = b"".join(raw)
        buf = np.frombuffer(data, np.uint8)
        if not len(buf):
            for i in left:
                out[i] = np.zeros(0, np.uint32)
            return out
        s = chunk_starts(buf, offs)
        e = np.r_[s[1:], len(buf)]
        at, size = self._places(data, s, e, span_hashes(buf, s, e, lower=False))
        ends = np.cumsum(size)
        total = int(ends[-1])
        values = self.flat[np.repeat(at - (ends - size), size) + np.arange(total)]
        first = np.searchsorted(s, offs)  # of each text's chunks
        edge = np.r_[0, ends][first]
        for k, i in enumerate(left):
            out[i] = values[edge[k]:edge[k + 1]]
        return out

    def _places(self, data: bytes, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each chunk in ``flat``."""
        order = np.argsort(h)
        heads = runs(h[order])
        kinds, first = h[order[heads]], order[heads]
        back = np.empty(len(h), np.int64)
        back[order] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(h)]))
        i = np.minimum(np.searchsorted(self.key, kinds), max(len(self.key) - 1, 0))
        known = self.key[i] == kinds if len(self.key) else np.zeros(len(kinds), bool)
        if not known.all():
            if 20 * len(self.key) + 4 * len(self.flat) > TABLE_BYTES:
                self.clear()
                known[:] = False
            new = np.flatnonzero(~known)
            got = self.ids([data[a:b].decode("utf-8") for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)])
            size = np.array([len(x) for x in got], np.int32)
            at = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
            self.flat = np.concatenate([self.flat, np.fromiter((v for x in got for v in x), np.uint32, int(size.sum()))])
            where = np.searchsorted(self.key, kinds[new])
            self.key, self.at, self.size = (np.insert(x, where, y) for x, y in ((self.key, kinds[new]), (self.at, at), (self.size, size)))
            i = np.searchsorted(self.key, kinds)
        return self.at[i][back], self.size[i][back]


@functools.cache
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder per Python worker and file."""
    return ByteEncoder(path)
