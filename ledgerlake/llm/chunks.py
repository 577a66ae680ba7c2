"""Vocabulary lookups of whole batches of texts by their white-space chunks.

No word of the split pattern crosses white space, so what a text yields (token
ids, or a token count) is what its chunks yield in a row. A batch is cut and
hashed in NumPy at ASCII white space alone; each distinct chunk is looked up once
in a table of sorted 64-bit hashes that lives as long as the Python worker, and
only chunks that are new to the worker are worked out. The table is bounded: it
is emptied when it holds ``TABLE`` chunks, which costs time and changes no result.

A chunk of printable ASCII is lower-cased and split here; any other new chunk is
normalised and split by the tokenizers library, so that its Unicode tables decide.
Cutting first is safe: ASCII white space is a starter that composes with nothing.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

from ledgerlake.llm.textkit import runs, span_hashes, words

TABLE = 1_000_000
WORDS = 100_000
BATCH_CHARS = 1 << 19
_ENDS = frozenset(".,;:!?")


class WordSplitter:
    """Cuts texts as a vocabulary file with NFC, white-space folding, lower case
    and a split pattern does; special strings of the file stand alone. Words are
    strings of the file's byte symbols (printable ASCII stands for itself)."""

    def __init__(self, path: str):
        import regex
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        kinds = [n["type"] for n in self.spec["normalizer"]["normalizers"]]
        split, level = self.spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or level["type"] != "ByteLevel":
            raise ValueError(f"{path}: only word-end BPE files with NFC and lower case are supported")
        self.split = regex.compile(split["pattern"]["Regex"]).findall
        whole = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        specials = [t["content"] for t in self.spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk; the two plainest shapes need no pattern."""
        if not (chunk.isascii() and chunk.isprintable()):
            return [w for w, _ in self.pre_tokenize(self.normalize(chunk))]
        low = chunk.lower()
        if low.isalpha():
            return [low]
        if low[-1] in _ENDS and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.split(low)

    def pieces(self, text: str) -> list[str]:
        """The text cut at special strings; these have odd places."""
        return self.special.split(text) if "<" in text else [text]


class ChunkTable:
    """Values (a few uint32) of chunks, worked out once per Python worker."""

    def __init__(self, of_word: Callable[[str], list[int]], split: Callable[[str], list[str]], table: int = TABLE, words: int = WORDS):
        self.of_word, self.split, self.table, self.words = of_word, split, table, words
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.key, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def word(self, w: str) -> list[int]:
        got = self.young.get(w)
        if got is None:
            got = self.old.get(w)
            if got is None:
                got = self.of_word(w)
            if len(self.young) >= self.words:
                self.old, self.young = self.young, {}
            self.young[w] = got
        return got

    def places(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and size of the values of each span in ``flat``."""
        order = np.argsort(h)
        starts = runs(h[order])
        kinds, first = h[order[starts]], order[starts]
        back = np.empty(len(h), np.int64)
        back[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(h)]))
        i = np.minimum(np.searchsorted(self.key, kinds), max(len(self.key) - 1, 0))
        known = self.key[i] == kinds if len(self.key) else np.zeros(len(kinds), bool)
        if not known.all():
            if len(self.key) + (~known).sum() > self.table:
                self.clear()
                known[:] = False
            new = np.flatnonzero(~known)
            raw = buf.tobytes()
            values, sizes = [], []
            for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True):
                n = len(values)
                for w in self.split(raw[a:b].decode("utf-8")):
                    values += self.word(w)
                sizes.append(len(values) - n)
            size = np.array(sizes, np.int32)
            at = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
            self.flat = np.concatenate([self.flat, np.array(values, np.uint32)])
            where = np.searchsorted(self.key, kinds[new])
            self.key, self.at, self.size = (np.insert(x, where, y) for x, y in ((self.key, kinds[new]), (self.at, at), (self.size, size)))
            i = np.searchsorted(self.key, kinds)
        return self.at[i][back], self.size[i][back]

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and size of the values of each chunk, and its text's number."""
        raw = [(t.lower() if t.isascii() else t).encode("utf-8") for t in texts]
        offs = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=offs[1:])
        buf = np.frombuffer(b"".join(raw), np.uint8)
        s, e, d = words(buf, offs)
        at, size = self.places(buf, s, e, span_hashes(buf, s, e, lower=False))
        return at, size.astype(np.int64), d

    def counts(self, texts: list[str]) -> np.ndarray:
        """The sum of the first values of each text's chunks' words."""
        at, size, d = self.spans(texts)
        total = np.r_[0, np.cumsum(self.flat[_ranges(at, size)].astype(np.int64))]
        ends = np.cumsum(size)
        return np.bincount(d, total[ends] - total[ends - size], len(texts)).astype(np.int64)

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All values in order, and the end of each text's."""
        at, size, d = self.spans(texts)
        return self.flat[_ranges(at, size)], np.cumsum(np.bincount(d, size, len(texts))).astype(np.int64)


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (size[0] of them), then those of at[1], and so on."""
    ends = np.cumsum(size)
    return np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
