"""Token counts by heap-and-linked-list byte-pair merging.

A text is normalised and cut into words of byte symbols as the vocabulary file
says. For each distinct word, its symbols stand in a doubly linked list and all adjacent
pairs that have a rank wait in a heap; the lowest rank is popped and merged
until the heap is empty. The count is the number of initial symbols less the
merges made; no identifier is ever produced. Each Python worker merges a distinct
word once (see ``chunks``).
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.chunks import BATCH_CHARS, ChunkTable, WordSplitter
from ledgerlake.llm.common import fresh
from ledgerlake.llm.textkit import flat, slices, tidy


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols that remain when pairs are merged lowest rank first, leftmost first."""
    n = len(symbols)
    if n < 2:
        return n
    sym = list(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue  # an older entry: one side has been merged since
        sym[i], sym[j] = a + b, ""
        merges += 1
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get((sym[i], sym[k]))) is not None:
                heapq.heappush(heap, (r, i, sym[i], sym[k]))
        if (h := left[i]) >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
            heapq.heappush(heap, (r, h, sym[h], sym[i]))
    return n - merges


class TokenCounter:
    """Counts tokens of texts for one vocabulary file."""

    def __init__(self, path: str):
        self.cut = WordSplitter(path)
        model = self.cut.spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.cut.spec = None  # the parsed file is large and not needed again
        self.table = ChunkTable(lambda w: [self.word(w)], self.cut.words)

    def word(self, w: str) -> int:
        s = list(w)
        s[-1] += self.end
        return merge_count(s, self.ranks)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special string of the file is one token."""
        parts, owner = [], []
        extra = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            cut = self.cut.pieces(t)
            extra[i] = len(cut) // 2
            for p in cut[::2]:
                parts.append(p)
                owner.append(i)
        return extra + np.bincount(np.array(owner, np.int64), self.table.counts(parts), len(texts)).astype(np.int64)


@functools.cache
def counter(path: str) -> TokenCounter:
    """One counter per Python worker and file."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """``docs`` without the text, plus n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    ``vocabulary`` is a path that every executor has. A null text counts as
    empty (0 bytes, 0 tokens); the other columns pass through unread, repeated
    rows stay repeated. Columns named like the results are replaced. A narrow,
    single-stage job: no shuffle, memory of one Arrow batch.
    """
    results = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    rest = [c for c in docs.columns if c != text and c not in results]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(c, t) for c, t in results.items()])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(vocabulary)
        for b in batches:
            for i, j in slices(flat(b.column(len(rest)))[1], BATCH_CHARS):
                part = b.slice(i, j - i)
                texts = [t or "" for t in part.column(len(rest)).to_pylist()]
                n = bpe.counts(texts)
                size = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], size, pa.array(n), pa.array(n > limit)], names=[*rest, *results])

    return docs.select(*rest, F.col(text).alias(fresh(rest, "_text"))).mapInArrow(run, schema)
