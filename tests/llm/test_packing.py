"""Packing against the tokenizers library, and its invariants on awkward rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import byte_chunks, packing
from ledgerlake.llm import queries as Q
from ledgerlake.llm.common import prepare

VOCAB = Q.vocabulary("byte_bpe_50k.json")
END = 2
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return byte_chunks.ByteEncoder(VOCAB).whole


def test_chunks_are_the_library(library):
    rng = random.Random(8)
    some = ["a", "É", "ß", "×", "÷", "é,", "1", "٣", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "'s", "'", "’s", "!", "...", "—,", "日", "x y", "\xa0", " ", "\x1c",
            "\x85", "<|endoftext|>", "<|", "😀", "é", "​", "ﬁ", "_a", "I'LL", "ÿ'", " ", "᠎", "\x00", "﻿", "ª", "²", "⁠"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(0, 16))) for _ in range(4000)]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)},x" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    enc = byte_chunks.ByteEncoder(VOCAB)
    for i in range(0, len(texts), 500):
        part = texts[i:i + 500]
        want = [x.ids for x in library.encode_batch(part, add_special_tokens=False)]
        bad = [t for t, a, b in zip(part, enc.encode(part), want, strict=True) if a.tolist() != b]
        assert not bad, bad[:5]


def test_other_files_go_to_the_library_whole():
    path = Q.vocabulary()
    texts = ["Hello, World!", "", "a  b"]
    enc = byte_chunks.ByteEncoder(path)
    assert [x.tolist() for x in enc.encode(texts)] == [x.ids for x in enc.whole.encode_batch(texts, add_special_tokens=False)]


def corpus():
    rng = random.Random(1)
    voc = [f"{rng.choice('abcdefg')}{i}" for i in range(50)]
    rows = [(i - 5, " ".join(rng.choice(voc) for _ in range(rng.randrange(0, 300)))) for i in range(250)]
    rows += [(900, None), (901, ""), (None, "free text"), rows[3], rows[3], (902, "one two " * 3000), (903, "x" * 40_000), (1 << 61, "big id"), ((1 << 61) + 1, "big id")]
    return rows


def checked(got, rows, library, capacity, end=END):
    """Pieces cover each document in order, lie gapless in their sequences, and hold the library's ids."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for d, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [end], "<u4")
        n = -(-len(ids) // capacity)
        first = len(ids) - (n - 1) * capacity
        cuts = [0] + [first + k * capacity for k in range(n)]
        want[d] += [(k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(ids[cuts[k]:cuts[k + 1]].tobytes())) for k in range(n)]
    assert {d: sorted(v) for d, v in by_doc.items()} == {d: sorted(v) for d, v in want.items()}
    for places in by_seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    total = sum(n for v in by_seq.values() for _, n in v)
    return len(by_seq), -(-total // capacity)


@pytest.mark.parametrize("capacity,block", [(1024, 8192), (64, 40)])
def test_packed_pieces_are_the_documents(spark, library, monkeypatch, capacity, block):
    prepare(spark)
    monkeypatch.setattr(packing, "BLOCK_PIECES", block)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("id", "ids", "length", "block")]).repartition(3)
    packed = packing.pack(df, VOCAB, END, capacity)
    got = packing.described(packed, packing.id_width(VOCAB, END)).collect()
    used, least = checked(got, rows, library, capacity)
    assert used <= least * 1.04 + 1


def test_empty_table(spark):
    prepare(spark)
    assert packing.described(packing.pack(spark.createDataFrame([], SCHEMA), VOCAB), "<u2").count() == 0


def test_documents_without_tokens_have_no_place(spark):
    prepare(spark)
    df = spark.createDataFrame([(1, ""), (2, "x"), (3, None)], SCHEMA)
    assert [r["doc_id"] for r in packing.described(packing.pack(df, VOCAB, None), "<u2").collect()] == [2]


def test_crossover_keeps_every_piece_and_helps():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(150, 700, 600))[::-1].astype(np.int64)
    first = packing.pack_all(lengths, np.argsort(-lengths, kind="stable"), 1024)
    other = packing.pack_all(lengths, rng.permutation(600), 1024)
    for _ in range(20):
        child = packing.crossed(lengths, first, other, 1024, rng)
        f = packing.fills(lengths, child)
        assert len(child) == 600 and f.max() <= 1024 and f.min() > 0 and f.sum() == lengths.sum()
    best = packing.evolve(lengths, packing.evolve(lengths, [], 1024, 1), 1024, 2)
    assert packing.worth(lengths, best[0]) < packing.worth(lengths, first)


def test_best_fit_takes_the_fullest_bin_that_can():
    bins, free = packing.place_best_fit([5, 3, 10, 1], np.array([4, 5, 0]), 10)
    assert bins.tolist() == [1, 0, 3, 0] and free.tolist() == [0, 0, 0, 0]
