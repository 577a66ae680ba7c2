"""Separator-aware chunks against a plain loop."""

import random
import time

import pytest

from ledgerlake.operators import text as X


def plain(t, size, overlap):
    out, p = [], 0
    while t:
        if p + size >= len(t):
            return [*out, (p, t[p:])]
        w = t[p:p + size]
        cut = next((w.rfind(s) + len(s) for s in X.SEPARATORS if s in w and w.rfind(s) + len(s) >= size // 2), size)
        out.append((p, w[:cut]))
        p += cut - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(20, 0), (20, 9), (50, 10)])
def test_chunks_are_the_plain_loop_and_cover_the_text(spark, size, overlap):
    rng = random.Random(size + overlap)
    texts = [None, "", " ", "x" * 500, "\n" * 300, "a" * size, "a" * (size + 1), "é́ \r\n" * 80, "𝔘 " * 200]
    texts += ["".join(rng.choice("abcdefgh  \n") for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    texts += ["\n\n".join("word " * rng.randrange(1, 12) for _ in range(30))]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(4)
    got = {}
    for r in sorted(X.chunk_separated(df, size, overlap).collect(), key=lambda r: (r["doc_id"], r["chunk_ix"])):
        got.setdefault(r["doc_id"], []).append((r["start"], r["chunk"]))
    assert got == {i: plain(t, size, overlap) for i, t in enumerate(texts) if t}
    for i, cs in got.items():
        assert "".join(c[max(0, (cs[k - 1][0] + len(cs[k - 1][1]) - p) if k else 0):] for k, (p, c) in enumerate(cs)) == texts[i]
        assert all(len(c) <= size for _, c in cs)


def test_long_text(spark):
    t = "lorem ipsum " * 200_000
    df = spark.createDataFrame([(1, t, None)], "doc_id long, text string, source string")
    began = time.time()
    got = [(r["start"], r["chunk"]) for r in X.chunk_separated(df).orderBy("chunk_ix").collect()]
    assert got == plain(t, 2000, 200) and time.time() - began < 60


def test_parameters_are_checked(spark):
    df = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, source string")
    for bad in ({"size": 20, "overlap": 10}, {"separators": ["ab"]}):
        with pytest.raises(ValueError):
            X.chunk_separated(df, **bad)
