"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import spelling
from ledgerlake.llm.common import prepare

SCHEMA = "doc_id long, text string, source string"


def lower(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def counted(rows):
    n = Counter()
    for d, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(rows):
    n = counted(rows)
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def corpus():
    rng = random.Random(2)
    base = ["colour", "coloré", "naïveté", "Straße", "letter", "lettre", "aaaaaa", "bookkeeper", "ÀÉÎÕÜ", "zebra", "y" * 70, "été×÷x"]
    letters = "abcdeéyÿÀ"
    words = list(base)
    for _ in range(350):
        w = list(rng.choice(words))
        i, k = rng.randrange(len(w)), rng.randrange(3)
        w[i:i + (k > 0)] = [] if k == 1 else [rng.choice(letters)]
        words.append("".join(w))
    rows = []
    for d in range(60):
        rows.append((d * 1000 - 3, " ".join(rng.choice(words[:1 + int(len(words) * rng.random() ** 2)]) for _ in range(150)), "s"))
    rows += [(7, None, "s"), (8, "", None), (9, "12 !? 日本 ŸĀ", "s"), (None, "zebra Zebra ZEBRA " * 3, "s"), rows[0], (1 << 62, "chain " * 64 + "chaim " * 16 + "chaimx " * 4, "s")]
    rows += [(10, "x1 " * 3 + "longest" * 40 + " " + "tail " * 200, "s")]
    return rows


@pytest.mark.parametrize("tight", [False, True])
def test_forms_are_brute_force(spark, monkeypatch, tight):
    prepare(spark)
    rows = corpus()
    if tight:  # many pieces, flushes and filter rounds
        for name, v in (("PIECE", 100), ("FLUSH", 20), ("PAGES", 1), ("LONG", 9), ("PROBES", 64), ("BITS_PER_WORD", 2000)):
            monkeypatch.setattr(spelling, name, v)
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("word", "n", "page", "root")]).repartition(4)
    got = spelling.spelling_forms(df).collect()
    want = by_hand(rows)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)
    assert any(v[0] and v[1] != v[0] for v in want.values())


def test_tables_without_words(spark):
    prepare(spark)
    for rows in ([], [(1, None, None), (2, "a b c 1 2 3", None)]):
        assert spelling.spelling_forms(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_crc_of_two_strings_in_a_row():
    rng = random.Random(4)
    a = [bytes(rng.randrange(256) for _ in range(rng.randrange(20))) for _ in range(200)]
    b = [bytes(rng.randrange(256) for _ in range(rng.randrange(spelling._SHORT))) for _ in range(200)]
    got = spelling.joined_crc(*[np.array([zlib.crc32(x) for x in s], np.uint32) for s in (a, b)], np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


def test_long_text_is_cut_between_runs():
    rng = random.Random(6)
    text = "".join(rng.choice("abcé  1") * rng.randrange(1, 60) for _ in range(400))
    total = {}
    for part in spelling.pieces(pa.array([text, "", text]), [b"5", b"6", b"5"], 64):
        spelling.piece_counts(*part, total)
    want = Counter()
    for w in re.findall("[A-Za-zÀ-ÿ]+", text):
        h = zlib.crc32(f"5:{w}".encode())
        w = w if h % 97 else w[:h % len(w)] + w[h % len(w) + 1:]
        if len(w) >= 5 and w:
            want[w.encode()] += 2
    assert total == want
