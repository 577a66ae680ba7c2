"""The prefix trie against brute force, with trees cut small so that nodes cross their borders."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import prefix_trie
from ledgerlake.llm.common import prepare
from ledgerlake.llm.radix_tree import RadixTree, shared

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:32], r, x))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def nodes_by_hand(seqs):
    members = defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    figures = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        leaves = sum(figures[k][0] for k in kids[p]) if kids[p] else 1
        figures[p] = (leaves, own + sum(figures[k][1] for k in kids[p]))
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *figures[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def awkward(n=260):
    rng = random.Random(11)
    texts = ["hello", "", None, "é😀", "long " * 40, "hello"]
    rows = []
    for c in [*range(-130, n), 5_000, 5_017, 700_001, 1 << 60, (1 << 60) + 1]:
        if c == 100:
            continue  # a missing base: some conversations are turnless
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), texts[0] if t < 2 else rng.choice(texts)))
    rows += [(40, None, "system", "first"), (40, None, "system", "first"), (41, 1, "user", "tie"), (41, 1, "user", "tie b"), (None, 1, "user", "lost")]
    rows += [(9_000 + i, t, "user", f"same {t}") for i in range(300) for t in range(4)]
    rows += [(12_345, t, "user", f"step {t % 7}") for t in range(900)]
    return rows


def as_rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 3, 20_000])
def test_trie_is_brute_force(spark, monkeypatch, chunk):
    prepare(spark)
    rows = awkward()
    monkeypatch.setattr(prefix_trie, "CHUNK_KEYS", chunk)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 5)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("base", F.lit(1)).withColumn("key", F.lit("x")).repartition(5)
    got = prefix_trie.rebuilt(df)
    seqs = rebuilt_by_hand(rows)
    assert {r["conv_id"]: [t["size"] for t in r["turns"]] for r in got.collect()} == {c: [len(x) for _, x in t] for c, t in seqs.items()}
    assert any(not t for t in seqs.values())
    assert as_rows(prefix_trie.trie(got)) == nodes_by_hand(seqs)


def test_empty_table_and_one_turnless_conversation(spark):
    prepare(spark)
    assert prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    one = as_rows(prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([(c, 0, "user", "x")], SCHEMA))))
    assert one == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_tree_grows_through_its_layouts():
    rng = random.Random(3)
    for fan in (3, 4, 5, 16, 17, 48, 49, 256):
        keys = {bytes([7, 7, a]) + bytes(rng.randrange(256) for _ in range(rng.randrange(3))) for a in range(fan)} | {b"", b"\x07"}
        order = sorted(keys)
        rng.shuffle(order)
        tree = RadixTree()
        for k in order:
            tree.insert(k, k)
        found = [n.value for n, *_ in tree.bottom_up() if n.value is not None]
        assert sorted(found) == sorted(keys)
        assert all(len(n.prefix) + (above + 1) == end for n, above, end, _ in tree.bottom_up())
    assert shared(b"abc", b"abd") == 2 and shared(b"ab", b"abd") == 2 and shared(b"\x00a", b"\x01a") == 0
