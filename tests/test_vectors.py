"""Nearest vectors against plain NumPy."""

import numpy as np
import pytest

from ledgerlake.operators import vectors as N

SCHEMA = "vec_id long, embedding array<float>, label string"


def brute(rows, queries, k):
    out = {}
    for q, w in queries:
        if not w or None in w:
            continue
        w = np.array(w, float)
        s = []
        for i, v in rows:
            if v and None not in v and len(v) == len(w):
                v = np.array(v, np.float32).astype(float)
                n = np.sqrt(v @ v) * np.sqrt(w @ w)
                s.append((-(v @ w) / n if n else np.inf, i))
        out[q] = [(i, None if x == np.inf else round(float(-x), 6)) for x, i in sorted((round(x, 9), i) for x, i in s)[:k]]
    return out


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_topk_is_brute_force(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(N, "BLOCK", 3)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    rows += [(i, rows[7][1]) for i in range(200, 260)]  # ties
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0, 2.0]), (304, [1.0] * 7 + [None])]
    queries = [(f"q{i}", rows[i][1]) for i in range(0, 40, 3)] + [("two", [2.0, 1.0]), ("none", None), ("null", [None, 1.0])]
    df = spark.createDataFrame([(*x, None) for x in rows], SCHEMA).repartition(5)
    qs = spark.createDataFrame(queries, "query_id string, query_vec array<double>")
    got = {}
    for x in sorted(N.vector_topk(df, qs, k=4, broadcast_bytes=broadcast_bytes).collect(), key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    want = brute(rows, queries, 4)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(got[q][j][1] == pytest.approx(s, abs=2e-6) for q, x in want.items() for j, (_, s) in enumerate(x))
    assert got["two"] == [(303, 0.8)]
    assert N.vector_topk(df, qs.limit(0)).count() == 0 == N.vector_topk(df.limit(0), qs).count()


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_recall_of_buckets(spark, broadcast_bytes):
    r = np.random.default_rng(4)
    centres = r.normal(size=(60, 32))
    rows = [(i, (centres[i % 60] + 0.35 * r.normal(size=32)).tolist(), None) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    qs = df.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vec")
    exact = {(x["query_id"], x["vec_id"]) for x in N.vector_topk(df, qs).collect()}
    got = {(x["query_id"], x["vec_id"]) for x in N.vector_topk_bucketed(df, qs, broadcast_bytes=broadcast_bytes).collect()}
    assert len(exact & got) >= 0.9 * len(exact) and len(exact) == 750


def test_recall_on_given_vectors(spark):
    from ledgerlake.plans import q_text as Q
    sf = "/root/testdata/sf0.1"
    exact = {(x["query_id"], x["vec_id"]) for x in Q._x3_rows(spark, sf).collect()}
    got = {(x["query_id"], x["vec_id"]) for x in Q._x3_bucketed(spark, sf).collect()}
    assert len(exact & got) >= 0.9 * len(exact)
