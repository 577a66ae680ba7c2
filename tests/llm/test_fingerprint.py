"""Fingerprints of neighbouring large ids, of long texts, and by a plain loop."""

import math

import numpy as np

from ledgerlake.llm import fingerprint
from ledgerlake.llm.common import prepare
from ledgerlake.llm.textkit import mix64, span_hashes


def test_large_ids_follow_one_another(spark):
    prepare(spark)
    ids = [*((1 << 60) + i for i in range(40)), *(-(1 << 60) - i for i in range(5)), 3, None]
    rows = [(i, f"text {(k * 29) % 47} of {k}") for k, i in enumerate(ids)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    text = dict(rows)
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    import hashlib
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        want = fingerprint.edited(text[i], text[following])
        assert got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def by_hand(text):
    words = {}
    for w in text.lower().split():
        words[w] = words.get(w, 0) + 1
    best = [math.inf] * fingerprint.SAMPLES
    for w, n in words.items():
        raw = np.frombuffer(w.encode(), np.uint8)
        r, c, b = (x[0] for x in fingerprint._variates(span_hashes(raw, np.array([0]), np.array([len(raw)]))))
        for k in range(fingerprint.SAMPLES):
            t = np.floor(np.log(np.float32(n)) / r[k] + b[k])
            v = c[k] + r[k] * b[k] - r[k] if t == 0 else c[k] - r[k] * (t - b[k]) - r[k]
            best[k] = min(best[k], np.float32(v))
    bits = mix64(np.array(best, np.float32).view(np.uint32).astype(np.uint64) + fingerprint._SEED[0])
    return (bits >> np.uint64(48)).astype(np.uint16).tolist()


def test_signature_is_the_plain_loop_in_any_slices(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.5, n) % 300) for n in (1, 7, 400, 900)]
    want = [by_hand(t) for t in texts]
    for terms in (fingerprint.TERMS, 50, 1):
        monkeypatch.setattr(fingerprint, "TERMS", terms)
        assert fingerprint.signatures(texts).tolist() == want


def test_likeness_is_the_generalised_jaccard_similarity(monkeypatch):
    monkeypatch.setattr(fingerprint, "TERMS", 1000)
    a = [f"a{i}" for i in range(300)] + [f"b{i}" for i in range(700)] * 2
    b = [f"b{i}" for i in range(700)] * 2 + [f"c{i}" for i in range(300)]
    same = [float(np.mean(np.equal(*fingerprint.signatures([" ".join(f"{s}{w}" for w in x) for x in (a, b)])))) for s in "stuvwxyz"]
    assert abs(np.mean(same) - 1400 / 2000) < 0.08
