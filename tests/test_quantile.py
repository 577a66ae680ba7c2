"""Exact quantiles against numpy, with hot values, tiny sketches and groups."""

import numpy as np
import pytest

from ledgerlake.functions import quantile as Q

PS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.975, 1.0)


def _frame(spark, rng, n):
    v = rng.normal(size=n).round(3)
    v[: n // 3] = 0.25  # a third of all rows hold one value
    hot = rng.permutation(v)
    g = [None if i % 7 == 0 else f"g{i % 3}" for i in range(n)]
    rows = [(g[i], float(hot[i]) if i % 11 else None, float("nan") if i % 13 == 0 else float(i * i)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, a double, b double").repartition(5)


@pytest.mark.parametrize("sketch,few,n", [(40, 100, 4000), (20, 10, 4000), (40, 3999, 4000), (10_000, 500_000, 4000), (40, 36, 37), (10_000, 0, 1)])
def test_quantiles_are_exact_on_every_path(spark, monkeypatch, sketch, few, n):
    monkeypatch.setattr(Q, "SKETCH", sketch)
    monkeypatch.setattr(Q, "FEW", few)
    rows, df = _frame(spark, np.random.default_rng(n), n)
    got = {(r["g"], r["column"]): r for r in Q.quantile_table(df, ["a", "b"], PS, by=["g"]).collect()}
    want = {}
    for i, c in ((1, "a"), (2, "b")):
        for g in {r[0] for r in rows}:
            v = [r[i] for r in rows if r[0] == g and r[i] is not None and r[i] == r[i]]
            if v:
                want[g, c] = (len(v), np.quantile(v, PS).tolist())
    assert set(got) == set(want)
    for k, (m, q) in want.items():
        assert got[k]["n"] == m and got[k]["q"] == pytest.approx(q, rel=1e-12, abs=1e-12)
    one = df.select(Q.quantiles_of(df, ["a", "b"], PS).alias("s")).first()["s"]
    for i, c in ((1, "a"), (2, "b")):
        v = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        assert (one[c] is None and not v) or one[c] == pytest.approx(np.quantile(v, PS).tolist(), rel=1e-12, abs=1e-12)


def test_no_values_give_null(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert df.select(Q.quantiles_of(df, ["a"], (0.5,)).alias("s")).first()["s"]["a"] is None
    assert Q.quantile_table(df, ["a"], (0.5,)).count() == 0


def test_no_stage_holds_all_values(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 5000)
    df = spark.range(100_000).selectExpr("cast(id as double) as a")
    plan = Q.quantile_table(df, ["a"], (0.5,))._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_list" not in plan
    kept = Q.quantile_table(df, ["a"], (0.5,)).first()
    assert kept["q"] == [49_999.5] and kept["n"] == 100_000
