"""Tasks get a fixed share of the rows, and results do not depend on it."""

from datetime import date, datetime

import numpy as np
import pytest

from ledgerlake.operators import common
from ledgerlake.operators import forecast as FC
from ledgerlake.operators import inventory as I
from ledgerlake.operators import products as R
from ledgerlake.operators import vectors as N


@pytest.fixture()
def small_tasks(monkeypatch):
    monkeypatch.setattr(common, "ROWS_A_TASK", 10)


def test_profitability_tasks_grow_in_number(spark, small_tasks):
    lines = spark.createDataFrame([(i % 40, 1.0 + i % 3, datetime(2023, 1 + i % 5, 1)) for i in range(200)], "ref long, qty double, date timestamp_ntz")
    inv = spark.createDataFrame([(i, f"s{i}", f"l{i}", 5, 1.0, 2.0, 3.0) for i in [*range(40), 7]],
                                "id long, sfa string, lib string, qty int, factory_price double, retail double, retail_us double")
    out = I.product_profitability(lines, inv)
    assert ", 20), REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
    got = {r.product_id: (r.total_units, r.total_transactions, r.active_periods) for r in out.collect()}
    for p in range(40):
        own, times = [i for i in range(200) if i % 40 == p], 2 if p == 7 else 1
        assert got[p] == (times * sum(1.0 + i % 3 for i in own), times * len(own), len({i % 5 for i in own}))


def test_panel_fills_gaps_in_many_tasks(spark, small_tasks):
    rows = [(s, date(2020, m, 1), float(s * m)) for s in range(30) for m in (1 + s % 3, 6, 9)] + [(1, date(2020, 12, 1), 5.0)]
    panel = FC.complete_panel(spark.createDataFrame(rows, "s long, p date, v double"), "s", "p", "v")
    assert panel.rdd.getNumPartitions() > 8
    seen = {(s, p): v for s, p, v in rows}
    want = {(s, date(2020, m, 1)): (seen.get((s, date(2020, m, 1)), 0.0), (s, date(2020, m, 1)) in seen) for s in range(30) for m in range(1 + s % 3, 13)}
    assert {(r.series_id, r.period): (r.y, r.observed) for r in panel.collect()} == want


def test_cross_sell_in_many_tasks(spark, small_tasks):
    items = spark.createDataFrame([(o, p) for o in range(60) for p in (o % 4, 4 + o % 3, 9)], "order_id long, product long")
    out = R.cross_sell_pairs(items, rows=180)
    assert out.rdd.getNumPartitions() > 8
    assert sum(r.orders for r in out.collect()) == 180


def test_a_task_keeps_k_vectors_a_query(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 16)
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(1000)], "vec_id long, embedding array<float>").repartition(2)
    qs = df.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vec")
    scored = N._ranked(df, qs, 5, ("query_id", "query_vec", "vec_id", "embedding"), N._one_key, N._one_key, (1, 1, 1), 0, 2)
    assert scored.count() <= 50 * 5 * 2
