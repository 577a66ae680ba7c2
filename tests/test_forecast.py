"""Forecast operators on synthetic panels with known structure."""

import math
from datetime import date

import numpy as np
import pytest

from ledgerlake.operators import forecast as FC


def _months(n, start=(2020, 1)):
    y, m = start
    out = []
    for _ in range(n):
        out.append(date(y, m, 1))
        m += 1
        if m == 13:
            y, m = y + 1, 1
    return out


def _panel(spark, series):
    rows = [(sid, p, float(v), True) for sid, pts in series.items() for p, v in pts]
    return spark.createDataFrame(rows, "series_id string, period date, y double, observed boolean")


def _seasonal(n, a=100.0, b=2.0, s=30.0, c=10.0):
    return [(p, a + b * t + s * math.sin(2 * math.pi * p.month / 12) + c * math.cos(2 * math.pi * p.month / 12))
            for t, p in enumerate(_months(n))]


def test_trend_season_fit_matches_numpy_lstsq(spark):
    rng = np.random.default_rng(7)
    pts = [(p, v + rng.normal(0, 3)) for p, v in _seasonal(40)]
    fit = FC.seasonal_trend_fit(_panel(spark, {"s": pts})).first()
    x = np.array([[1.0, t, math.sin(2 * math.pi * p.month / 12), math.cos(2 * math.pi * p.month / 12)]
                  for t, (p, _) in enumerate(pts)])
    y = np.array([v for _, v in pts])
    beta, res, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert [fit.b0, fit.b1, fit.b2, fit.b3] == pytest.approx(list(beta), rel=1e-9)
    assert fit.sigma == pytest.approx(math.sqrt(res[0] / (40 - 4)), rel=1e-9)


def test_forecast_extends_each_series_and_skips_short_ones(spark):
    panel = _panel(spark, {"long": _seasonal(30), "short": _seasonal(5)})
    fc = FC.seasonal_trend_forecast(panel, horizon=6, min_points=12).collect()
    assert {r.series_id for r in fc} == {"long"} and sorted(r.h for r in fc) == [1, 2, 3, 4, 5, 6]
    first = min(fc, key=lambda r: r.h)
    exp = dict(_seasonal(31))[_months(31)[-1]]
    assert first.period == _months(31)[-1] and first.yhat == pytest.approx(exp, abs=1e-4)
    assert first.yhat_lower <= first.yhat <= first.yhat_upper


def test_naive_and_selection_prefer_trend_season_on_seasonal_data(spark):
    panel = _panel(spark, {"a": _seasonal(36), "b": _seasonal(36, b=-1.0, s=50.0)})
    nv = FC.naive_forecast(panel, horizon=3).collect()
    assert {(r.series_id, r.h) for r in nv} == {(s, h) for s in "ab" for h in (1, 2, 3)}
    sel = {(r.series_id, r.model): r for r in FC.select_forecast_model(panel).collect()}
    assert sel[("a", "seasonal_trend")].chosen and sel[("b", "seasonal_trend")].chosen
    assert sel[("a", "seasonal_trend")].rmse < sel[("a", "naive")].rmse


def test_registered_selection_scores_the_boosted_trees(spark):
    from ledgerlake.plans.registry import QUERIES, load_all
    load_all()
    sf, models = "/root/testdata/sf0.001", {}
    for r in QUERIES["select_forecast_model"](spark, sf).collect():
        models.setdefault(r.series_id, []).append(r)
    two = {(r.series_id, r.model): r.rmse for r in QUERIES["select_forecast_model_two"](spark, sf).collect()}
    assert {s for s, m in two if m == "seasonal_trend"} == {s for s, m in models.items() if "gbt" in {r.model for r in m}}
    assert {(r.series_id, r.model) for m in models.values() for r in m if r.model != "gbt"} == set(two)
    for m in models.values():
        assert [r.model for r in m if r.chosen] == [min(m, key=lambda r: (r.rmse, r.model)).model]
    assert any(r.chosen for m in models.values() for r in m if r.model == "gbt")


def test_accuracy_metrics(spark):
    pred = spark.createDataFrame([("s", date(2020, 1, 1), 10.0, 12.0, "m"), ("s", date(2020, 2, 1), 20.0, 18.0, "m")],
                                 "series_id string, period date, y double, yhat double, model string")
    r = FC.forecast_accuracy(pred).first()
    assert (r.mae, r.rmse) == (2.0, 2.0) and r.mape == pytest.approx(15.0) and r.r2 == pytest.approx(1 - 8 / 50)


def test_recursive_gbt_produces_every_step(spark):
    panel = _panel(spark, {f"s{i}": _seasonal(30, a=100.0 + 10 * i) for i in range(4)})
    out = FC.gbt_forecast(panel, horizon=4).collect()
    assert len(out) == 16 and {r.h for r in out} == {1, 2, 3, 4}
    assert all(math.isfinite(r.yhat) and r.yhat_lower <= r.yhat <= r.yhat_upper for r in out)


def test_diagnostics_flags(spark):
    panel = _panel(spark, {"seasonal": _seasonal(48, b=0.0), "trend": [(p, float(t * t)) for t, p in enumerate(_months(48))]})
    d = {r.series_id: r for r in FC.series_diagnostics(panel).collect()}
    assert d["seasonal"].seasonal and d["seasonal"].autocorrelated
    assert not d["trend"].stationary and "non-stationary" in d["trend"].advice


class Doubling:
    """A model whose forecasts can be worked out by hand: twice the last value."""

    def __init__(self, seen):
        self.seen = seen

    def fit(self, rows):
        self.seen.append({(r.series_id, r.period) for r in rows.collect()})
        return self

    def transform(self, df):
        return df.withColumn("prediction", df["lag_1"] * 2.0)


def test_folds_are_in_time_order(spark):
    m = _months(14)
    panel = _panel(spark, {"a": [(p, 1.0) for p in m], "b": [(p, 1.0) for p in m[9:]]})
    assert FC.month_folds(panel, 5) == [(m[4], m[5]), (m[6], m[7]), (m[8], m[9]), (m[10], m[11]), (m[12], m[13])]
    assert FC.month_folds(panel, 20) == [] and FC.month_folds(panel.limit(0), 5) == []


def test_fold_errors_come_from_months_the_model_has_not_seen(spark):
    m = _months(24)
    y = {"a": [3.0 * i * i for i in range(24)], "b": [100.0 - i for i in range(24)]}
    seen = []
    got = FC.gbt_cv_errors(_panel(spark, {s: list(zip(m, v)) for s, v in y.items()}), n_folds=5, fit=Doubling(seen).fit).collect()
    usable = m[12:]  # 12 rows a series have all lags: folds of 2 months, the first 2 months only train
    assert {(r.series_id, r.period, r.fold) for r in got} == {(s, usable[2 + 2 * k + i], k) for s in "ab" for k in range(5) for i in (0, 1)}
    for r in got:
        i = m.index(r.period)
        assert r.error == pytest.approx(y[r.series_id][i] - 2 * y[r.series_id][i - 1])
    assert [max(p for _, p in s) for s in seen] == [usable[1 + 2 * k] for k in range(5)]


def test_interval_of_the_trees_is_their_error_out_of_fold(spark, monkeypatch):
    m = _months(24)
    rng = np.random.default_rng(1)
    y = rng.normal(100, 5, 24).tolist()
    stub = Doubling([])
    monkeypatch.setattr(FC, "_gbt_on", lambda rows, lags, *a: stub.fit(rows))
    out = sorted(FC.gbt_forecast(_panel(spark, {"a": list(zip(m, y))}), horizon=2).collect(), key=lambda r: r.h)
    sd = np.std([y[i] - 2 * y[i - 1] for i in range(14, 24)])
    assert [r.yhat for r in out] == pytest.approx([2 * y[-1], 4 * y[-1]])
    assert [r.yhat_upper - r.yhat for r in out] == pytest.approx([1.96 * sd] * 2, abs=1e-5)


def test_blend_feeds_the_next_step_and_its_interval_is_the_hold_out(spark):
    m = _months(36)
    y = [10.0 + (i * 7) % 5 for i in range(36)]
    seen = []
    panel = _panel(spark, {"a": list(zip(m, y)), "short": list(zip(m[:20], y[:20]))})
    out = sorted(FC.ensemble_forecast(panel, horizon=3, weight=0.8, fit=Doubling(seen).fit).collect(), key=lambda r: r.h)
    want, last = [], y[-1]
    for _ in range(3):
        last = 0.8 * 2 * last + 0.2 * last
        want.append(last)
    assert [(r.series_id, r.period) for r in out] == [("a", p) for p in _months(39)[36:]]
    assert [r.yhat for r in out] == pytest.approx(want)
    errors = [y[i] - 2 * y[i - 1] for i in range(30, 36)]
    lo, hi = np.quantile(errors, [0.025, 0.975])
    assert [r.yhat_lower for r in out] == pytest.approx([w + lo for w in want], abs=1e-5)
    assert [r.yhat_upper for r in out] == pytest.approx([w + hi for w in want], abs=1e-5)
    assert seen == [{("a", p) for p in m[12:30]}]


def test_elimination_of_dependent_columns_gives_zero(spark):
    rows = [(2.0, 4.0, 8.0, 6.0, 12.0, 18.0)]  # the second regressor is twice the first
    d = FC.eliminated(spark.createDataFrame(rows, "m00 double, m01 double, m11 double, r0 double, r1 double, yy double"), 2).first()
    assert (d.b0, d.b1, d.sse) == (3.0, 0.0, 0.0)


def test_sums_in_whole_units_do_not_depend_on_the_order(spark):
    rng = np.random.default_rng(5)
    pts = [(p, round(v + rng.normal(0, 30), 2)) for p, v in _seasonal(50)]
    a = FC.seasonal_trend_fit(_panel(spark, {"s": pts}), places=2).first()
    b = FC.seasonal_trend_fit(_panel(spark, {"s": pts[::-1]}).repartition(7), places=2).first()
    assert a == b
    plain = FC.seasonal_trend_fit(_panel(spark, {"s": pts})).first()
    assert [a.b0, a.b1, a.b2, a.b3, a.sigma] == pytest.approx([plain.b0, plain.b1, plain.b2, plain.b3, plain.sigma], rel=1e-9)


def test_each_series_is_forecast_by_its_winner(spark):
    walk = [(p, float((i * 37) % 11 + (1000 if i >= 24 else 0))) for i, p in enumerate(_months(36))]
    panel = _panel(spark, {"season": _seasonal(36), "step": walk})
    out = FC.best_model_forecast(panel, horizon=2).collect()
    assert {(r.series_id, r.model) for r in out} == {("season", "seasonal_trend"), ("step", "naive")}
    errors = [b[1] - a[1] for a, b in zip(walk, walk[1:])]
    step = min((r for r in out if r.series_id == "step"), key=lambda r: r.h)
    assert step.yhat == walk[-1][1] and step.yhat_lower == pytest.approx(walk[-1][1] + np.quantile(errors, 0.025), abs=1e-5)


def test_trees_fitted_together_are_those_of_mllib(spark, monkeypatch):
    """Every model has MLlib's predictions, with sampled cuts, ties, written-back rows and grouped sums."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.sql import functions as F
    from ledgerlake.operators import trees as T
    rng = np.random.default_rng(3)
    passes = []
    monkeypatch.setattr(T, "_summed", lambda *a, kept=T._summed: (passes.append(len(a[1])), kept(*a))[1])
    x = rng.integers(0, 40, (12_000, 3)) * (rng.random((12_000, 3)) < 0.6)
    y = np.round(x[:, 0] * 3.1 + (x[:, 1] > 9) * x[:, 2] + rng.normal(size=12_000), 2)
    rows = FC.settled(spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x.tolist(), y.tolist())], "a double, b double, c double, y double").coalesce(2))
    some = [rows, rows.where("a < 20"), rows.limit(20)]
    ours = [T.BoostedTrees(r, ["a", "b", "c"], "y", 5, 4, 0.25, 42) for r in some]
    T.fit_together(ours)
    assert len(passes) == 5 * 4 and passes[0] == 3
    for r, own in zip(some, ours):
        fit = GBTRegressor(labelCol="y", maxIter=5, stepSize=0.25, maxDepth=4, seed=42).fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(r))
        both = own.transform(fit.setPredictionCol("theirs").transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)))
        assert both.where(F.abs(F.col("prediction") - F.col("theirs")) > 1e-9).count() == 0
    grouped = T.BoostedTrees(rows.repartition(6), ["a", "b", "c"], "y", 5, 4, 0.25, 42)
    monkeypatch.setattr(T, "DIRECT", 2)
    monkeypatch.setattr(T, "GROUP", 2)
    monkeypatch.setattr(T, "CHUNK", 500)
    monkeypatch.setattr(T, "_edges", lambda m, kept=T._edges: kept(ours[0]))
    T.fit_together([grouped])
    assert all((a.feature == b.feature).all() and np.allclose(a.value, b.value) for a, b in zip(grouped.trees, ours[0].trees))


def test_folds_and_forecast_are_fitted_in_the_same_passes(spark, monkeypatch):
    from ledgerlake.operators import trees as T
    calls = []
    monkeypatch.setattr(FC, "fit_together", lambda models: (calls.append(len(models)), T.fit_together(models)))
    panel = _panel(spark, {f"s{i}": _seasonal(30, a=100.0 + 10 * i) for i in range(3)})
    assert FC.gbt_forecast(panel, horizon=2).count() == 6 and calls == [6]
    sel = FC.select_forecast_model(panel, with_gbt=True)
    assert {r.model for r in sel.collect()} == {"naive", "seasonal_trend", "gbt"} and len(calls) == 2
