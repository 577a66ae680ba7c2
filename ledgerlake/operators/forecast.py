"""Panel forecasting over many monthly series at once.

A panel is ``(series_id, period, y)``: product x month, country x month,
KPI x month... Every operator works on all series together; windows are
partitioned by series (a series holds at most one row per month, so no
window task grows with the data); model fits reduce each series to
sufficient statistics with one aggregation; the per-series solve is an elimination
written out in plain columns.
"""

from __future__ import annotations

import math
from typing import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.columns import r6, rnd, safe_div
from ledgerlake.operators.common import settled, spread
from ledgerlake.operators.trees import BoostedTrees, fit_together

S, P, Y = "series_id", "period", "y"

# Fixed values of the reference's forecast diagnostics and intervals.
LJUNG_BOX_LAGS = 10
CHI2_95_10 = 18.307          # 95 % quantile of chi-square with 10 degrees of freedom
DF_CRITICAL_5PCT = -2.86     # Dickey-Fuller 5 % critical value (constant, no trend)
Z_95 = 1.96
ADVICE = {
    "nonstationary": "Series may be non-stationary. Consider differencing or detrending.",
    "autocorrelated": "Significant autocorrelation detected. SARIMA or Prophet might be more suitable.",
    "seasonal": "Seasonal patterns detected. Consider using seasonal models.",
    "missing": "Series contains {pct}% missing values. Consider imputation.",
}


def _w(series: str = S, period: str = P):
    return Window.partitionBy(series).orderBy(period)


def complete_panel(long: DataFrame, series: str, period: str, value: str, drop_last: bool = False) -> DataFrame:
    """Monthly panel: every series from its first month to the last month of
    the data (one that the caller knows to be partial goes with ``drop_last``),
    missing months 0 with ``observed`` = false. The observed months, computed once,
    are spread by series, and each is followed by the months up to the next one, so
    there is no series x month cross product, and what follows by series needs no shuffle."""
    d = settled(long.select(F.col(series).alias(S), F.to_date(F.date_trunc("MONTH", F.col(period))).alias(P),
                            F.col(value).cast("double").alias(Y)) \
                    .groupBy(S, P).agg(F.sum(Y).alias(Y)).where(F.col(P).isNotNull()))
    b = d.agg(F.min(P).alias("lo"), F.max(P).alias("hi"), F.approx_count_distinct(S).alias("n")).first()
    months = 1 if b["hi"] is None else 12 * (b["hi"].year - b["lo"].year) + b["hi"].month - b["lo"].month + 1
    end = F.lit(b["hi"]).cast("date")
    if drop_last:
        end = F.add_months(end, -1)
    d = spread(d, b["n"] * months, S).where(F.col(P) <= end).withColumn("_to", F.coalesce(F.add_months(F.lead(P).over(_w()), -1), end))
    d = d.select(S, F.col(P).alias("_p"), Y, F.explode(F.sequence(P, "_to", F.expr("INTERVAL 1 MONTH"))).alias(P))
    y = F.when(F.col(S).isNotNull() & (F.col(P) == F.col("_p")), F.col(Y))
    return d.select(S, P, F.coalesce(y, F.lit(0.0)).alias(Y), y.isNotNull().alias("observed"))


def _by_series(panel: DataFrame) -> DataFrame:
    """The panel computed once and spread by series, for several passes."""
    panel = settled(panel)
    return spread(panel, panel.count(), S)


def lag_features(panel: DataFrame, lags: int = 12, horizon: int = 1, external: DataFrame | None = None) -> DataFrame:
    """lag_1..lag_n, month, quarter, 3- and 6-period means of the shifted
    series, external regressors (left join on the period), target =
    y shifted ``horizon`` ahead; incomplete rows dropped."""
    w = _w()
    cols = [F.lag(Y, i).over(w).alias(f"lag_{i}") for i in range(1, lags + 1)]
    roll = []
    for k in (3, 6):
        fr = w.rowsBetween(-k, -1)
        roll.append(F.when(F.count(Y).over(fr) == k, F.avg(Y).over(fr)).alias(f"rolling_{k}_mean"))
    f = panel.select(S, P, Y, *cols, F.month(P).alias("month"), F.quarter(P).alias("quarter"), *roll,
                     F.lead(Y, horizon).over(w).alias("y_target"))
    # rounding reads the window results as columns (a second projection), so
    # each window aggregate is computed once
    f = f.withColumns({c: r6(c) for c in ("rolling_3_mean", "rolling_6_mean")})
    if external is not None:
        f = f.join(external, P, "left")
    return f.dropna()


def calendar_features(panel: DataFrame, places: int = 2) -> DataFrame:
    """year, month, quarter, day of year, lags 1/2/3/6/12 and rolling mean
    and sample std over 3/6/12 periods including the current one (null until
    the window is full).

    The rolling figures come from integer sums of ``y`` and of its square in
    units of 10**-``places`` (cents), so they do not depend on the order of
    addition; one division, resp. one square root, ends each.
    """
    w, steps = _w(), (3, 6, 12)
    out = [F.year(P).alias("year"), F.month(P).alias("month"), F.quarter(P).alias("quarter"),
           F.dayofyear(P).alias("dayofyear")]
    out += [F.lag(Y, k).over(w).alias(f"lag_{k}") for k in (1, 2, 3, 6, 12)]
    unit = float(10 ** places)
    cents = panel.withColumn("_c", F.rint(F.col(Y) * F.lit(unit)).cast("decimal(18,0)"))
    # running sums, each row added once; a rolling sum is the difference of two of them
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = cents.select(S, P, Y, *out, F.count(Y).over(upto).alias("_n"), F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_s"),
                     F.coalesce(F.sum(F.col("_c") * F.col("_c")).over(upto), F.lit(0)).alias("_q"))
    d = d.select("*", *[F.lag(f"_{x}", k).over(w).alias(f"_{x}{k}") for x in "nsq" for k in steps])
    rolled = {}
    for k in steps:
        n, s1, s2 = (F.col(f"_{x}") - F.coalesce(F.col(f"_{x}{k}"), F.lit(0)) for x in "nsq")
        s1, s2 = s1.cast("decimal(19,0)"), s2.cast("decimal(36,0)")
        var = (s2 * F.lit(k) - s1 * s1).cast("double") / F.lit(float(k * (k - 1)))
        full = n == k
        rolled[f"rolling_mean_{k}"] = r6(F.when(full, s1.cast("double") / F.lit(k * unit)))
        rolled[f"rolling_std_{k}"] = r6(F.when(full, F.sqrt(var) / F.lit(unit)))
    return d.withColumns(rolled).drop(*[f"_{x}" for x in "nsq"], *[f"_{x}{k}" for x in "nsq" for k in steps])


def naive_forecast(panel: DataFrame, horizon: int = 6) -> DataFrame:
    """the last value carried forward ``horizon`` months."""
    last = panel.groupBy(S).agg(F.max(P).alias("_p"), F.max_by(Y, P).alias("_y"))
    return last.select(S, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "_p", "_y") \
               .select(S, F.add_months("_p", F.col("h")).alias(P), "h", F.col("_y").alias("yhat"))


# ---------------------------------------------------------------- trend + season
# The regressors are 1, t, sin and cos of 2 pi month / 12. Twice a sine or cosine of
# a whole month is a + b * sqrt(3) with the whole numbers below (January to December),
# so that all sums over a series are sums of whole numbers, exact in any order.
_K = 4
ROOT3 = 1.7320508075688772
SIN_A, SIN_B = (1, 0, 2, 0, 1, 0, -1, 0, -2, 0, -1, 0), (0, 1, 0, 1, 0, 0, 0, -1, 0, -1, 0, 0)
COS_A, COS_B = (0, 1, 0, -1, 0, -2, 0, -1, 0, 1, 0, 2), (1, 0, 0, 0, -1, 0, -1, 0, 0, 0, 1, 0)


def _of_month(values: Sequence[int], period=P):
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.month(period))


def _sin_cos(period=P):
    def wave(a, b):
        return (_of_month(a, period) + _of_month(b, period) * F.lit(ROOT3)) / F.lit(2.0)
    return wave(SIN_A, SIN_B), wave(COS_A, COS_B)


def _line(t, period=P):
    """The fitted curve at ``t``: always the same operations in the same order."""
    sin, cos = _sin_cos(period)
    return F.col("b0") + F.col("b1") * t + F.col("b2") * sin + F.col("b3") * cos


def _with_t(panel: DataFrame) -> DataFrame:
    start = F.min(P).over(Window.partitionBy(S))
    return panel.withColumn("_t", F.months_between(P, start).cast("double"))


def _statistics(panel: DataFrame, places: int | None) -> DataFrame:
    """X'X (m00..m33), X'y (r0..r3) and y'y per series from sums of products
    of whole numbers; ``y`` counts in units of 10**-``places`` (None: as doubles)."""
    start = F.min(P).over(_w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    y = F.col(Y) if places is None else F.rint(F.col(Y) * F.lit(float(10 ** places))).cast("decimal(18,0)")
    rows = panel.select(S, P, y.alias("y"), F.months_between(P, start).cast("int").alias("t"), F.month(P).alias("month"))
    t = F.col("t").cast("bigint")
    by_y = F.sum(F.col("y") * (F.col("t").cast("decimal(9,0)") if places is not None else F.col("t")))
    # The waves depend on the month of the year alone: rows are added up by it first.
    m = rows.groupBy(S, "month").agg(F.count("*").alias("n"), F.max("t").alias("t_last"), F.max(P).alias("p_last"), F.sum(t).alias("t"), F.sum(t * t).alias("tt"),
                                     F.sum("y").alias("y"), by_y.alias("ty"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    m = m.select("*", *[F.element_at(F.array(*[F.lit(v) for v in values]), F.col("month")).alias(n)
                        for n, values in (("a", SIN_A), ("b", SIN_B), ("u", COS_A), ("v", COS_B))])
    c = {n: F.col(n) for n in "nyabuvt"}
    sums = {"n": F.sum("n"), "t_last": F.max("t_last"), "p_last": F.max("p_last"), "t": F.sum("t"), "tt": F.sum("tt"), "y": F.sum("y"), "ty": F.sum("ty"), "yy": F.sum("yy"),
            "ss": F.sum(c["n"] * (c["a"] * c["a"] + 3 * c["b"] * c["b"])), "cc": F.sum(c["n"] * (c["u"] * c["u"] + 3 * c["v"] * c["v"])),
            "sca": F.sum(c["n"] * (c["a"] * c["u"] + 3 * c["b"] * c["v"])), "scb": F.sum(c["n"] * (c["a"] * c["v"] + c["b"] * c["u"]))}
    for n in "abuv":
        sums |= {n: F.sum(c["n"] * c[n]), "t" + n: F.sum(c["t"] * c[n]), "y" + n: F.sum(c["y"] * (c[n].cast("decimal(9,0)") if places is not None else c[n]))}
    g = m.groupBy(S).agg(*[x.alias("_" + n) for n, x in sums.items()])

    def whole_sum(n):
        return F.col("_" + n).cast("double")

    def half(n, m):
        return (whole_sum(n) + whole_sum(m) * F.lit(ROOT3)) / F.lit(2.0)

    return g.select(S, F.col("_n").alias("n"), F.col("_t_last").cast("double").alias("t_last"), F.col("_p_last").alias("p_last"), whole_sum("yy").alias("yy"),
                    whole_sum("n").alias("m00"), whole_sum("t").alias("m01"), half("a", "b").alias("m02"), half("u", "v").alias("m03"),
                    whole_sum("tt").alias("m11"), half("ta", "tb").alias("m12"), half("tu", "tv").alias("m13"),
                    (whole_sum("ss") / F.lit(4.0)).alias("m22"), ((whole_sum("sca") + whole_sum("scb") * F.lit(ROOT3)) / F.lit(4.0)).alias("m23"),
                    (whole_sum("cc") / F.lit(4.0)).alias("m33"),
                    whole_sum("y").alias("r0"), whole_sum("ty").alias("r1"), half("ya", "yb").alias("r2"), half("yu", "yv").alias("r3"))


#: A pivot below this share of its diagonal entry counts as zero: the regressor depends on those before it.
PIVOT = 1e-12


def eliminated(stats: DataFrame, k: int = _K) -> DataFrame:
    """Solve the k x k normal equations of every row by elimination, in plain columns:
    adds b0..b(k-1) and ``sse``. One projection per step; a dependent regressor gets 0."""
    d = stats.withColumns({f"_d{i}": F.col(f"m{i}{i}") for i in range(k)})
    for i in range(k):
        ok = F.col(f"m{i}{i}") > F.lit(PIVOT) * F.col(f"_d{i}")
        d = d.withColumns({f"_f{i}{j}": F.when(ok, F.col(f"m{i}{j}") / F.col(f"m{i}{i}")).otherwise(0.0) for j in range(i + 1, k)}
                          | {f"_g{i}": F.when(ok, F.col(f"r{i}") / F.col(f"m{i}{i}")).otherwise(0.0)})
        d = d.withColumns({f"m{x}{y}": F.col(f"m{x}{y}") - F.col(f"_f{i}{x}") * F.col(f"m{i}{y}") for x in range(i + 1, k) for y in range(x, k)}
                          | {f"r{x}": F.col(f"r{x}") - F.col(f"_f{i}{x}") * F.col(f"r{i}") for x in range(i + 1, k)})
    for i in reversed(range(k)):
        x = F.col(f"_g{i}")
        for j in range(i + 1, k):
            x = x - F.col(f"_f{i}{j}") * F.col(f"b{j}")
        d = d.withColumn(f"b{i}", x)
    sse = F.col("yy")
    for i in range(k):
        sse = sse - F.col(f"r{i}") * F.col(f"_g{i}")
    return d.withColumn("sse", F.greatest(sse, F.lit(0.0)))


def seasonal_trend_fit(panel: DataFrame, min_points: int = 12, places: int | None = None) -> DataFrame:
    """F4 fit: least squares of y on [1, t, sin, cos(2 pi month / 12)] per series from
    sufficient statistics (one aggregation), solved by elimination in plain columns.
    Returns (series_id, n, t_last, last period, b0..b3, sigma). With ``places`` the sums
    are of whole units of 10**-places, so the result does not depend on the order of rows."""
    unit = F.lit(1.0 if places is None else float(10 ** places))
    fit = eliminated(_statistics(panel, places).where(F.col("n") >= min_points))
    dof = F.greatest(F.col("n").cast("double") - _K, F.lit(1.0))
    return fit.select(S, "n", "t_last", "p_last", *[(F.col(f"b{i}") / unit).alias(f"b{i}") for i in range(_K)],
                      (F.sqrt(F.col("sse") / dof) / unit).alias("sigma"))


def seasonal_trend_forecast(panel: DataFrame, horizon: int = 6, min_points: int = 12, places: int | None = None) -> DataFrame:
    """``horizon`` future months per series with yhat and a +-1.96 sigma
    interval (the stand-in for the Prophet / auto-ARIMA calls: same inputs,
    same ds/yhat/yhat_lower/yhat_upper outputs)."""
    fit = seasonal_trend_fit(panel, min_points, places)
    f = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    f = f.withColumn(P, F.add_months("p_last", F.col("h"))).withColumn("_t", F.col("t_last") + F.col("h"))
    yhat = _line(F.col("_t"))
    band = F.lit(Z_95) * F.col("sigma")
    return f.select(S, P, "h", r6(yhat).alias("yhat"), r6(yhat - band).alias("yhat_lower"),
                    r6(yhat + band).alias("yhat_upper"))


def seasonal_trend_fitted(panel: DataFrame, fit: DataFrame) -> DataFrame:
    """In-sample fitted values of a ``seasonal_trend_fit`` (join on the series)."""
    p = _with_t(panel).join(fit.select(S, "b0", "b1", "b2", "b3"), S)
    return p.select(S, P, Y, _line(F.col("_t")).alias("yhat"))


# ---------------------------------------------------------------- boosted trees
GBT_LAGS = (1, 2, 3, 6, 12)


def _gbt_training_rows(panel: DataFrame, lags: Sequence[int]) -> DataFrame:
    w = _w()
    cols = [F.lag(Y, k).over(w).alias(f"lag_{k}") for k in lags]
    rows = panel.select(S, P, Y, *cols, *[F.lag(Y, k).over(w).alias(f"_{k}") for k in range(1, 7)])
    roll = []
    for k in (3, 6):
        earlier = [F.col(f"_{i}") for i in range(k, 0, -1)]
        total = sum((F.coalesce(c, F.lit(0.0)) for c in earlier), F.lit(0.0))
        roll.append(safe_div(total, sum((c.isNotNull().cast("double") for c in earlier), F.lit(0.0))).alias(f"roll_{k}"))
    return rows.select(S, P, Y, *[f"lag_{k}" for k in lags], *roll, F.month(P).cast("double").alias("month"),
                       F.quarter(P).cast("double").alias("quarter")).dropna()


def _feature_names(lags):
    return [f"lag_{k}" for k in lags] + ["roll_3", "roll_6", "month", "quarter"]


def gbt_fit(panel: DataFrame, lags: Sequence[int] = GBT_LAGS, max_iter: int | None = None, max_depth: int = 5,
            seed: int = 42, rows: DataFrame | None = None) -> BoostedTrees:
    """F5 fit: one global model of boosted trees over the lag features of every series,
    fitted when first used. ``rows``: the panel's feature rows, if at hand."""
    return _gbt_on(settled(_gbt_training_rows(panel, lags)) if rows is None else rows, lags, max_iter or TREES, max_depth, seed)


#: Few trees of a larger step: each tree level is a pass over the rows.
TREES, STEP = 12, 0.25


def _gbt_on(rows: DataFrame, lags: Sequence[int], max_iter: int = TREES, max_depth: int = 5, seed: int = 42) -> BoostedTrees:
    return BoostedTrees(rows, _feature_names(lags), Y, max_iter, max_depth, STEP, seed)


CV_FOLDS = 5


def month_folds(panel: DataFrame, n_folds: int = CV_FOLDS) -> list[tuple]:
    """(first, last) test month of each of ``n_folds`` folds over the months of the
    whole panel, in time order: the months are cut into n_folds + 1 runs of equal
    length (the first takes the remainder), each but the first is a test."""
    b = panel.agg(F.min(P).alias("lo"), F.max(P).alias("hi")).first()
    if b["lo"] is None:
        return []
    months = pd.date_range(b["lo"], b["hi"], freq="MS").date
    size = len(months) // (n_folds + 1)
    if size == 0:
        return []
    starts = range(len(months) - n_folds * size, len(months), size)
    return [(months[i], months[i + size - 1]) for i in starts]


def gbt_cv_errors(panel: DataFrame, lags: Sequence[int] = GBT_LAGS, n_folds: int = CV_FOLDS, fit=None,
                  rows: DataFrame | None = None, beside: Sequence = ()) -> DataFrame:
    """(series, period, y, yhat, error, fold) out of fold: each fold's months are
    predicted one step ahead by one global model that saw earlier months only.
    ``fit``: panel rows -> model, by default the boosted trees. Folds without earlier
    rows are left out. ``rows``: the panel's feature rows, if at hand. Boosted trees are
    fitted in the same passes, with those of ``beside``."""
    rows = settled(_gbt_training_rows(panel, lags)) if rows is None else rows
    got, folds = [], []
    for k, (first, last) in enumerate(month_folds(rows, n_folds)):
        train = rows.where(F.col(P) < F.lit(first))
        if train.isEmpty():
            continue
        folds.append((k, first, last, (fit or (lambda x: _gbt_on(x, lags)))(train)))
    fit_together([*beside, *[model for *_, model in folds]])
    for k, first, last, model in folds:
        test = model.transform(rows.where(F.col(P).between(F.lit(first), F.lit(last))))
        got.append(test.select(S, P, Y, F.col("prediction").alias("yhat"), (F.col(Y) - F.col("prediction")).alias("error"), F.lit(k).alias("fold")))
    if not got:
        return rows.select(S, P, Y, F.col(Y).alias("yhat"), F.lit(0.0).alias("error"), F.lit(0).alias("fold")).limit(0)
    out = got[0]
    for g in got[1:]:
        out = out.unionByName(g)
    return out


def gbt_forecast(panel: DataFrame, horizon: int = 6, lags: Sequence[int] = GBT_LAGS, model=None,
                 min_points: int = 13, n_folds: int = CV_FOLDS, rows: DataFrame | None = None) -> DataFrame:
    """recursive multi-step forecast with one global model. The state of
    a series is its last max(lags) values (an array, bounded); each step
    derives the features from the state, predicts, appends the prediction
    and is checkpointed (reliable checkpoint) so lineage stays flat.
    Interval: +-1.96 x the standard deviation of the series' errors on the folds
    that its models had not seen (``gbt_cv_errors``). ``rows``: the feature rows of the
    panel, if at hand; then the panel is taken as spread by series."""
    if rows is None:
        panel = _by_series(panel)
        rows = settled(_gbt_training_rows(panel, lags))
    model = model or _gbt_on(rows, lags)
    errors = gbt_cv_errors(panel, lags, n_folds, rows=rows, beside=[model])
    out = recursive_forecast(panel, model, horizon, lags)
    resid = errors.groupBy(S).agg(F.stddev_pop("error").alias("_sd"))
    out = out.join(resid, S, "left")
    band = F.lit(Z_95) * F.coalesce(F.col("_sd"), F.lit(0.0))
    return out.select(S, P, "h", r6("yhat").alias("yhat"), r6(F.col("yhat") - band).alias("yhat_lower"),
                      r6(F.col("yhat") + band).alias("yhat_upper"))


def recursive_forecast(panel: DataFrame, model, horizon: int, lags: Sequence[int] = GBT_LAGS, weight: float = 1.0) -> DataFrame:
    """(series, period, h, yhat): ``weight`` x model + (1 - weight) x the last value of
    the state, which is what the next step sees. ``model`` needs ``transform`` to add a
    ``prediction`` to lag, roll, month and quarter columns. Series shorter than the
    longest lag are left out. Each step is written to the shared folder."""
    depth = max(lags)
    recent = panel.withColumn("_rn", F.row_number().over(Window.partitionBy(S).orderBy(F.desc(P)))).where(F.col("_rn") <= depth)
    state = recent.groupBy(S).agg(F.array_sort(F.collect_list(F.struct(P, Y))).alias("_hist"),
                                  F.max(P).alias("_p"), F.count(F.lit(1)).alias("_n")) \
                  .where(F.col("_n") >= depth) \
                  .select(S, "_p", F.transform("_hist", lambda s: s[Y]).alias("_v"))
    steps = []
    for h in range(1, horizon + 1):
        nxt = F.add_months("_p", 1)
        means = {f"roll_{k}": F.aggregate(F.slice("_v", -k, k), F.lit(0.0), lambda a, x: a + x) / F.lit(float(k)) for k in (3, 6)}
        feats = state.select(S, "_p", "_v", *[F.element_at("_v", -k).alias(f"lag_{k}") for k in lags],
                             *[m.alias(n) for n, m in means.items()],
                             F.month(nxt).cast("double").alias("month"), F.quarter(nxt).cast("double").alias("quarter"))
        blend = F.lit(weight) * F.col("prediction") + F.lit(1 - weight) * F.element_at("_v", -1) if weight != 1.0 else F.col("prediction")
        state = settled(model.transform(feats).select(S, F.add_months("_p", 1).alias("_p"), F.concat(F.slice("_v", 2, depth - 1), F.array(blend)).alias("_v")))
        steps.append(state.select(S, F.col("_p").alias(P), F.lit(h).alias("h"), F.element_at("_v", -1).alias("yhat")))
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out


# ---------------------------------------------------------------- evaluation
def naive_backtest(panel: DataFrame) -> DataFrame:
    """One-step-ahead naive predictions over history: yhat_t = y_{t-1}."""
    return panel.select(S, P, Y, F.lag(Y, 1).over(_w()).alias("yhat")).where(F.col("yhat").isNotNull()) \
                .withColumn("model", F.lit("naive"))


def residual_interval(pred: DataFrame, lower: float = 0.025, upper: float = 0.975) -> DataFrame:
    """per series (and model) the 2.5 % / 97.5 % quantiles of the residuals
    y - yhat: the deterministic limit of the reference's residual bootstrap."""
    keys = [S] + (["model"] if "model" in pred.columns else [])
    w = Window.partitionBy(*keys).orderBy(F.col("_e").asc_nulls_last())
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = pred.select(*keys, (F.col(Y) - F.col("yhat")).alias("_e")) \
                 .withColumns({"_at": F.row_number().over(w) - 1, "_m": F.count("_e").over(whole)})
    found, ends = [], {}
    for name, p in (("lower", lower), ("upper", upper)):
        place = (F.col("_m") - 1) * F.lit(p)
        for end, at in (("a", F.floor(place)), ("b", F.ceil(place))):
            found.append(F.max(F.when(F.col("_at") == at, F.col("_e"))).alias(f"_{name}_{end}"))
        a, b, last = F.col(f"_{name}_a"), F.col(f"_{name}_b"), (F.col("_m") - 1) * F.lit(p)
        ends[name] = F.when(a == b, a).otherwise((F.ceil(last) - last) * a + (last - F.floor(last)) * b)
    g = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("_m").alias("_m"), *found)
    return g.select(*keys, "n", r6(ends["lower"]).alias("resid_lower"), r6(ends["upper"]).alias("resid_upper"))


def forecast_accuracy(pred: DataFrame) -> DataFrame:
    """F8: MAE, RMSE, MAPE % (over non-zero actuals) and R^2 per (series, model)."""
    e = F.col(Y) - F.col("yhat")
    g = pred.groupBy(S, "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("_mae"), F.avg(e * e).alias("_mse"),
        F.avg(F.when(F.col(Y) != 0, F.abs(e / F.col(Y)))).alias("_mape"),
        F.sum(e * e).alias("_sse"), F.var_pop(Y).alias("_var"))
    r2 = F.lit(1.0) - safe_div(F.col("_sse"), F.col("_var") * F.col("n"))
    return g.select(S, "model", "n", r6("_mae").alias("mae"), r6(F.sqrt("_mse")).alias("rmse"),
                    r6(F.col("_mape") * 100).alias("mape"), r6(F.when(F.col("_var") > 0, r2)).alias("r2"))


def _split(panel: DataFrame, test_frac: float):
    """(train, test) rows of every series; test rows keep ``_t``, the months since the
    start of their series."""
    whole = _w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = panel.withColumns({"_rn": F.row_number().over(_w()), "_n": F.count(F.lit(1)).over(whole), "_start": F.min(P).over(whole)})
    cut = F.floor(F.col("_n") * F.lit(1 - test_frac))
    return (p.where(F.col("_rn") <= cut).select(*panel.columns),
            p.where(F.col("_rn") > cut).select(*panel.columns, F.months_between(P, "_start").cast("double").alias("_t")))


def select_forecast_model(panel: DataFrame, test_frac: float = 0.2, min_points: int = 12,
                          with_gbt: bool = False, places: int | None = None) -> DataFrame:
    """hold out the last ``test_frac`` of every series, forecast it with
    each model fitted on the rest, score (F8) and flag the lowest RMSE per
    series (ties -> model name). Output (series, model, n, mae, rmse, mape, r2, chosen)."""
    train, test = _split(panel, test_frac)
    last = train.groupBy(S).agg(F.max_by(Y, P).alias("_last"))
    fit = seasonal_trend_fit(train, min_points, places).select(S, "b0", "b1", "b2", "b3", F.lit(True).alias("_fitted"))
    # both predictions of a test row side by side: everything stays with its series
    both = F.array(F.struct(F.lit("naive").alias("model"), F.col("_last").alias("yhat")),
                   F.when(F.col("_fitted"), F.struct(F.lit("seasonal_trend").alias("model"), _line(F.col("_t")).alias("yhat"))))
    preds = test.join(last, S).join(fit, S, "left").select(S, P, Y, F.explode(F.array_compact(both)).alias("_m")) \
                .select(S, P, Y, F.col("_m.yhat").alias("yhat"), F.col("_m.model").alias("model"))
    if with_gbt:
        train = _by_series(train)
        rows = settled(_gbt_training_rows(train, GBT_LAGS))
        model = gbt_fit(train, rows=rows)
        g = gbt_forecast(train, horizon=test.groupBy(S).count().agg(F.max("count")).first()[0] or 1, model=model, rows=rows)
        gp = test.join(g.select(S, P, "yhat"), [S, P]).select(S, P, Y, "yhat", F.lit("gbt").alias("model"))
        preds = preds.unionByName(gp)
    acc = forecast_accuracy(preds)
    w = Window.partitionBy(S).orderBy(F.col("rmse").asc_nulls_last(), "model")
    return acc.withColumn("chosen", F.row_number().over(w) == 1)


def ensemble_forecast(panel: DataFrame, horizon: int = 6, weight: float = 0.8, min_rows: int = 24, holdout: int = 6,
                      lags: Sequence[int] = GBT_LAGS, fit=None) -> DataFrame:
    """recursive blend of ``weight`` x model and (1 - weight) x the last value,
    each blended value feeding the next step. The one global model (``fit``: feature
    rows -> model, by default boosted trees) sees all but the last ``holdout`` months
    of each series; the 2.5 / 97.5 % quantiles of its one-step errors there are the
    interval. Series need ``min_rows`` feature rows."""
    rows = _gbt_training_rows(panel, lags)
    over = Window.partitionBy(S)
    rows = settled(rows.withColumns({"_n": F.count(F.lit(1)).over(over), "_back": F.row_number().over(over.orderBy(F.desc(P)))})
                       .where(F.col("_n") >= min_rows))
    model = (fit or (lambda x: _gbt_on(x, lags)))(rows.where(F.col("_back") > holdout).drop("_n", "_back"))
    test = model.transform(rows.where(F.col("_back") <= holdout)).select(S, P, Y, F.col("prediction").alias("yhat"))
    band = residual_interval(test).select(S, "resid_lower", "resid_upper")
    fc = recursive_forecast(panel.join(rows.select(S).distinct(), S, "left_semi"), model, horizon, lags, weight)
    return fc.join(band, S).select(S, P, "h", r6("yhat").alias("yhat"), r6(F.col("yhat") + F.col("resid_lower")).alias("yhat_lower"),
                                   r6(F.col("yhat") + F.col("resid_upper")).alias("yhat_upper"))


def series_diagnostics(panel: DataFrame, lags: int = LJUNG_BOX_LAGS) -> DataFrame:
    """per series Ljung-Box Q over ``lags`` lags (vs chi2 0.95), lag-12
    autocorrelation (seasonal when n >= 24 and r12 > 1.96 / sqrt(n)),
    Dickey-Fuller t of the lagged level in the regression of the first
    difference (stationary when t < -2.86), % months never observed, and the
    advice text. Autocorrelations come from window lags and one groupBy."""
    w = _w()
    # the mean over the rows in order, so that one sort serves both windows
    mean = F.avg(Y).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = panel.select(S, P, Y, "observed", (F.col(Y) - mean).alias("_d"))
    lagged = d.select("*", *[F.lag("_d", k).over(w).alias(f"_l{k}") for k in list(range(1, lags + 1)) + [12]],
                      F.lag(Y, 1).over(w).alias("_y1"))
    dy = F.col(Y) - F.col("_y1")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_den"),
            F.avg(F.when(~F.col("observed"), 1.0).otherwise(0.0)).alias("_miss"),
            F.regr_slope(dy, F.col("_y1")).alias("_b"), F.regr_intercept(dy, F.col("_y1")).alias("_a"),
            F.regr_count(dy, F.col("_y1")).alias("_m"), F.regr_sxx(dy, F.col("_y1")).alias("_sxx"),
            F.regr_syy(dy, F.col("_y1")).alias("_syy"), F.regr_sxy(dy, F.col("_y1")).alias("_sxy")]
    aggs += [F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_n{k}") for k in list(range(1, lags + 1)) + [12]]
    g = lagged.groupBy(S).agg(*aggs)
    n = F.col("n").cast("double")
    q = F.lit(0.0)
    for k in range(1, lags + 1):
        rk = safe_div(F.col(f"_n{k}"), F.col("_den"))
        q = q + rk * rk / (n - F.lit(float(k)))
    q = n * (n + 2) * q
    r12 = safe_div(F.col("_n12"), F.col("_den"))
    sse = F.col("_syy") - F.col("_b") * F.col("_sxy")
    se = F.sqrt(safe_div(sse, (F.col("_m") - 2).cast("double")) / F.col("_sxx"))
    t = safe_div(F.col("_b"), se)
    out = g.select(S, "n", r6(q).alias("ljung_box_q"), r6(r12).alias("acf_12"), r6(t).alias("df_t"),
                   r6(F.col("_miss") * 100).alias("missing_pct"))
    out = out.withColumn("stationary", F.coalesce(F.col("df_t") < DF_CRITICAL_5PCT, F.lit(False))) \
             .withColumn("autocorrelated", F.coalesce(F.col("ljung_box_q") > CHI2_95_10, F.lit(False))) \
             .withColumn("seasonal", F.coalesce((F.col("n") >= 24) &
                                                (F.col("acf_12") > F.lit(Z_95) / F.sqrt(F.col("n").cast("double"))),
                                                F.lit(False)))
    msgs = F.array_compact(F.array(
        F.when(~F.col("stationary"), F.lit(ADVICE["nonstationary"])),
        F.when(F.col("autocorrelated"), F.lit(ADVICE["autocorrelated"])),
        F.when(F.col("seasonal"), F.lit(ADVICE["seasonal"])),
        F.when(F.col("missing_pct") > 0, F.replace(F.lit(ADVICE["missing"]), F.lit("{pct}"),
                                                   F.format_string("%.1f", rnd("missing_pct", 1))))))
    return out.withColumn("advice", F.concat_ws(" ", msgs))


def best_model_forecast(panel: DataFrame, horizon: int = 6, test_frac: float = 0.2, min_points: int = 12, with_gbt: bool = False,
                        places: int | None = None) -> DataFrame:
    """Select, then forecast: each series by the model that F9 flags on its hold-out,
    fitted on the whole series. (series, period, h, yhat, yhat_lower, yhat_upper, model).
    The naive model's interval are the quantiles of its one-step errors (F7)."""
    chosen = settled(select_forecast_model(panel, test_frac, min_points, with_gbt, places).where("chosen").select(S, "model"))
    errors = residual_interval(naive_backtest(panel)).select(S, "resid_lower", "resid_upper")
    naive = naive_forecast(panel, horizon).join(errors, S, "left").select(
        S, P, "h", "yhat", (F.col("yhat") + F.col("resid_lower")).alias("yhat_lower"), (F.col("yhat") + F.col("resid_upper")).alias("yhat_upper"))
    of_model = {"naive": naive, "seasonal_trend": seasonal_trend_forecast(panel, horizon, min_points, places)}
    if with_gbt:
        of_model["gbt"] = gbt_forecast(panel, horizon)
    out = None
    for name, fc in of_model.items():
        own = fc.join(chosen.where(F.col("model") == name).select(S), S, "left_semi").select(
            S, P, "h", *[r6(c).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")], F.lit(name).alias("model"))
        out = own if out is None else out.unionByName(own)
    return out


def multi_metric_forecast(monthly: DataFrame, metrics: Sequence[str], horizon: int = 6, min_points: int = 19, with_gbt: bool = False,
                          places: int | None = None) -> DataFrame:
    """every listed monthly KPI with at least ``min_points`` points, forecast by
    the model that wins its hold-out, one row per future month with
    ``{metric}_yhat``, ``_yhat_lower``, ``_yhat_upper`` and ``_model`` (null for a KPI
    with too few points)."""
    long = monthly.select("period", *[F.col(m).cast("double").alias(m) for m in metrics]) \
                  .unpivot(["period"], list(metrics), S, Y).where(F.col(Y).isNotNull())
    enough = Window.partitionBy(S)
    panel = settled(long.withColumn("_n", F.count("*").over(enough)).where(F.col("_n") >= min_points).select(S, F.col("period").alias(P), Y))
    fc = best_model_forecast(panel, horizon, with_gbt=with_gbt, places=places)
    return fc.groupBy(P).pivot(S, list(metrics)).agg(*[F.first(c).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper", "model")])
