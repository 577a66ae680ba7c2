"""Registered F-queries (panel forecasting) and, where SQL can express them,
their DuckDB oracles. The boosted trees are checked rows-only here, and by
tests with models whose forecasts can be worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import forecast as FC
from ledgerlake.operators import products as R
from ledgerlake.plans.metrics import monthly_metrics
from ledgerlake.plans import q_plans  # noqa: F401  (registers the monthly oracle first)
from ledgerlake.plans import trendsql as Q
from ledgerlake.plans.registry import ORACLES, register
from ledgerlake.plans.sqlkit import month
from ledgerlake.sources import tables as tb
from ledgerlake.sources.tables import with_views as V

MONTHLY_KPIS = ["revenue", "orders", "unique_customers", "aov", "returning_customers",
                "refund_count", "refund_amount", "cancel_count", "cancel_amount"]


def product_panel(spark, sf):
    """Product x month revenue (cents), each series to the last month of the data."""
    rows = tb.read_table(spark, sf, "lineitem").count()
    return FC.complete_panel(R.monthly_product_sales(tb.order_items(spark, sf), rows=rows), "product", "month", "revenue")


_PANEL = f"""d AS (SELECT product AS series_id, {month()} AS period, round_even(sum(line_price), 2) AS y
       FROM items_v WHERE product IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2),
e AS (SELECT max(period) AS hi FROM d),
lo AS (SELECT series_id, min(period) AS lo FROM d GROUP BY 1),
sp AS (SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)
         AS period FROM lo, e WHERE lo <= hi),
panel AS (SELECT sp.series_id, sp.period, coalesce(d.y, 0.0) AS y, d.y IS NOT NULL AS observed
          FROM sp LEFT JOIN d USING (series_id, period))"""


@register("product_panel", V(f"WITH {_PANEL} SELECT * FROM panel", "items_v"))
def _panel(spark, sf):
    return product_panel(spark, sf)


_LAGS = ", ".join(f"lag(y, {i}) OVER w AS lag_{i}" for i in range(1, 13))


@register("lag_features", V(f"""
WITH {_PANEL},
f AS (SELECT series_id, period, y, {_LAGS}, CAST(month(period) AS INTEGER) AS month,
        CAST(quarter(period) AS INTEGER) AS quarter,
        round_even(CASE WHEN count(y) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
                   THEN avg(y) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END, 6) AS rolling_3_mean,
        round_even(CASE WHEN count(y) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) = 6
                   THEN avg(y) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) END, 6) AS rolling_6_mean,
        lead(y, 1) OVER w AS y_target
      FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY period))
SELECT * FROM f WHERE COLUMNS(*) IS NOT NULL""", "items_v"))
def _f1(spark, sf):
    return FC.lag_features(product_panel(spark, sf))


def _roll(k):
    fr = f"(w ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    c = "CAST(round(y * 100) AS HUGEINT)"
    full = f"CASE WHEN count(y) OVER {fr} = {k} THEN"
    return (f"round_even({full} CAST(sum({c}) OVER {fr} AS DOUBLE) / {k * 100}.0 END, 6) AS rolling_mean_{k}, "
            f"round_even({full} sqrt(CAST({k} * sum({c} * {c}) OVER {fr} - sum({c}) OVER {fr} * sum({c}) OVER {fr} "
            f"AS DOUBLE) / {k * (k - 1)}.0) / 100.0 END, 6) AS rolling_std_{k}")


@register("calendar_features", V(f"""
WITH {_PANEL}
SELECT series_id, period, y, CAST(year(period) AS INTEGER) AS year, CAST(month(period) AS INTEGER) AS month,
  CAST(quarter(period) AS INTEGER) AS quarter, CAST(dayofyear(period) AS INTEGER) AS dayofyear,
  lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, lag(y, 3) OVER w AS lag_3, lag(y, 6) OVER w AS lag_6,
  lag(y, 12) OVER w AS lag_12, {_roll(3)}, {_roll(6)}, {_roll(12)}
FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY period)""", "items_v"))
def _f2(spark, sf):
    return FC.calendar_features(product_panel(spark, sf))


@register("naive_forecast", V(f"""
WITH {_PANEL},
l AS (SELECT series_id, max(period) AS p, arg_max(y, period) AS y FROM panel GROUP BY 1)
SELECT series_id, CAST(p + to_months(CAST(h AS INTEGER)) AS DATE) AS period, CAST(h AS INTEGER) AS h, y AS yhat
FROM l, (SELECT unnest(range(1, 7)) AS h)""", "items_v"))
def _f3(spark, sf):
    return FC.naive_forecast(product_panel(spark, sf))


_BT = """bt AS (SELECT series_id, period, y, lag(y, 1) OVER (PARTITION BY series_id ORDER BY period) AS yhat,
              'naive' AS model FROM panel QUALIFY yhat IS NOT NULL)"""


@register("residual_interval", V(f"""
WITH {_PANEL}, {_BT}
SELECT series_id, model, count(*) AS n, round_even(quantile_cont(y - yhat, 0.025), 6) AS resid_lower,
       round_even(quantile_cont(y - yhat, 0.975), 6) AS resid_upper FROM bt GROUP BY 1, 2""", "items_v"))
def _f7(spark, sf):
    return FC.residual_interval(FC.naive_backtest(product_panel(spark, sf)))


@register("forecast_accuracy", V(f"""
WITH {_PANEL}, {_BT},
g AS (SELECT series_id, model, count(*) AS n, avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse,
        avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) AS mape, sum((y - yhat) * (y - yhat)) AS sse,
        var_pop(y) AS v FROM bt GROUP BY 1, 2)
SELECT series_id, model, n, round_even(mae, 6) AS mae, round_even(sqrt(mse), 6) AS rmse, round_even(mape * 100, 6) AS mape,
  round_even(CASE WHEN v > 0 THEN 1 - sse / nullif(v * n, 0) END, 6) AS r2 FROM g""", "items_v"))
def _f8(spark, sf):
    return FC.forecast_accuracy(FC.naive_backtest(product_panel(spark, sf)))


_LB = " + ".join(f"(n{k} / nullif(den, 0)) * (n{k} / nullif(den, 0)) / (n - {k})" for k in range(1, 11))


@register("series_diagnostics", V(f"""
WITH {_PANEL},
dvt AS (SELECT *, y - avg(y) OVER (PARTITION BY series_id) AS dv FROM panel),
l AS (SELECT *, {", ".join(f"lag(dv, {k}) OVER w AS l{k}" for k in list(range(1, 11)) + [12])},
        lag(y, 1) OVER w AS y1 FROM dvt WINDOW w AS (PARTITION BY series_id ORDER BY period)),
g AS (SELECT series_id, count(*) AS n, sum(dv * dv) AS den, avg(CASE WHEN NOT observed THEN 1.0 ELSE 0.0 END) AS miss,
        regr_slope(y - y1, y1) AS b, regr_count(y - y1, y1) AS m, regr_sxx(y - y1, y1) AS sxx,
        regr_syy(y - y1, y1) AS syy, regr_sxy(y - y1, y1) AS sxy,
        {", ".join(f"sum(dv * l{k}) AS n{k}" for k in list(range(1, 11)) + [12])} FROM l GROUP BY 1),
o AS (SELECT series_id, n, round_even(n * (n + 2) * ({_LB}), 6) AS ljung_box_q,
        round_even(n12 / nullif(den, 0), 6) AS acf_12,
        round_even(b / nullif(sqrt(((syy - b * sxy) / nullif(CAST(m - 2 AS DOUBLE), 0)) / sxx), 0), 6) AS df_t,
        round_even(miss * 100, 6) AS missing_pct FROM g),
o2 AS (SELECT *, coalesce(df_t < {FC.DF_CRITICAL_5PCT}, false) AS stationary,
        coalesce(ljung_box_q > {FC.CHI2_95_10}, false) AS autocorrelated,
        coalesce(n >= 24 AND acf_12 > 1.96 / sqrt(CAST(n AS DOUBLE)), false) AS seasonal FROM o)
SELECT *, concat_ws(' ',
  CASE WHEN NOT stationary THEN '{FC.ADVICE["nonstationary"]}' END,
  CASE WHEN autocorrelated THEN '{FC.ADVICE["autocorrelated"]}' END,
  CASE WHEN seasonal THEN '{FC.ADVICE["seasonal"]}' END,
  CASE WHEN missing_pct > 0 THEN replace('{FC.ADVICE["missing"]}', '{{pct}}', printf('%.1f', round_even(missing_pct, 1))) END)
  AS advice FROM o2""", "items_v"))
def _f10(spark, sf):
    return FC.series_diagnostics(product_panel(spark, sf))


#: The panels hold money: sums of cents.
CENTS = 2


@register("seasonal_trend_forecast", V(f"""
WITH {_PANEL}, {Q.trend_forecast(CENTS)}
SELECT series_id, period, h, round_even(yhat, 6) AS yhat, round_even(yhat - band, 6) AS yhat_lower, round_even(yhat + band, 6) AS yhat_upper FROM trend""", "items_v"))
def _f4(spark, sf):
    return FC.seasonal_trend_forecast(product_panel(spark, sf), horizon=6, min_points=12, places=CENTS)


@register("gbt_forecast")
def _f5(spark, sf):
    return FC.gbt_forecast(product_panel(spark, sf), horizon=6)


@register("ensemble_forecast")
def _f6(spark, sf):
    return FC.ensemble_forecast(product_panel(spark, sf), horizon=6)


@register("select_forecast_model")
def _f9(spark, sf):
    return FC.select_forecast_model(product_panel(spark, sf), with_gbt=True, places=CENTS)


@register("select_forecast_model_two", V(f"WITH {_PANEL}, {Q.PT}, {Q.selection(CENTS)} SELECT * FROM sel", "items_v"))
def _f9_two(spark, sf):
    return FC.select_forecast_model(product_panel(spark, sf), places=CENTS)


@register("best_model_forecast", V(f"""
WITH {_PANEL}, {Q.trend_forecast(CENTS)}, {Q.selection(CENTS)}, {Q.best()} SELECT * FROM best""", "items_v"))
def _f9_best(spark, sf):
    return FC.best_model_forecast(product_panel(spark, sf), places=CENTS)


def _kpi_sql() -> str:
    monthly = ORACLES["monthly_metrics"]
    long = " UNION ALL ".join(f"SELECT '{m}' AS series_id, period, {m}::DOUBLE AS y FROM mm WHERE {m} IS NOT NULL" for m in MONTHLY_KPIS)
    wide = ", ".join(f"any_value({c}) FILTER (series_id = '{m}') AS {m}_{c}" for m in MONTHLY_KPIS for c in ("yhat", "yhat_lower", "yhat_upper", "model"))
    return f"""WITH mm AS ({monthly}), long AS ({long}),
panel AS (SELECT * FROM long WHERE series_id IN (SELECT series_id FROM long GROUP BY 1 HAVING count(*) >= 19)),
{Q.trend_forecast(CENTS)}, {Q.selection(CENTS)}, {Q.best()} SELECT period, {wide} FROM best GROUP BY period"""


@register("multi_metric_forecast", _kpi_sql())
def _f11(spark, sf):
    return FC.multi_metric_forecast(monthly_metrics(tb.orders(spark, sf), tb.orders(spark, sf, with_country=True)),
                                    MONTHLY_KPIS, places=CENTS)
