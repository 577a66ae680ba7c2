"""Registered T-queries (time analytics) and their DuckDB oracles."""

from __future__ import annotations

from ledgerlake.operators import timeseries as TS
from ledgerlake.plans.registry import register
from ledgerlake.plans.sqlkit import month, spine
from ledgerlake.sources import tables as tb
from ledgerlake.sources.tables import with_views as V

_REV_M = f"""g AS (SELECT {month()} AS period, sum(total) AS revenue FROM orders_v
                   WHERE date IS NOT NULL GROUP BY 1),
sp AS ({spine('g')}),
s AS (SELECT sp.period, round_even(coalesce(g.revenue, 0), 2) AS revenue FROM sp LEFT JOIN g USING (period))"""


@register("revenue_over_time", V(f"WITH {_REV_M} SELECT * FROM s", "orders_v"))
def _t1(spark, sf):
    return TS.revenue_over_time(tb.orders(spark, sf))


@register("revenue_over_time_weekly", V(f"""
WITH g AS (SELECT CAST(date_trunc('week', date) AS DATE) AS period, sum(total) AS revenue FROM orders_v
           WHERE date IS NOT NULL GROUP BY 1),
sp AS ({spine('g', step="7 DAYS")})
SELECT sp.period, round_even(coalesce(g.revenue, 0), 2) AS revenue FROM sp LEFT JOIN g USING (period)""",
                                         "orders_v"))
def _t1w(spark, sf):
    return TS.revenue_over_time(tb.orders(spark, sf), freq="W")


@register("revenue_growth", V(f"""
WITH {_REV_M}
SELECT period, revenue,
  round_even((revenue - lag(revenue) OVER (ORDER BY period)) / nullif(lag(revenue) OVER (ORDER BY period), 0) * 100, 6)
    AS growth_pct
FROM s""", "orders_v"))
def _t2(spark, sf):
    return TS.revenue_growth(tb.orders(spark, sf))


@register("customers_over_time", V(f"""
WITH g AS (SELECT {month()} AS period, count(DISTINCT client) AS customers FROM orders_v
           WHERE date IS NOT NULL GROUP BY 1),
sp AS ({spine('g')})
SELECT sp.period, coalesce(g.customers, 0) AS customers FROM sp LEFT JOIN g USING (period)""", "orders_v"))
def _t3(spark, sf):
    return TS.customers_over_time(tb.orders(spark, sf))


@register("orders_over_time", V(f"""
WITH g AS (SELECT {month()} AS period, count(reference) AS orders FROM orders_v
           WHERE date IS NOT NULL GROUP BY 1),
sp AS ({spine('g')})
SELECT sp.period, coalesce(g.orders, 0) AS orders FROM sp LEFT JOIN g USING (period)""", "orders_v"))
def _t4(spark, sf):
    return TS.orders_over_time(tb.orders(spark, sf))


@register("aov_over_time", V(f"""
WITH g AS (SELECT {month()} AS period, sum(total) AS revenue, count(reference) AS orders FROM orders_v
           WHERE date IS NOT NULL GROUP BY 1),
sp AS ({spine('g')})
SELECT sp.period, round_even(coalesce(g.revenue, 0) / nullif(coalesce(g.orders, 0), 0), 6) AS aov
FROM sp LEFT JOIN g USING (period)""", "orders_v"))
def _t5(spark, sf):
    return TS.aov_over_time(tb.orders(spark, sf))


_COHORT = f"""cm AS (SELECT DISTINCT client, {month()} AS month FROM orders_v
                    WHERE client IS NOT NULL AND date IS NOT NULL),
c AS (SELECT client, month, min(month) OVER (PARTITION BY client) AS cohort FROM cm)"""


@register("cohort_retention", V(f"""
WITH {_COHORT},
g AS (SELECT cohort, CAST(date_diff('month', cohort, month) AS INTEGER) AS cohort_index, count(*) AS customers
      FROM c GROUP BY 1, 2)
SELECT cohort, cohort_index, customers,
  round_even(customers / nullif(max(CASE WHEN cohort_index = 0 THEN customers END) OVER (PARTITION BY cohort), 0) * 100, 6)
    AS retention_pct
FROM g""", "orders_v"))
def _t6(spark, sf):
    return TS.cohort_retention(tb.orders(spark, sf))


@register("net_revenue_retention", V(f"""
WITH per AS (SELECT client, {month()} AS month, sum(total) AS rev FROM orders_v
             WHERE client IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2),
p2 AS (SELECT *, min(month) OVER (PARTITION BY client) AS cohort FROM per),
g AS (SELECT cohort, month, sum(rev) AS revenue FROM p2 GROUP BY 1, 2),
g2 AS (SELECT *, sum(CASE WHEN month = cohort THEN revenue END) OVER (PARTITION BY cohort) AS start_rev FROM g)
SELECT cohort AS cohort_start, month, round_even(revenue / nullif(start_rev, 0) * 100, 6) AS nrr_pct
FROM g2 WHERE month >= cohort AND start_rev IS NOT NULL AND start_rev <> 0""", "orders_v"))
def _t7(spark, sf):
    return TS.net_revenue_retention(tb.orders(spark, sf))


@register("day_of_week_revenue", V("""
SELECT dayname(date) AS day_of_week, round_even(sum(total), 2) AS revenue FROM orders_v
WHERE date IS NOT NULL GROUP BY 1""", "orders_v"))
def _t8(spark, sf):
    return TS.day_of_week_revenue(tb.orders(spark, sf))


@register("hour_of_day_revenue", V("""
SELECT CAST(hour(date) AS INTEGER) AS hour, round_even(sum(total), 2) AS revenue FROM carts_v
WHERE date IS NOT NULL GROUP BY 1""", "carts_v"))
def _t9(spark, sf):
    return TS.hour_of_day_revenue(tb.carts(spark, sf))


@register("year_over_year", V("""
WITH g AS (SELECT CAST(date_trunc('year', date) AS DATE) AS period, sum(total) AS total_revenue,
                  count(*) AS total_orders FROM orders_v WHERE date IS NOT NULL GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series(CAST(min(period) AS TIMESTAMP), CAST(max(period) AS TIMESTAMP),
             INTERVAL 1 YEAR)) AS DATE) AS period FROM g),
s AS (SELECT sp.period, coalesce(g.total_revenue, 0) AS total_revenue, coalesce(g.total_orders, 0) AS total_orders,
             coalesce(g.total_revenue, 0) / nullif(coalesce(g.total_orders, 0), 0) AS yearly_aov
      FROM sp LEFT JOIN g USING (period))
SELECT CAST(year(period) AS INTEGER) AS year, round_even(total_revenue, 2) AS total_revenue,
  round_even((total_revenue - lag(total_revenue) OVER w) / nullif(lag(total_revenue) OVER w, 0) * 100, 6) AS revenue_growth,
  total_orders,
  round_even((total_orders - lag(total_orders) OVER w) / nullif(lag(total_orders) OVER w, 0) * 100, 6) AS orders_growth,
  round_even(yearly_aov, 6) AS yearly_aov,
  round_even((yearly_aov - lag(yearly_aov) OVER w) / nullif(lag(yearly_aov) OVER w, 0) * 100, 6) AS aov_growth
FROM s WINDOW w AS (ORDER BY period)""", "orders_v"))
def _t10(spark, sf):
    return TS.year_over_year(tb.orders(spark, sf))


@register("monthly_refunds_cancellations", V(f"""
WITH g AS (SELECT {month()} AS period,
  count(reference) FILTER (WHERE contains(state, 'O')) AS refund_count,
  coalesce(sum(total) FILTER (WHERE contains(state, 'O')), 0) AS refund_amount,
  count(reference) FILTER (WHERE contains(state, 'P')) AS cancel_count,
  coalesce(sum(total) FILTER (WHERE contains(state, 'P')), 0) AS cancel_amount
  FROM orders_v WHERE date IS NOT NULL GROUP BY 1),
sp AS ({spine('g')})
SELECT sp.period, coalesce(refund_count, 0) AS refund_count, round_even(coalesce(refund_amount, 0), 2) AS refund_amount,
       coalesce(cancel_count, 0) AS cancel_count, round_even(coalesce(cancel_amount, 0), 2) AS cancel_amount
FROM sp LEFT JOIN g USING (period)""", "orders_v"))
def _t11(spark, sf):
    return TS.monthly_refunds_cancellations(tb.orders(spark, sf))


def _top_sql(key: str, view: str) -> str:
    return V(f"""
WITH g AS (SELECT {month()} AS period, {key}, sum(total) AS rev FROM {view}
           WHERE {key} IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY rev DESC, {key}) AS rn FROM g)
SELECT period, {key} AS top_{key}, round_even(rev, 2) AS top_{key}_revenue FROM r WHERE rn = 1""", view)


@register("monthly_top_payment", _top_sql("payment", "orders_v"))
def _t12(spark, sf):
    return TS.monthly_top_payment(tb.orders(spark, sf))


@register("monthly_top_country", _top_sql("country", "orders_c"))
def _t13(spark, sf):
    return TS.monthly_top_country(tb.orders(spark, sf, with_country=True))


@register("moving_average", V(f"""
WITH {_REV_M}
SELECT period, revenue,
  round_even(CASE WHEN count(revenue) OVER w = 3 THEN avg(revenue) OVER w END, 6) AS revenue_ma3
FROM s WINDOW w AS (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", "orders_v"))
def _t15(spark, sf):
    return TS.moving_average(TS.revenue_over_time(tb.orders(spark, sf)), value="revenue")


@register("linear_trend", V(f"""
WITH {_REV_M}, t AS (SELECT revenue, CAST(row_number() OVER (ORDER BY period) - 1 AS DOUBLE) AS x FROM s)
SELECT round_even(regr_slope(revenue, x), 6) AS slope, round_even(regr_intercept(revenue, x), 6) AS intercept,
       count(revenue) AS points FROM t""", "orders_v"))
def _t16(spark, sf):
    return TS.linear_trend(TS.revenue_over_time(tb.orders(spark, sf)), value="revenue")


@register("peak_period", V(f"""
WITH {_REV_M}
SELECT period, revenue AS peak_value FROM s WHERE revenue IS NOT NULL ORDER BY revenue DESC, period LIMIT 1""",
                           "orders_v"))
def _t17(spark, sf):
    return TS.peak_period(TS.revenue_over_time(tb.orders(spark, sf)), value="revenue")
