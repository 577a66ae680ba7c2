"""Registered B-queries (order KPIs) and their DuckDB oracles."""

from __future__ import annotations

from ledgerlake.operators import basic as B
from ledgerlake.plans.registry import register
from ledgerlake.sources import tables as tb
from ledgerlake.sources.tables import with_views as V

M = tb.ABANDONED_MARKER


@register("basic_kpis", V("""
SELECT count(*) AS total_orders, round_even(sum(total), 2) AS total_revenue,
       count(DISTINCT client) AS unique_customers,
       round_even(coalesce(count(*) / nullif(count(DISTINCT client), 0), 0), 6) AS avg_orders_per_customer
FROM orders_v""", "orders_v"))
def _b1(spark, sf):
    return B.basic_kpis(tb.orders(spark, sf))


@register("average_order_value", V("SELECT round_even(avg(total), 6) AS aov FROM orders_v", "orders_v"))
def _b2(spark, sf):
    return B.average_order_value(tb.orders(spark, sf))


@register("order_value_distribution", V("""
SELECT round_even(min(total), 6) AS min, round_even(quantile_cont(total, 0.25), 6) AS q1,
       round_even(quantile_cont(total, 0.5), 6) AS median, round_even(quantile_cont(total, 0.75), 6) AS q3,
       round_even(max(total), 6) AS max, round_even(avg(total), 6) AS mean,
       round_even(stddev_samp(total), 6) AS std
FROM orders_v""", "orders_v"))
def _b3(spark, sf):
    return B.order_value_distribution(tb.orders(spark, sf))


@register("cart_abandonment_rate", V("""
WITH refs AS (SELECT DISTINCT reference AS ref FROM orders_v WHERE reference IS NOT NULL),
a AS (SELECT count(DISTINCT c.order_ref) AS total_carts, count(r.ref) AS completed_carts
      FROM carts_v c LEFT JOIN refs r ON c.order_ref = r.ref)
SELECT total_carts, completed_carts,
       round_even(CASE WHEN total_carts = 0 THEN 0.0
                  ELSE (1 - completed_carts / total_carts) * 100 END, 6) AS abandonment_rate
FROM a""", "orders_v", "carts_v"))
def _b4(spark, sf):
    return B.cart_abandonment_rate(tb.carts(spark, sf), tb.orders(spark, sf))


@register("completed_carts", V("""
SELECT * FROM carts_v WHERE order_ref IN (SELECT reference FROM orders_v)""", "orders_v", "carts_v"))
def _j3(spark, sf):
    return B.completed_carts(tb.carts(spark, sf), tb.orders(spark, sf))


@register("order_state_breakdown", V("""
WITH g AS (SELECT state, sum(total) AS total_revenue, count(total) AS order_count, count(*) AS rows_
           FROM orders_v GROUP BY state),
t AS (SELECT sum(rows_) AS all_rows, sum(total_revenue) AS all_rev FROM g)
SELECT state, round_even(total_revenue, 2) AS total_revenue, order_count,
       round_even(CASE WHEN all_rows > 0 THEN order_count / all_rows * 100 ELSE 0 END, 6) AS order_pct,
       round_even(CASE WHEN all_rev > 0 THEN total_revenue / all_rev * 100 ELSE 0 END, 6) AS revenue_pct
FROM g, t WHERE state IS NOT NULL""", "orders_v"))
def _b5(spark, sf):
    return B.order_state_breakdown(tb.orders(spark, sf))


@register("cart_abandonment_by_marker", V(f"""
SELECT count(*) AS total_carts, count(*) FILTER (WHERE order_ref = '{M}') AS abandoned_carts,
       round_even(coalesce(count(*) FILTER (WHERE order_ref = '{M}') / nullif(count(*), 0) * 100, 0), 6)
         AS abandonment_rate
FROM carts_v""", "carts_v"))
def _b6(spark, sf):
    return B.cart_abandonment_by_marker(tb.carts(spark, sf))


@register("abandoned_cart_values", V(f"""
SELECT count(total) AS count, round_even(avg(total), 6) AS average_cart_value,
       round_even(quantile_cont(total, 0.5), 6) AS median_cart_value,
       round_even(sum(total), 2) AS total_lost_value, round_even(stddev_samp(total), 6) AS std,
       round_even(min(total), 6) AS min, round_even(quantile_cont(total, 0.25), 6) AS q1,
       round_even(quantile_cont(total, 0.75), 6) AS q3, round_even(max(total), 6) AS max
FROM carts_v WHERE order_ref = '{M}'""", "carts_v"))
def _b7(spark, sf):
    return B.abandoned_cart_values(tb.carts(spark, sf))


@register("abandoned_time_patterns", V(f"""
WITH a AS (SELECT CAST(hour(date) AS VARCHAR) AS h, dayname(date) AS d, CAST(month(date) AS VARCHAR) AS m
           FROM carts_v WHERE order_ref = '{M}')
SELECT 'hour' AS pattern, h AS bucket, count(*) AS carts FROM a GROUP BY h
UNION ALL SELECT 'weekday', d, count(*) FROM a GROUP BY d
UNION ALL SELECT 'month', m, count(*) FROM a GROUP BY m""", "carts_v"))
def _b8(spark, sf):
    return B.abandoned_time_patterns(tb.carts(spark, sf))


@register("revenue_concentration", V("""
WITH r AS (SELECT total, row_number() OVER (ORDER BY total DESC NULLS LAST, id) AS rk FROM orders_v),
k AS (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) AS k, sum(total) AS rev FROM orders_v),
t AS (SELECT sum(total) AS top_rev FROM r, k WHERE rk <= k.k)
SELECT k.k AS top_count,
       round_even(CASE WHEN k.k > 0 THEN coalesce(t.top_rev, 0) ELSE 0 END, 2) AS top_10pct_revenue,
       round_even(CASE WHEN k.rev > 0 THEN (CASE WHEN k.k > 0 THEN coalesce(t.top_rev, 0) ELSE 0 END)
                  / k.rev * 100 ELSE 0 END, 6) AS top_10pct_revenue_concentration
FROM k, t""", "orders_v"))
def _b9(spark, sf):
    return B.revenue_concentration(tb.orders(spark, sf))


@register("payment_method_stats", V("""
SELECT payment, round_even(sum(total), 2) AS total_revenue, round_even(avg(total), 6) AS avg_order_value,
       count(total) AS order_count
FROM orders_v WHERE payment IS NOT NULL GROUP BY payment""", "orders_v"))
def _b10(spark, sf):
    return B.payment_method_stats(tb.orders(spark, sf))


@register("country_stats", V("""
SELECT country, round_even(sum(total), 2) AS total_revenue,
       round_even(sum(total) / nullif(count(total), 0), 6) AS avg_order_value,
       count(total) AS order_count, count(DISTINCT client) AS unique_customers
FROM orders_c WHERE country IS NOT NULL GROUP BY country""", "orders_c"))
def _b11(spark, sf):
    return B.country_stats(tb.orders(spark, sf, with_country=True))


@register("top_countries", V("""
SELECT country, round_even(sum(total), 2) AS total_revenue FROM orders_c
WHERE country IS NOT NULL GROUP BY country ORDER BY sum(total) DESC, country LIMIT 10""", "orders_c"))
def _b12(spark, sf):
    return B.top_countries(tb.orders(spark, sf, with_country=True))


@register("refund_cancellation", V("""
WITH a AS (SELECT count(*) AS n, sum(total) AS rev,
  count(*) FILTER (WHERE contains(state, 'O')) AS refunds,
  count(*) FILTER (WHERE contains(state, 'P')) AS cancellations,
  sum(total) FILTER (WHERE contains(state, 'O')) AS lost_ref,
  sum(total) FILTER (WHERE contains(state, 'P')) AS lost_can FROM orders_v)
SELECT round_even(CASE WHEN n > 0 THEN refunds / n * 100 ELSE 0 END, 6) AS refund_rate,
       round_even(CASE WHEN n > 0 THEN cancellations / n * 100 ELSE 0 END, 6) AS cancellation_rate,
       round_even(coalesce(lost_ref, 0), 2) AS revenue_lost_refunds,
       round_even(CASE WHEN rev > 0 THEN coalesce(lost_ref, 0) / rev * 100 ELSE 0 END, 6) AS revenue_refund_pct,
       round_even(coalesce(lost_can, 0), 2) AS revenue_lost_cancellations,
       round_even(CASE WHEN rev > 0 THEN coalesce(lost_can, 0) / rev * 100 ELSE 0 END, 6) AS revenue_cancel_pct
FROM a""", "orders_v"))
def _b13(spark, sf):
    return B.refund_cancellation(tb.orders(spark, sf))


@register("monthly_state_mix", V("""
SELECT CAST(date_trunc('month', date) AS DATE) AS month,
  round_even(count(*) FILTER (WHERE state = 'P') / count(*) * 100, 6) AS pct_P,
  round_even(count(*) FILTER (WHERE state = 'O') / count(*) * 100, 6) AS pct_O,
  round_even(count(*) FILTER (WHERE state = 'F') / count(*) * 100, 6) AS pct_F
FROM orders_v WHERE state IS NOT NULL AND date IS NOT NULL GROUP BY 1""", "orders_v"))
def _b14(spark, sf):
    return B.monthly_state_mix(tb.orders(spark, sf))


@register("geographic_distribution", V("""
SELECT country, count(*) AS order_count FROM orders_c WHERE country IS NOT NULL GROUP BY country""",
                                       "orders_c"))
def _b15(spark, sf):
    return B.geographic_distribution(tb.orders(spark, sf, with_country=True))


@register("top_clients", V("""
WITH per AS (SELECT client, count(*) AS c, sum(total) AS r FROM orders_v WHERE client IS NOT NULL GROUP BY client),
bc AS (SELECT client, c AS top_count FROM per ORDER BY c DESC, client LIMIT 10),
br AS (SELECT client, r AS top_revenue FROM per ORDER BY r DESC, client LIMIT 10)
SELECT coalesce(bc.client, br.client) AS client, bc.top_count, round_even(br.top_revenue, 2) AS top_revenue,
       round_even(br.top_revenue / nullif(bc.top_count, 0), 6) AS avg_order_value
FROM bc FULL OUTER JOIN br ON bc.client = br.client""", "orders_v"))
def _b16(spark, sf):
    return B.top_clients(tb.orders(spark, sf))


@register("top_client_timeline", V("""
WITH per AS (SELECT client, count(*) AS c FROM orders_v WHERE client IS NOT NULL GROUP BY client),
top AS (SELECT client FROM per ORDER BY c DESC, client LIMIT 10)
SELECT * FROM orders_v WHERE client IN (SELECT client FROM top)""", "orders_v"))
def _b17(spark, sf):
    return B.top_client_timeline(tb.orders(spark, sf))


@register("revenue_per_customer", V("""
SELECT round_even(sum(total) / nullif(count(DISTINCT client), 0), 6) AS revenue_per_customer FROM orders_v""",
                                    "orders_v"))
def _b18(spark, sf):
    return B.revenue_per_customer(tb.orders(spark, sf))
