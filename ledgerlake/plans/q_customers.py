"""Registered C-queries (customer analytics) and their DuckDB oracles."""

from __future__ import annotations

from ledgerlake.operators import customers as C
from ledgerlake.plans.registry import register
from ledgerlake.plans.sqlkit import month
from ledgerlake.sources import tables as tb
from ledgerlake.sources.tables import with_views as V

_DAYS = "CAST(floor((epoch({a}) - epoch({b})) / 86400) AS BIGINT)"


def _score(m, q, rev=False):
    s = f"(1 + CAST({m} > {q}[1] AS INTEGER) + CAST({m} > {q}[2] AS INTEGER) + CAST({m} > {q}[3] AS INTEGER))"
    return f"(5 - {s})" if rev else s


@register("rfm", V(f"""
WITH per AS (SELECT client, max(date) AS last, count(*) AS frequency, sum(total) AS monetary
             FROM orders_v WHERE client IS NOT NULL GROUP BY client),
ao AS (SELECT max(date) + INTERVAL 1 DAY AS a FROM orders_v),
p2 AS (SELECT per.*, {_DAYS.format(a='ao.a', b='last')} AS recency FROM per, ao),
q AS (SELECT quantile_cont(recency, [0.25, 0.5, 0.75]) AS qr, quantile_cont(frequency, [0.25, 0.5, 0.75]) AS qf,
             quantile_cont(monetary, [0.25, 0.5, 0.75]) AS qm FROM p2),
s AS (SELECT client, recency, frequency, round_even(monetary, 2) AS monetary,
             {_score('recency', 'qr', True)} AS r_score, {_score('frequency', 'qf')} AS f_score,
             {_score('monetary', 'qm')} AS m_score FROM p2, q)
SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_score FROM s""",
                   "orders_v"))
def _c1(spark, sf):
    return C.rfm(tb.orders(spark, sf))


_SEG = """per AS (SELECT client, sum(total) AS spend FROM orders_v WHERE client IS NOT NULL GROUP BY client),
c AS (SELECT client, spend, sum(spend) OVER (ORDER BY spend DESC NULLS LAST, client
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(spend) OVER () * 100 AS share FROM per),
seg AS (SELECT client, round_even(spend, 2) AS spend, round_even(share, 6) AS cumsum_pct,
   CASE WHEN round_even(share, 9) > 0 AND round_even(share, 9) <= 20 THEN 'High-value'
        WHEN round_even(share, 9) > 20 AND round_even(share, 9) <= 50 THEN 'Mid-value'
        WHEN round_even(share, 9) > 50 AND round_even(share, 9) <= 100 THEN 'Low-value' END AS segment FROM c)"""


@register("customer_value_segments", V(f"WITH {_SEG} SELECT * FROM seg", "orders_v"))
def _c2(spark, sf):
    return C.customer_value_segments(tb.orders(spark, sf))


@register("segment_value_box", V(f"""
WITH {_SEG}
SELECT segment, count(*) AS customers, round_even(min(spend), 6) AS min,
  round_even(quantile_cont(spend, 0.25), 6) AS q1, round_even(quantile_cont(spend, 0.5), 6) AS median,
  round_even(quantile_cont(spend, 0.75), 6) AS q3, round_even(max(spend), 6) AS max
FROM seg GROUP BY segment""", "orders_v"))
def _c3(spark, sf):
    return C.segment_value_box(C.customer_value_segments(tb.orders(spark, sf)))


@register("clv_revenue", V("""
SELECT round_even(avg(total) * (count(client) / nullif(count(DISTINCT client), 0)) * 12, 6) AS clv FROM orders_v""",
                           "orders_v"))
def _c5(spark, sf):
    return C.clv_revenue(tb.orders(spark, sf))


@register("clv_refined", V("""
SELECT round_even(avg(total) * (count(*) / nullif(count(DISTINCT client), 0)) * 12, 6) AS clv FROM orders_v""",
                           "orders_v"))
def _c6(spark, sf):
    return C.clv_refined(tb.orders(spark, sf))


_BEH = """per AS (SELECT client, sum(total) AS total_revenue, count(*) AS order_count,
              count(*) FILTER (WHERE state = 'P') AS cancelled_orders,
              CASE WHEN count(*) > 1 THEN 'repeat' ELSE 'one_time' END AS customer_type
       FROM orders_v WHERE client IS NOT NULL GROUP BY client)"""


@register("customer_behavior", V(f"""
WITH {_BEH},
g AS (SELECT customer_type, count(*) AS customers, sum(total_revenue) AS total_revenue, sum(order_count) AS orders,
             sum(cancelled_orders) AS cancelled_orders FROM per GROUP BY customer_type)
SELECT customer_type, customers, round_even(total_revenue, 2) AS total_revenue, CAST(orders AS BIGINT) AS orders,
  CAST(cancelled_orders AS BIGINT) AS cancelled_orders,
  round_even(customers / sum(customers) OVER () * 100, 6) AS customer_pct,
  round_even(total_revenue / nullif(sum(total_revenue) OVER (), 0) * 100, 6) AS revenue_pct,
  round_even(CASE WHEN customer_type = 'repeat' THEN total_revenue / nullif(orders, 0)
                  ELSE total_revenue / nullif(customers, 0) END, 6) AS avg_order_value
FROM g""", "orders_v"))
def _c7(spark, sf):
    return C.customer_behavior(tb.orders(spark, sf))


@register("top_repeat_customers", V(f"""
WITH {_BEH}
SELECT client, round_even(total_revenue, 2) AS total_revenue, order_count, cancelled_orders FROM per
WHERE customer_type = 'repeat' ORDER BY total_revenue DESC, client LIMIT 10""", "orders_v"))
def _c7b(spark, sf):
    return C.top_repeat_customers(tb.orders(spark, sf))


@register("churn_inactive", V(f"""
WITH per AS (SELECT client, max(date) AS last FROM orders_v WHERE client IS NOT NULL GROUP BY client),
ao AS (SELECT max(date) + INTERVAL 1 DAY AS a FROM orders_v),
a AS (SELECT count(*) AS customers, count(*) FILTER (WHERE {_DAYS.format(a='ao.a', b='last')} > 90) AS churned
      FROM per, ao)
SELECT customers, churned, round_even(coalesce(churned / nullif(customers, 0) * 100, 0), 6) AS churn_rate FROM a""",
                              "orders_v"))
def _c8(spark, sf):
    return C.churn_inactive(tb.orders(spark, sf))


_CHURN = f"""cm AS (SELECT DISTINCT client, {month()} AS month FROM orders_v WHERE client IS NOT NULL AND date IS NOT NULL),
m AS (SELECT month, dense_rank() OVER (ORDER BY month) AS ix FROM (SELECT DISTINCT month FROM cm)),
cmi AS (SELECT cm.client, m.ix FROM cm JOIN m USING (month)),
sz AS (SELECT ix, count(*) AS n FROM cmi GROUP BY ix),
lost AS (SELECT a.ix, count(*) AS l FROM cmi a
         WHERE NOT EXISTS (SELECT 1 FROM cmi b WHERE b.client = a.client AND b.ix = a.ix + 1) GROUP BY a.ix)"""


@register("churn_monthly", V(f"""
WITH {_CHURN}
SELECT m.month, round_even(coalesce(lost.l, 0) / nullif(sz.n, 0) * 100, 6) AS churn_rate
FROM m JOIN sz ON sz.ix = m.ix - 1 LEFT JOIN lost ON lost.ix = m.ix - 1""", "orders_v"))
def _c9(spark, sf):
    return C.churn_monthly(tb.orders(spark, sf))


@register("churn_monthly_ratio", V(f"""
WITH {_CHURN}
SELECT m.month, round_even(coalesce(lost.l, 0) / nullif(sz.n, 0), 6) AS churn_rate
FROM m LEFT JOIN sz ON sz.ix = m.ix - 1 LEFT JOIN lost ON lost.ix = m.ix - 1""", "orders_v"))
def _c9b(spark, sf):
    return C.churn_monthly(tb.orders(spark, sf), as_percent=False, include_first=True)


@register("lifecycle_stages", V(f"""
WITH now AS (SELECT max(date) AS n FROM orders_v),
per AS (SELECT client, min(date) AS first_purchase_date, max(date) AS last_purchase_date,
               count(reference) AS total_orders FROM orders_v WHERE client IS NOT NULL GROUP BY client),
p2 AS (SELECT per.*, {_DAYS.format(a='now.n', b='last_purchase_date')} AS days_since_last_purchase FROM per, now)
SELECT *, CASE WHEN total_orders = 1 AND days_since_last_purchase <= 30 THEN 'New'
               WHEN total_orders >= 2 AND days_since_last_purchase <= 30 THEN 'Active'
               ELSE 'At-Risk' END AS stage FROM p2""", "orders_v"))
def _c10(spark, sf):
    return C.lifecycle_stages(tb.orders(spark, sf))


@register("repeat_purchase_interval", V("""
WITH per AS (SELECT client, date_diff('day', CAST(min(date) AS DATE), CAST(max(date) AS DATE)) AS span,
                    count(*) AS n FROM orders_v WHERE client IS NOT NULL AND date IS NOT NULL GROUP BY client)
SELECT round_even(CAST(sum(span) AS DOUBLE) / nullif(sum(n - 1), 0), 6) AS avg_interval_days FROM per""",
                                        "orders_v"))
def _c11(spark, sf):
    return C.repeat_purchase_interval(tb.orders(spark, sf))


@register("new_vs_returning", V(f"""
WITH cm AS (SELECT DISTINCT client, {month()} AS month FROM orders_v WHERE client IS NOT NULL AND date IS NOT NULL),
c AS (SELECT *, min(month) OVER (PARTITION BY client) AS cohort FROM cm)
SELECT month AS period, count(*) AS unique_customers, count(*) FILTER (WHERE month = cohort) AS new_customers,
       count(*) - count(*) FILTER (WHERE month = cohort) AS returning_customers FROM c GROUP BY month""",
                                "orders_v"))
def _c12(spark, sf):
    return C.new_vs_returning(tb.orders(spark, sf))


@register("purchase_frequency", V("""
SELECT client, count(date) AS orders FROM orders_v WHERE client IS NOT NULL GROUP BY client""", "orders_v"))
def _c13(spark, sf):
    return C.purchase_frequency(tb.orders(spark, sf))


@register("purchase_frequency_mean", V("""
SELECT round_even(avg(orders), 6) AS avg_purchase_frequency FROM
  (SELECT client, count(date) AS orders FROM orders_v WHERE client IS NOT NULL GROUP BY client)""", "orders_v"))
def _c13b(spark, sf):
    return C.purchase_frequency_mean(tb.orders(spark, sf))


@register("customer_acquisition_daily", V("""
SELECT CAST(date AS DATE) AS day, count(DISTINCT client) AS customers FROM orders_v
WHERE date IS NOT NULL GROUP BY 1""", "orders_v"))
def _c14(spark, sf):
    return C.customer_acquisition_daily(tb.orders(spark, sf))
