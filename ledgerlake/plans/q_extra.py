"""Registered join operators (J4-J7), wide pivots (T6, R5) and the
remaining cleaning sub-pipelines (P15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import customers as C
from ledgerlake.operators import products as R
from ledgerlake.operators import timeseries as TS
from ledgerlake.plans import pipeline as PL
from ledgerlake.plans.registry import register
from ledgerlake.plans.sqlkit import month, spine
from ledgerlake.sources import exports as X
from ledgerlake.sources import tables as tb
from ledgerlake.sources.tables import with_views as V


@register("lost_customers", V(f"""
WITH cm AS (SELECT DISTINCT client, {month()} AS month FROM orders_v WHERE client IS NOT NULL AND date IS NOT NULL),
m AS (SELECT month, dense_rank() OVER (ORDER BY month) AS ix FROM (SELECT DISTINCT month FROM cm)),
cmi AS (SELECT cm.client, m.ix FROM cm JOIN m USING (month))
SELECT m.month, a.client FROM cmi a JOIN m ON m.ix = a.ix + 1
WHERE NOT EXISTS (SELECT 1 FROM cmi b WHERE b.client = a.client AND b.ix = a.ix + 1)""", "orders_v"))
def _j4(spark, sf):
    return C.lost_customers(tb.orders(spark, sf))


@register("first_purchase_join", V("""
SELECT o.*, f.first_purchase FROM orders_v o LEFT JOIN
  (SELECT client, min(date) AS first_purchase FROM orders_v WHERE client IS NOT NULL GROUP BY client) f
  ON o.client = f.client""", "orders_v"))
def _j5(spark, sf):
    return C.first_purchase_join(tb.orders(spark, sf))


@register("price_join", V("""
SELECT i.*, p.price AS base_price FROM items_v i LEFT JOIN products_v p ON i.product = p.product""",
                          "items_v", "products_v"))
def _j6(spark, sf):
    return R.price_join(tb.order_items(spark, sf), tb.products(spark, sf))


@register("metric_align", V(f"""
WITH r AS (SELECT {month()} AS period, round_even(sum(total), 2) AS revenue FROM orders_v WHERE date IS NOT NULL GROUP BY 1),
c AS (SELECT {month()} AS period, count(DISTINCT client) AS customers FROM orders_v
      WHERE date IS NOT NULL GROUP BY 1),
u AS (SELECT period FROM r UNION ALL SELECT period FROM c),
sp AS ({spine('u')})
SELECT sp.period, r.revenue, c.customers FROM sp LEFT JOIN r USING (period) LEFT JOIN c USING (period)""",
                            "orders_v"))
def _j7(spark, sf):
    o = tb.orders(spark, sf)
    rev = o.where(F.col("date").isNotNull()).groupBy(TS.month_start("date").alias("period")) \
           .agg(TS.r2(F.sum("total")).alias("revenue"))
    cust = o.where(F.col("date").isNotNull()).groupBy(TS.month_start("date").alias("period")) \
             .agg(F.countDistinct("client").alias("customers"))
    return TS.metric_align(rev, cust)


@register("cohort_retention_wide")
def _t6w(spark, sf):
    return TS.cohort_retention_wide(tb.orders(spark, sf))


@register("monthly_product_sales_wide", V(f"""
WITH mps AS (SELECT {month()} AS month, product, round_even(sum(line_price), 2) AS revenue
  FROM items_v WHERE product IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2),
p AS (SELECT product, row_number() OVER (ORDER BY product) - 1 AS k FROM (SELECT DISTINCT product FROM mps)),
m AS (SELECT DISTINCT month FROM mps)
SELECT month, k // {R.WIDE_BLOCK} AS block, list(product ORDER BY k) AS products,
       list(coalesce(revenue, 0.0) ORDER BY k) AS revenue
FROM (SELECT month, product, k FROM m, p) LEFT JOIN mps USING (month, product) GROUP BY 1, 2""", "items_v"))
def _r5w(spark, sf):
    return R.monthly_product_sales_blocks(tb.order_items(spark, sf), value="revenue")


@register("preprocess_carts", V(f"""
SELECT * FROM (
  SELECT id, order_ref, coalesce(CAST(client AS VARCHAR), 'Unknown') AS client, total, date,
         coalesce(carrier, 'Unknown') AS carrier,
         row_number() OVER (PARTITION BY order_ref, date ORDER BY id NULLS FIRST,
           coalesce(CAST(client AS VARCHAR), 'Unknown') NULLS FIRST, total NULLS FIRST,
           coalesce(carrier, 'Unknown') NULLS FIRST) AS rn
  FROM carts_v WHERE NOT coalesce(order_ref = '{tb.ABANDONED_MARKER}' AND total = 0, false)
    AND date >= TIMESTAMP '2021-03-31') WHERE rn = 1""".replace("SELECT * FROM (", "SELECT id, order_ref, client, total, date, carrier FROM ("),
                                 "carts_v"))
def _p15c(spark, sf):
    return PL.clean_carts(tb.carts(spark, sf))


@register("preprocess_retail", V("""
SELECT DISTINCT CAST(CAST(date AS DATE) AS TIMESTAMP) AS "Date", CAST(ref AS VARCHAR) AS "Ref", order_id, line,
  CAST(qty AS INTEGER) AS "Qté", round_even(unit_price, 2) AS "PV TTC", amount AS "CA TTC"
FROM lines_v WHERE date IS NOT NULL""", "lines_v"))
def _p15r(spark, sf):
    return PL.clean_retail(X.retail_export(tb.sales_lines(spark, sf)))
