"""Registered R-queries (product analytics) and their DuckDB oracles."""

from __future__ import annotations

from ledgerlake.operators import products as R
from ledgerlake.plans.registry import register
from ledgerlake.plans.sqlkit import month
from ledgerlake.sources import tables as tb
from ledgerlake.sources.tables import with_views as V

_PS = """ps AS (SELECT product, sum(quantity) AS u, sum(line_price) AS r FROM items_v WHERE product IS NOT NULL GROUP BY product)"""


def _items(spark, sf):
    return tb.order_items(spark, sf)


@register("top_products_by_revenue", V(f"""
WITH {_PS} SELECT product, round_even(u, 6) AS total_units_sold, round_even(r, 2) AS total_revenue
FROM ps ORDER BY r DESC, product LIMIT 10""", "items_v"))
def _r1(spark, sf):
    return R.top_products(_items(spark, sf), by="revenue")


@register("top_products_by_units", V(f"""
WITH {_PS} SELECT product, round_even(u, 6) AS total_units_sold, round_even(r, 2) AS total_revenue
FROM ps ORDER BY u DESC, product LIMIT 10""", "items_v"))
def _r1u(spark, sf):
    return R.top_products(_items(spark, sf), by="units")


@register("product_revenue_share", V("""
WITH t AS (SELECT sum(line_price) AS total FROM items_v),
g AS (SELECT product, sum(line_price) AS revenue FROM items_v WHERE product IS NOT NULL GROUP BY product)
SELECT product, round_even(revenue, 2) AS revenue, round_even(revenue / nullif(total, 0) * 100, 6) AS revenue_share_pct
FROM g, t""", "items_v"))
def _r2(spark, sf):
    return R.product_revenue_share(_items(spark, sf))


@register("product_discount", V("""
SELECT i.product, round_even(avg((1 - (i.line_price / nullif(i.quantity, 0)) / p.price) * 100), 6) AS avg_discount_rate_pct
FROM items_v i LEFT JOIN products_v p ON i.product = p.product WHERE p.price > 0 GROUP BY i.product""",
                            "items_v", "products_v"))
def _r3(spark, sf):
    return R.product_discount(_items(spark, sf), tb.products(spark, sf))


@register("product_repeat_rate", V("""
WITH pc AS (SELECT client, product, count(*) AS n FROM items_v WHERE product IS NOT NULL AND client IS NOT NULL
            GROUP BY 1, 2)
SELECT product, round_even(CASE WHEN count(*) FILTER (WHERE n > 1) > 0
                           THEN count(*) FILTER (WHERE n > 1) / count(*) * 100 END, 6) AS repeat_purchase_rate_pct
FROM pc GROUP BY product""", "items_v"))
def _r4(spark, sf):
    return R.product_repeat_rate(_items(spark, sf))


_MPS = f"""mps AS (SELECT {month()} AS month, product, round_even(sum(quantity), 6) AS units,
          round_even(sum(line_price), 2) AS revenue
   FROM items_v WHERE product IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2)"""


@register("monthly_product_sales", V(f"WITH {_MPS} SELECT * FROM mps", "items_v"))
def _r5(spark, sf):
    return R.monthly_product_sales(_items(spark, sf))


@register("monthly_product_price", V(f"""
SELECT {month('i.date')} AS month, i.product,
  round_even(avg(i.line_price / nullif(i.quantity, 0)), 6) AS avg_unit_price,
  round_even(avg(CASE WHEN p.price > 0 THEN 1 - (i.line_price / nullif(i.quantity, 0)) / p.price END), 6) AS avg_discount_rate
FROM items_v i LEFT JOIN products_v p ON i.product = p.product
WHERE i.product IS NOT NULL AND i.date IS NOT NULL GROUP BY 1, 2""", "items_v", "products_v"))
def _r6(spark, sf):
    return R.monthly_product_price(_items(spark, sf), tb.products(spark, sf))


@register("items_per_order", V("""
SELECT round_even(avg(q), 6) AS avg_items_per_order, count(*) AS orders
FROM (SELECT order_id, sum(quantity) AS q FROM items_v WHERE order_id IS NOT NULL GROUP BY order_id)""", "items_v"))
def _r7(spark, sf):
    return R.items_per_order(_items(spark, sf))


@register("cross_sell_pairs", V("""
WITH op AS (SELECT DISTINCT order_id, product FROM items_v WHERE order_id IS NOT NULL AND product IS NOT NULL)
SELECT a.product AS product_a, b.product AS product_b, count(*) AS orders
FROM op a JOIN op b ON a.order_id = b.order_id AND a.product < b.product
GROUP BY 1, 2 HAVING count(*) >= 2""", "items_v"))
def _r8(spark, sf):
    return R.cross_sell_pairs(_items(spark, sf), rows=tb.read_table(spark, sf, "lineitem").count())


@register("top_product_series", V(f"""
WITH {_MPS},
top AS (SELECT product FROM mps GROUP BY product ORDER BY sum(revenue) DESC, product LIMIT 1),
m AS (SELECT DISTINCT month FROM mps)
SELECT m.month, top.product, coalesce(mps.revenue, 0.0) AS revenue
FROM m CROSS JOIN top LEFT JOIN mps ON mps.month = m.month AND mps.product = top.product""", "items_v"))
def _r9(spark, sf):
    return R.top_product_series(_items(spark, sf))
