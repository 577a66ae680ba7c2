"""Registered J/I-queries (joins, margins, inventory) and their DuckDB oracles."""

from __future__ import annotations

from ledgerlake.operators import customers as C
from ledgerlake.operators import inventory as I
from ledgerlake.plans.registry import register
from ledgerlake.plans.sqlkit import month
from ledgerlake.sources import tables as tb
from ledgerlake.sources.tables import with_views as V

_ENR = """enr AS (SELECT l.*, i.factory_price, i.retail, i.retail_us, i.sfa, i.lib
                  FROM lines_v l LEFT JOIN inv_v i ON l.ref = i.id)"""


def _lines(spark, sf):
    return tb.sales_lines(spark, sf)


def _inv(spark, sf):
    return tb.inventory(spark, sf)


@register("enrich_sales", V(f"WITH {_ENR} SELECT * FROM enr", "lines_v", "inv_v"))
def _j1(spark, sf):
    return I.enrich_sales(_lines(spark, sf), _inv(spark, sf))


@register("unmatched_products", V("""
SELECT count(DISTINCT ref) AS unmatched_products FROM lines_v
WHERE ref IS NOT NULL AND ref NOT IN (SELECT id FROM inv_v WHERE id IS NOT NULL)""", "lines_v", "inv_v"))
def _j1b(spark, sf):
    return I.unmatched_products(_lines(spark, sf), _inv(spark, sf))


@register("stock_full_join", V("""
WITH s AS (SELECT ref AS product_id, sum(qty) AS total_units_sold, avg(qty) AS avg_units, count(qty) AS sales_frequency
           FROM lines_v WHERE ref IS NOT NULL GROUP BY ref)
SELECT coalesce(s.product_id, i.id) AS product_id, coalesce(total_units_sold, 0) AS total_units_sold,
       round_even(coalesce(avg_units, 0), 6) AS avg_units, coalesce(sales_frequency, 0) AS sales_frequency,
       i.qty AS stock_qty, i.retail, i.factory_price
FROM s FULL OUTER JOIN inv_v i ON s.product_id = i.id""", "lines_v", "inv_v"))
def _j2(spark, sf):
    return I.stock_full_join(_lines(spark, sf), _inv(spark, sf))


@register("line_margin", V(f"""
WITH {_ENR} SELECT *, (retail - factory_price) * qty AS margin FROM enr""", "lines_v", "inv_v"))
def _i1(spark, sf):
    return I.line_margin(I.enrich_sales(_lines(spark, sf), _inv(spark, sf)))


def _gm_sql(keys: list[str], key_exprs: list[str]) -> str:
    sel = ", ".join(f"{e} AS {k}" for k, e in zip(keys, key_exprs))
    grp = f"GROUP BY {', '.join(str(i + 1) for i in range(len(keys)))}" if keys else ""
    head = f"{sel}, " if keys else ""
    return f"""SELECT {head}round_even(sum(retail * qty), 2) AS revenue, round_even(sum(factory_price * qty), 2) AS total_cost,
  round_even(sum(retail * qty - factory_price * qty), 2) AS gross_profit, round_even(sum(qty), 6) AS units,
  round_even(sum(retail * qty - factory_price * qty) / nullif(sum(retail * qty), 0) * 100, 2) AS margin_rate
FROM enr {grp}"""


@register("gross_margin_rate", V(f"WITH {_ENR} {_gm_sql([], [])}", "lines_v", "inv_v"))
def _i2(spark, sf):
    return I.gross_margin_rate(I.enrich_sales(_lines(spark, sf), _inv(spark, sf)))


@register("gross_margin_by_category", V(f"WITH {_ENR} {_gm_sql(['sfa'], ['sfa'])}", "lines_v", "inv_v"))
def _i2c(spark, sf):
    return I.gross_margin_rate(I.enrich_sales(_lines(spark, sf), _inv(spark, sf)), groupby="sfa")


@register("gross_margin_monthly", V(f"WITH {_ENR} {_gm_sql(['sfa', 'period'], ['sfa', month()])}",
                                    "lines_v", "inv_v"))
def _i2m(spark, sf):
    return I.gross_margin_rate(I.enrich_sales(_lines(spark, sf), _inv(spark, sf)), groupby="sfa", time_freq="M")


@register("margin_stats", V(f"""
WITH {_ENR}, r AS ({_gm_sql(['sfa'], ['sfa'])})
SELECT round_even(avg(margin_rate), 6) AS avg_margin, round_even(quantile_cont(margin_rate, 0.5), 6) AS median_margin,
  round_even(stddev_samp(margin_rate), 6) AS margin_std, round_even(min(margin_rate), 6) AS min_margin,
  round_even(max(margin_rate), 6) AS max_margin FROM r""", "lines_v", "inv_v"))
def _i3(spark, sf):
    return I.margin_stats(I.gross_margin_rate(I.enrich_sales(_lines(spark, sf), _inv(spark, sf)), groupby="sfa"))


@register("inventory_metrics", V("""
WITH l AS (SELECT * FROM lines_v WHERE ref IS NOT NULL AND date IS NOT NULL),
d AS (SELECT ref, CAST(date AS DATE) AS d, sum(qty) AS q FROM l GROUP BY 1, 2),
w AS (SELECT ref, CAST(date_trunc('week', date) AS DATE) AS w, sum(qty) AS q FROM l GROUP BY 1, 2),
ds AS (SELECT ref, avg(q) AS a, stddev_samp(q) AS s, count(q) AS c FROM d GROUP BY ref),
ws AS (SELECT ref, avg(q) AS a, stddev_samp(q) AS s, count(q) AS c FROM w GROUP BY ref),
m AS (SELECT i.id AS ref, coalesce(i.qty, 0) AS stock_qty, coalesce(ds.a, 0) AS daily_avg_sales,
        coalesce(ds.s, 0) AS daily_sales_std, coalesce(ds.c, 0) AS days_with_sales,
        coalesce(ws.a, 0) AS weekly_avg_sales, coalesce(ws.s, 0) AS weekly_sales_std, coalesce(ws.c, 0) AS weeks_with_sales
      FROM inv_v i LEFT JOIN ds ON i.id = ds.ref LEFT JOIN ws ON i.id = ws.ref),
m2 AS (SELECT *, CASE WHEN daily_avg_sales > 0 THEN stock_qty / daily_avg_sales ELSE 'inf'::DOUBLE END AS doi,
              CASE WHEN daily_avg_sales > 0 THEN daily_sales_std / daily_avg_sales ELSE 0.0 END AS cv FROM m)
SELECT ref, stock_qty, round_even(daily_avg_sales, 6) AS daily_avg_sales, round_even(daily_sales_std, 6) AS daily_sales_std,
  days_with_sales, round_even(weekly_avg_sales, 6) AS weekly_avg_sales, round_even(weekly_sales_std, 6) AS weekly_sales_std,
  weeks_with_sales,
  round_even(daily_avg_sales * 30 / greatest(CAST(stock_qty AS DOUBLE), 0.1), 6) AS daily_turnover_ratio,
  round_even(weekly_avg_sales * 4 / greatest(CAST(stock_qty AS DOUBLE), 0.1), 6) AS weekly_turnover_ratio,
  round_even(doi, 6) AS days_of_inventory,
  CASE WHEN doi <= 15 THEN 'Critical' WHEN doi <= 30 THEN 'Low' WHEN doi <= 60 THEN 'Adequate' ELSE 'Excess' END AS stock_status,
  round_even(cv, 6) AS daily_sales_cv,
  CASE WHEN doi < 15 AND cv < 1 THEN 'High Risk - Consistent Sales'
       WHEN doi < 15 AND cv >= 1 THEN 'Medium Risk - Volatile Sales' ELSE 'Low Risk' END AS stock_risk
FROM m2""", "lines_v", "inv_v"))
def _i4(spark, sf):
    return I.inventory_metrics(_lines(spark, sf), _inv(spark, sf))


def _prof(per: str) -> str:
    return f"""{_ENR},
p AS (SELECT ref, lib, sfa, sum(qty) AS total_units, count(qty) AS total_transactions, min(factory_price) AS cost_price,
        min(retail) AS retail_price, min(retail_us) AS retail_price_us, count(DISTINCT {per}) AS active_periods
      FROM enr WHERE ref IS NOT NULL AND lib IS NOT NULL AND sfa IS NOT NULL GROUP BY 1, 2, 3),
prof AS (SELECT ref AS product_id, lib AS product_name, sfa AS category, total_units, total_transactions, cost_price,
        retail_price, retail_price_us, active_periods, round_even(total_units * retail_price, 2) AS total_revenue,
        round_even(total_units * cost_price, 2) AS total_cost,
        round_even(total_units * retail_price - total_units * cost_price, 2) AS gross_profit,
        round_even((total_units * retail_price - total_units * cost_price) / nullif(total_units * retail_price, 0) * 100, 2)
          AS margin_rate,
        round_even(total_units / nullif(active_periods, 0), 2) AS avg_units_per_period
      FROM p WHERE total_units >= 1)"""


@register("product_profitability", V(f"WITH {_prof(month())} SELECT * FROM prof", "lines_v", "inv_v"))
def _i5(spark, sf):
    return I.product_profitability(_lines(spark, sf), _inv(spark, sf))


@register("profitability_stats", V(f"""
WITH {_prof(month())}
SELECT count(*) AS total_products, round_even(sum(total_revenue), 2) AS total_revenue,
  round_even(sum(gross_profit), 2) AS total_profit, round_even(avg(margin_rate), 6) AS avg_margin_rate,
  round_even(quantile_cont(margin_rate, 0.5), 6) AS median_margin_rate, max(margin_rate) AS top_margin_rate,
  min(margin_rate) AS bottom_margin_rate FROM prof""", "lines_v", "inv_v"))
def _i6(spark, sf):
    return I.profitability_stats(I.product_profitability(_lines(spark, sf), _inv(spark, sf)))


def _abc(per: str) -> str:
    return f"""{_prof(per)},
c AS (SELECT *, sum(total_revenue) OVER (ORDER BY total_revenue DESC NULLS LAST, product_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(total_revenue) OVER () AS grand FROM prof),
st AS (SELECT id, CAST(sum(qty) AS BIGINT) AS current_stock FROM inv_v GROUP BY id),
abc AS (SELECT c.product_id, product_name, category, total_units, total_transactions, cost_price, retail_price,
        retail_price_us, active_periods, total_revenue, total_cost, gross_profit, margin_rate, avg_units_per_period,
        round_even(total_revenue / nullif(grand, 0), 6) AS revenue_contribution,
        round_even(cum / nullif(grand, 0), 6) AS cumulative_contribution,
        CASE WHEN round_even(cum / nullif(grand, 0), 9) <= 0.8 THEN 'A'
             WHEN round_even(cum / nullif(grand, 0), 9) <= 0.95 THEN 'B' ELSE 'C' END AS abc_category,
        st.current_stock, round_even(st.current_stock * cost_price, 6) AS stock_value
      FROM c LEFT JOIN st ON c.product_id = st.id)"""


@register("abc_classes", V(f"WITH {_abc(month())} SELECT * FROM abc", "lines_v", "inv_v"))
def _i7(spark, sf):
    return I.abc_classes(_lines(spark, sf), _inv(spark, sf))


@register("abc_summary", V(f"""
WITH {_abc(month())}, g AS (SELECT abc_category, count(*) AS product_count, sum(total_revenue) AS total_revenue,
                         sum(total_units) AS total_units, sum(gross_profit) AS gross_profit FROM abc GROUP BY 1)
SELECT abc_category, product_count, round_even(total_revenue, 2) AS total_revenue, round_even(total_units, 6) AS total_units,
       round_even(gross_profit, 2) AS gross_profit,
       round_even(total_revenue / nullif(sum(total_revenue) OVER (), 0) * 100, 2) AS revenue_percent FROM g""",
                           "lines_v", "inv_v"))
def _i8(spark, sf):
    return I.abc_summary(I.abc_classes(_lines(spark, sf), _inv(spark, sf)))


@register("stock_recommendations", V(f"""
WITH {_abc("CAST(date AS DATE)")},
d AS (SELECT date, ref, sum(qty) AS q FROM lines_v WHERE ref IS NOT NULL GROUP BY 1, 2),
st2 AS (SELECT ref AS product_id, avg(q) AS avg_daily_sales, stddev_samp(q) AS sales_std, max(q) AS max_daily_sales
        FROM d GROUP BY ref),
r AS (SELECT abc.*, st2.avg_daily_sales, st2.sales_std, st2.max_daily_sales,
        CASE abc_category WHEN 'A' THEN 14 WHEN 'B' THEN 21 WHEN 'C' THEN 30 END AS safety_stock_days
      FROM abc LEFT JOIN st2 USING (product_id)),
r2 AS (SELECT *, round_even(avg_daily_sales * safety_stock_days + sales_std * sqrt(7.0), 0) AS safety_stock FROM r),
r3 AS (SELECT *, round_even(avg_daily_sales * 7.0 + safety_stock, 0) AS reorder_point,
         round_even(avg_daily_sales * sqrt(14.0 * safety_stock_days), 0) AS optimal_order_qty FROM r2)
SELECT * REPLACE (round_even(avg_daily_sales, 6) AS avg_daily_sales, round_even(sales_std, 6) AS sales_std),
  CASE WHEN current_stock <= safety_stock THEN 'Critical' WHEN current_stock <= reorder_point THEN 'Reorder'
       ELSE 'Adequate' END AS stock_status,
  CASE WHEN avg_daily_sales > 0 THEN round_even(current_stock / avg_daily_sales, 0) ELSE 999.0 END AS days_of_stock
FROM r3""", "lines_v", "inv_v"))
def _i9(spark, sf):
    return I.stock_recommendations(_lines(spark, sf), _inv(spark, sf))


_MOVE = """mx AS (SELECT max(date) AS e FROM lines_v),
s AS (SELECT ref AS product_id, sum(qty) AS total_units_sold, avg(qty) AS avg_units_per_period,
        count(qty) AS sales_frequency, min(date) AS first_sale, max(date) AS last_sale
      FROM lines_v, mx WHERE date >= mx.e - INTERVAL 90 DAY AND ref IS NOT NULL GROUP BY ref),
s2 AS (SELECT s.*, CAST(floor((epoch(mx.e) - epoch(last_sale)) / 86400) AS BIGINT) AS days_since_last_sale FROM s, mx),
j AS (SELECT coalesce(s2.product_id, i.id) AS product_id, coalesce(total_units_sold, 0) AS total_units_sold,
        coalesce(avg_units_per_period, 0) AS avg_units_per_period, coalesce(sales_frequency, 0) AS sales_frequency,
        first_sale, last_sale, days_since_last_sale, i.qty AS stock_qty, i.retail, i.factory_price
      FROM s2 FULL OUTER JOIN inv_v i ON s2.product_id = i.id),
j2 AS (SELECT *, stock_qty * factory_price AS stock_value, total_units_sold / CAST(90 AS DOUBLE) AS daily_sales_rate,
        CASE WHEN total_units_sold / CAST(90 AS DOUBLE) > 0 THEN stock_qty / (total_units_sold / CAST(90 AS DOUBLE))
             ELSE 'inf'::DOUBLE END AS days_of_stock FROM j),
cut AS (SELECT quantile_cont(total_units_sold, 0.8) AS c FROM j2),
j3 AS (SELECT j2.*, CASE WHEN total_units_sold >= cut.c THEN 'Best Seller' WHEN total_units_sold = 0 THEN 'Dead Stock'
                        WHEN avg_units_per_period <= 1 THEN 'Slow Mover' ELSE 'Regular Mover' END AS movement_category,
        CASE WHEN stock_qty = 0 AND total_units_sold > 0 THEN 'Out of Stock' WHEN days_of_stock <= 30 THEN 'Low Stock'
             WHEN days_of_stock >= 180 THEN 'Overstocked' ELSE 'Optimal' END AS stock_status FROM j2, cut),
mv AS (SELECT product_id, total_units_sold, round_even(avg_units_per_period, 6) AS avg_units_per_period, sales_frequency,
        first_sale, last_sale, days_since_last_sale, stock_qty, retail, factory_price,
        round_even(stock_value, 6) AS stock_value, round_even(daily_sales_rate, 6) AS daily_sales_rate,
        round_even(days_of_stock, 6) AS days_of_stock, movement_category, stock_status,
        CASE WHEN movement_category = 'Dead Stock' THEN 'Consider clearance/promotion or discontinuation'
             WHEN movement_category = 'Best Seller' AND stock_status IN ('Out of Stock', 'Low Stock') THEN 'Urgent restock needed'
             WHEN movement_category = 'Slow Mover' AND stock_status = 'Overstocked' THEN 'Consider promotion or inventory reduction'
             WHEN stock_status = 'Overstocked' THEN 'Review order quantities'
             WHEN stock_status = 'Low Stock' AND movement_category <> 'Slow Mover' THEN 'Plan restock'
             ELSE 'Maintain current strategy' END AS recommendation, stock_value AS sv_raw FROM j3)"""


@register("product_movement", V(f"WITH {_MOVE} SELECT * EXCLUDE (sv_raw) FROM mv", "lines_v", "inv_v"))
def _i10(spark, sf):
    return I.product_movement(_lines(spark, sf), _inv(spark, sf), bestseller_threshold=0.2)


@register("movement_summary", V(f"""
WITH {_MOVE}
SELECT 'category_counts' AS section, movement_category AS key, CAST(count(*) AS DOUBLE) AS value FROM mv GROUP BY 2
UNION ALL SELECT 'stock_status_counts', stock_status, CAST(count(*) AS DOUBLE) FROM mv GROUP BY 2
UNION ALL SELECT 'bestseller_stock_availability', stock_status, CAST(count(*) AS DOUBLE) FROM mv
  WHERE movement_category = 'Best Seller' GROUP BY 2
UNION ALL SELECT 'totals', 'total_stock_value', round_even(coalesce(sum(stock_value), 0), 6) FROM mv
UNION ALL SELECT 'totals', 'dead_stock_value',
  round_even(coalesce(sum(stock_value) FILTER (WHERE movement_category = 'Dead Stock'), 0), 6) FROM mv
UNION ALL SELECT 'bestseller_stats', 'count', CAST(count(*) AS DOUBLE) FROM mv WHERE movement_category = 'Best Seller'
UNION ALL SELECT 'bestseller_stats', 'total_units', round_even(sum(total_units_sold), 6) FROM mv
  WHERE movement_category = 'Best Seller'""", "lines_v", "inv_v"))
def _i11(spark, sf):
    return I.movement_summary(I.product_movement(_lines(spark, sf), _inv(spark, sf), bestseller_threshold=0.2))


@register("overall_margin", V("""
WITH c AS (SELECT sum(factory_price * qty) AS cost FROM inv_v), r AS (SELECT sum(unit_price) AS rev FROM lines_v)
SELECT round_even(CASE WHEN rev > 0 THEN (rev - cost) / rev * 100 ELSE 0 END, 6) AS gross_profit_margin FROM r, c""",
                              "lines_v", "inv_v"))
def _i12(spark, sf):
    return I.overall_margin(_lines(spark, sf), _inv(spark, sf))


_MM = """mm AS (SELECT id, lib, round_even(factory_price * qty, 6) AS total_cost,
  round_even(retail - factory_price * qty, 6) AS margin_eur,
  round_even((retail - factory_price * qty) / nullif(retail, 0), 6) AS margin_eur_pct,
  round_even(retail_us - factory_price * qty, 6) AS margin_us,
  round_even((retail_us - factory_price * qty) / nullif(retail_us, 0), 6) AS margin_us_pct FROM inv_v)"""


@register("market_margins", V(f"WITH {_MM} SELECT * FROM mm", "inv_v"))
def _i13(spark, sf):
    return I.market_margins(_inv(spark, sf))


@register("market_margin_means", V("""
SELECT round_even(avg(retail - factory_price * qty), 6) AS avg_margin_eur,
       round_even(avg(retail_us - factory_price * qty), 6) AS avg_margin_us FROM inv_v""", "inv_v"))
def _i13b(spark, sf):
    return I.market_margin_means(_inv(spark, sf))


@register("market_margin_extremes", V(f"""
WITH {_MM}
(SELECT *, 'top_margin_eur' AS list FROM mm ORDER BY margin_eur DESC, id LIMIT 10)
UNION ALL (SELECT *, 'bottom_margin_us_pct' AS list FROM mm ORDER BY margin_us_pct ASC, id LIMIT 15)""", "inv_v"))
def _i13c(spark, sf):
    return I.market_margin_extremes(_inv(spark, sf))


@register("clv_profit", V("""
WITH e AS (SELECT l.client, l.qty, i.factory_price, i.retail FROM lines_c l LEFT JOIN inv_v i ON l.ref = i.id)
SELECT round_even(avg((retail - factory_price) * qty) * (count(client) / nullif(count(DISTINCT client), 0)) * 12, 6)
  AS clv FROM e""", "lines_c", "inv_v"))
def _c4(spark, sf):
    lines = I.enrich_sales(tb.sales_lines(spark, sf, with_client=True), _inv(spark, sf))
    return C.clv_profit(lines)
