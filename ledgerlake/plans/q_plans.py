"""Registered multi-operator plans: T14 monthly metrics (the flagship),
C15 customer report, the S5 KPI summary and its text consumers (S7, X5, X7)."""

from __future__ import annotations

from ledgerlake.operators import text as X
from ledgerlake.plans import q_basic, q_customers, q_time  # noqa: F401  (component oracles)
from ledgerlake.plans.metrics import customer_report, kpi_table, monthly_metrics
from ledgerlake.plans.registry import ORACLES, register
from ledgerlake.plans.sqlkit import month, spine
from ledgerlake.sources import files as S
from ledgerlake.sources import tables as tb
from ledgerlake.sources.tables import with_views as V

_KPI_PARTS = [
    ("basic_kpis", ["total_orders", "total_revenue", "unique_customers", "avg_orders_per_customer"]),
    ("average_order_value", ["aov"]),
    ("order_value_distribution", ["min", "q1", "median", "q3", "max", "mean", "std"]),
    ("clv_revenue", ["clv"]),
    ("churn_inactive", ["churn_rate"]),
    ("refund_cancellation", ["refund_rate", "cancellation_rate", "revenue_lost_refunds", "revenue_refund_pct",
                             "revenue_lost_cancellations", "revenue_cancel_pct"]),
    ("cart_abandonment_rate", ["abandonment_rate"]),
]


def kpi_sql() -> str:
    parts = []
    for i, (name, cols) in enumerate(_KPI_PARTS):
        for c in cols:
            parts.append(f"SELECT '{c}' AS metric, CAST(\"{c}\" AS DOUBLE) AS value FROM ({ORACLES[name]}) AS k{i}")
    return "\nUNION ALL\n".join(parts)


KPI_SQL = kpi_sql()


@register("kpi_summary", KPI_SQL)
def _s5(spark, sf):
    return kpi_table(spark, sf)


@register("summary_lines", f"""
SELECT '- ' || metric || ': ' || printf('%.6f', value) AS line, metric FROM ({KPI_SQL}) AS k""")
def _s7(spark, sf):
    return S.summary_lines(kpi_table(spark, sf))


def _kv(m: str) -> str:
    return f"(SELECT max(value) FROM kpi WHERE metric = '{m}')"


def _answer_sql() -> str:
    from ledgerlake.plans.q_text import _ROUTE
    case = "'" + X.METRIC_FALLBACK.replace("'", "''") + "'"
    for phrases, metric, tmpl, is_int in reversed(X.METRIC_RULES):
        cond = " OR ".join(f"contains(lower(text), '{p}')" for p in phrases)
        shown = f"CAST({_kv(metric)} AS BIGINT)" if is_int else f"round_even({_kv(metric)}, 2)"
        case = f"CASE WHEN ({cond}) AND {_kv(metric)} IS NOT NULL THEN printf('{tmpl}', {shown}) ELSE {case} END"
    return f"WITH kpi AS ({KPI_SQL}), routed AS ({_ROUTE}) SELECT routed.*, {case} AS answer FROM routed WHERE route = 'metric'"


def _pairs_sql() -> str:
    import re
    from ledgerlake.plans.q_text import TEMPLATES
    rows = []
    for prompt, completion in TEMPLATES:
        comp = "'" + completion.replace("'", "''") + "'"
        for m in sorted(set(re.findall(r"\{(\w+)\}", completion))):
            comp = f"replace({comp}, '{{{m}}}', printf('%.2f', round_even({_kv(m)}, 2)))"
        rows.append(f"SELECT '{prompt.replace(chr(39), chr(39) * 2)}' AS prompt, {comp} AS completion")
    return f"WITH kpi AS ({KPI_SQL}) " + " UNION ALL ".join(rows)


def _attach_text_oracles() -> None:
    ORACLES["answer_metric_questions"] = _answer_sql()
    ORACLES["instruction_pairs"] = _pairs_sql()


@register("monthly_metrics", V(f"""
WITH o AS (SELECT * FROM orders_c WHERE date IS NOT NULL),
base AS (SELECT {month()} AS period, sum(total) AS revenue, count(reference) AS orders,
  count(reference) FILTER (WHERE contains(state, 'O')) AS refund_count,
  sum(total) FILTER (WHERE contains(state, 'O')) AS refund_amount,
  count(reference) FILTER (WHERE contains(state, 'P')) AS cancel_count,
  sum(total) FILTER (WHERE contains(state, 'P')) AS cancel_amount FROM o GROUP BY 1),
sp AS ({spine('base')}),
cm AS (SELECT DISTINCT client, {month()} AS month FROM o WHERE client IS NOT NULL),
c AS (SELECT *, min(month) OVER (PARTITION BY client) AS cohort FROM cm),
nr AS (SELECT month AS period, count(*) AS unique_customers, count(*) FILTER (WHERE month = cohort) AS new_customers,
       count(*) - count(*) FILTER (WHERE month = cohort) AS returning_customers FROM c GROUP BY month),
m AS (SELECT month, dense_rank() OVER (ORDER BY month) AS ix FROM (SELECT DISTINCT month FROM cm)),
cmi AS (SELECT cm.client, m.ix FROM cm JOIN m USING (month)),
sz AS (SELECT ix, count(*) AS n FROM cmi GROUP BY ix),
lost AS (SELECT a.ix, count(*) AS l FROM cmi a
         WHERE NOT EXISTS (SELECT 1 FROM cmi b WHERE b.client = a.client AND b.ix = a.ix + 1) GROUP BY a.ix),
ch AS (SELECT m.month AS period, round_even(coalesce(lost.l, 0) / nullif(sz.n, 0) * 100, 6) AS churn_rate
       FROM m JOIN sz ON sz.ix = m.ix - 1 LEFT JOIN lost ON lost.ix = m.ix - 1),
pg AS (SELECT {month()} AS period, payment, sum(total) AS rev FROM o WHERE payment IS NOT NULL GROUP BY 1, 2),
pay AS (SELECT period, payment AS top_payment FROM
        (SELECT *, row_number() OVER (PARTITION BY period ORDER BY rev DESC, payment) AS rn FROM pg) WHERE rn = 1),
cg AS (SELECT {month()} AS period, country, sum(total) AS rev FROM o WHERE country IS NOT NULL GROUP BY 1, 2),
ctry AS (SELECT period, country AS top_country FROM
        (SELECT *, row_number() OVER (PARTITION BY period ORDER BY rev DESC, country) AS rn FROM cg) WHERE rn = 1)
SELECT sp.period, round_even(coalesce(revenue, 0), 2) AS revenue, coalesce(orders, 0) AS orders,
  coalesce(unique_customers, 0) AS unique_customers,
  round_even(coalesce(revenue, 0) / nullif(coalesce(orders, 0), 0), 6) AS aov,
  coalesce(new_customers, 0) AS new_customers, coalesce(returning_customers, 0) AS returning_customers, churn_rate,
  coalesce(refund_count, 0) AS refund_count, round_even(coalesce(refund_amount, 0), 2) AS refund_amount,
  coalesce(cancel_count, 0) AS cancel_count, round_even(coalesce(cancel_amount, 0), 2) AS cancel_amount,
  top_payment, top_country
FROM sp LEFT JOIN base USING (period) LEFT JOIN nr USING (period) LEFT JOIN ch USING (period)
LEFT JOIN pay USING (period) LEFT JOIN ctry USING (period)""", "orders_c"))
def _t14(spark, sf):
    return monthly_metrics(tb.orders(spark, sf), tb.orders(spark, sf, with_country=True))


@register("customer_report", V(f"""
WITH g AS (SELECT {month()} AS period, count(DISTINCT client) AS customers FROM orders_v WHERE date IS NOT NULL GROUP BY 1),
sp AS ({spine('g')}),
acq AS (SELECT 'monthly_acquisition' AS section, CAST(sp.period AS VARCHAR) AS key,
               CAST(coalesce(g.customers, 0) AS DOUBLE) AS value FROM sp LEFT JOIN g USING (period)),
geo AS (SELECT 'geographic_distribution' AS section, country AS key, CAST(count(*) AS DOUBLE) AS value
        FROM orders_c WHERE country IS NOT NULL GROUP BY country)
SELECT * FROM acq UNION ALL SELECT * FROM geo
UNION ALL SELECT 'clv', 'clv', clv FROM ({ORACLES['clv_revenue']}) AS c
UNION ALL SELECT 'purchase_frequency', 'avg_purchase_frequency', avg_purchase_frequency
  FROM ({ORACLES['purchase_frequency_mean']}) AS p""", "orders_v", "orders_c"))
def _c15(spark, sf):
    return customer_report(spark, sf)


from ledgerlake.plans import q_text  # noqa: E402,F401  (registers the X-queries first)

_attach_text_oracles()
