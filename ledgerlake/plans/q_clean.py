"""Registered P-queries (cleaning, validation, profiling) and DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import clean as P
from ledgerlake.operators import customers as C
from ledgerlake.operators import rules as R
from ledgerlake.plans import pipeline as PL
from ledgerlake.plans.registry import register
from ledgerlake.sources import exports as X
from ledgerlake.sources import tables as tb
from ledgerlake.sources.tables import with_views as V

ORDERS_COLS = "id, reference, client, total, date, state, payment"


@register("standardize_columns", V(f"SELECT {ORDERS_COLS} FROM orders_v", "orders_v"))
def _p1(spark, sf):
    o = tb.orders(spark, sf)
    return P.standardize_columns(o.toDF(*[f" {c} " for c in o.columns]))


@register("snake_case_columns", V("SELECT * FROM inv_v", "inv_v"))
def _p2(spark, sf):
    return P.snake_case_columns(X.inventory_export(tb.inventory(spark, sf)))


@register("clean_amount", V("SELECT CAST(id AS VARCHAR) AS id, total FROM orders_v", "orders_v"))
def _p3(spark, sf):
    e = P.standardize_columns(X.orders_export(tb.orders(spark, sf)))
    return P.clean_amount_column(e, "Total", "total").select("id", "total")


@register("clean_amount_report", V("""
SELECT count(total) AS original_non_null, count(total) AS converted_non_null FROM orders_v""", "orders_v"))
def _p3r(spark, sf):
    e = P.standardize_columns(X.orders_export(tb.orders(spark, sf)))
    return P.amount_conversion_report(P.clean_amount_column(e, "Total", "total_clean"), "Total", "total_clean")


@register("clean_retail_amounts", V("""
SELECT order_id, line, round_even(unit_price, 2) AS "PV TTC", amount AS "CA TTC" FROM lines_v""", "lines_v"))
def _p4(spark, sf):
    e = X.retail_export(tb.sales_lines(spark, sf))
    return P.clean_retail_amounts(e, ["PV TTC", "CA TTC"]).select("order_id", "line", "PV TTC", "CA TTC")


@register("parse_date", V("""
SELECT order_id, line, CAST(CAST(date AS DATE) AS TIMESTAMP) AS "Date" FROM lines_v WHERE date IS NOT NULL""",
                          "lines_v"))
def _p5(spark, sf):
    e = X.retail_export(tb.sales_lines(spark, sf))
    return P.parse_date(e, "Date", "dd MMM yyyy").select("order_id", "line", "Date")


@register("exclude_clients", V(f"""
SELECT {ORDERS_COLS} FROM orders_v
WHERE client IS NULL OR client NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD' AND c_custkey IS NOT NULL)""",
                               "orders_v"))
def _p6(spark, sf):
    ex = tb.read_table(spark, sf, "customer").where(F.col("c_mktsegment") == "HOUSEHOLD") \
           .select(F.col("c_custkey").alias("client"))
    return P.exclude_clients(tb.orders(spark, sf), ex)


@register("filter_min_date", V(f"SELECT {ORDERS_COLS} FROM orders_v WHERE date >= TIMESTAMP '1997-01-01'", "orders_v"))
def _p7(spark, sf):
    return P.filter_min_date(tb.orders(spark, sf), "1997-01-01")


@register("drop_empty_carts", V(f"""
SELECT * FROM carts_v WHERE NOT coalesce(order_ref = '{tb.ABANDONED_MARKER}' AND total = 0, false)""", "carts_v"))
def _p8(spark, sf):
    return P.drop_empty_carts(tb.carts(spark, sf), tb.ABANDONED_MARKER)


@register("require_columns", V(f"""
SELECT {ORDERS_COLS} FROM orders_v WHERE client IS NOT NULL AND total IS NOT NULL AND date IS NOT NULL""", "orders_v"))
def _p9(spark, sf):
    return P.require_columns(tb.orders(spark, sf), ["client", "total", "date"])


@register("fill_unknown", V("""
SELECT id, order_ref, coalesce(CAST(client AS VARCHAR), 'Unknown') AS client, total, date,
       coalesce(carrier, 'Unknown') AS carrier FROM carts_v""", "carts_v"))
def _p10(spark, sf):
    c = tb.carts(spark, sf).withColumn("client", F.col("client").cast("string"))
    return P.fill_unknown(c, ["client", "carrier"])


@register("dedup_by_keys", V("""
SELECT order_id, line, date, ref, qty, amount, unit_price FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id, line ORDER BY date NULLS FIRST, ref NULLS FIRST,
         qty NULLS FIRST, amount NULLS FIRST, unit_price NULLS FIRST) AS rn FROM lines_v) WHERE rn = 1""", "lines_v"))
def _p11(spark, sf):
    return P.dedup_by_keys(tb.sales_lines(spark, sf), ["order_id", "line"])


@register("dedup_exact", V("SELECT DISTINCT * FROM lines_v", "lines_v"))
def _p12(spark, sf):
    return P.dedup_exact(tb.sales_lines(spark, sf))


def _order_rules():
    return [("Total must be >= 0", F.col("total") >= 0),
            ("Date must not be in the future", F.col("date") <= F.lit("2100-01-01").cast("timestamp_ntz")),
            ("Client is required", F.col("client").isNotNull()),
            ("State is required", F.col("state").isNotNull())]


@register("validate_rows", V("""
WITH r AS (SELECT id, list_filter([CASE WHEN NOT coalesce(total >= 0, false) THEN 'Total must be >= 0' END,
  CASE WHEN NOT coalesce(date <= TIMESTAMP '2100-01-01', false) THEN 'Date must not be in the future' END,
  CASE WHEN NOT coalesce(client IS NOT NULL, false) THEN 'Client is required' END,
  CASE WHEN NOT coalesce(state IS NOT NULL, false) THEN 'State is required' END], lambda x: x IS NOT NULL) AS e
  FROM orders_v)
SELECT id, len(e) = 0 AS ok, array_to_string(e, '; ') AS errors FROM r""", "orders_v"))
def _p13(spark, sf):
    return P.validate_rows(tb.orders(spark, sf), _order_rules())


def _broken_sql(rules, as_of):
    """(message, condition) of each rule in DuckDB's words."""
    out = []
    for c, kind, bound in rules:
        optional, kind = kind.startswith("optional "), kind.removeprefix("optional ")
        text = f"CAST({c} AS VARCHAR)"
        number = f"TRY_CAST({text} AS DECIMAL(38, 6))"
        value = {"text": text, "date": f"TRY_CAST({text} AS TIMESTAMP)", "amount": number,
                 "integer": f"CASE WHEN {number} = floor({number}) THEN {number} END"}[kind]
        out.append((f"{c} must be {'an' if kind in ('integer', 'amount') else 'a'} {kind}",
                    f"({value}) IS NULL AND {c} IS NOT NULL" if optional else f"({value}) IS NULL"))
        if bound:
            limit = bound.replace("as_of", f"TIMESTAMP '{as_of}'")
            out.append((f"{c} {R.MEANING[bound]}", f"NOT coalesce(({value}) {limit}, true)"))
    return out


def _validate_sql(view, rules, keys, as_of):
    cases = ", ".join(f"CASE WHEN {b} THEN '{m}' END" for m, b in _broken_sql(rules, as_of))
    return V(f"""WITH r AS (SELECT {keys}, list_filter([{cases}], lambda x: x IS NOT NULL) AS e FROM {view})
SELECT {keys}, len(e) = 0 AS ok, array_to_string(e, '; ') AS errors FROM r""", view)


def _report_sql(tables):
    parts = [f"SELECT '{name}' AS \"table\", '{m}' AS rule, count(*) AS n_rows, count(*) FILTER (WHERE {b}) AS n_broken FROM {view}"
             for name, view, rules, as_of in tables for m, b in _broken_sql(rules, as_of)]
    return V("\nUNION ALL ".join(parts), *[view for _, view, _, _ in tables])


# The day of validation lies inside the data of each table, so that later rows are found.
_CHECKED = [("orders", "orders_v", R.ORDER_RULES, "1998-01-01"), ("carts", "carts_v", R.CART_RULES, "2024-01-20"),
            ("inventory", "inv_v", R.INVENTORY_RULES, None), ("lines", "lines_v", R.LINE_RULES, "1998-01-01")]


def _source(spark, sf, name):
    return {"orders": tb.orders, "carts": tb.carts, "inventory": tb.inventory, "lines": tb.sales_lines}[name](spark, sf)


def _register_rules(name, view, rules, as_of):
    keys = ["order_id", "line"] if name == "lines" else ["id"]

    @register(f"validate_{name}", _validate_sql(view, rules, ", ".join(keys), as_of))
    def _rows(spark, sf):
        return R.validate(_source(spark, sf, name), rules, keys, as_of)


for _table in _CHECKED:
    _register_rules(*_table)


@register("validation_report", _report_sql(_CHECKED))
def _p13r(spark, sf):
    parts = [R.rule_report(_source(spark, sf, name), rules, as_of).select(F.lit(name).alias("table"), "rule", "n_rows", "n_broken")
             for name, _, rules, as_of in _CHECKED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_DQ = """WITH q AS (SELECT quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.75) AS q3 FROM orders_v),
d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM orders_v)),
a AS (SELECT count(*) AS rows_, count(*) FILTER (WHERE total < 0) AS neg,
        count(*) FILTER (WHERE total < q1 - 1.5 * (q3 - q1) OR total > q3 + 1.5 * (q3 - q1)) AS outl,
        count(*) FILTER (WHERE date > TIMESTAMP '1998-01-01') AS fut,
        count(*) FILTER (WHERE date < TIMESTAMP '2020-01-01') AS old FROM orders_v, q),
k AS (SELECT 'required' AS "check", CAST(1 AS BIGINT) AS n_bad, 'Missing required columns: carrier' AS t
      UNION ALL SELECT 'duplicates', a.rows_ - d.n, 'Found ' || (a.rows_ - d.n) || ' duplicate rows' FROM a, d
      UNION ALL SELECT 'neg:total', neg, 'Found ' || neg || ' negative values in total' FROM a
      UNION ALL SELECT 'outlier:total', outl, 'Found ' || outl || ' potential outliers in total' FROM a
      UNION ALL SELECT 'future:date', fut, 'Found ' || fut || ' future dates in date' FROM a
      UNION ALL SELECT 'old:date', old, 'Found ' || old || ' dates before 2020-01-01 in date' FROM a),
l AS (SELECT "check", n_bad = 0 AS passed, n_bad, CASE WHEN n_bad > 0 THEN t END AS issue FROM k)"""


def _dq(spark, sf):
    return P.data_quality_score(tb.orders(spark, sf), ["id", "total", "date", "client", "carrier"], ["total", "weight"], ["date"],
                                now="1998-01-01")


@register("data_quality_checks", V(f"{_DQ} SELECT * FROM l", "orders_v"))
def _p14(spark, sf):
    return _dq(spark, sf)


@register("data_quality_score", V(f"""{_DQ}
SELECT round_even(count(*) FILTER (WHERE passed) / count(*), 6) AS score, count(*) AS checks FROM l""", "orders_v"))
def _p14s(spark, sf):
    return P.quality_score(_dq(spark, sf))


def _profile_sql():
    parts = []
    for c, dtype in (("id", "bigint"), ("reference", "string"), ("client", "bigint"), ("total", "double"), ("date", "timestamp_ntz"),
                     ("state", "string"), ("payment", "string")):
        head = f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls"
        x = f"CAST({c} AS DOUBLE)"
        stats = [f"avg({x})", f"stddev_samp({x})", f"min({x})", *[f"quantile_cont({x}, {p})" for p in (0.25, 0.5, 0.75)], f"max({x})"]
        if dtype in ("bigint", "double"):
            values = [f"count({c})", *[f"round_even({e}, 6)" for e in stats]]
        else:
            values = ["CAST(NULL AS BIGINT)", *["CAST(NULL AS DOUBLE)"] * 7]
        names = ("count", "mean", "std", "min", "q1", "median", "q3", "max")
        parts.append(f"{head}, {', '.join(f'{v} AS {n}' for v, n in zip(values, names, strict=True))} FROM orders_v")
    return V("\nUNION ALL ".join(parts), "orders_v")


@register("profile_table", _profile_sql())
def _p16(spark, sf):
    return P.profile_table(tb.orders(spark, sf))


@register("histogram", V("""
WITH b AS (SELECT min(total) AS lo, max(total) AS hi FROM orders_v),
g AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((total - lo) / (hi - lo) * 30.0), 29) END AS INTEGER) AS bin,
             count(*) AS c FROM orders_v, b WHERE total IS NOT NULL GROUP BY 1),
s AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
SELECT s.bin, round_even(lo + s.bin * ((hi - lo) / 30.0), 6) AS bin_start,
       round_even(lo + (s.bin + 1) * ((hi - lo) / 30.0), 6) AS bin_end, coalesce(g.c, 0) AS count
FROM s CROSS JOIN b LEFT JOIN g ON s.bin = g.bin""", "orders_v"))
def _p17(spark, sf):
    return P.histogram(tb.orders(spark, sf), "total")


@register("correlation_matrix", V("""
WITH a AS (SELECT corr(qty, qty) AS c0, corr(qty, amount) AS c1, corr(qty, unit_price) AS c2,
  corr(amount, qty) AS c3, corr(amount, amount) AS c4, corr(amount, unit_price) AS c5,
  corr(unit_price, qty) AS c6, corr(unit_price, amount) AS c7, corr(unit_price, unit_price) AS c8 FROM lines_v)
SELECT * FROM (VALUES ('qty', 'qty', 0), ('qty', 'amount', 1), ('qty', 'unit_price', 2), ('amount', 'qty', 3),
  ('amount', 'amount', 4), ('amount', 'unit_price', 5), ('unit_price', 'qty', 6), ('unit_price', 'amount', 7),
  ('unit_price', 'unit_price', 8)) v(col_a, col_b, i)""".replace("SELECT * FROM (VALUES", "SELECT col_a, col_b, round_even(CASE i WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 WHEN 4 THEN c4 WHEN 5 THEN c5 WHEN 6 THEN c6 WHEN 7 THEN c7 ELSE c8 END, 6) AS corr FROM a, (VALUES"),
                                   "lines_v"))
def _p18(spark, sf):
    return P.correlation_matrix(tb.sales_lines(spark, sf), ["qty", "amount", "unit_price"])


def _rfm_long_sql() -> str:
    from ledgerlake.plans import q_customers  # noqa: F401  (registers the rfm oracle first)
    from ledgerlake.plans.registry import ORACLES
    rfm = ORACLES["rfm"]
    return " UNION ALL ".join(
        f"SELECT client, '{v}' AS variable, CAST({v} AS DOUBLE) AS value FROM ({rfm}) AS t{i}"
        for i, v in enumerate(("r_score", "f_score", "m_score")))


def _rfm_corr_sql() -> str:
    from ledgerlake.plans import q_customers  # noqa: F401  (registers the rfm oracle first)
    from ledgerlake.plans.registry import ORACLES
    names = ("r_score", "f_score", "m_score")
    return " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round_even(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr "
                              f"FROM ({ORACLES['rfm']}) AS t{i}{j}" for i, a in enumerate(names) for j, b in enumerate(names))


@register("rfm_score_correlation", _rfm_corr_sql())
def _p18r(spark, sf):
    return P.correlation_matrix(C.rfm(tb.orders(spark, sf)), ["r_score", "f_score", "m_score"])


@register("unpivot_scores", _rfm_long_sql())
def _p19(spark, sf):
    return P.unpivot_scores(C.rfm(tb.orders(spark, sf)), ["client"], ["r_score", "f_score", "m_score"])


@register("preprocess_orders", V("""
SELECT id, reference, CAST(client AS VARCHAR) AS client, total, payment, state, date FROM orders_v
WHERE date >= TIMESTAMP '1997-01-01' AND id IS NOT NULL AND total IS NOT NULL""", "orders_v"))
def _p15(spark, sf):
    return PL.clean_orders(X.orders_export(tb.orders(spark, sf)), min_date="1997-01-01")


@register("preprocess_inventory", V("SELECT DISTINCT * FROM inv_v", "inv_v"))
def _p15i(spark, sf):
    return PL.clean_inventory(X.inventory_export(tb.inventory(spark, sf)))
