"""Registered X-queries (retrieval, routing, question tables) and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import basic as B
from ledgerlake.operators import text as X
from ledgerlake.operators import vectors as N
from ledgerlake.plans.metrics import kpi_table
from ledgerlake.plans.registry import register
from ledgerlake.sources import tables as tb

# Prompt/completion templates for the instruction pairs.
TEMPLATES = [
    ("Give me an overview of our business performance.",
     "Total revenue: {total_revenue}. Unique customers: {unique_customers}. "
     "Average orders per customer: {avg_orders_per_customer}."),
    ("What is our average order value?", "The average order value is {aov}."),
    ("What is our customer lifetime value?", "The estimated 12-month customer lifetime value is {clv}."),
    ("How many orders were refunded or cancelled?",
     "Refund rate: {refund_rate}%. Cancellation rate: {cancellation_rate}%."),
]


def _chunk_sql(size: int, overlap: int) -> str:
    stride = size - overlap
    n = (f"CASE WHEN text IS NULL OR length(text) = 0 THEN 0 WHEN length(text) <= {size} THEN 1 "
         f"ELSE CAST(ceil((length(text) - {overlap}) / {stride}.0) AS BIGINT) END")
    return f"""
WITH d AS (SELECT doc_id, source, text, unnest(range({n})) AS i FROM documents)
SELECT doc_id, source, CAST(i AS INTEGER) AS chunk_ix, substring(text, CAST(i * {stride} + 1 AS BIGINT), {size}) AS chunk
FROM d"""


@register("chunk_fixed", _chunk_sql(500, 0))
def _x1(spark, sf):
    return X.chunk_fixed(tb.read_table(spark, sf, "documents"))


@register("chunk_overlap", _chunk_sql(2000, 200))
def _x2(spark, sf):
    return X.chunk_overlap(tb.read_table(spark, sf, "documents"))


def _separated_sql(size: int, overlap: int) -> str:
    cuts = " ".join(f"WHEN length(regexp_extract(w, '(?s)^.*{s}')) >= {size // 2} THEN length(regexp_extract(w, '(?s)^.*{s}'))"
                    for s in ("\\n\\n", "\\n", " "))
    window = f"substring(text, CAST(start + 1 AS BIGINT), {size})"
    return f"""
WITH RECURSIVE c AS (
  SELECT doc_id, source, text, 0 AS ix, 0 AS start FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, source, text, ix + 1, CAST(start + CASE {cuts} ELSE {size} END - {overlap} AS INTEGER)
  FROM (SELECT *, {window} AS w FROM c WHERE start + {size} < length(text)))
SELECT doc_id, source, ix AS chunk_ix, start,
  substring(w, 1, CASE WHEN start + {size} >= length(text) THEN {size} {cuts} ELSE {size} END) AS chunk
FROM (SELECT *, {window} AS w FROM c)"""


@register("chunk_separated", _separated_sql(2000, 200))
def _x2s(spark, sf):
    return X.chunk_separated(tb.read_table(spark, sf, "documents"))


@register("chunk_separated_short", _separated_sql(200, 40))
def _x2ss(spark, sf):
    return X.chunk_separated(tb.read_table(spark, sf, "documents"), size=200, overlap=40)


@register("vector_topk", """
WITH x AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings
           WHERE label IS NOT NULL),
c AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY 1, 2),
v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
d AS (SELECT c.label AS query_id, v.vec_id, sum(v.x * c.m) AS dot FROM v JOIN c ON v.pos = c.pos GROUP BY 1, 2),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1),
cn AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1),
s AS (SELECT d.query_id, d.vec_id, d.dot / (vn.n * cn.n) AS score FROM d JOIN vn USING (vec_id)
      JOIN cn ON cn.label = d.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round_even(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def _x3(spark, sf):
    emb = tb.read_table(spark, sf, "embeddings")
    q = X.label_centroids(emb).select(F.col("label").alias("query_id"), F.col("centroid").alias("query_vec"))
    return N.vector_topk(emb, q, k=5)


def _rows_as_queries(emb):
    return emb.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@register("vector_topk_rows", """
WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
d AS (SELECT q.vec_id AS query_id, v.vec_id, sum(v.x * q.x) AS dot FROM v JOIN v AS q ON v.pos = q.pos AND q.vec_id % 20 = 0
      GROUP BY 1, 2),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1),
s AS (SELECT query_id, d.vec_id, dot / (a.n * b.n) AS score FROM d JOIN vn AS a ON a.vec_id = d.vec_id JOIN vn AS b ON b.vec_id = query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round_even(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def _x3_rows(spark, sf):
    emb = tb.read_table(spark, sf, "embeddings")
    return N.vector_topk(emb, _rows_as_queries(emb), k=5)


@register("vector_topk_bucketed")
def _x3_bucketed(spark, sf):
    # The given vectors lie nearly at random, so few planes and more tables are needed.
    emb = tb.read_table(spark, sf, "embeddings")
    return N.vector_topk_bucketed(emb, _rows_as_queries(emb), k=5, tables=6, bits=4)


def _any(words):
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


_ROUTE = f"""SELECT *, CASE WHEN {_any(X.METRIC_KEYWORDS)} THEN 'metric' WHEN {_any(X.TABLE_KEYWORDS)} THEN 'table'
        ELSE 'unknown' END AS route,
  CASE WHEN NOT {_any(X.METRIC_KEYWORDS)} AND {_any(X.TABLE_KEYWORDS)} THEN
    CASE WHEN contains(lower(text), 'country') THEN 'country' WHEN contains(lower(text), 'payment') THEN 'payment' END
  END AS "table"
FROM conversations WHERE role = 'user'"""


def _questions(spark, sf):
    return tb.read_table(spark, sf, "conversations").where(F.col("role") == "user")


@register("route_questions", _ROUTE)
def _x4(spark, sf):
    return X.route_questions(_questions(spark, sf))


@register("answer_metric_questions")
def _x5(spark, sf):
    return X.answer_metric_questions(X.route_questions(_questions(spark, sf)), kpi_table(spark, sf))


@register("table_cell_aggregate", tb.with_views("""
WITH cs AS (SELECT country, round_even(sum(total), 2) AS total_revenue FROM orders_c WHERE country IS NOT NULL
            GROUP BY country)
SELECT count(*) AS cells, CAST(sum(CAST(total_revenue AS DECIMAL(38, 2))) AS DOUBLE) AS answer_value, 'sum' AS aggregation FROM cs""",
                                                "orders_c"))
def _x6(spark, sf):
    return X.table_cell_aggregate(B.country_stats(tb.orders(spark, sf, with_country=True)), "total_revenue", "sum")


def _cells(spark, sf):
    return B.country_stats(tb.orders(spark, sf, with_country=True))


_CELLS = """WITH cs AS (SELECT country, round_even(sum(total), 2) AS total_revenue, count(total) AS order_count FROM orders_c
            WHERE country IS NOT NULL GROUP BY country)"""


@register("table_cell_average", tb.with_views(f"""{_CELLS}
SELECT count(*) AS cells, round_even(avg(order_count), 6) AS answer_value, 'average' AS aggregation FROM cs""", "orders_c"))
def _x6a(spark, sf):
    return X.table_cell_aggregate(_cells(spark, sf), "order_count", "average")


@register("table_cell_count", tb.with_views(f"""{_CELLS}
SELECT count(*) AS cells, CAST(count(*) AS DOUBLE) AS answer_value, 'count' AS aggregation FROM cs WHERE country < 'J'""", "orders_c"))
def _x6c(spark, sf):
    return X.table_cell_aggregate(_cells(spark, sf), "country", "count", where=F.col("country") < "J")


@register("table_cell_none", tb.with_views(f"""{_CELLS}
SELECT country AS answer FROM cs""", "orders_c"))
def _x6n(spark, sf):
    return X.table_cell_aggregate(_cells(spark, sf), "country", "none")


@register("instruction_pairs")
def _x7(spark, sf):
    return X.instruction_pairs(kpi_table(spark, sf), TEMPLATES)
