"""Registered S-queries (sources and sinks) and their DuckDB oracles.

Sinks are checked by reading back what they wrote: each query writes under
the shared checkpoint folder and returns the re-read table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import basic as B
from ledgerlake.operators import timeseries as TS
from ledgerlake.plans.registry import register
from ledgerlake.sources import files as S
from ledgerlake.sources import tables as tb
from ledgerlake.sources import web as W
from ledgerlake.sources.tables import with_views as V

ORDERS_SCHEMA = ("id bigint, reference string, client bigint, total double, date timestamp_ntz, "
                 "state string, payment string")


@register("load_csv", V("SELECT id, reference, client, total, date, state, payment FROM orders_v", "orders_v"))
def _s1(spark, sf):
    path = S.scratch_path(spark, "orders-csv")
    S.save_table(tb.orders(spark, sf), path, fmt="csv", sep=";")
    return S.load_csv(spark, path, schema=ORDERS_SCHEMA)


@register("load_tables", "SELECT * FROM orders")
def _s2(spark, sf):
    t = S.load_tables(spark, sf, ["orders", "order_items_absent"])
    assert t["order_items_absent"] is None
    return t["orders"]


@register("union_exports", V("SELECT id, reference, client, total, date, state, payment FROM orders_v", "orders_v"))
def _s3(spark, sf):
    o = tb.orders(spark, sf)
    early = o.where(F.col("date") < F.lit("1998-01-01").cast("timestamp_ntz"))
    late = o.where(F.col("date") >= F.lit("1998-01-01").cast("timestamp_ntz")) \
            .toDF(*[f"col_{i}" for i in range(len(o.columns))])
    undated = o.where(F.col("date").isNull()).toDF(*[c.upper() for c in o.columns])
    return S.union_exports([early, late, undated])


@register("save_table", V("SELECT * FROM lines_v", "lines_v"))
def _s4(spark, sf):
    path = S.scratch_path(spark, "lines-parquet")
    S.save_table(tb.sales_lines(spark, sf), path)
    return spark.read.parquet(path)


@register("save_insights")
def _s5w(spark, sf):
    o = tb.orders(spark, sf)
    out = S.scratch_path(spark, "insights")
    tables = {"revenue_over_time": TS.revenue_over_time(o), "payment_method_stats": B.payment_method_stats(o)}
    scalars = {"basic_kpis": B.basic_kpis(o), "aov": B.average_order_value(o)}
    return S.save_insights(spark, tables, out, scalars)


_FEEDBACK = """SELECT '2024-01-01T00:00:00' AS timestamp, q.text AS question, a.text AS answer, 'unrated' AS feedback
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'"""


def feedback_rows(spark, sf, at: str = "2024-01-01T00:00:00"):
    """Question/answer pairs: a user turn followed by an assistant turn."""
    c = tb.read_table(spark, sf, "conversations")
    q = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"]).select(F.lit(at).alias("timestamp"), "question", "answer",
                                                 F.lit("unrated").alias("feedback"))


@register("feedback_append", _FEEDBACK)
def _s6(spark, sf):
    path = S.scratch_path(spark, "feedback")
    S.feedback_append(feedback_rows(spark, sf), path)
    return S.read_feedback(spark, path)


@register("tables_as_documents")
def _s8(spark, sf):
    o = tb.orders(spark, sf)
    from ledgerlake.operators.text import OVERVIEW_TEXT
    tables = {"revenue_over_time": TS.revenue_over_time(o), "payment_method_stats": B.payment_method_stats(o),
              "country_stats": B.country_stats(tb.orders(spark, sf, with_country=True))}
    return S.tables_as_documents(spark, tables, rows_per_doc=50, overview=OVERVIEW_TEXT)


NAV_CARD = r'<li><a href="([^"]*)">([^<]*)</a></li>'
NAV_ID = r"/(\d+)"


@register("extract_listing", f"""
WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '{NAV_CARD}', 0)) AS card,
                  unnest(range(len(regexp_extract_all(html, '{NAV_CARD}', 0)))) AS card_ix FROM pages)
SELECT page_id, CAST(card_ix AS INTEGER) AS card_ix, regexp_extract(card, '{NAV_CARD}', 2) AS name,
       regexp_extract(card, '{NAV_CARD}', 1) AS link,
       TRY_CAST(NULLIF(trim(replace(replace(regexp_extract(card, '{W.SHOP_PRICE_PATTERN}', 1), '€', ''), ',', '')), '')
                AS DOUBLE) AS price,
       regexp_extract(regexp_extract(card, '{NAV_CARD}', 1), '{NAV_ID}', 1) AS product_id
FROM c""")
def _s9(spark, sf):
    return W.extract_listing(tb.read_table(spark, sf, "pages"), card_pattern=NAV_CARD, title_pattern=NAV_CARD, id_pattern=NAV_ID)


_FLAGS = f"""SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS listing,
  coalesce(TRY_CAST(NULLIF(regexp_extract(url, '[?&]page=(\\d+)', 1), '') AS INTEGER), 1) AS page,
  coalesce(regexp_matches(html, '{W.SHOP_NEXT_PATTERN}'), false) AS has_next FROM pages"""


@register("has_next_page", _FLAGS)
def _s10(spark, sf):
    return W.has_next_page(tb.read_table(spark, sf, "pages"))


@register("last_pages", f"SELECT listing, min(page) AS last_page FROM ({_FLAGS}) AS f WHERE NOT has_next GROUP BY listing")
def _s10b(spark, sf):
    return W.last_pages(W.has_next_page(tb.read_table(spark, sf, "pages")))
