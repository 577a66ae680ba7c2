"""Canonical views over the driver's star schema.

Each view renames the driver's columns to the commerce vocabulary the
operators use. Views are lazy; Catalyst prunes unused columns down to the
Parquet scan, so a view costs only what the calling operator reads. Joins to
dimension tables are added only when the caller asks for the column they
bring (``with_country``, ``with_client``), because Catalyst cannot drop an
outer join whose columns go unused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Marker written in the order-reference column of carts that
# never became an order, as in the shop's cart export.
ABANDONED_MARKER = "Panier abandonné"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customer_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client, country): customer joined to the 25-row nation table.

    ``nation`` is a fixed-size dimension (one row per country), so it is
    broadcast; the customer side is never broadcast.
    """
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client"), F.col("c_nationkey").alias("_nk"))
    nation = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("_nk"), F.col("n_name").alias("country"))
    return cust.join(F.broadcast(nation), "_nk", "left").drop("_nk")


def orders(spark: SparkSession, sf_dir: str, with_country: bool = False) -> DataFrame:
    """(id, reference, client, total, date, state, payment[, country])."""
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").cast("string").alias("reference"),
        F.col("o_custkey").alias("client"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").alias("date"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderpriority").alias("payment"),
    )
    if with_country:
        o = o.join(customer_country(spark, sf_dir), "client", "left")
    return o


def sales_lines(spark: SparkSession, sf_dir: str, with_client: bool = False) -> DataFrame:
    """Retail sales lines: (order_id, line, date, ref, qty, amount, unit_price[, client])."""
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").alias("date"),
        F.col("l_partkey").alias("ref"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("amount"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
    )
    if with_client:
        oc = read_table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("client"))
        li = li.join(oc, "order_id", "left")
    return li


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, product, quantity, line_price, date, client): lines with their order."""
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("line_price"),
    )
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("date"),
        F.col("o_custkey").alias("client"),
    )
    return li.join(o, "order_id", "inner")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sfa, lib, ean, qty, factory_price, retail, retail_us) from ``part``."""
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("sfa"),
        F.col("p_name").alias("lib"),
        F.col("p_brand").alias("ean"),
        F.col("p_size").alias("qty"),
        (F.lit(0.6) * F.col("p_retailprice")).alias("factory_price"),
        F.col("p_retailprice").alias("retail"),
        (F.lit(1.1) * F.col("p_retailprice")).alias("retail_us"),
    )


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, order_ref, client, total, date, carrier) from ``events``.

    A purchase event carries its id as order reference; every other event is an
    abandoned cart and carries the marker.
    """
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string"))
         .otherwise(F.lit(ABANDONED_MARKER)).alias("order_ref"),
        F.col("user_id").alias("client"),
        F.col("value").alias("total"),
        F.col("ts").alias("date"),
        F.col("event_type").alias("carrier"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product, name, price): base catalogue prices."""
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("product"), F.col("p_name").alias("name"),
                    F.col("p_retailprice").alias("price"))


# DuckDB twins of the views above, used by the oracle SQL (CTE bodies).
SQL_VIEWS = {
    "orders_v": """SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS reference,
        o_custkey AS client, o_totalprice AS total, o_orderdate AS date,
        o_orderstatus AS state, o_orderpriority AS payment FROM orders""",
    "orders_c": """SELECT o.o_orderkey AS id, CAST(o.o_orderkey AS VARCHAR) AS reference,
        o.o_custkey AS client, o.o_totalprice AS total, o.o_orderdate AS date,
        o.o_orderstatus AS state, o.o_orderpriority AS payment, n.n_name AS country
        FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
        LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "lines_v": """SELECT l_orderkey AS order_id, l_linenumber AS line, l_shipdate AS date,
        l_partkey AS ref, l_quantity AS qty, l_extendedprice AS amount,
        l_extendedprice / nullif(l_quantity, 0) AS unit_price FROM lineitem""",
    "lines_c": """SELECT l.l_orderkey AS order_id, l.l_linenumber AS line, l.l_shipdate AS date,
        l.l_partkey AS ref, l.l_quantity AS qty, l.l_extendedprice AS amount,
        l.l_extendedprice / nullif(l.l_quantity, 0) AS unit_price, o.o_custkey AS client
        FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "items_v": """SELECT l.l_orderkey AS order_id, l.l_partkey AS product,
        l.l_quantity AS quantity, l.l_extendedprice AS line_price,
        o.o_orderdate AS date, o.o_custkey AS client
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "inv_v": """SELECT p_partkey AS id, p_type AS sfa, p_name AS lib, p_brand AS ean,
        p_size AS qty, CAST(0.6 AS DOUBLE) * p_retailprice AS factory_price, p_retailprice AS retail,
        CAST(1.1 AS DOUBLE) * p_retailprice AS retail_us FROM part""",
    "carts_v": f"""SELECT event_id AS id,
        CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR)
             ELSE '{ABANDONED_MARKER}' END AS order_ref,
        user_id AS client, value AS total, ts AS date, event_type AS carrier FROM events""",
    "products_v": """SELECT p_partkey AS product, p_name AS name, p_retailprice AS price
        FROM part""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the named view CTEs (DuckDB dialect)."""
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
