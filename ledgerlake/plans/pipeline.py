"""The ordered cleaning chain for the four shop tables, as composed
DataFrame transforms over the raw export shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import clean as P
from ledgerlake.sources.tables import ABANDONED_MARKER


def clean_orders(raw: DataFrame, min_date: str = P.DEFAULT_MIN_DATE, excluded=()) -> DataFrame:
    """Raw order export -> typed orders: names, amounts, dates, exclusions,
    cut-off, required fields, duplicates on (id, date)."""
    df = P.standardize_columns(raw)
    df = df.select(F.col("id").cast("long").alias("id"), F.col("Référence").alias("reference"),
                   F.col("Client").alias("client"), F.col("Total").alias("total"),
                   F.col("Paiement").alias("payment"), F.col("État").alias("state"),
                   F.col("Date").alias("date"))
    df = P.clean_amount_column(df, "total")
    df = P.parse_date(df, "date", "yyyy-MM-dd HH:mm:ss")
    if excluded:
        df = P.exclude_clients(df, excluded)
    df = P.filter_min_date(df, min_date)
    df = P.require_columns(df, ["id", "total", "date"])
    return P.dedup_by_keys(df, ["id", "date"])


def clean_carts(carts: DataFrame, min_date: str = P.DEFAULT_MIN_DATE) -> DataFrame:
    """Carts: drop empty abandoned carts, cut-off, fill unknown client/carrier,
    duplicates on (order_ref, date)."""
    df = P.drop_empty_carts(carts, ABANDONED_MARKER)
    df = P.filter_min_date(df, min_date)
    df = df.withColumn("client", F.col("client").cast("string"))
    df = P.fill_unknown(df, ["client", "carrier"])
    return P.dedup_by_keys(df, ["order_ref", "date"], order=["id", "client", "total", "carrier"])


def clean_retail(raw: DataFrame) -> DataFrame:
    """Retail lines: amounts before '(', 'dd MMM yyyy' dates, exact duplicates."""
    df = P.clean_retail_amounts(raw, ["PV TTC", "CA TTC"])
    df = P.parse_date(df, "Date", "dd MMM yyyy")
    return P.dedup_exact(df)


def clean_inventory(raw: DataFrame) -> DataFrame:
    """Inventory: snake_case names without the price group, exact duplicates."""
    return P.dedup_exact(P.snake_case_columns(raw))


def preprocess_pipeline(orders_raw: DataFrame, carts: DataFrame, retail_raw: DataFrame,
                        inventory_raw: DataFrame, min_date: str = P.DEFAULT_MIN_DATE) -> dict:
    """The four cleaned tables (lazy; nothing runs until written/read)."""
    return {"orders": clean_orders(orders_raw, min_date), "carts": clean_carts(carts, min_date),
            "retail": clean_retail(retail_raw), "inventory": clean_inventory(inventory_raw)}
