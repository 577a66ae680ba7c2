"""The shop's raw export shapes, rendered from the canonical views.

The cleaning operators (P1-P15) parse text such as ``'1 234,50 €'``,
``'12,00€(TTC)'`` and ``'05 Dec 2024'``. These views render the driver's
tables in exactly those formats, column by column, so every parser runs
over whole tables derived from the given data, and its result can be
checked against the typed source column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.columns import r2

NBSP = " "


def euro_text(c, sep: str = " ", suffix: str = " €"):
    """1234.5 -> '1 234,50 €' (thousands separator ``sep``, decimal comma)."""
    s = F.format_number(c, 2)                      # '1,234.50'
    s = F.replace(s, F.lit(","), F.lit("#"))
    s = F.replace(s, F.lit("."), F.lit(","))
    s = F.replace(s, F.lit("#"), F.lit(sep))
    return F.concat(s, F.lit(suffix))


def orders_export(orders: DataFrame) -> DataFrame:
    """Orders as the ';' shop export: French headers, text amounts (NBSP
    thousands), padded header names as in the raw files."""
    return orders.select(
        F.col("id").cast("string").alias(" id"),
        F.col("reference").alias("Référence "),
        F.col("client").cast("string").alias(" Client"),
        euro_text(F.col("total"), NBSP).alias("Total"),
        F.col("payment").alias("Paiement"),
        F.col("state").alias("État"),
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("Date"))


def retail_export(lines: DataFrame) -> DataFrame:
    """Sales lines as the retail file: 'dd MMM yyyy' dates, '12,00€(TTC)' amounts."""
    return lines.select(
        F.date_format("date", "dd MMM yyyy").alias("Date"),
        F.col("ref").cast("string").alias("Ref"),
        F.col("order_id").alias("order_id"), F.col("line").alias("line"),
        F.col("qty").cast("int").alias("Qté"),
        F.concat(euro_text(r2("unit_price"), "", "€"), F.lit("(TTC)")).alias("PV TTC"),
        F.concat(euro_text(F.col("amount"), "", "€"), F.lit("(TTC)")).alias("CA TTC"))


def inventory_export(inventory: DataFrame) -> DataFrame:
    """Inventory with spaced, capitalised headers and a price-group column."""
    return inventory.select(
        F.col("id").alias("Id"), F.col("sfa").alias("SFA"), F.col("lib").alias("Lib"),
        F.col("ean").alias("EAN"), F.col("qty").alias("Qty"),
        F.col("factory_price").alias("Factory Price"), F.col("retail").alias("Retail"),
        F.col("retail_us").alias("Retail US"), F.lit("G1").alias("Group Price"))
