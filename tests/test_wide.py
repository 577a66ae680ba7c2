"""The wide form of monthly product sales holds what the long form holds."""

from ledgerlake.operators import products as R
from ledgerlake.plans.registry import QUERIES, load_all
from ledgerlake.sources import tables as tb

SF = "/root/testdata/sf0.001"


def test_wide_sales_have_every_product_and_month(spark):
    load_all()
    long = {(r["month"], r["product"]): r["revenue"] for r in R.monthly_product_sales(tb.order_items(spark, SF)).collect()}
    months, products = {m for m, _ in long}, sorted({p for _, p in long})
    want = {(m, p): long.get((m, p), 0.0) for m in months for p in products}
    got = {}
    for r in QUERIES["monthly_product_sales_wide"](spark, SF).collect():
        for p, v in zip(r["products"], r["revenue"], strict=True):
            assert (r["month"], p) not in got and r["block"] == products.index(p) // R.WIDE_BLOCK
            got[r["month"], p] = v
    assert len(products) > 5 and got == want


def test_blocks_are_filled_in_order(spark):
    rows = [(f"p{k:02}", 1.0, float(k), "2020-01-05") for k in range(7)] + [("p03", 1.0, 9.0, "2020-02-05"), (None, 1.0, 1.0, "2020-02-05")]
    items = spark.createDataFrame(rows, "product string, quantity double, line_price double, date string").selectExpr(
        "product", "quantity", "line_price", "CAST(date AS TIMESTAMP_NTZ) AS date")
    got = {(str(r["month"]), r["block"]): (r["products"], r["revenue"]) for r in R.monthly_product_sales_blocks(items, block=3).collect()}
    assert got["2020-02-01", 1] == (["p03", "p04", "p05"], [9.0, 0.0, 0.0])
    assert got["2020-01-01", 2] == (["p06"], [6.0]) and got["2020-02-01", 2] == (["p06"], [0.0]) and len(got) == 6
