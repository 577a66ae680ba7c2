"""Product analytics on order items.

Input: canonical ``order_items`` (order_id, product, quantity, line_price,
date, client) and ``products`` (product, name, price).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.columns import month_start, pct, r2, r6, safe_div, xsum
from ledgerlake.operators.common import ordered_cumsum, settled, spread

WIDE_BLOCK = 256


def _product_sales(items: DataFrame, product: str, qty: str, price: str) -> DataFrame:
    return items.where(F.col(product).isNotNull()).groupBy(product).agg(
        F.sum(qty).alias("total_units_sold"), xsum(price).alias("total_revenue"))


def top_products(items: DataFrame, top_n: int = 10, by: str = "revenue", product: str = "product",
                 qty: str = "quantity", price: str = "line_price") -> DataFrame:
    """The ``top_n`` products by units (``by='units'``) or by revenue."""
    s = _product_sales(items, product, qty, price)
    key = "total_units_sold" if by == "units" else "total_revenue"
    return s.orderBy(F.desc(key), F.asc(product)).limit(top_n) \
            .select(product, r6("total_units_sold").alias("total_units_sold"),
                    r2("total_revenue").alias("total_revenue"))


def product_revenue_share(items: DataFrame, product: str = "product", price: str = "line_price") -> DataFrame:
    """R2: revenue per product and its % of all revenue (scalar-subquery total)."""
    total = items.select(xsum(price)).scalar()
    g = items.where(F.col(product).isNotNull()).groupBy(product).agg(xsum(price).alias("revenue"))
    return g.select(product, r2("revenue").alias("revenue"),
                    r6(pct(F.col("revenue"), total)).alias("revenue_share_pct"))


def _with_base_price(items: DataFrame, products: DataFrame, product: str) -> DataFrame:
    base = products.select(F.col("product").alias("_bp"), F.col("price").alias("base_price"))
    return items.join(base, items[product] == base["_bp"], "left").drop("_bp")


def product_discount(items: DataFrame, products: DataFrame, product: str = "product",
                     qty: str = "quantity", price: str = "line_price") -> DataFrame:
    """Mean of (1 - unit price / base price) * 100 per product, keeping
    lines whose base price is > 0."""
    m = _with_base_price(items, products, product).where(F.col("base_price") > 0)
    unit = safe_div(F.col(price), F.col(qty))
    g = m.groupBy(product).agg(F.avg((F.lit(1.0) - unit / F.col("base_price")) * 100).alias("_d"))
    return g.select(product, r6("_d").alias("avg_discount_rate_pct"))


def product_repeat_rate(items: DataFrame, product: str = "product", client: str = "client") -> DataFrame:
    """Clients who bought a product more than once / clients who bought
    it, in %; null (not 0) when nobody repeated."""
    pc = items.where(F.col(product).isNotNull() & F.col(client).isNotNull()) \
              .groupBy(client, product).agg(F.count(F.lit(1)).alias("_n"))
    g = pc.groupBy(product).agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_n") > 1).alias("_rep"))
    rate = F.when(F.col("_rep") > 0, pct("_rep", "_all"))
    return g.select(product, r6(rate).alias("repeat_purchase_rate_pct"))


def monthly_product_sales(items: DataFrame, product: str = "product", qty: str = "quantity",
                          price: str = "line_price", date: str = "date", rows: int | None = None) -> DataFrame:
    """R5 (long form, the contract): units and revenue per observed (month, product).
    With ``rows``, about the number of items, they are spread by product first."""
    items = items.where(F.col(product).isNotNull() & F.col(date).isNotNull())
    if rows is not None:
        items = spread(items, rows, product)
    g = items.groupBy(month_start(date).alias("month"), product) \
             .agg(F.sum(qty).alias("units"), xsum(price).alias("revenue"))
    return g.select("month", product, r6("units").alias("units"), r2("revenue").alias("revenue"))


def monthly_product_sales_wide(items: DataFrame, products: Sequence, value: str = "revenue",
                               **kw) -> DataFrame:
    """R5 wide form for an explicit, bounded product list (0-filled)."""
    long = monthly_product_sales(items, **kw)
    p = kw.get("product", "product")
    wide = long.groupBy("month").pivot(p, list(products)).agg(F.sum(value))
    return wide.fillna(0)


def monthly_product_sales_blocks(items: DataFrame, value: str = "revenue", block: int = WIDE_BLOCK, **kw) -> DataFrame:
    """R5 wide form of every product: products in order, ``block`` of them to a
    row, so a row is bounded and no product list is needed. A row per (month,
    block) holds the block's products and their ``value`` (0-filled), month by
    observed month. The months, few, are broadcast to the blocks."""
    long = monthly_product_sales(items, **kw)
    p = kw.get("product", "product")
    ranked = ordered_cumsum(long.select(p).distinct().withColumn("_one", F.lit(1)), [F.col(p).asc()], {"_k": "_one"})
    place = ranked.select(p, F.floor((F.col("_k") - 1) / block).cast("long").alias("block"))
    blocks = place.groupBy("block").agg(F.array_sort(F.collect_list(p)).alias("products"))
    cells = long.join(place, p).groupBy("month", "block").agg(
        F.map_from_entries(F.collect_list(F.struct(p, F.col(value).cast("double")))).alias("_v"))
    grid = blocks.crossJoin(F.broadcast(long.select("month").distinct()))
    filled = F.transform("products", lambda x: F.coalesce(F.try_element_at("_v", x), F.lit(0.0)))
    return grid.join(cells, ["month", "block"], "left").select("month", "block", "products", filled.alias(value))


def monthly_product_price(items: DataFrame, products: DataFrame, product: str = "product",
                          qty: str = "quantity", price: str = "line_price", date: str = "date") -> DataFrame:
    """Per (month, product) mean unit price and mean discount ratio
    (1 - unit / base; null where the base price is <= 0 or missing)."""
    m = _with_base_price(items, products, product).where(F.col(product).isNotNull() & F.col(date).isNotNull())
    unit = safe_div(F.col(price), F.col(qty))
    disc = F.when(F.col("base_price") > 0, F.lit(1.0) - unit / F.col("base_price"))
    g = m.groupBy(month_start(date).alias("month"), product).agg(
        F.avg(unit).alias("_u"), F.avg(disc).alias("_d"))
    return g.select("month", product, r6("_u").alias("avg_unit_price"), r6("_d").alias("avg_discount_rate"))


def items_per_order(items: DataFrame, order: str = "order_id", qty: str = "quantity") -> DataFrame:
    """Mean over orders of the order's total quantity."""
    per = items.where(F.col(order).isNotNull()).groupBy(order).agg(F.sum(qty).alias("_q"))
    return per.agg(r6(F.avg("_q")).alias("avg_items_per_order"), F.count(F.lit(1)).alias("orders"))


def cross_sell_pairs(items: DataFrame, min_frequency: int = 2, block: int = 256,
                     order: str = "order_id", product: str = "product", rows: int | None = None) -> DataFrame:
    """Unordered product pairs bought in the same order in at least
    ``min_frequency`` orders -> (product_a < product_b, orders).

    * Items with support below ``min_frequency`` cannot be in a frequent
      pair, so they are removed first (exact pruning).
    * Pairs are generated per (order, block_i, block_j) key, where an
      order's items are hashed into ceil(size / block) blocks: one huge
      basket is spread over many join keys of at most block^2 candidate
      pairs each, instead of one self-join group. Typical baskets are one
      block, i.e. a plain self-join on the order id.
    * Rows and pairs are counted before they are spread, so a task's share of
      them is the same at any size (``rows``: about the number of items).
    """
    items = items.where(F.col(order).isNotNull() & F.col(product).isNotNull()).select(order, product)
    op = settled(items.distinct() if rows is None else spread(items, rows, order).distinct())
    n = op.count()
    by_product = spread(op, n, product)
    support = by_product.groupBy(product).agg(F.count(F.lit(1)).alias("_sup")).where(F.col("_sup") >= min_frequency)
    opf = spread(by_product.join(support.select(product), product, "left_semi"), n, order)
    sizes = opf.groupBy(order).agg(F.count(F.lit(1)).alias("_size"))
    opf = settled(opf.join(sizes, order).where(F.col("_size") > 1))
    # rows of both copies, and pairs: they say how far to spread the join and the counts
    blocks = F.ceil(F.col("_size") / F.lit(block)) + 1
    made = opf.agg(F.sum(blocks), F.sum((F.col("_size") - 1) / 2)).first()
    copies, n_pairs = int(made[0] or 0), int(made[1] or 0)
    opf = opf.withColumn("_nb", F.ceil(F.col("_size") / F.lit(block)).cast("int")) \
             .withColumn("_b", F.pmod(F.xxhash64(product), F.col("_nb")).cast("int"))
    # left copy: item a in block i, paired with every block j >= i
    left = opf.select(order, F.col(product).alias("_a"), F.col("_b").alias("_i"),
                      F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)).alias("_j"))
    # right copy: item b in block j, visited from every block i <= j
    right = opf.select(order, F.col(product).alias("_p"), F.col("_b").alias("_j"),
                       F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"))
    at = [order, "_i", "_j"]
    pairs = spread(left, copies, *at).join(spread(right, copies, *at), at).where(
        (F.col("_i") < F.col("_j")) | (F.col("_a") < F.col("_p")))
    pa = F.least("_a", "_p").alias("product_a")
    pb = F.greatest("_a", "_p").alias("product_b")
    pairs = spread(pairs.select(pa, pb), n_pairs, "product_a", "product_b")
    cnt = pairs.groupBy("product_a", "product_b").agg(F.count(F.lit(1)).alias("orders"))
    return cnt.where(F.col("orders") >= min_frequency)


def top_product_series(items: DataFrame, product: str = "product", price: str = "line_price",
                       date: str = "date") -> DataFrame:
    """The product with the most revenue and its monthly revenue over
    every month in which anything sold (0 where it did not sell)."""
    long = monthly_product_sales(items, product=product, price=price, date=date)
    top = long.groupBy(product).agg(F.sum("revenue").alias("_r")) \
              .orderBy(F.desc("_r"), F.asc(product)).limit(1).select(product).scalar()
    months = long.select("month").distinct().withColumn(product, top)
    series = long.select("month", product, "revenue")
    return months.join(series, ["month", product], "left").fillna(0.0, subset=["revenue"])


def price_join(items: DataFrame, products: DataFrame, product: str = "product") -> DataFrame:
    """Order items left-joined to the catalogue base price."""
    return _with_base_price(items, products, product)
