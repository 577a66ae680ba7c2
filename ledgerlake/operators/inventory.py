"""Margin and inventory analytics.

Inputs are the canonical ``sales_lines`` (date, ref, qty, amount,
unit_price, ...) and ``inventory`` (id, sfa, lib, qty, factory_price,
retail, retail_us). The line table is the big one: it is reduced by
``groupBy`` on the product (and day/week/month) before it meets the
inventory, so joins run on per-product rows. The inventory is a dimension
table, joined by key; it is broadcast only through Spark's size-checked
automatic threshold, never by hint, because a catalogue can grow large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.columns import pct, period_start, r2, r6, rnd, safe_div
from ledgerlake.functions.quantile import quantiles_of
from ledgerlake.operators.common import ordered_cumsum, settled, spread

INF = float("inf")

# Fixed values of the reference's inventory rules.
ABC_THRESHOLDS = {"A": 0.8, "B": 0.95}
SAFETY_STOCK_DAYS = {"A": 14, "B": 21, "C": 30}
RECOMMENDATIONS = {
    "dead": "Consider clearance/promotion or discontinuation",
    "urgent": "Urgent restock needed",
    "promote": "Consider promotion or inventory reduction",
    "review": "Review order quantities",
    "plan": "Plan restock",
    "keep": "Maintain current strategy",
}


def enrich_sales(lines: DataFrame, inventory: DataFrame, ref: str = "ref", inv_id: str = "id") -> DataFrame:
    """Left join lines to inventory prices, category and name.

    Duplicate inventory ids fan out, as in a pandas merge.
    """
    inv = inventory.select(F.col(inv_id).alias("_inv_id"), "factory_price", "retail", "retail_us",
                           "sfa", "lib")
    return lines.join(inv, lines[ref] == inv["_inv_id"], "left").drop("_inv_id")


def unmatched_products(lines: DataFrame, inventory: DataFrame, ref: str = "ref",
                       inv_id: str = "id") -> DataFrame:
    """J1 (second output): distinct sold products missing from the inventory."""
    inv = inventory.select(F.col(inv_id).alias("_inv_id"))
    miss = lines.where(F.col(ref).isNotNull()).join(inv, lines[ref] == inv["_inv_id"], "left_anti")
    return miss.agg(F.countDistinct(ref).alias("unmatched_products"))


def line_margin(df: DataFrame, cost: str = "factory_price", price: str = "retail",
                qty: str = "qty") -> DataFrame:
    """Gross margin (price - cost) * qty of every line."""
    return df.withColumn("margin", (F.col(price) - F.col(cost)) * F.col(qty))


def gross_margin_rate(df: DataFrame, groupby: str | None = None, time_freq: str | None = None,
                      cost: str = "factory_price", price: str = "retail", qty: str = "qty",
                      date: str = "date") -> DataFrame:
    """Revenue, cost, profit and units by an optional column and/or period;
    margin_rate = profit / revenue * 100, half-even to 2 places."""
    keys = []
    d = df
    if groupby:
        keys.append(groupby)
    if time_freq:
        d = d.withColumn("period", period_start(date, time_freq))
        keys.append("period")
    rev = F.col(price) * F.col(qty)
    cst = F.col(cost) * F.col(qty)
    aggs = [F.sum(rev).alias("revenue"), F.sum(cst).alias("total_cost"),
            F.sum(rev - cst).alias("gross_profit"), F.sum(qty).alias("units")]
    g = d.groupBy(*keys).agg(*aggs) if keys else d.agg(*aggs)
    return g.select(*keys, r2("revenue").alias("revenue"), r2("total_cost").alias("total_cost"),
                    r2("gross_profit").alias("gross_profit"), r6("units").alias("units"),
                    rnd(pct("gross_profit", "revenue"), 2).alias("margin_rate"))


def margin_stats(rates: DataFrame, col: str = "margin_rate") -> DataFrame:
    """Mean, median, sample std, min and max of the rounded group rates."""
    rates = settled(rates.select(col))
    return rates.agg(r6(F.avg(col)).alias("avg_margin"), r6(F.stddev_samp(col)).alias("margin_std"),
                     r6(F.min(col)).alias("min_margin"), r6(F.max(col)).alias("max_margin")) \
                .withColumn("median_margin", r6(quantiles_of(rates, [col], (0.5,))[col][0]))


def _stats(sums: DataFrame, key: str, prefix: str) -> DataFrame:
    return sums.groupBy(key).agg(F.avg("_q").alias(f"{prefix}_avg_sales"),
                                 F.stddev_samp("_q").alias(f"{prefix}_sales_std"),
                                 F.count("_q").alias(f"{prefix}s_with_sales"))


def inventory_metrics(lines: DataFrame, inventory: DataFrame, ref: str = "ref", qty: str = "qty",
                      date: str = "date") -> DataFrame:
    """I4: per inventory item, daily and weekly sales (observed days/weeks)
    mean/std/count, turnover ratios, days of inventory, stock status, CV and
    risk. Items without sales get zeros (and +inf days of inventory)."""
    l = _by_product(lines, ref).where(F.col(date).isNotNull())
    daily = l.groupBy(ref, F.to_date(date).alias("_d")).agg(F.sum(qty).alias("_q"))
    # weeks are sums of days: one pass over the lines feeds both grains
    weekly = daily.groupBy(ref, period_start("_d", "W").alias("_w")).agg(F.sum("_q").alias("_q"))
    ds = _stats(daily, ref, "daily").withColumnRenamed("dailys_with_sales", "days_with_sales")
    ws = _stats(weekly, ref, "weekly").withColumnRenamed("weeklys_with_sales", "weeks_with_sales")
    inv = inventory.select(F.col("id").alias(ref), F.col("qty").alias("stock_qty"))
    m = inv.join(ds, ref, "left").join(ws, ref, "left")
    m = m.fillna(0, subset=["daily_avg_sales", "daily_sales_std", "days_with_sales", "weekly_avg_sales",
                            "weekly_sales_std", "weeks_with_sales", "stock_qty"])
    floor_qty = F.greatest(F.col("stock_qty").cast("double"), F.lit(0.1))
    days = F.when(F.col("daily_avg_sales") > 0, F.col("stock_qty") / F.col("daily_avg_sales")) \
            .otherwise(F.lit(INF))
    m = m.withColumn("days_of_inventory", days)
    status = (F.when(F.col("days_of_inventory") <= 15, "Critical")
               .when(F.col("days_of_inventory") <= 30, "Low")
               .when(F.col("days_of_inventory") <= 60, "Adequate")
               .otherwise("Excess"))
    cv = F.when(F.col("daily_avg_sales") > 0, F.col("daily_sales_std") / F.col("daily_avg_sales")) \
          .otherwise(F.lit(0.0))
    m = m.withColumn("daily_sales_cv", cv)
    risk = (F.when((F.col("days_of_inventory") < 15) & (F.col("daily_sales_cv") < 1),
                   "High Risk - Consistent Sales")
             .when((F.col("days_of_inventory") < 15) & (F.col("daily_sales_cv") >= 1),
                   "Medium Risk - Volatile Sales")
             .otherwise("Low Risk"))
    return m.select(ref, "stock_qty", r6("daily_avg_sales").alias("daily_avg_sales"),
                    r6("daily_sales_std").alias("daily_sales_std"), "days_with_sales",
                    r6("weekly_avg_sales").alias("weekly_avg_sales"),
                    r6("weekly_sales_std").alias("weekly_sales_std"), "weeks_with_sales",
                    r6(F.col("daily_avg_sales") * 30 / floor_qty).alias("daily_turnover_ratio"),
                    r6(F.col("weekly_avg_sales") * 4 / floor_qty).alias("weekly_turnover_ratio"),
                    r6("days_of_inventory").alias("days_of_inventory"), status.alias("stock_status"),
                    r6("daily_sales_cv").alias("daily_sales_cv"), risk.alias("stock_risk"))


def _by_product(lines: DataFrame, ref: str) -> DataFrame:
    """The lines with a product, spread by it."""
    return spread(lines.where(F.col(ref).isNotNull()), lines.count(), ref)


def product_profitability(lines: DataFrame, inventory: DataFrame, period: str = "M",
                          min_sales: float = 1, ref: str = "ref", qty: str = "qty",
                          date: str = "date") -> DataFrame:
    """Per matched (product, name, category): units, transactions, prices,
    distinct active periods; revenue = units x retail, cost, profit, margin %
    and units per period (both half-even 2 dp); keep units >= min_sales.

    Lines are spread by product and added up by (product, period), then by
    product, within the same tasks, so the distinct period count is a plain
    count; what meets the inventory is a row per product.
    """
    # The join key is part of the grouping and the inventory only adds group
    # keys and min() prices, so pre-aggregating is exact (duplicate inventory
    # ids still fan out the sums, as the row-level merge does).
    pre = _by_product(lines, ref).groupBy(ref, period_start(date, period).alias("_p")).agg(
        F.sum(qty).alias("_u0"), F.count(qty).alias("_t0"))
    pre = pre.groupBy(ref).agg(F.sum("_u0").alias("_u"), F.sum("_t0").alias("_t"), F.count("_p").alias("_n"))
    e = enrich_sales(pre, inventory, ref=ref).where(F.col("lib").isNotNull() & F.col("sfa").isNotNull())
    g = e.groupBy(ref, "lib", "sfa").agg(
        F.sum("_u").alias("total_units"), F.sum("_t").alias("total_transactions"),
        F.min("factory_price").alias("cost_price"), F.min("retail").alias("retail_price"),
        F.min("retail_us").alias("retail_price_us"), F.max("_n").alias("active_periods"))
    g = g.withColumn("total_revenue", F.col("total_units") * F.col("retail_price")) \
         .withColumn("total_cost", F.col("total_units") * F.col("cost_price")) \
         .withColumn("gross_profit", F.col("total_revenue") - F.col("total_cost"))
    g = g.where(F.col("total_units") >= min_sales)
    return g.select(F.col(ref).alias("product_id"), F.col("lib").alias("product_name"),
                    F.col("sfa").alias("category"), "total_units", "total_transactions",
                    "cost_price", "retail_price", "retail_price_us", "active_periods",
                    r2("total_revenue").alias("total_revenue"), r2("total_cost").alias("total_cost"),
                    r2("gross_profit").alias("gross_profit"),
                    rnd(pct("gross_profit", "total_revenue"), 2).alias("margin_rate"),
                    rnd(safe_div("total_units", "active_periods"), 2).alias("avg_units_per_period"))


def profitability_stats(profit: DataFrame) -> DataFrame:
    """Product count, revenue, profit and margin-rate statistics."""
    profit = settled(profit.select("total_revenue", "gross_profit", "margin_rate"))
    return profit.agg(F.count(F.lit(1)).alias("total_products"), r2(F.sum("total_revenue")).alias("total_revenue"),
                      r2(F.sum("gross_profit")).alias("total_profit"),
                      r6(F.avg("margin_rate")).alias("avg_margin_rate"),
                      F.max("margin_rate").alias("top_margin_rate"),
                      F.min("margin_rate").alias("bottom_margin_rate")) \
                 .withColumn("median_margin_rate", r6(quantiles_of(profit, ["margin_rate"], (0.5,))["margin_rate"][0]))


def abc_classes(lines: DataFrame, inventory: DataFrame, period: str = "M",
                thresholds: dict | None = None, partitions: int | None = None) -> DataFrame:
    """Products by revenue (desc, then id), cumulative revenue share;
    <= A threshold -> A, <= B -> B, else C; with current stock (sum over the
    inventory id) and its value at cost. The cumulative share is a
    distributed prefix sum; class edges compare the share rounded to 9 digits.
    """
    th = thresholds or ABC_THRESHOLDS
    prof = product_profitability(lines, inventory, period)
    cum = ordered_cumsum(prof, [F.col("total_revenue").desc_nulls_last(), F.col("product_id").asc()],
                         {"_cum": "total_revenue"}, partitions=partitions, grand_totals=True)
    share = rnd(safe_div("_cum", "_cum_grand"), 9)
    cls = F.when(share <= th["A"], "A").when(share <= th["B"], "B").otherwise("C")
    stock = inventory.groupBy(F.col("id").alias("product_id")).agg(F.sum("qty").alias("current_stock"))
    out = cum.withColumn("revenue_contribution", r6(safe_div("total_revenue", "_cum_grand"))) \
             .withColumn("cumulative_contribution", r6(safe_div("_cum", "_cum_grand"))) \
             .withColumn("abc_category", cls).drop("_cum", "_cum_grand")
    out = out.join(stock, "product_id", "left")
    return out.withColumn("stock_value", r6(F.col("current_stock") * F.col("cost_price")))


def abc_summary(abc: DataFrame) -> DataFrame:
    """I8: products, revenue, units, profit and revenue % (2 dp) per class."""
    g = abc.groupBy("abc_category").agg(F.count(F.lit(1)).alias("product_count"),
                                        F.sum("total_revenue").alias("total_revenue"),
                                        F.sum("total_units").alias("total_units"),
                                        F.sum("gross_profit").alias("gross_profit"))
    allw = Window.partitionBy()
    return g.select("abc_category", "product_count", r2("total_revenue").alias("total_revenue"),
                    r6("total_units").alias("total_units"), r2("gross_profit").alias("gross_profit"),
                    rnd(pct("total_revenue", F.sum("total_revenue").over(allw)), 2).alias("revenue_percent"))


def stock_recommendations(lines: DataFrame, inventory: DataFrame, lead_time_days: int = 7,
                          safety_days: dict | None = None, period: str = "D",
                          ref: str = "ref", qty: str = "qty", date: str = "date",
                          partitions: int | None = None) -> DataFrame:
    """ABC classes joined to per-product daily sales stats (observed
    dates): safety stock, reorder point, order quantity (half-even to units),
    stock status and days of stock (999 when nothing sells). A null std (one
    selling day) propagates, leaving the status Adequate."""
    sd = safety_days or SAFETY_STOCK_DAYS
    abc = abc_classes(lines, inventory, period, partitions=partitions)
    daily = _by_product(lines, ref).groupBy(date, ref).agg(F.sum(qty).alias("_q"))
    st = daily.groupBy(F.col(ref).alias("product_id")).agg(
        F.avg("_q").alias("avg_daily_sales"), F.stddev_samp("_q").alias("sales_std"),
        F.max("_q").alias("max_daily_sales"))
    r = abc.join(st, "product_id", "left")
    days = F.when(F.col("abc_category") == "A", sd["A"]).when(F.col("abc_category") == "B", sd["B"]) \
            .when(F.col("abc_category") == "C", sd["C"])
    r = r.withColumn("safety_stock_days", days)
    lead = float(lead_time_days)
    r = r.withColumn("safety_stock", rnd(F.col("avg_daily_sales") * F.col("safety_stock_days")
                                              + F.col("sales_std") * F.lit(lead ** 0.5), 0))
    r = r.withColumn("reorder_point", rnd(F.col("avg_daily_sales") * lead + F.col("safety_stock"), 0))
    r = r.withColumn("optimal_order_qty", rnd(
        F.col("avg_daily_sales") * F.sqrt(F.lit(2 * lead) * F.col("safety_stock_days")), 0))
    status = (F.when(F.col("current_stock") <= F.col("safety_stock"), "Critical")
               .when(F.col("current_stock") <= F.col("reorder_point"), "Reorder").otherwise("Adequate"))
    dos = F.when(F.col("avg_daily_sales") > 0,
                 rnd(F.col("current_stock") / F.col("avg_daily_sales"), 0)).otherwise(F.lit(999.0))
    return r.withColumn("stock_status", status).withColumn("days_of_stock", dos) \
            .withColumn("avg_daily_sales", r6("avg_daily_sales")).withColumn("sales_std", r6("sales_std"))


def product_movement(lines: DataFrame, inventory: DataFrame, slow_mover_threshold: float = 1,
                     bestseller_threshold: float = 0.8, stock_coverage_days: int = 90,
                     ref: str = "ref", qty: str = "qty", date: str = "date") -> DataFrame:
    """Movement over the last ``stock_coverage_days`` (inclusive) of the
    latest date; full outer join with the inventory; best seller when units
    >= the (1 - threshold) quantile of units over all rows, then dead (0),
    slow (mean units per line <= threshold), regular; stock status and a
    recommendation by the fixed decision table."""
    end = lines.select(F.max(date)).scalar()
    start = end - F.make_dt_interval(F.lit(stock_coverage_days))
    recent = lines.where(F.col(date) >= start)
    s = recent.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("product_id")).agg(
        F.sum(qty).alias("total_units_sold"), F.avg(qty).alias("avg_units_per_period"),
        F.count(qty).alias("sales_frequency"), F.min(date).alias("first_sale"),
        F.max(date).alias("last_sale"))
    s = s.withColumn("days_since_last_sale", F.timestamp_diff("DAY", F.col("last_sale"), end))
    inv = inventory.select(F.col("id"), F.col("qty").alias("stock_qty"), "retail", "factory_price")
    j = s.join(inv, s["product_id"] == inv["id"], "full")
    j = j.withColumn("product_id", F.coalesce("product_id", "id")).drop("id") \
         .fillna(0, subset=["total_units_sold", "avg_units_per_period", "sales_frequency"])
    j = j.withColumn("stock_value", F.col("stock_qty") * F.col("factory_price")) \
         .withColumn("daily_sales_rate", F.col("total_units_sold") / F.lit(float(stock_coverage_days)))
    j = j.withColumn("days_of_stock", F.when(F.col("daily_sales_rate") > 0,
                                             F.col("stock_qty") / F.col("daily_sales_rate"))
                     .otherwise(F.lit(INF)))
    j = settled(j)
    cut = quantiles_of(j, ["total_units_sold"], (1 - bestseller_threshold,))["total_units_sold"][0]
    j = j.withColumn("_cut", cut)
    move = (F.when(F.col("total_units_sold") >= F.col("_cut"), "Best Seller")
             .when(F.col("total_units_sold") == 0, "Dead Stock")
             .when(F.col("avg_units_per_period") <= slow_mover_threshold, "Slow Mover")
             .otherwise("Regular Mover"))
    j = j.withColumn("movement_category", move)
    status = (F.when((F.col("stock_qty") == 0) & (F.col("total_units_sold") > 0), "Out of Stock")
               .when(F.col("days_of_stock") <= 30, "Low Stock")
               .when(F.col("days_of_stock") >= 180, "Overstocked").otherwise("Optimal"))
    j = j.withColumn("stock_status", status)
    mc, ss = F.col("movement_category"), F.col("stock_status")
    rec = (F.when(mc == "Dead Stock", RECOMMENDATIONS["dead"])
            .when((mc == "Best Seller") & ss.isin("Out of Stock", "Low Stock"), RECOMMENDATIONS["urgent"])
            .when((mc == "Slow Mover") & (ss == "Overstocked"), RECOMMENDATIONS["promote"])
            .when(ss == "Overstocked", RECOMMENDATIONS["review"])
            .when((ss == "Low Stock") & (mc != "Slow Mover"), RECOMMENDATIONS["plan"])
            .otherwise(RECOMMENDATIONS["keep"]))
    return j.withColumn("recommendation", rec).select(
        "product_id", "total_units_sold", r6("avg_units_per_period").alias("avg_units_per_period"),
        "sales_frequency", "first_sale", "last_sale", "days_since_last_sale", "stock_qty", "retail",
        "factory_price", r6("stock_value").alias("stock_value"),
        r6("daily_sales_rate").alias("daily_sales_rate"), r6("days_of_stock").alias("days_of_stock"),
        "movement_category", "stock_status", "recommendation")


def movement_summary(movement: DataFrame) -> DataFrame:
    """Counts by movement category and by stock status, total and dead
    stock value, best-seller count/units and their status mix, as one
    GROUPING SETS pass -> (section, key, value)."""
    m = movement.withColumn("_best", F.col("movement_category") == "Best Seller")
    g = m.groupingSets([["movement_category"], ["stock_status"], ["_best", "stock_status"], []],
                       "movement_category", "stock_status", "_best").agg(
        F.count(F.lit(1)).alias("n"), F.sum("stock_value").alias("value"),
        F.sum("total_units_sold").alias("units"),
        F.sum(F.when(F.col("movement_category") == "Dead Stock", F.col("stock_value"))).alias("dead_value"),
        F.grouping_id().alias("_gid"))
    cat = g.where(F.col("_gid") == 3).select(F.lit("category_counts").alias("section"),
                                             F.col("movement_category").alias("key"),
                                             F.col("n").cast("double").alias("value"))
    stat = g.where(F.col("_gid") == 5).select(F.lit("stock_status_counts").alias("section"),
                                              F.col("stock_status").alias("key"),
                                              F.col("n").cast("double").alias("value"))
    best = g.where((F.col("_gid") == 4) & F.col("_best")).select(
        F.lit("bestseller_stock_availability").alias("section"), F.col("stock_status").alias("key"),
        F.col("n").cast("double").alias("value"))
    tot = g.where(F.col("_gid") == 7).select(
        F.lit("totals").alias("section"),
        F.explode(F.array(
            F.struct(F.lit("total_stock_value").alias("k"), r6(F.coalesce("value", F.lit(0.0))).alias("v")),
            F.struct(F.lit("dead_stock_value").alias("k"), r6(F.coalesce("dead_value", F.lit(0.0))).alias("v")),
        )).alias("kv")).select("section", F.col("kv.k").alias("key"), F.col("kv.v").alias("value"))
    bsum = g.where(F.col("_gid") == 4).groupBy("_best").agg(F.sum("n").alias("n"), F.sum("units").alias("u")) \
            .where(F.col("_best"))
    bstat = bsum.select(F.lit("bestseller_stats").alias("section"), F.explode(F.array(
        F.struct(F.lit("count").alias("k"), F.col("n").cast("double").alias("v")),
        F.struct(F.lit("total_units").alias("k"), r6(F.col("u").cast("double")).alias("v")))).alias("kv")) \
        .select("section", F.col("kv.k").alias("key"), F.col("kv.v").alias("value"))
    return cat.unionByName(stat).unionByName(best).unionByName(tot).unionByName(bstat)


def overall_margin(lines: DataFrame, inventory: DataFrame, price: str = "unit_price") -> DataFrame:
    """(sum of sold prices - sum of stock cost) / sum of sold prices * 100; 0 without revenue."""
    cost = inventory.select(F.sum(F.col("factory_price") * F.col("qty"))).scalar()
    a = lines.agg(F.sum(price).alias("_rev"))
    m = F.when(F.col("_rev") > 0, (F.col("_rev") - cost) / F.col("_rev") * 100).otherwise(F.lit(0.0))
    return a.select(r6(m).alias("gross_profit_margin"))


def market_margins(inventory: DataFrame) -> DataFrame:
    """Per item EUR and US margins (price - factory price x qty) and shares."""
    tc = F.col("factory_price") * F.col("qty")
    return inventory.select(
        "id", "lib", r6(tc).alias("total_cost"),
        r6(F.col("retail") - tc).alias("margin_eur"),
        r6(safe_div(F.col("retail") - tc, F.col("retail"))).alias("margin_eur_pct"),
        r6(F.col("retail_us") - tc).alias("margin_us"),
        r6(safe_div(F.col("retail_us") - tc, F.col("retail_us"))).alias("margin_us_pct"))


def market_margin_means(inventory: DataFrame) -> DataFrame:
    """Mean EUR and US margins."""
    tc = F.col("factory_price") * F.col("qty")
    return inventory.agg(r6(F.avg(F.col("retail") - tc)).alias("avg_margin_eur"),
                         r6(F.avg(F.col("retail_us") - tc)).alias("avg_margin_us"))


def market_margin_extremes(inventory: DataFrame, top: int = 10, bottom: int = 15) -> DataFrame:
    """The ``top`` items by EUR margin and the ``bottom`` items by US margin share."""
    mm = market_margins(inventory)
    hi = mm.orderBy(F.desc("margin_eur"), "id").limit(top).withColumn("list", F.lit("top_margin_eur"))
    lo = mm.orderBy(F.asc("margin_us_pct"), "id").limit(bottom).withColumn("list", F.lit("bottom_margin_us_pct"))
    return hi.unionByName(lo)


def stock_full_join(lines: DataFrame, inventory: DataFrame, ref: str = "ref", qty: str = "qty") -> DataFrame:
    """Per-product sales summary full-outer-joined with the inventory;
    only the three sales columns are zero-filled."""
    s = lines.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("product_id")).agg(
        F.sum(qty).alias("total_units_sold"), F.avg(qty).alias("avg_units"),
        F.count(qty).alias("sales_frequency"))
    inv = inventory.select("id", F.col("qty").alias("stock_qty"), "retail", "factory_price")
    j = s.join(inv, s["product_id"] == inv["id"], "full") \
         .fillna(0, subset=["total_units_sold", "avg_units", "sales_frequency"])
    return j.select(F.coalesce("product_id", "id").alias("product_id"), "total_units_sold",
                    r6("avg_units").alias("avg_units"), "sales_frequency", "stock_qty", "retail",
                    "factory_price")
