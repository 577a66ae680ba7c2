"""Edge fixtures listed in FIXTURES.md section 5."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.columns import clean_amount
from ledgerlake.operators import basic as B
from ledgerlake.operators import clean as P
from ledgerlake.operators import customers as C
from ledgerlake.operators import inventory as I
from ledgerlake.operators import products as R
from ledgerlake.operators import text as X
from ledgerlake.operators import timeseries as TS
from ledgerlake.sources import web as W

OSCHEMA = ("id long, reference string, client string, total double, date timestamp_ntz, "
           "state string, payment string, country string")


def _orders(spark, rows):
    return spark.createDataFrame(rows, OSCHEMA)


def test_null_client_counted_in_rows_not_groups(spark):
    o = _orders(spark, [(1, "a", None, 10.0, datetime(2023, 1, 1), "F", "card", "FR"),
                        (2, "b", "A", 20.0, datetime(2023, 1, 2), "F", "card", "FR")])
    r = B.basic_kpis(o).first()
    assert (r.total_orders, r.unique_customers, r.avg_orders_per_customer) == (2, 1, 2.0)
    # mean orders per non-null client = 1 row / 1 client
    assert C.clv_revenue(o).first().clv == pytest.approx(15.0 * 1 * 12)


def test_empty_month_is_zero_filled_and_churn_uses_observed_months(spark):
    o = _orders(spark, [(1, "a", "A", 10.0, datetime(2023, 1, 5), "F", "c", "FR"),
                        (2, "b", "B", 30.0, datetime(2023, 3, 5), "F", "c", "FR")])
    s = {r.period.month: r.revenue for r in TS.revenue_over_time(o).collect()}
    assert s == {1: 10.0, 2: 0.0, 3: 30.0}
    g = {r.period.month: r.growth_pct for r in TS.revenue_growth(o).collect()}
    assert g[1] is None and g[2] == -100.0 and g[3] is None          # x / 0 -> null
    ch = C.churn_monthly(o).collect()
    assert [(r.month.month, r.churn_rate) for r in ch] == [(3, 100.0)]  # Jan -> Mar (observed)


def test_tied_quartiles_rfm_defined(spark):
    rows = [(i, f"r{i}", f"C{i}", 10.0, datetime(2023, 1, 1), "F", "c", "FR") for i in range(8)]
    r = C.rfm(_orders(spark, rows)).collect()
    assert len(r) == 8 and {x.f_score for x in r} == {1} and {x.rfm_score for x in r} == {"411"}


def test_zero_revenue_state_shares(spark):
    o = _orders(spark, [(1, "a", "A", 0.0, datetime(2023, 1, 1), "P", "c", "FR")])
    r = B.order_state_breakdown(o).first()
    assert (r.order_pct, r.revenue_pct) == (100.0, 0.0)
    rc = B.refund_cancellation(o).first()
    assert rc.cancellation_rate == 100.0 and rc.revenue_cancel_pct == 0.0


def test_one_selling_day_null_std_and_unmatched_product(spark):
    lines = spark.createDataFrame(
        [(1, 1, datetime(2023, 1, 1), 10, 2.0, 20.0, 10.0), (2, 1, datetime(2023, 1, 1), 99, 1.0, 5.0, 5.0)],
        "order_id long, line int, date timestamp_ntz, ref long, qty double, amount double, unit_price double")
    inv = spark.createDataFrame([(10, "cat", "ten", "e", 5, 6.0, 10.0, 11.0),
                                 (11, "cat", "eleven", "e", 3, 6.0, 10.0, 11.0)],
                                "id long, sfa string, lib string, ean string, qty int, factory_price double, "
                                "retail double, retail_us double")
    assert I.unmatched_products(lines, inv).first().unmatched_products == 1
    rec = {r.product_id: r for r in I.stock_recommendations(lines, inv).collect()}
    assert rec[10].sales_std is None and rec[10].stock_status == "Adequate"
    mv = {r.product_id: r for r in I.product_movement(lines, inv, bestseller_threshold=0.2).collect()}
    assert mv[11].movement_category == "Dead Stock" and mv[11].days_of_stock == float("inf")
    assert mv[99].stock_qty is None                      # sold but not in inventory (full join)
    m = {r.ref: r for r in I.inventory_metrics(lines, inv).collect()}
    assert m[11].days_of_inventory == float("inf") and m[11].stock_status == "Excess"


def test_duplicate_keys_keep_deterministic_first(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 9.0), (2, "z", 1.0)], "k long, v string, x double")
    out = {r.k: (r.v, r.x) for r in P.dedup_by_keys(df, ["k"]).collect()}
    assert out == {1: ("a", 9.0), 2: ("z", 1.0)}


def test_malformed_amounts(spark):
    df = spark.createDataFrame([("1 234,50 €",), ("12,00€(x)",), ("abc",), (None,)], "s string")
    got = [r[0] for r in df.select(clean_amount("s")).collect()]
    assert got[0] == 1234.5 and got[2] is None and got[3] is None
    assert df.select(P.clean_retail_amount("s")).collect()[1][0] == 12.0


def test_negative_and_future_values(spark):
    o = _orders(spark, [(1, "a", "A", -5.0, datetime(2999, 1, 1), "F", "c", "FR"),
                        (2, "b", "B", 5.0, datetime(2023, 1, 1), "F", "c", "FR")])
    rules = [("neg", F.col("total") >= 0), ("future", F.col("date") <= F.lit("2100-01-01").cast("timestamp_ntz"))]
    v = {r.id: r for r in P.validate_rows(o, rules).collect()}
    assert not v[1].ok and v[1].errors == "neg; future" and v[2].ok
    checks = {r.check: r.n_bad for r in P.data_quality_score(o, ["id"], ["total"], ["date"], now="2100-01-01").collect()}
    assert checks["neg:total"] == 1 and checks["future:date"] == 1


def test_repeated_cart_ids_make_rate_negative(spark, order_data):
    carts = spark.createDataFrame([(i, "R1", "A", 1.0, datetime(2023, 1, 1)) for i in range(3)],
                                  "id long, order_ref string, client string, total double, date timestamp_ntz")
    assert B.cart_abandonment_rate(carts, order_data).first().abandonment_rate == -200.0


def test_baskets_one_item_and_repeated_items(spark):
    items = spark.createDataFrame(
        [(1, 10), (1, 10), (1, 11), (2, 10), (2, 11), (3, 12), (4, 10), (4, 11), (4, 12)],
        "order_id long, product long").withColumn("quantity", F.lit(1.0))
    pairs = {(r.product_a, r.product_b): r.orders for r in R.cross_sell_pairs(items).collect()}
    assert pairs == {(10, 11): 3}
    # blocked pair generation (tiny blocks) must give the same answer
    assert {(r.product_a, r.product_b): r.orders for r in R.cross_sell_pairs(items, block=1).collect()} == pairs
    assert R.items_per_order(items).first().avg_items_per_order == pytest.approx(9 / 4)


def test_listing_html(spark):
    html = ('<article class="product card">\n<div class="big title">\n'
            '<a href="https://x/en/accueil/880-flora-3666">Flora</a></div>\n<span class="price">1,250.00 €</span></article>'
            '<article class="product card"><span class="price">10.00 €</span></article>'
            '<article class="product card"><div class="title"><a href="https://x/en/accueil/881-x">Five</a></div>'
            '<span class="price">5.00 €</span></article>'
            '<article class="product card"><div class="title"><a href="https://x/en/other">NoId</a></div></article>'
            '<article class="news"><div class="title"><a href="https://x/n">News</a></div></article>'
            '<div class="pagination">\n<a class="next" href="?p=2">Next</a></div>')
    pages = spark.createDataFrame([(1, "https://x/en/list?page=1", html), (2, "https://x/en/list?page=2", "<p>end</p>"),
                                   (3, None, None)], "page_id long, url string, html string")
    rows = W.extract_listing(pages).orderBy("card_ix").collect()
    assert [(r.name, r.price, r.product_id) for r in rows] == [
        ("Flora", 1250.0, "880"), ("N/A", 10.0, ""), ("Five", 5.0, "881"), ("NoId", None, "")]
    flags = W.has_next_page(pages)
    assert {r.page_id: r.has_next for r in flags.collect()} == {1: True, 2: False, 3: False}
    assert {r.listing: r.last_page for r in W.last_pages(flags.where("url IS NOT NULL")).collect()} == {"https://x/en/list": 2}


def test_no_local_checkpoint_folder_on_a_cluster(spark, monkeypatch):
    from ledgerlake import session

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k, d=None: d)}))
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session)


@pytest.mark.parametrize("n,expected", [(0, 0), (499, 1), (500, 1), (501, 2), (1000, 2)])
def test_fixed_chunks(spark, n, expected):
    docs = spark.createDataFrame([(1, "x" * n, "s")], "doc_id long, text string, source string")
    ch = X.chunk_fixed(docs).collect()
    assert len(ch) == expected and "".join(c.chunk for c in sorted(ch, key=lambda c: c.chunk_ix)) == "x" * n


def test_overlap_chunks_cover_text(spark):
    text = "".join(chr(65 + i % 26) for i in range(4000))
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    ch = sorted(X.chunk_overlap(docs).collect(), key=lambda c: c.chunk_ix)
    assert [len(c.chunk) for c in ch] == [2000, 2000, 400]
    assert ch[1].chunk[:200] == ch[0].chunk[-200:]


def test_two_payments_tied_pick_smallest_name(spark):
    o = _orders(spark, [(1, "a", "A", 10.0, datetime(2023, 1, 1), "F", "zeta", "FR"),
                        (2, "b", "B", 10.0, datetime(2023, 1, 2), "F", "alpha", "FR")])
    assert TS.monthly_top_payment(o).first().top_payment == "alpha"


def test_running_share_segments_across_partitions(spark):
    rows = [(i, f"r{i}", f"C{i:03d}", float(1000 - i), datetime(2023, 1, 1), "F", "c", "FR") for i in range(300)]
    seg = C.customer_value_segments(_orders(spark, rows), partitions=7).orderBy(F.desc("spend")).collect()
    total = sum(1000 - i for i in range(300))
    running = 0.0
    for i, r in enumerate(seg):
        running += 1000 - i
        assert r.cumsum_pct == pytest.approx(running / total * 100, abs=1e-6)
    assert seg[-1].segment == "Low-value" and seg[0].segment == "High-value"


def test_ordered_cumsum_hot_value_splits_across_partitions(spark):
    from ledgerlake.operators.common import ordered_cumsum
    # a third of the rows share one value: ties are ordered by the key and
    # spread over several range partitions, sums stay exact
    rows = [(i, 5.0 if i % 3 == 0 else float(i % 17)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v double")
    out = ordered_cumsum(df.withColumn("one", F.lit(1.0)), [F.col("v").desc(), F.col("k").asc()],
                         {"cum": "v", "rank": "one"}, partitions=16, grand_totals=True).collect()
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    expect, run = {}, 0.0
    for pos, (k, v) in enumerate(ordered, 1):
        run += v
        expect[k] = (run, float(pos))
    for r in out:
        assert r.cum == pytest.approx(expect[r.k][0], abs=1e-6) and r.rank == expect[r.k][1]
    assert {r.rank_grand for r in out} == {3000.0}


def test_rounding_keeps_its_places_at_every_magnitude(spark):
    import duckdb
    from ledgerlake.functions.columns import r2, r6
    vals = [0.125, 0.375, 0.545, -2.5, 123456.1234567, 12345678901.37, 123456789012.67, 3752339125855.999,
            1e15, float("inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [tuple(r) for r in df.select("i", r2("v").alias("a"), r6("v").alias("b")).orderBy("i").collect()]
    con = duckdb.connect()
    want = [(i,) + con.execute("SELECT round_even(CAST(? AS DOUBLE), 2), round_even(CAST(? AS DOUBLE), 6)", [v, v]).fetchone()
            for i, v in enumerate(vals)]
    assert got == want
    assert [got[i][1] for i in (0, 1, 5, 6)] == [0.12, 0.38, 12345678901.37, 123456789012.67]
    assert got[4][2] == 123456.123457


def test_exact_sum_does_not_depend_on_order(spark):
    from ledgerlake.functions.columns import xavg, xsum
    vals = [0.1] * 1000 + [1e10, 0.37, float("nan")]
    up = spark.createDataFrame([(v,) for v in vals], "v double").agg(xsum("v").alias("s"), xavg("v").alias("m")).first()
    down = spark.createDataFrame([(v,) for v in vals[::-1]], "v double").repartition(7) \
                .agg(xsum("v").alias("s"), xavg("v").alias("m")).first()
    assert tuple(up) == tuple(down) == (10000000100.37, 10000000100.37 / 1002)
    assert spark.range(0).agg(xsum("id").alias("s"), xavg("id").alias("m")).first() == (None, None)
