"""The five assertions of the reference's own unit test, on its fixture."""

from ledgerlake.operators import basic as B
from ledgerlake.operators import customers as C


def test_basic_kpis(order_data):
    r = B.basic_kpis(order_data).first()
    assert (r.total_orders, r.total_revenue, r.unique_customers) == (5, 1500.0, 3)
    assert abs(r.avg_orders_per_customer - 5 / 3) < 1e-5


def test_cart_abandonment_rate(cart_data, order_data):
    assert B.cart_abandonment_rate(cart_data, order_data).first().abandonment_rate == 50.0


def test_repeat_purchase_interval(order_data):
    assert C.repeat_purchase_interval(order_data).first().avg_interval_days == 2.0


def test_churn_rate(order_data):
    assert C.churn_inactive(order_data, inactive_days=90).first().churn_rate == 0.0


def test_refined_clv(order_data):
    assert abs(C.clv_refined(order_data).first().clv - 6000) <= 1
