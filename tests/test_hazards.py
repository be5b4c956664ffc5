"""Semantic hazards of the reference on literal tables in the
e-commerce schema."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from revlens.plans import notebook_analyses as nb
from revlens.plans import sql_analyses as q

D = dt.datetime

SCHEMAS = {
    "customers": "customer_id long, customer_unique_id long, customer_zip_code_prefix int, "
                 "customer_city string, customer_state string",
    "orders": "order_id long, customer_id long, order_status string, "
              "order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
              "order_delivered_carrier_date timestamp_ntz, "
              "order_delivered_customer_date timestamp_ntz, "
              "order_estimated_delivery_date timestamp_ntz",
    "payments": "order_id long, payment_sequential int, payment_type string, "
                "payment_installments int, payment_value double",
    "items": "order_id long, order_item_id int, product_id long, seller_id long, price double, "
             "freight_value double, shipping_limit_date timestamp_ntz",
    "reviews": "review_id long, order_id long, review_score int, review_comment_title string, "
               "review_comment_message string, review_creation_date timestamp_ntz, "
               "review_answer_timestamp timestamp_ntz",
    "products": "product_id long, product_category_name string, product_name_lenght double, "
                "product_description_lenght double, product_photos_qty double, "
                "product_weight_g double, product_length_cm double, product_height_cm double, "
                "product_width_cm double",
    "translation": "product_category_name string, product_category_name_english string",
    "sellers": "seller_id long, seller_zip_code_prefix int, seller_city string",
    "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, "
                   "geolocation_lng double, geolocation_city string, geolocation_state string",
}


def tables(spark, **rows):
    return {k: spark.createDataFrame(rows.get(k, []), s) for k, s in SCHEMAS.items()}


def _order(oid, cid, ts, status="delivered", delivered=None, est=None):
    return (oid, cid, status, ts, ts, None, delivered, est)


def test_h1_desc_tiles_hide_champions(spark):
    # 8 people, 2 repeat buyers: NTILE over frequency DESC puts both in tile 1,
    # so the ">= 3" rule can never call a repeat buyer a champion
    cust = [(i, i, 1, "c", "SP") for i in range(8)]
    orders, pays = [], []
    oid = 0
    for i in range(8):
        for k in range(2 if i < 2 else 1):
            orders.append(_order(oid, i, D(2018, 1, 1 + i + k * 10)))
            pays.append((oid, 1, "boleto", 1, 10.0 * (i + 1)))
            oid += 1
    t = tables(spark, customers=cust, orders=orders, payments=pays)
    seg = {r.customer_segment for r in q.qry_01_rfm_segments(t).collect()}
    assert "Champions" not in seg and "At Risk Loyal" not in seg
    assert "Single Purchase" in seg


def test_h3_bin_edges_sql_vs_pandas(spark):
    # same ZIP for customer and seller -> distance 0
    cust = [(1, 1, 1, "c", "SP")]
    orders = [_order(10, 1, D(2018, 1, 1), delivered=D(2018, 1, 5), est=D(2018, 1, 10))]
    items = [(10, 1, 100, 7, 50.0, 5.0, D(2018, 1, 2))]
    sellers = [(7, 1, "sao paulo")]
    geo = [(1, -23.5, -46.6, "sao paulo", "SP")]
    t = tables(spark, customers=cust, orders=orders, items=items, sellers=sellers,
               geolocation=geo, payments=[(10, 1, "boleto", 1, 50.0)])
    sql = {r.distance_band: r.total_orders for r in q.qry_06_seller_distance(t).collect()}
    assert sql == {"Local": 1}                      # SQL: 0 km < 100 -> Local
    pdb = {r.distance_bin: r.total_orders for r in nb.ana_06_distance_bins(t).collect()}
    assert pdb == {"Local (<100 km)": 0, "Regional (100-500 km)": 0,
                   "Long Distance (>500 km)": 0}   # pandas: 0 km is outside (0, 100]


def test_h4_fan_out_is_literal(spark):
    # one order, 2 payments x 3 items: SUM(payment_value) counts each payment 3 times
    cust = [(1, 1, 1, "c", "SP")]
    orders = [_order(10, 1, D(2018, 1, 1), delivered=D(2018, 1, 5), est=D(2018, 1, 3))]
    pays = [(10, 1, "boleto", 1, 10.0), (10, 2, "voucher", 1, 5.0)]
    items = [(10, i, 100 + i, 7, 1.0, float(i), D(2018, 1, 2)) for i in range(1, 4)]
    t = tables(spark, customers=cust, orders=orders, payments=pays, items=items)
    r = q.qry_02_state_ltv(t).collect()[0]
    assert r.avg_ltv == 45.0                         # (10 + 5) * 3 item rows
    assert r.avg_freight_cost == 2.0 and r.avg_delivery_delay_days == 2.0


def test_h10_having_edges(spark):
    # 50 people buy category 'x' once: SQL keeps > 50 (drops it), pandas >= 50 keeps it
    cust = [(i, i, 1, "c", "SP") for i in range(50)]
    orders = [_order(i, i, D(2018, 1, 1)) for i in range(50)]
    items = [(i, 1, 500, 7, 10.0, 1.0, D(2018, 1, 2)) for i in range(50)]
    prods = [(500, "x", 10.0, 10.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    t = tables(spark, customers=cust, orders=orders, items=items, products=prods)
    assert q.qry_05_category_repeat(t).count() == 0
    got = nb.ana_05_category_repeat(t).collect()
    assert [(r.category, r.customers) for r in got] == [("x", 50)]


def test_h15_h16_churn_windows(spark):
    # max delivered purchase 2018-08-31; last orders at exactly -6 months and -180 days
    cust = [(i, i, 1, "c", "SP") for i in range(4)]
    orders = [_order(1, 0, D(2018, 8, 31)),                    # the maximum
              _order(2, 1, D(2018, 2, 28)),                    # = max - 6 months (clamped)
              _order(3, 2, D(2018, 3, 4)),                     # = max - 180 days
              _order(4, 3, D(2018, 2, 27, 23)),                # just before -6 months
              _order(5, 3, D(2018, 9, 15), status="shipped")]  # not delivered, later
    t = tables(spark, customers=cust, orders=orders,
               payments=[(i, 1, "boleto", 1, 1.0) for i in range(1, 6)])
    churn = {r.customer_unique_id: r.churn_status for r in q.churn_flags(t).collect()}
    assert churn == {0: "Active", 1: "Active", 2: "Active", 3: "Churned"}
    nbc = {r.customer_unique_id: r.churned for r in nb.ana_03_one_time_churn(t).collect()}
    assert nbc == {0: False, 1: True, 2: False, 3: True}
    # H16: SQL snapshot uses all orders (2018-09-15) + 1 day
    rfm = {r.customer_unique_id: r.recency_days for r in q.rfm_scores(t).collect()}
    assert rfm[0] == (dt.date(2018, 9, 16) - dt.date(2018, 8, 31)).days


def test_h20_null_group_keys(spark):
    cust = [(1, 1, 1, "c", None), (2, 2, 1, "c", "SP")]
    orders = [_order(1, 1, D(2018, 1, 1), delivered=D(2018, 1, 3), est=D(2018, 1, 5)),
              _order(2, 2, D(2018, 1, 1), delivered=D(2018, 1, 4), est=D(2018, 1, 5))]
    items = [(1, 1, 9, 9, 1.0, 1.0, D(2018, 1, 2)), (2, 1, 9, 9, 1.0, 1.0, D(2018, 1, 2))]
    t = tables(spark, customers=cust, orders=orders, items=items,
               payments=[(1, 1, "boleto", 1, 1.0), (2, 1, "boleto", 1, 1.0)])
    sql_states = {r.customer_state for r in q.qry_02_state_ltv(t).collect()}
    assert sql_states == {None, "SP"}               # SQL keeps the NULL group
    nb_states = {r.customer_state for r in nb.ana_02_state_delivery(t).collect()}
    assert nb_states == {"SP"}                       # pandas groupby drops it


def test_h17_ties_broken_by_key(spark):
    # two orders of one person at the same timestamp: the smaller order_id is first
    cust = [(1, 1, 1, "c", "SP")]
    orders = [_order(20, 1, D(2018, 1, 1)), _order(10, 1, D(2018, 1, 1))]
    t = tables(spark, customers=cust, orders=orders)
    first = q.first_order_ids(t).collect()[0]
    assert first.first_order_id == 10
    buyer = q.churn_flags(t).collect()[0]
    assert buyer.buyer_type == "One-time Buyer"      # first == last timestamp


def test_person_with_several_customer_ids(spark):
    # customer_id is per order address; customer_unique_id is the person
    cust = [(1, 100, 1, "c", "SP"), (2, 100, 1, "c", "SP"), (3, 300, 1, "c", "RJ")]
    orders = [_order(10, 1, D(2018, 1, 1)), _order(11, 2, D(2018, 3, 1)),
              _order(12, 3, D(2018, 3, 1))]
    pays = [(10, 1, "boleto", 1, 10.0), (11, 1, "boleto", 1, 20.0), (12, 1, "voucher", 2, 5.0)]
    t = tables(spark, customers=cust, orders=orders, payments=pays)
    rfm = {r.customer_unique_id: (r.frequency, r.total_spent) for r in q.rfm_scores(t).collect()}
    assert rfm == {100: (2, 30.0), 300: (1, 5.0)}
    buyers = {r.customer_unique_id: r.buyer_type for r in q.churn_flags(t).collect()}
    assert buyers == {100: "Repeat Buyer", 300: "One-time Buyer"}
    seg = {r.customer_unique_id: r.customer_segment
           for r in q.qry_11_rfm_customer_segments(t).collect()}
    assert seg[300] == "Single Purchase" and seg[100] != "Single Purchase"


def test_h13_missing_text_stays_null(spark):
    # pandas' astype(str) would write 'nan'; NULL is kept, as documented
    from revlens.plans.cleaning import clean_geolocation, clean_sellers
    sellers = spark.createDataFrame([("s1", None, None)], "seller_id string, seller_zip_code_prefix string, seller_city string")
    assert [tuple(r) for r in clean_sellers(sellers).collect()] == [("s1", None, None)]
    geo = spark.createDataFrame([(None, -10.0, -50.0, None, None)],
                                "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, "
                                "geolocation_city string, geolocation_state string")
    row = clean_geolocation(geo).first()
    assert row.geolocation_zip_code_prefix is None and row.geolocation_city is None


def test_h18_times_are_parsed_before_they_are_compared(spark):
    # as text '2018-1-9' is after '2018-01-10'; parsed once at the source it is not
    from revlens.plans.cleaning import clean_orders
    cols = ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
            "order_delivered_customer_date", "order_estimated_delivery_date"]
    rows = [("o1", "c1", "delivered", "2018-1-9 08:00:00", *[None] * 4),
            ("o2", "c1", "delivered", "2018-01-10 08:00:00", *[None] * 4)]
    df = spark.createDataFrame(rows, "order_id string, customer_id string, order_status string, "
                               + ", ".join(f"{c} string" for c in cols))
    out = clean_orders(df)
    assert dict(out.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert df.agg(F.max("order_purchase_timestamp")).first()[0].startswith("2018-1-9")
    assert out.agg(F.max_by("order_id", "order_purchase_timestamp")).first()[0] == "o2"


def test_h21_dropped_sellers_and_products_drop_their_order_rows(small_tables):
    from revlens.plans import notebook_analyses as nb
    from revlens.plans.cleaning import clean_tables, product_categories
    c = nb.notebook_tables(small_tables)
    items, raw = c["items"], clean_tables(small_tables)
    kept_sellers = raw["sellers"].select("seller_id")
    assert kept_sellers.count() < small_tables["sellers"].count()
    assert items.join(kept_sellers, "seller_id").count() < items.count()
    kept = product_categories(small_tables["products"])
    assert sorted(kept.collect()) == sorted(raw["products"].select(*kept.columns).collect())
    people = items.join(kept, "product_id").join(nb._orders_customers(c, ("order_id",)), "order_id")
    most = people.groupBy("product_category_name").agg(F.countDistinct("customer_unique_id").alias("n")).agg(F.max("n")).first()[0]
    assert nb.category_repeat(c, min_customers=most + 1).count() == 0
    assert nb.category_repeat(c, min_customers=1).agg(F.max("customers")).first()[0] == most
