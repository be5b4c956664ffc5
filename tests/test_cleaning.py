"""Cleaning pipelines and relational operators on literal fixtures in the
e-commerce schema (the hazards the test tables cannot show)."""

import datetime as dt
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revlens.operators.relational import (duplicate_count, first_non_null_per_column,
                                          first_row_per_key, mark_join)
from revlens.plans import cleaning as C

D = dt.datetime


def test_seller_city_pipeline_h11_h14(spark):
    rows = [
        ("s1", "1234", "sao paulo/sp"),
        ("s2", "12345678", "são paulo"),                       # composed
        ("s3", None, unicodedata.normalize("NFD", "são paulo")),  # decomposed
        ("s4", "0", "04482255"),                               # digits only -> dropped
        ("s5", "1", "vendas@creditparts.com.br"),              # title case -> invalid -> dropped
        ("s6", "2", "santa barbara d'oeste"),
        ("s7", "3", "Sao Pauo"),
        ("s8", "4", "  rio de janeiro , rj"),
        ("s9", "5", "sp"),
    ]
    df = spark.createDataFrame(rows, "seller_id string, seller_zip_code_prefix string, "
                                     "seller_city string")
    got = {r.seller_id: (r.seller_zip_code_prefix, r.seller_city)
           for r in C.clean_sellers(df).collect()}
    assert set(got) == {"s1", "s2", "s3", "s6", "s7", "s8", "s9"}
    assert got["s1"] == ("01234", "Sao Paulo")            # 'Sao Paulo/Sp' misses map 1
    assert got["s2"] == ("12345678", "São Paulo")
    assert got["s3"] == (None, "São Paulo")              # 'SãO Paulo' decomposed key
    assert got["s6"][1] == unicodedata.normalize("NFKD", "Santa Barbara D'Oeste")
    assert got["s7"][1] == "Sao Paulo"                  # typo fix stays unaccented
    assert got["s8"][1] == "Rio De Janeiro"             # map 1 ran before the split
    assert got["s9"][1] == "São Paulo"                   # 'Sp' -> São Paulo
    assert got["s2"][1].encode() == "S\u00e3o Paulo".encode()  # composed, byte-exact


def test_products_median_after_drop(spark):
    rows = [
        (1, "a", 10.0, 100.0, None, 1.0, 1.0, 1.0, 1.0),
        (2, "null", 20.0, None, 2.0, 1.0, 2.0, 2.0, 2.0),
        (3, "", None, 300.0, 3.0, 1.0, 3.0, 3.0, 3.0),
        (4, "b", 1000.0, 1000.0, 9.0, 0.0, 1.0, 1.0, 1.0),   # zero weight -> dropped first
        (5, "c", 40.0, 400.0, 4.0, None, 1.0, 1.0, 1.0),     # null weight -> dropped
    ]
    cols = ("product_id long, product_category_name string, product_name_lenght double, "
            "product_description_lenght double, product_photos_qty double, product_weight_g double, "
            "product_length_cm double, product_height_cm double, product_width_cm double")
    df = spark.createDataFrame(rows, cols)
    allp = {r.product_id: r for r in C.clean_products(df, drop_unknown=False).collect()}
    assert set(allp) == {1, 2, 3}
    assert allp[2].product_category_name == "unknown" and allp[3].product_category_name == "unknown"
    assert allp[3].product_name_lenght == 15.0           # median of 10, 20 (after the drop)
    assert allp[1].product_photos_qty == 2.5
    assert allp[2].product_volume_cm3 == 8.0
    assert [r.product_id for r in C.clean_products(df).collect()] == [1]


def test_orders_null_safe_drop_h9(spark):
    rows = [
        (1, 10, " delivered ", D(2018, 1, 1), D(2018, 1, 2), None, D(2018, 1, 1, 12), D(2018, 1, 20)),
        (2, 10, "delivered", D(2018, 1, 1), None, None, D(2018, 1, 3), D(2018, 1, 20)),
        (3, 11, "delivered", D(2018, 1, 1), D(2018, 1, 1, 1), None, None, D(2018, 1, 20)),
        (4, None, "delivered", D(2018, 1, 1), None, None, None, None),
    ]
    cols = ("order_id long, customer_id long, order_status string, order_purchase_timestamp "
            "timestamp_ntz, order_approved_at timestamp_ntz, order_delivered_carrier_date "
            "timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
            "order_estimated_delivery_date timestamp_ntz")
    got = {r.order_id: r for r in C.clean_orders(spark.createDataFrame(rows, cols)).collect()}
    assert set(got) == {2, 3}                 # 1: delivered before approval; 4: no customer
    assert got[2].order_status == "delivered"
    assert got[2].delivery_days == 2 and got[2].delay_days == -17
    assert got[3].approval_hours == 1.0 and got[3].delivery_days is None


def test_orders_string_timestamps_coerce(spark):
    rows = [(1, 1, "delivered", "2018-01-01 10:00:00", "not a date", None, None, None)]
    cols = ("order_id long, customer_id long, order_status string, order_purchase_timestamp string, "
            "order_approved_at string, order_delivered_carrier_date string, "
            "order_delivered_customer_date string, order_estimated_delivery_date string")
    r = C.clean_orders(spark.createDataFrame(rows, cols)).collect()[0]
    assert r.order_purchase_timestamp == D(2018, 1, 1, 10) and r.order_approved_at is None


def test_reviews_dedupe_and_placeholders(spark):
    rows = [
        (1, 100, 5, None, " nice ", D(2018, 1, 1), D(2018, 1, 2)),
        (1, 101, 4, "dup", "x", D(2018, 1, 1), D(2018, 1, 3)),   # later answer -> not kept
        (2, 102, 3, " ", None, D(2018, 1, 5), D(2018, 1, 4)),    # answer before creation
        (3, 103, 1, "t", "", D(2018, 1, 5), D(2018, 1, 6)),
    ]
    cols = ("review_id long, order_id long, review_score int, review_comment_title string, "
            "review_comment_message string, review_creation_date timestamp_ntz, "
            "review_answer_timestamp timestamp_ntz")
    got = {r.review_id: r for r in C.clean_reviews(spark.createDataFrame(rows, cols)).collect()}
    assert set(got) == {1, 3}
    assert got[1].order_id == 100 and got[1].review_comment_title == "no_title"
    assert got[1].review_comment_message == "nice"
    assert got[3].review_comment_message == "no_comment"


def test_geolocation_step_order(spark):
    rows = [("1", -23.5, -46.6, "sao paulo", " SP "), ("1", -23.5, -46.6, "sao paulo", " SP "),
            ("22", -23.6, -46.7, " sao paulo ", "SP"), ("333", 10.0, -46.0, "x", "SP")]
    df = spark.createDataFrame(rows, "geolocation_zip_code_prefix string, geolocation_lat double, "
                                     "geolocation_lng double, geolocation_city string, "
                                     "geolocation_state string")
    got = sorted((r.geolocation_zip_code_prefix, r.geolocation_city, r.geolocation_state)
                 for r in C.clean_geolocation(df).collect())
    # the padded name is stripped but not replaced (replace runs before strip)
    assert got == [("00001", "são paulo", "SP"), ("00022", "sao paulo", "SP")]


def test_customers_cleaning(spark):
    rows = [("\"c1\"", "u1", 1234, " sao paulo ", "SP"), ("c2", "u2", 99999, "x", "ZZ")]
    df = spark.createDataFrame(rows, "customer_id string, customer_unique_id string, "
                                     "customer_zip_code_prefix int, customer_city string, "
                                     "customer_state string")
    got = {r.customer_id: r for r in C.clean_customers(df).collect()}
    assert got["c1"].customer_zip_code_prefix == "01234" and got["c1"].region == "Sudeste"
    assert got["c1"].customer_city == "sao paulo" and got["c1"].zip_first_digit == 0
    assert got["c2"].region is None


def test_first_per_key_vs_first_non_null_h5(spark):
    rows = [("u1", D(2018, 1, 1), 1, None, 5), ("u1", D(2018, 1, 2), 2, D(2018, 1, 9), 4),
            ("u2", D(2018, 1, 1), 3, D(2018, 1, 3), None), ("u2", D(2018, 1, 1), 4, D(2018, 1, 4), 2)]
    df = spark.createDataFrame(rows, "u string, ts timestamp_ntz, order_id long, "
                                     "delivered timestamp_ntz, score int")
    first = {r.u: r for r in first_row_per_key(df, ["u"], ["ts", "order_id"],
                                               ["order_id", "delivered", "score"]).collect()}
    assert first["u1"].delivered is None and first["u2"].order_id == 3
    nn = {r.u: r for r in first_non_null_per_column(df, ["u"], ["ts", "order_id"],
                                                     ["order_id", "delivered", "score"]).collect()}
    assert nn["u1"].order_id == 1 and nn["u1"].delivered == D(2018, 1, 9)  # values mix rows
    assert nn["u2"].score == 2
    pdf = pd.DataFrame(rows, columns=["u", "ts", "order_id", "delivered", "score"])
    ref = pdf.sort_values(["ts", "order_id"]).groupby("u").first()
    assert ref.loc["u1", "delivered"] == pd.Timestamp(2018, 1, 9)


def test_mark_join_and_duplicates(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    marks = spark.createDataFrame([(1,), (1,), (3,)], "k long")
    got = sorted((r.k, r.f) for r in mark_join(df, marks, "k", "f").collect())
    assert got == [(1, 1), (2, 0), (3, 1)]
    d = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a long, b string")
    assert duplicate_count(d).collect()[0].duplicates == 1
    assert duplicate_count(d, ["a"]).collect()[0].duplicates == 1
