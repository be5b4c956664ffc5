"""Single-operator queries: each exercises one building block over a whole
derived table, so the block can be checked against SQL on its own.

* ``win_01``: NTILE(4) over all orders by amount paid (distributed tiles)
* ``win_02``: order sequence number per person (skew-safe per-group number)
* ``win_03``: pandas ``rank(method='first')`` of revenue per person
* ``dup_02``: first delivered order per person (``DISTINCT ON``)
* ``dup_06``: the different cleaned seller cities (``unique()``)
* ``agg_14``: median coordinates per ZIP prefix
* ``agg_18``: first non-null delivery date per person in purchase order
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators.ordering import Sort, global_position, group_row_number, ntile
from revlens.operators.relational import (first_non_null_per_column, first_row_per_key,
                                          group_median)
from revlens.plans import sql_analyses as q
from revlens.plans.cleaning import clean_geolocation, clean_sellers

Tables = dict[str, DataFrame]


def win_01_order_value_ntile(t: Tables) -> DataFrame:
    paid = q._payments_per_order(t).select("order_id", "order_paid")
    return ntile(paid, 4, [Sort("order_paid", desc=True, nulls_first=True)], ["order_id"],
                 "value_tile").select("order_id", "value_tile")


def win_02_order_sequence(t: Tables) -> DataFrame:
    co = q._customer_orders(t)
    return group_row_number(co, ["customer_unique_id"], [Sort("order_purchase_timestamp")],
                            ["order_id"], "order_number").select(
        "customer_unique_id", "order_id", "order_number")


def win_03_revenue_rank_first(t: Tables) -> DataFrame:
    rev = (q._customer_orders(t, ("order_id",)).join(q._payments_per_order(t), "order_id")
           .groupBy("customer_unique_id").agg(F.sum("order_paid").alias("revenue")))
    return global_position(rev, [Sort("revenue")], ["customer_unique_id"], out="revenue_rank",
                           total=None).select("customer_unique_id", "revenue_rank")


def dup_02_first_delivered_order(t: Tables) -> DataFrame:
    co = q._customer_orders(t)
    return first_row_per_key(co, ["customer_unique_id"], ["order_purchase_timestamp", "order_id"],
                             ["order_id", "order_purchase_timestamp"])


def dup_06_seller_cities(t: Tables) -> DataFrame:
    return clean_sellers(t["sellers"]).select("seller_city").distinct()


def agg_14_zip_median_point(t: Tables) -> DataFrame:
    return group_median(clean_geolocation(t["geolocation"]), ["geolocation_zip_code_prefix"],
                        ["geolocation_lat", "geolocation_lng"])


def agg_18_first_delivery_date(t: Tables) -> DataFrame:
    co = q._customer_orders(t, ("order_id", "order_purchase_timestamp",
                                "order_delivered_customer_date"))
    return first_non_null_per_column(co, ["customer_unique_id"],
                                     ["order_purchase_timestamp", "order_id"],
                                     ["order_delivered_customer_date"])
