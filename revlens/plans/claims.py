"""Headline findings of the project README, computed from the raw tables
(delivered orders, as in the SQL analyses)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.dates import fractional_days
from revlens.operators.ordering import Rank, Sort, running_totals
from revlens.plans import sql_analyses as q

Tables = dict[str, DataFrame]


def _revenue_per_person(t: Tables) -> DataFrame:
    return (q._customer_orders(t, ("order_id",)).join(q._payments_per_order(t), "order_id")
            .groupBy("customer_unique_id").agg(F.sum("order_paid").alias("revenue")))


def clm_01_pareto_share(t: Tables, top_share: float = 0.2, revenue_share: float = 0.8) -> DataFrame:
    """Revenue share of the top 20 % of people, and the share of people that
    makes 80 % of revenue (ranked by revenue DESC, then person id), via a
    distributed running total."""
    rev = _revenue_per_person(t)
    order, key = [Sort("revenue", desc=True)], ["customer_unique_id"]
    cum = running_totals(rev, [Rank(order, key, "cum_revenue", "revenue", "total_revenue"),
                               Rank(order, key, "rank", None, "customers")])
    k_top = F.ceil(F.col("customers") * F.lit(top_share))
    return cum.agg(
        F.max("customers").alias("customers"),
        F.max(k_top).cast("bigint").alias("top_customers"),
        F.round(F.max(F.when(F.col("rank") == k_top, F.col("cum_revenue")))
                * 100.0 / F.max("total_revenue"), 4).alias("top_revenue_pct"),
        F.min(F.when(F.col("cum_revenue") >= F.col("total_revenue") * F.lit(revenue_share),
                     F.col("rank"))).alias("customers_for_revenue_share"),
    ).withColumn("pct_customers_for_revenue_share",
                 F.round(F.col("customers_for_revenue_share") * 100.0 / F.col("customers"), 4))


def _category(t: Tables) -> DataFrame:
    cat = F.trim(F.col("product_category_name"))
    p = (t["products"].where(F.col("product_category_name").isNotNull() & (cat != ""))
         .select("product_id", cat.alias("product_category_name")))
    tr = t["translation"].select("product_category_name", "product_category_name_english")
    return (p.join(tr, "product_category_name", "left")
            .select("product_id", F.coalesce("product_category_name_english",
                                             "product_category_name").alias("category")))


def clm_02_best_selling_categories(t: Tables, k: int = 10) -> DataFrame:
    """Top categories by delivered items sold (revenue = item price). Item rows
    become one per product before they meet the products, so a best seller is no
    hot key of that join."""
    o = q._delivered(t).select("order_id")
    sold = (t["items"].select("order_id", "product_id", "price").join(o, "order_id")
            .groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("paid")))
    return (sold.join(_category(t), "product_id").groupBy("category")
            .agg(F.sum("n").alias("items_sold"),
                 F.round(F.sum("paid"), 2).alias("revenue"))
            .orderBy(F.col("items_sold").desc(), "category").limit(k))


def clm_03_peak_month(t: Tables) -> DataFrame:
    m = q.qry_10_monthly_revenue(t)
    return m.orderBy(F.col("monthly_revenue").desc(), "order_month").limit(1)


def clm_04_no_second_purchase(t: Tables) -> DataFrame:
    per = (q._customer_orders(t, ("order_id",)).groupBy("customer_unique_id")
           .agg(F.countDistinct("order_id").alias("n")))
    return per.agg(F.count(F.lit(1)).alias("customers"),
                   F.sum((F.col("n") == 1).cast("bigint")).alias("single_order_customers"),
                   F.round(F.avg((F.col("n") == 1).cast("double")) * 100, 4)
                   .alias("pct_no_second_purchase"))


def clm_05_top_regions(t: Tables, k: int = 5) -> DataFrame:
    """States by delivered revenue (payments), highest first."""
    o = q._delivered(t).select("order_id", "customer_id")
    c = t["customers"].select("customer_id", "customer_state")
    return (o.join(q._payments_per_order(t), "order_id").join(c, "customer_id")
            .groupBy("customer_state").agg(F.round(F.sum("order_paid"), 2).alias("revenue"))
            .orderBy(F.col("revenue").desc(), "customer_state").limit(k))


def clm_06_delivery_vs_review(t: Tables) -> DataFrame:
    """Pearson correlation of delivery days and review score over delivered
    orders with a review (one row per review)."""
    o = (q._delivered(t).where(F.col("order_delivered_customer_date").isNotNull())
         .select("order_id", fractional_days("order_delivered_customer_date",
                                             "order_purchase_timestamp").alias("delivery_days")))
    r = t["reviews"].select("order_id", "review_score")
    j = o.join(r, "order_id")
    return j.agg(F.count(F.lit(1)).alias("pairs"),
                 F.round(F.corr("delivery_days", F.col("review_score").cast("double")), 6)
                 .alias("correlation"))


def clm_07_rfm_repeat_rate(t: Tables) -> DataFrame:
    seg = q.qry_11_rfm_customer_segments(t)
    return seg.agg(F.count(F.lit(1)).alias("customers"),
                   F.sum((F.col("customer_segment") != "Single Purchase").cast("bigint"))
                   .alias("repeat_customers"),
                   F.round(F.avg((F.col("customer_segment") != "Single Purchase").cast("double"))
                           * 100, 4).alias("repeat_rate_pct"))
