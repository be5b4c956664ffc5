"""Adapter from the given TPC-H-like test tables to the e-commerce schema.

The analyses are written against the e-commerce tables (customers, orders,
order payments, order items, reviews, products, category translation,
sellers, geolocation). The test parquet files carry a TPC-H-like star schema
instead, so this module derives the e-commerce tables from them with plain
projections and joins. Everything is lazy: each table is a DataFrame whose
work grows with the input files.

The same derivation is given as DuckDB SQL (``ORACLE_ADAPTER_SQL``) so the
oracle side starts from identical rows. Keep the two in step.

Fixed derivation rules (shared by both sides):
  PTS                      = o_orderdate + (o_orderkey % 24) hours
  order_status             = 'delivered' when o_orderstatus = 'F' and o_orderkey % 3 = 0,
                             else lower(o_orderstatus)
  order_approved_at        = PTS + (o_orderkey % 30) hours
  order_delivered_carrier  = PTS + (6 + o_orderkey % 72) hours, NULL when o_orderkey % 13 = 0
  order_delivered_customer = PTS + (12 + o_orderkey * 7 % 700) hours, NULL when o_orderkey % 17 = 0
  order_estimated_delivery = day of PTS + 20 days
  payment_type             = by l_linenumber % 4: 0 credit_card, 1 boleto, 2 voucher, 3 debit_card
  review order_id          = event_id - 1 when event_id % 10 = 9 (second review), else event_id
  product category         = NULL when p_partkey % 50 = 0, '' when p_partkey % 51 = 0,
                             else ' ' || p_brand
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("customers", "orders", "payments", "items", "reviews", "products",
          "translation", "sellers", "geolocation")


def _hours(e: Column) -> Column:
    return F.make_dt_interval(F.lit(0), e.cast("int"))


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    n = _read(spark, sf_dir, "nation")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("c_custkey").alias("customer_id"),
                    F.col("c_custkey").alias("customer_unique_id"),
                    F.col("c_nationkey").alias("customer_zip_code_prefix"),
                    F.lower("c_mktsegment").alias("customer_city"),
                    F.col("n_name").alias("customer_state")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pts = F.col("o_orderdate") + _hours(k % 24)
    return o.select(
        k.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when((F.col("o_orderstatus") == "F") & (k % 3 == 0), F.lit("delivered"))
         .otherwise(F.lower("o_orderstatus")).alias("order_status"),
        pts.alias("order_purchase_timestamp"),
        (pts + _hours(k % 30)).alias("order_approved_at"),
        F.when(k % 13 != 0, pts + _hours(6 + k % 72)).alias("order_delivered_carrier_date"),
        F.when(k % 17 != 0, pts + _hours(12 + (k * 7) % 700)).alias("order_delivered_customer_date"),
        (F.to_date(pts).cast("timestamp_ntz") + _days(20)).alias("order_estimated_delivery_date"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments_from_lineitem(_read(spark, sf_dir, "lineitem"))


def payments_from_lineitem(li: DataFrame) -> DataFrame:
    """Payment rows from line items (batch or streaming DataFrame)."""
    ln = F.col("l_linenumber") % 4
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.when(ln == 0, "credit_card").when(ln == 1, "boleto").when(ln == 2, "voucher")
         .otherwise("debit_card").alias("payment_type"),
        (F.col("l_quantity").cast("int") % 10).alias("payment_installments"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("payment_value"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax") / F.lit(1000.0)).alias("freight_value"),
        F.col("l_shipdate").alias("shipping_limit_date"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("review_id"),
        F.when(k % 10 == 9, k - 1).otherwise(k).alias("order_id"),
        (F.lit(1) + F.col("user_id") % 5).cast("int").alias("review_score"),
        F.when(k % 4 != 0, F.col("event_type")).alias("review_comment_title"),
        F.when(k % 3 != 0, F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
         .alias("review_comment_message"),
        F.col("ts").alias("review_creation_date"),
        (F.col("ts") + _hours(k % 50 - 2)).alias("review_answer_timestamp"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    size = F.col("p_size").cast("double")
    return p.select(
        k.alias("product_id"),
        F.when(k % 50 == 0, F.lit(None).cast("string"))
         .when(k % 51 == 0, F.lit(""))
         .otherwise(F.concat(F.lit(" "), F.col("p_brand"))).alias("product_category_name"),
        F.when(k % 37 != 0, F.length("p_name").cast("double")).alias("product_name_lenght"),
        F.when(k % 41 != 0, (F.length("p_type") * 10).cast("double")).alias("product_description_lenght"),
        F.when(k % 43 != 0, (F.col("p_size") % 5).cast("double")).alias("product_photos_qty"),
        F.when(k % 47 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice")).alias("product_weight_g"),
        size.alias("product_length_cm"),
        F.when(k % 53 != 0, (F.col("p_size") % 7 + 1).cast("double")).alias("product_height_cm"),
        (F.lit(1) + k % 30).cast("double").alias("product_width_cm"),
    )


def translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return (p.where(F.length("p_brand") == 7)
            .select(F.col("p_brand").alias("product_category_name"),
                    F.upper("p_brand").alias("product_category_name_english"))
            .distinct())


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    n = _read(spark, sf_dir, "nation")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("s_suppkey").alias("seller_id"),
                    F.col("s_nationkey").alias("seller_zip_code_prefix"),
                    _written_city(F.col("s_suppkey"), F.lower("n_name")).alias("seller_city")))


#: Ways in which sellers write their city, by ``s_suppkey % 16``: text before
#: and after the name, or a text instead of it (None: the key itself).
CITY_AFFIXES = {0: ("", ""), 1: ("  ", "  "), 2: ("", " / sp"), 3: ("", "-df"), 4: ("", ", br"), 13: ("", "   do  sul")}
CITY_TEXTS = {5: None, 6: "centro", 7: "sao pauo", 8: "sao paulo", 9: "rio de janeiro", 10: "sbc",
              11: "vendas@creditparts.com.br", 12: "brasilia df", 14: "garulhos", 15: "scao jose do rio pardo"}


def _written_city(key: Column, name: Column) -> Column:
    out = name
    for k, (before, after) in CITY_AFFIXES.items():
        out = F.when(key % 16 == k, F.concat(F.lit(before), name, F.lit(after))).otherwise(out)
    for k, text in CITY_TEXTS.items():
        out = F.when(key % 16 == k, key.cast("string") if text is None else F.lit(text)).otherwise(out)
    return out


def geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    n = _read(spark, sf_dir, "nation")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("c_nationkey").alias("geolocation_zip_code_prefix"),
                    (F.lit(-30.0) + F.col("c_nationkey") * F.lit(1.2)
                     + F.col("c_acctbal") / F.lit(100000.0)).alias("geolocation_lat"),
                    (F.lit(-70.0) + F.col("c_nationkey") * F.lit(0.9)).alias("geolocation_lng"),
                    F.lower("c_mktsegment").alias("geolocation_city"),
                    F.col("n_name").alias("geolocation_state")))


def _as_text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def csv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as their CSV file has them: all times are text."""
    return _as_text(orders(spark, sf_dir), "order_purchase_timestamp", "order_approved_at",
                    "order_delivered_carrier_date", "order_delivered_customer_date",
                    "order_estimated_delivery_date")


def csv_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(reviews(spark, sf_dir), "review_creation_date", "review_answer_timestamp")


def csv_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as text, with shipping dates that are no dates."""
    k, c = F.col("order_id"), "shipping_limit_date"
    out = _as_text(items(spark, sf_dir), c)
    return out.withColumn(c, F.when(k % 29 == 0, "unknown").when(k % 31 == 0, "1995-02-31 00:00:00")
                          .otherwise(F.col(c)))


_BUILDERS = {
    "csv_orders": csv_orders, "csv_reviews": csv_reviews, "csv_items": csv_items,
    "customers": customers, "orders": orders, "payments": payments, "items": items,
    "reviews": reviews, "products": products, "translation": translation,
    "sellers": sellers, "geolocation": geolocation,
}


def load_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All e-commerce tables derived from the test parquet folder (lazy)."""
    return {name: build(spark, sf_dir) for name, build in _BUILDERS.items()}


# DuckDB form of the same derivation, used as leading CTEs by every oracle
# query. CTE names carry a ``src_`` prefix so they never shadow the
# pre-registered test views (``orders`` in particular).
ORACLE_ADAPTER_SQL = """
src_customers AS (
  SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id,
         c_nationkey AS customer_zip_code_prefix, lower(c_mktsegment) AS customer_city,
         n_name AS customer_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
src_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'delivered'
              ELSE lower(o_orderstatus) END AS order_status,
         o_orderdate + to_hours(o_orderkey % 24) AS order_purchase_timestamp,
         o_orderdate + to_hours(o_orderkey % 24) + to_hours(o_orderkey % 30) AS order_approved_at,
         CASE WHEN o_orderkey % 13 <> 0
              THEN o_orderdate + to_hours(o_orderkey % 24) + to_hours(6 + o_orderkey % 72) END
           AS order_delivered_carrier_date,
         CASE WHEN o_orderkey % 17 <> 0
              THEN o_orderdate + to_hours(o_orderkey % 24) + to_hours(12 + (o_orderkey * 7) % 700) END
           AS order_delivered_customer_date,
         CAST(CAST(o_orderdate + to_hours(o_orderkey % 24) AS DATE) AS TIMESTAMP) + to_days(20)
           AS order_estimated_delivery_date
  FROM orders),
src_payments AS (
  SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
         CASE l_linenumber % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'boleto'
              WHEN 2 THEN 'voucher' ELSE 'debit_card' END AS payment_type,
         CAST(trunc(l_quantity) AS INTEGER) % 10 AS payment_installments,
         l_extendedprice / 1000.0::DOUBLE AS payment_value
  FROM lineitem),
src_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, l_extendedprice / 1000.0::DOUBLE AS price,
         l_extendedprice * l_tax / 1000.0::DOUBLE AS freight_value,
         l_shipdate AS shipping_limit_date
  FROM lineitem),
src_csv_items AS (
  SELECT * REPLACE (CASE WHEN order_id % 29 = 0 THEN 'unknown'
                         WHEN order_id % 31 = 0 THEN '1995-02-31 00:00:00'
                         ELSE CAST(shipping_limit_date AS VARCHAR) END AS shipping_limit_date)
  FROM src_items),
src_reviews AS (
  SELECT event_id AS review_id,
         CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS order_id,
         CAST(1 + user_id % 5 AS INTEGER) AS review_score,
         CASE WHEN event_id % 4 <> 0 THEN event_type END AS review_comment_title,
         CASE WHEN event_id % 3 <> 0 THEN ' ' || event_type || ' ' END AS review_comment_message,
         ts AS review_creation_date,
         ts + to_hours(event_id % 50 - 2) AS review_answer_timestamp
  FROM events),
src_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 51 = 0 THEN ''
              ELSE ' ' || p_brand END AS product_category_name,
         CASE WHEN p_partkey % 37 <> 0 THEN CAST(length(p_name) AS DOUBLE) END AS product_name_lenght,
         CASE WHEN p_partkey % 41 <> 0 THEN CAST(length(p_type) * 10 AS DOUBLE) END
           AS product_description_lenght,
         CASE WHEN p_partkey % 43 <> 0 THEN CAST(p_size % 5 AS DOUBLE) END AS product_photos_qty,
         CASE WHEN p_partkey % 47 = 0 THEN 0.0::DOUBLE ELSE p_retailprice END AS product_weight_g,
         CAST(p_size AS DOUBLE) AS product_length_cm,
         CASE WHEN p_partkey % 53 <> 0 THEN CAST(p_size % 7 + 1 AS DOUBLE) END AS product_height_cm,
         CAST(1 + p_partkey % 30 AS DOUBLE) AS product_width_cm
  FROM part),
src_translation AS (
  SELECT DISTINCT p_brand AS product_category_name, upper(p_brand) AS product_category_name_english
  FROM part WHERE length(p_brand) = 7),
src_sellers AS (
  SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix,
         CASE s_suppkey % 16 {cities} ELSE lower(n_name) END AS seller_city
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
src_geolocation AS (
  SELECT c_nationkey AS geolocation_zip_code_prefix,
         -30.0::DOUBLE + c_nationkey * 1.2::DOUBLE + c_acctbal / 100000.0::DOUBLE AS geolocation_lat,
         -70.0::DOUBLE + c_nationkey * 0.9::DOUBLE AS geolocation_lng,
         lower(c_mktsegment) AS geolocation_city, n_name AS geolocation_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
""".replace("{cities}", " ".join(
    [f"WHEN {k} THEN '{a}' || lower(n_name) || '{b}'" for k, (a, b) in CITY_AFFIXES.items()]
    + [f"WHEN {k} THEN " + ("CAST(s_suppkey AS VARCHAR)" if x is None else f"'{x}'") for k, x in CITY_TEXTS.items()]))


def oracle(sql_body: str, ctes: str = "") -> str:
    """Prefix an oracle statement with the adapter CTEs.

    ``ctes`` are further comma-separated CTE definitions (without WITH);
    ``sql_body`` is the final SELECT.
    """
    extra = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    return f"WITH {ORACLE_ADAPTER_SQL.strip()}{extra}\n{sql_body.strip()}"
