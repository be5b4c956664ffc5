"""DuckDB statements for the queries of ``plans/storage.py``: counts and digests
of the adapter's tables themselves."""

from __future__ import annotations

from revlens.functions.strings import PANDAS_NA
from revlens.sources.adapters import oracle

SQL: dict[str, str] = {}

_MISSING = ", ".join(f"'{token}'" for token in ("", *PANDAS_NA))
#: A text as it returns from a CSV file: without outer blanks, missing tokens as NULL.
_CATEGORY = (f"CASE WHEN trim(product_category_name) NOT IN ({_MISSING}) THEN trim(product_category_name) END")


def _digest(columns: list[str], cents: tuple[str, ...] = ()) -> str:
    values = ", ".join(f"CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR)" if c in cents else f"CAST({c} AS VARCHAR)"
                       for c in columns)
    return f"CAST(coalesce(sum(CAST('0x' || substr(md5(concat_ws('|', {values})), 1, 8) AS BIGINT)), 0) AS BIGINT)"


_ORDER = ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
          "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"]
_PRODUCT = ["product_name_lenght", "product_description_lenght", "product_photos_qty", "product_weight_g",
            "product_length_cm", "product_height_cm", "product_width_cm"]
_CONTENT = {
    "customers": ("src_customers", ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
                                    "customer_state"], ()),
    "orders": ("src_csv_orders", _ORDER, ()),
    "payments": ("src_payments", ["order_id", "payment_sequential", "payment_type", "payment_installments",
                                  "payment_value"], ("payment_value",)),
    "items": ("src_csv_items", ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value",
                                "shipping_limit_date"], ("price", "freight_value")),
    "products": ("src_products", ["product_id", _CATEGORY, *_PRODUCT], tuple(_PRODUCT)),
}

#: Times of the raw orders as text.
_TEXT_ORDERS = "src_csv_orders AS (SELECT order_id, customer_id, order_status, " + ", ".join(
    f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in _ORDER[3:]) + " FROM src_orders)"

SQL["src_05_folder_ingest"] = oracle("\nUNION ALL\n".join(
    f"SELECT '{name}' AS \"table\", CAST(0 AS BIGINT) AS files_in_error, count(*) AS rows, "
    f"CAST(0 AS BIGINT) AS corrupt_rows, {_digest(columns, cents)} AS digest FROM {source}"
    for name, (source, columns, cents) in _CONTENT.items()), _TEXT_ORDERS)

SQL["src_01_inferred_types"] = oracle("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, "
    f"count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) IN ({_MISSING})) AS nulls, "
    + ("CAST(NULL AS BIGINT)" if kind == "string" else
       f"CAST(coalesce(sum(CAST(round({c} * 100) AS BIGINT)), 0) AS BIGINT)") + " AS hundredths FROM src_products"
    for c, kind in (("product_id", "bigint"), ("product_category_name", "string"), *((c, "double") for c in _PRODUCT))))

SQL["snk_01_replace_roundtrip"] = oracle(
    f"SELECT count(*) AS rows, {_digest(_ORDER)} AS digest, TRUE AS failure_kept_table "
    "FROM src_csv_orders WHERE order_status = 'delivered'", _TEXT_ORDERS)
