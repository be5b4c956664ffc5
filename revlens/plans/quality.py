"""Data-quality reports of the notebook, applied to the e-commerce tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators import profiling as P
from revlens.operators.relational import duplicate_count
from revlens.plans.cleaning import clean_products, clean_tables
from revlens.sources.adapters import TABLES

Tables = dict[str, DataFrame]


def prf_01_shapes(t: Tables) -> DataFrame:
    """Rows and columns of every raw table."""
    out = None
    for name in sorted(TABLES):
        s = P.shape(t[name]).select(F.lit(name).alias("table"), "rows", "columns")
        out = s if out is None else out.unionByName(s)
    return out


def prf_02_column_info(t: Tables) -> DataFrame:
    """``info()`` of every raw table: position, column, type, non-null count."""
    out = None
    for name in sorted(TABLES):
        s = P.column_info(t[name]).select(F.lit(name).alias("table"), "position", "column",
                                          "dtype", "non_null")
        out = s if out is None else out.unionByName(s)
    return out


def prf_03_null_counts(t: Tables) -> DataFrame:
    out = None
    for name in sorted(TABLES):
        s = P.null_counts(t[name]).select(F.lit(name).alias("table"), "column", "nulls")
        out = s if out is None else out.unionByName(s)
    return out


def prf_04_describe_payments(t: Tables) -> DataFrame:
    """``describe()`` of the cleaned payments' value and installments."""
    pay = clean_tables(t)["payments"]
    d = P.describe_numeric(pay, ["payment_value", "payment_installments"])
    # mean and std are shown to 6 places so the summation order cannot show,
    # interpolated quartiles to 11 places (engines interpolate with different
    # operation orders, which differ in the last binary digit)
    return d.withColumn("value", F.when(F.col("statistic").isin("mean", "std"),
                                        F.round("value", 6))
                        .when(F.col("statistic").isin("25%", "50%", "75%"), F.round("value", 11))
                        .otherwise(F.col("value")))


def prf_04_describe_text_orders(t: Tables) -> DataFrame:
    """``describe()`` of a text-only frame: orders before timestamp parsing."""
    o = t["orders"]
    return P.describe_text(o.select(*[F.col(c).cast("string").alias(c) for c in o.columns]))


def prf_05_payment_type_counts(t: Tables) -> DataFrame:
    return P.value_counts(t["payments"], "payment_type")


def prf_05_category_counts_with_nulls(t: Tables) -> DataFrame:
    """``value_counts(dropna=False)`` of the raw product category (NULL is a
    group of its own)."""
    return P.value_counts(t["products"], "product_category_name", dropna=False)


def prf_06_customer_cardinality(t: Tables) -> DataFrame:
    c = clean_tables(t)["customers"]
    return P.distinct_counts(c, ["customer_unique_id", "customer_city", "customer_state"])


def prf_07_products_quality(t: Tables) -> DataFrame:
    """Quality table of products after cleaning, before dropping 'unknown'."""
    return P.quality_table(clean_products(t["products"], drop_unknown=False))


def prf_08_customer_rules(t: Tables) -> DataFrame:
    """State not two capitals, city shorter than 3, ZIP not five digits
    (on the cleaned customers)."""
    c = clean_tables(t)["customers"]
    return P.rule_counts(c, {
        "invalid_state": ~F.coalesce(F.col("customer_state").rlike(r"^[A-Z]{2}$"), F.lit(False)),
        "short_city": F.length("customer_city") < 3,
        "invalid_zip": ~F.coalesce(F.col("customer_zip_code_prefix").rlike(r"^\d{5}$"),
                                   F.lit(False)),
    })


def prf_09_duplicates(t: Tables) -> DataFrame:
    """Duplicate rows of each raw table, and duplicate customer keys."""
    out = None
    for name in sorted(TABLES):
        s = duplicate_count(t[name]).select(F.lit(name).alias("check"), "duplicates")
        out = s if out is None else out.unionByName(s)
    for key in ("customer_id", "customer_unique_id"):
        s = duplicate_count(t["customers"], [key]).select(F.lit(f"customers.{key}").alias("check"),
                                                          "duplicates")
        out = out.unionByName(s)
    return out


def prf_10_item_outliers(t: Tables) -> DataFrame:
    out = P.iqr_outliers(clean_tables(t)["items"], ["price", "freight_value"])
    bounds = [c for c in out.columns if c.endswith(("_lower", "_upper"))]
    # bounds shown to 11 places (interpolation order differs between engines)
    return out.select(*[F.round(c, 11).alias(c) if c in bounds else F.col(c) for c in out.columns])


def prf_11_parse_failures(t: Tables) -> DataFrame:
    """NULL shipping dates after coercion (parse failures + missing)."""
    items = clean_tables(t)["items"]
    return items.agg(F.sum(F.col("shipping_limit_date").isNull().cast("bigint"))
                     .alias("unparsed_shipping_dates"))


def prf_12_payment_minima(t: Tables) -> DataFrame:
    p = t["payments"]
    return p.agg(F.min("payment_sequential").cast("double").alias("min_payment_sequential"),
                 F.min("payment_installments").cast("double").alias("min_payment_installments"),
                 F.min("payment_value").cast("double").alias("min_payment_value"))

