"""Registry of named queries: name -> (tables -> DataFrame).

Every entry reads the tables produced by ``revlens.sources.adapters`` (so its
work grows with the input) and has, where SQL can state it, a DuckDB oracle
of the same name in ``revlens.plans.oracles.SQL``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.plans import claims as clm
from revlens.plans import cleaning as cln
from revlens.plans import notebook_analyses as ana
from revlens.plans import primitives as prim
from revlens.plans import quality as prf
from revlens.plans import sql_analyses as q
from revlens.plans import storage as sto
from revlens.sources.adapters import load_tables

TableQuery = Callable[[dict[str, DataFrame]], DataFrame]

REGISTRY: dict[str, TableQuery] = {
    "qry_01_rfm_segments": q.qry_01_rfm_segments,
    "qry_02_state_ltv": q.qry_02_state_ltv,
    "qry_03_churn_buyer_type": q.qry_03_churn_buyer_type,
    "qry_04_first_order_reviews": q.qry_04_first_order_reviews,
    "qry_05_category_repeat": q.qry_05_category_repeat,
    "qry_06_seller_distance": q.qry_06_seller_distance,
    "qry_07_seller_rating": q.qry_07_seller_rating,
    "qry_08_payment_method": q.qry_08_payment_method,
    "qry_09_aov_retention": q.qry_09_aov_retention,
    "qry_10_monthly_revenue": q.qry_10_monthly_revenue,
    "qry_11_rfm_customer_segments": q.qry_11_rfm_customer_segments,
    # notebook analyses (cleaned inputs, pandas semantics)
    "ana_01_rfm_quantile": ana.ana_01_rfm_quantile,
    "ana_02_state_delivery": ana.ana_02_state_delivery,
    "ana_03_one_time_churn": ana.ana_03_one_time_churn,
    "ana_04_first_review_repeat": ana.ana_04_first_review_repeat,
    "ana_05_category_repeat": ana.ana_05_category_repeat,
    "ana_06_distance_bins": ana.ana_06_distance_bins,
    "ana_07_seller_rating_bins": ana.ana_07_seller_rating_bins,
    "ana_08_payment_bins": ana.ana_08_payment_bins,
    "ana_09_aov_bins": ana.ana_09_aov_bins,
    "ana_10_strategy_summary": ana.ana_10_strategy_summary,
    "ana_11_customer_overview": ana.ana_11_customer_overview,
    # README findings
    "clm_01_pareto_share": clm.clm_01_pareto_share,
    "clm_02_best_selling_categories": clm.clm_02_best_selling_categories,
    "clm_03_peak_month": clm.clm_03_peak_month,
    "clm_04_no_second_purchase": clm.clm_04_no_second_purchase,
    "clm_05_top_regions": clm.clm_05_top_regions,
    "clm_06_delivery_vs_review": clm.clm_06_delivery_vs_review,
    "clm_07_rfm_repeat_rate": clm.clm_07_rfm_repeat_rate,
    # cleaning pipelines
    "cln_01_customers": lambda t: cln.clean_customers(t["customers"]),
    "cln_02_translation": lambda t: cln.clean_translation(t["translation"]),
    "cln_03_sellers": lambda t: cln.clean_sellers(t["sellers"]),
    "cln_04_products": lambda t: cln.clean_products(t["products"]),
    "cln_05_orders": lambda t: cln.clean_tables(t)["orders"],
    "cln_06_reviews": lambda t: cln.clean_tables(t)["reviews"],
    "cln_07_geolocation": lambda t: cln.clean_geolocation(t["geolocation"]),
    "cln_08_items": lambda t: cln.clean_tables(t)["items"],
    "cln_09_payments": lambda t: cln.clean_payments(t["payments"]),
    # profiling / quality reports
    "prf_01_shapes": prf.prf_01_shapes,
    "prf_02_column_info": prf.prf_02_column_info,
    "prf_03_null_counts": prf.prf_03_null_counts,
    "prf_04_describe_payments": prf.prf_04_describe_payments,
    "prf_04_describe_text_orders": prf.prf_04_describe_text_orders,
    "prf_05_payment_type_counts": prf.prf_05_payment_type_counts,
    "prf_05_category_counts_with_nulls": prf.prf_05_category_counts_with_nulls,
    "prf_06_customer_cardinality": prf.prf_06_customer_cardinality,
    "prf_07_products_quality": prf.prf_07_products_quality,
    "prf_08_customer_rules": prf.prf_08_customer_rules,
    "prf_09_duplicates": prf.prf_09_duplicates,
    "prf_10_item_outliers": prf.prf_10_item_outliers,
    "prf_11_parse_failures": prf.prf_11_parse_failures,
    "prf_12_payment_minima": prf.prf_12_payment_minima,
    # single-operator queries
    "win_01_order_value_ntile": prim.win_01_order_value_ntile,
    "win_02_order_sequence": prim.win_02_order_sequence,
    "win_03_revenue_rank_first": prim.win_03_revenue_rank_first,
    "dup_02_first_delivered_order": prim.dup_02_first_delivered_order,
    "dup_06_seller_cities": prim.dup_06_seller_cities,
    "agg_14_zip_median_point": prim.agg_14_zip_median_point,
    "agg_18_first_delivery_date": prim.agg_18_first_delivery_date,
    # sources and sinks, through files
    "src_01_inferred_types": sto.src_01_inferred_types,
    "src_05_folder_ingest": sto.src_05_folder_ingest,
    "snk_01_replace_roundtrip": sto.snk_01_replace_roundtrip,
}


def bind(fn: TableQuery) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_tables(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: bind(fn) for name, fn in REGISTRY.items()}
