"""DuckDB oracles for the notebook analyses, claims, cleaning pipelines and
quality reports. The cleaning steps are restated in SQL as ``cl_*`` CTEs
over the adapter CTEs; the M:N merges are written as literal joins."""

from __future__ import annotations

from revlens.plans.cleaning import (REGION_BY_STATE, SELLER_CITY_INVALID, SELLER_CITY_MAP_1,
                                    SELLER_CITY_MAP_2, SELLER_CITY_TYPOS)
from revlens.sources.adapters import oracle

# Python whitespace class (same text as revlens.functions.strings.PY_WS).
_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _zfill(x: str) -> str:
    return f"CASE WHEN length({x}) < 5 THEN lpad({x}, 5, '0') ELSE {x} END"


_REGION_CASE = "CASE customer_state " + " ".join(
    f"WHEN '{state}' THEN '{region}'" for state, region in REGION_BY_STATE.items()) + " END"

_ZIP_DIGITS = "regexp_replace(CAST(customer_zip_code_prefix AS VARCHAR), '\\D', '', 'g')"

CL_CUSTOMERS = f"""
cl_customers AS (
  SELECT customer_id, customer_unique_id,
         {_zfill(_ZIP_DIGITS)} AS customer_zip_code_prefix,
         {_strip("trim(customer_city, '\"')")} AS customer_city,
         {_strip("trim(customer_state, '\"')")} AS customer_state
  FROM src_customers),
cl_customers2 AS (
  SELECT *, {_REGION_CASE} AS region,
         CAST(substr(customer_zip_code_prefix, 1, 1) AS INTEGER) AS zip_first_digit
  FROM cl_customers)
"""

_US_DAY = "86400000000.0::DOUBLE"


def _fdays(end: str, start: str) -> str:
    return f"CAST(floor(date_diff('microsecond', {start}, {end}) / {_US_DAY}) AS BIGINT)"


CL_ORDERS = f"""
cl_orders AS (
  SELECT order_id, customer_id, {_strip("order_status")} AS order_status,
         order_purchase_timestamp, order_approved_at, order_delivered_carrier_date,
         order_delivered_customer_date, order_estimated_delivery_date,
         date_diff('microsecond', order_purchase_timestamp, order_approved_at)
           / 3600000000.0::DOUBLE AS approval_hours,
         {_fdays("order_delivered_customer_date", "order_purchase_timestamp")} AS delivery_days,
         {_fdays("order_delivered_carrier_date", "order_approved_at")} AS carrier_days,
         {_fdays("order_delivered_customer_date", "order_estimated_delivery_date")} AS delay_days
  FROM src_orders
  WHERE NOT coalesce(order_delivered_customer_date < order_approved_at, false)
    AND customer_id IS NOT NULL AND order_purchase_timestamp IS NOT NULL),
nb_orders AS (SELECT * FROM cl_orders WHERE order_status = 'delivered')
"""

CL_PAYMENTS = """
cl_payments AS (
  SELECT * FROM src_payments WHERE payment_installments >= 0 AND payment_value > 0)
"""

CL_PRODUCTS = """
pr_tok AS (
  SELECT * REPLACE (coalesce(CASE WHEN product_category_name IN ('', 'null') THEN NULL
                                  ELSE product_category_name END, 'unknown') AS product_category_name)
  FROM src_products),
pr_kept AS (
  SELECT * FROM pr_tok
  WHERE coalesce(product_weight_g > 0, false) AND coalesce(product_length_cm > 0, false)
    AND coalesce(product_height_cm > 0, false) AND coalesce(product_width_cm > 0, false)),
pr_med AS (
  SELECT median(product_name_lenght) AS m1, median(product_description_lenght) AS m2,
         median(product_photos_qty) AS m3 FROM pr_kept),
cl_products_all AS (
  SELECT product_id, product_category_name,
         coalesce(product_name_lenght, m1) AS product_name_lenght,
         coalesce(product_description_lenght, m2) AS product_description_lenght,
         coalesce(product_photos_qty, m3) AS product_photos_qty,
         product_weight_g, product_length_cm, product_height_cm, product_width_cm,
         product_length_cm * product_height_cm * product_width_cm AS product_volume_cm3
  FROM pr_kept CROSS JOIN pr_med),
cl_products AS (SELECT * FROM cl_products_all WHERE product_category_name <> 'unknown')
"""

CL_GEO = f"""
geo_s AS (
  SELECT DISTINCT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng,
         {_strip("regexp_replace(geolocation_city, '^sao paulo$', 'são paulo', 'i')")}
           AS geolocation_city,
         geolocation_state
  FROM src_geolocation),
cl_geolocation AS (
  SELECT {_zfill("CAST(geolocation_zip_code_prefix AS VARCHAR)")} AS geolocation_zip_code_prefix,
         geolocation_lat, geolocation_lng, geolocation_city,
         {_strip("geolocation_state")} AS geolocation_state
  FROM geo_s
  WHERE geolocation_lat BETWEEN -33.75 AND 5.25 AND geolocation_lng BETWEEN -73.5 AND -34.5)
"""

def _mapped(x: str, values: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {x} END"


def _first_part(x: str, *seps: str) -> str:
    for sep in seps:
        x = f"split_part({x}, '{sep}', 1)"
    return x


# The city pipeline step by step. The fixture's letters are ASCII but for the
# 'ã' that the first fix-up writes, which NFKD decomposes.
CL_SELLERS = f"""
city_1 AS (
  SELECT seller_id, regexp_replace(CAST(seller_zip_code_prefix AS VARCHAR), '\\D', '', 'g') AS zip,
         array_to_string(list_transform(regexp_extract_all({_strip("seller_city")}, '[A-Za-z]+|[^A-Za-z]+'),
                                        lambda w: upper(w[1]) || lower(w[2:])), '') AS city
  FROM src_sellers),
city_2 AS (SELECT * REPLACE ({_mapped("city", SELLER_CITY_MAP_1)} AS city) FROM city_1),
city_3 AS (
  SELECT * REPLACE (regexp_replace({_first_part("city", "/", "-", ",")}, '{_WS}+', ' ', 'g') AS city) FROM city_2
  WHERE NOT coalesce(regexp_matches(city, '^[0-9]+$'), false)),
city_4 AS (SELECT * REPLACE ({_mapped("city", SELLER_CITY_TYPOS)} AS city) FROM city_3),
city_5 AS (SELECT * REPLACE ({_mapped("city", SELLER_CITY_TYPOS)} AS city) FROM city_4),
city_6 AS (
  SELECT * REPLACE ({_first_part(_strip("replace(city, 'ã', 'a' || chr(771))"), "/", chr(92), "-", ",")} AS city)
  FROM city_5
  WHERE city IS NULL OR city NOT IN ({", ".join(repr(x) for x in SELLER_CITY_INVALID)})),
cl_sellers AS (
  SELECT seller_id, CASE WHEN zip <> '' THEN {_zfill("zip")} END AS seller_zip_code_prefix,
         {_mapped("city", SELLER_CITY_MAP_2)} AS seller_city
  FROM city_6)
"""

CL_ITEMS = """
cl_items AS (
  SELECT * REPLACE (TRY_CAST(shipping_limit_date AS TIMESTAMP) AS shipping_limit_date) FROM src_csv_items)
"""

NB = ",\n".join(x.strip() for x in (CL_CUSTOMERS, CL_ORDERS, CL_PAYMENTS, CL_PRODUCTS, CL_GEO,
                                     CL_SELLERS))

_OC = """
oc AS (SELECT o.order_id, o.order_purchase_timestamp, c.customer_unique_id, o.customer_id
       FROM nb_orders o JOIN cl_customers2 c ON o.customer_id = c.customer_id)
"""

SQL: dict[str, str] = {}

_RFM_NB = """
snap AS (SELECT MAX(order_purchase_timestamp) + INTERVAL 1 DAY AS snapshot FROM nb_orders),
rfm AS (
  SELECT oc.customer_unique_id,
         CAST(floor(date_diff('microsecond', MAX(oc.order_purchase_timestamp), ANY_VALUE(s.snapshot))
                    / 86400000000.0::DOUBLE) AS BIGINT) AS Recency,
         COUNT(DISTINCT oc.order_id) AS Frequency, SUM(p.payment_value) AS Monetary
  FROM oc JOIN cl_payments p ON oc.order_id = p.order_id CROSS JOIN snap s
  GROUP BY oc.customer_unique_id),
rep AS (SELECT * FROM rfm WHERE Frequency > 1),
edges AS (SELECT quantile_cont(Recency, [0.25, 0.5, 0.75]) AS e FROM rep),
ranked AS (
  SELECT rep.customer_unique_id,
    CASE WHEN Recency <= e[1] THEN 4 WHEN Recency <= e[2] THEN 3
         WHEN Recency <= e[3] THEN 2 ELSE 1 END AS R,
    ROW_NUMBER() OVER (ORDER BY Frequency, customer_unique_id) AS rf,
    ROW_NUMBER() OVER (ORDER BY Monetary, customer_unique_id) AS rm,
    COUNT(*) OVER () AS n
  FROM rep CROSS JOIN edges),
scores AS (
  SELECT customer_unique_id, R,
    CASE WHEN n <= 1 THEN 1 ELSE greatest(1, (4 * (rf - 1) + n - 2) // (n - 1)) END AS F,
    CASE WHEN n <= 1 THEN 1 ELSE greatest(1, (4 * (rm - 1) + n - 2) // (n - 1)) END AS M
  FROM ranked),
seg AS (
  SELECT rfm.*, CASE WHEN Frequency = 1 THEN 'Single Purchase'
      WHEN R >= 3 AND F >= 3 THEN 'Champions'
      WHEN R <= 2 AND F >= 3 THEN 'At Risk Loyal'
      WHEN R >= 3 AND F <= 2 THEN 'Recent Low Frequency'
      ELSE 'Regular Repeat Buyers' END AS Segment
  FROM rfm LEFT JOIN scores ON rfm.customer_unique_id = scores.customer_unique_id),
rfm_summary AS (
  SELECT Segment, COUNT(customer_unique_id) AS customers,
         round_even(AVG(Monetary), 2) AS avg_ltv, round_even(AVG(Frequency), 2) AS avg_orders,
         round_even(AVG(Recency), 2) AS avg_recency
  FROM seg GROUP BY Segment)
"""

SQL["ana_01_rfm_quantile"] = oracle("SELECT * FROM rfm_summary", NB + "," + _OC + "," + _RFM_NB)

SQL["ana_02_state_delivery"] = oracle("""
SELECT c.customer_state, AVG(o.delivery_days) AS avg_delivery,
       COUNT(DISTINCT o.order_id) AS total_orders
FROM nb_orders o JOIN cl_customers2 c ON o.customer_id = c.customer_id
WHERE c.customer_state IS NOT NULL
GROUP BY c.customer_state ORDER BY total_orders DESC, c.customer_state LIMIT 10
""", NB)

_FL = """
latest AS (SELECT MAX(order_purchase_timestamp) AS l FROM nb_orders),
fl AS (
  SELECT customer_unique_id, MIN(order_purchase_timestamp) AS "min",
         MAX(order_purchase_timestamp) AS "max"
  FROM oc GROUP BY customer_unique_id),
fl2 AS (
  SELECT fl.*, "max" < (SELECT l FROM latest) - INTERVAL 180 DAY AS churned,
         "min" = "max" AS one_time FROM fl)
"""

SQL["ana_03_one_time_churn"] = oracle("SELECT * FROM fl2", NB + "," + _OC + "," + _FL)

_FIRST = """
first_o AS (
  SELECT customer_unique_id, order_id FROM (
    SELECT customer_unique_id, order_id,
      ROW_NUMBER() OVER (PARTITION BY customer_unique_id
                         ORDER BY order_purchase_timestamp, order_id) AS rn FROM oc) WHERE rn = 1),
repeat_people AS (SELECT customer_unique_id, COUNT(*) > 1 AS rep FROM oc GROUP BY customer_unique_id),
first_order_reviews AS (
  SELECT f.customer_unique_id, f.order_id, r.review_score, p.rep
  FROM first_o f LEFT JOIN src_reviews r ON f.order_id = r.order_id
  JOIN repeat_people p ON f.customer_unique_id = p.customer_unique_id)
"""

SQL["ana_04_first_review_repeat"] = oracle("""
SELECT review_score, AVG(CAST(rep AS INTEGER)) AS repeat
FROM first_order_reviews WHERE review_score IS NOT NULL GROUP BY review_score ORDER BY review_score
""", NB + "," + _OC + "," + _FIRST)

_CAT = """
item_categories AS (
  SELECT oc.customer_unique_id,
         coalesce(t.product_category_name_english, p.product_category_name) AS category
  FROM src_items i JOIN cl_products p ON i.product_id = p.product_id
  JOIN oc ON i.order_id = oc.order_id
  LEFT JOIN src_translation t ON p.product_category_name = t.product_category_name),
person_rows AS (SELECT customer_unique_id, COUNT(*) AS total_orders FROM item_categories GROUP BY 1),
person_cat_pairs AS (SELECT DISTINCT customer_unique_id, category FROM item_categories WHERE category IS NOT NULL),
category_rates AS (
  SELECT cc.category, COUNT(cc.customer_unique_id) AS customers,
         AVG(CASE WHEN ct.total_orders > 1 THEN 1 ELSE 0 END) AS repeat_rate
  FROM person_cat_pairs cc JOIN person_rows ct ON cc.customer_unique_id = ct.customer_unique_id
  GROUP BY cc.category HAVING COUNT(cc.customer_unique_id) >= 50)
"""

SQL["ana_05_category_repeat"] = oracle("""
SELECT category, customers, repeat_rate FROM category_rates
ORDER BY repeat_rate DESC, category LIMIT 10
""", NB + "," + _OC + "," + _CAT)

SQL["ana_06_distance_bins"] = oracle("""
SELECT b.distance_bin, round_even(a.avg_delivery_days, 1) AS avg_delivery_days,
       CAST(coalesce(a.total_orders, 0) AS BIGINT) AS total_orders
FROM (VALUES ('Local (<100 km)', 1), ('Regional (100-500 km)', 2),
             ('Long Distance (>500 km)', 3)) b(distance_bin, bin_order)
LEFT JOIN agg a ON a.distance_bin = b.distance_bin
ORDER BY b.bin_order
""", NB + """,
geo AS (SELECT geolocation_zip_code_prefix AS z, median(geolocation_lat) AS lat,
               median(geolocation_lng) AS lng FROM cl_geolocation GROUP BY 1),
pairs AS (SELECT DISTINCT order_id, seller_id FROM src_items),
d AS (
  SELECT o.order_id, o.delivery_days,
    2 * 6371.0 * asin(sqrt(
        pow(sin((radians(gs.lat) - radians(gc.lat)) / 2), 2)
        + cos(radians(gc.lat)) * cos(radians(gs.lat))
          * pow(sin((radians(gs.lng) - radians(gc.lng)) / 2), 2))) AS km
  FROM nb_orders o JOIN pairs p ON o.order_id = p.order_id
  JOIN cl_customers2 c ON o.customer_id = c.customer_id
  JOIN cl_sellers s ON p.seller_id = s.seller_id
  JOIN geo gc ON c.customer_zip_code_prefix = gc.z
  JOIN geo gs ON s.seller_zip_code_prefix = gs.z),
binned AS (
  SELECT *, CASE WHEN km > 0 AND km <= 100 THEN 'Local (<100 km)'
                 WHEN km > 100 AND km <= 500 THEN 'Regional (100-500 km)'
                 WHEN km > 500 AND km <= 'inf'::DOUBLE THEN 'Long Distance (>500 km)' END
              AS distance_bin FROM d),
agg AS (SELECT distance_bin, AVG(delivery_days) AS avg_delivery_days,
               COUNT(DISTINCT order_id) AS total_orders
        FROM binned WHERE distance_bin IS NOT NULL GROUP BY distance_bin)
""")

_SELLER_ROWS = """
seller_mean_score AS (
  SELECT i.seller_id, AVG(r.review_score) AS avg_seller_rating
  FROM src_reviews r JOIN src_items i ON r.order_id = i.order_id GROUP BY i.seller_id),
person_order_rows AS (SELECT customer_unique_id, COUNT(*) AS total FROM oc GROUP BY 1),
seller_item_rows AS (
  SELECT oc.order_id, i.seller_id, sa.avg_seller_rating, cn.total > 1 AS rep
  FROM oc JOIN src_items i ON oc.order_id = i.order_id
  JOIN seller_mean_score sa ON i.seller_id = sa.seller_id
  JOIN person_order_rows cn ON oc.customer_unique_id = cn.customer_unique_id)
"""

SQL["ana_07_seller_rating_bins"] = oracle("""
SELECT b.rating_bin, round_even(a.rr * 100, 2) AS repeat_rate,
       CAST(coalesce(a.n, 0) AS BIGINT) AS customers
FROM (VALUES ('1-2 (poor)', 1), ('2-3 (below avg)', 2), ('3-4 (good)', 3),
             ('4-5 (excellent)', 4)) b(rating_bin, bin_order)
LEFT JOIN (
  SELECT CASE WHEN avg_seller_rating > 0 AND avg_seller_rating <= 2 THEN '1-2 (poor)'
              WHEN avg_seller_rating > 2 AND avg_seller_rating <= 3 THEN '2-3 (below avg)'
              WHEN avg_seller_rating > 3 AND avg_seller_rating <= 4 THEN '3-4 (good)'
              WHEN avg_seller_rating > 4 AND avg_seller_rating <= 5 THEN '4-5 (excellent)' END
           AS rating_bin,
         AVG(CAST(rep AS INTEGER)) AS rr, COUNT(rep) AS n
  FROM seller_item_rows GROUP BY 1) a ON a.rating_bin = b.rating_bin
ORDER BY b.bin_order
""", NB + "," + _OC + "," + _SELLER_ROWS)

SQL["ana_08_payment_bins"] = oracle("""
SELECT payment_type, inst_group, round_even(AVG(payment_value), 6) AS avg_ltv,
       COUNT(DISTINCT customer_unique_id) AS customers
FROM pay WHERE inst_group IS NOT NULL AND payment_type IS NOT NULL
GROUP BY payment_type, inst_group ORDER BY avg_ltv DESC, payment_type, inst_group
""", NB + "," + _OC + """,
pay AS (
  SELECT oc.customer_unique_id, p.payment_type, p.payment_value,
    CASE WHEN p.payment_installments > 0 AND p.payment_installments <= 1 THEN 'Single'
         WHEN p.payment_installments > 1 AND p.payment_installments <= 6 THEN '2-6'
         WHEN p.payment_installments > 6 AND p.payment_installments <= 100 THEN '7+' END AS inst_group
  FROM src_items i JOIN oc ON i.order_id = oc.order_id
  JOIN cl_payments p ON i.order_id = p.order_id
  WHERE p.payment_installments > 0)
""")

_AOV = """
aov AS (
  SELECT oc.customer_unique_id, AVG(i.price) AS avg_order_value,
         COUNT(DISTINCT oc.order_id) AS total_orders
  FROM src_items i JOIN oc ON i.order_id = oc.order_id GROUP BY oc.customer_unique_id),
aov_seg AS (
  SELECT b.segment, b.bin_order, a.repeat_rate, CAST(coalesce(a.customers, 0) AS BIGINT) AS customers
  FROM (VALUES ('Low', 1), ('Medium', 2), ('High', 3)) b(segment, bin_order)
  LEFT JOIN (
    SELECT CASE WHEN avg_order_value > 0 AND avg_order_value <= 100 THEN 'Low'
                WHEN avg_order_value > 100 AND avg_order_value <= 300 THEN 'Medium'
                WHEN avg_order_value > 300 AND avg_order_value <= 1000000 THEN 'High' END AS segment,
           AVG(CASE WHEN total_orders > 1 THEN 1 ELSE 0 END) AS repeat_rate,
           COUNT(customer_unique_id) AS customers
    FROM aov GROUP BY 1) a ON a.segment = b.segment)
"""

SQL["ana_09_aov_bins"] = oracle("""
SELECT segment, repeat_rate, customers FROM aov_seg ORDER BY bin_order
""", NB + "," + _OC + "," + _AOV)

SQL["ana_10_strategy_summary"] = oracle("""
SELECT 'one_time_buyers_pct' AS metric, CAST(NULL AS VARCHAR) AS label,
       AVG(CAST(one_time AS INTEGER)) * 100 AS value FROM fl2
UNION ALL
SELECT 'repeat_rate_by_first_review_score_pct', CAST(review_score AS VARCHAR),
       round_even(AVG(CAST(rep AS INTEGER)) * 100, 1)
FROM first_order_reviews WHERE review_score IS NOT NULL GROUP BY review_score
UNION ALL
SELECT 'top_row_of_last_result_pct', segment, repeat_rate * 100 FROM aov_seg WHERE bin_order = 1
UNION ALL
SELECT * FROM (SELECT 'top_category_repeat_rate_pct', category, repeat_rate * 100 FROM category_rates
               ORDER BY repeat_rate DESC, category LIMIT 1)
UNION ALL
SELECT 'high_rated_seller_repeat_pct', CAST(NULL AS VARCHAR), AVG(CAST(rep AS INTEGER)) * 100
FROM seller_item_rows WHERE avg_seller_rating >= 4
UNION ALL
SELECT 'rfm_' || measure, Segment, value
FROM (SELECT Segment, customers::DOUBLE AS customers, avg_ltv::DOUBLE AS avg_ltv,
             avg_orders::DOUBLE AS avg_orders, avg_recency::DOUBLE AS avg_recency FROM rfm_summary)
     UNPIVOT INCLUDE NULLS (value FOR measure IN (customers, avg_ltv, avg_orders, avg_recency))
""", NB + "," + _OC + "," + _FL + "," + _FIRST + "," + _AOV + "," + _CAT + "," + _SELLER_ROWS + "," + _RFM_NB)

SQL["ana_11_customer_overview"] = oracle("""
SELECT 'unique_customers' AS metric, CAST(NULL AS VARCHAR) AS label,
       CAST(COUNT(DISTINCT customer_unique_id) AS DOUBLE) AS value FROM cl_customers2
UNION ALL SELECT 'unique_cities', NULL, COUNT(DISTINCT customer_city) FROM cl_customers2
UNION ALL SELECT 'states', NULL, COUNT(DISTINCT customer_state) FROM cl_customers2
UNION ALL SELECT 'customers_by_region', region, COUNT(*) FROM cl_customers2
          WHERE region IS NOT NULL GROUP BY region
UNION ALL SELECT * FROM (SELECT 'top_cities', customer_city, COUNT(*) AS n FROM cl_customers2
          WHERE customer_city IS NOT NULL GROUP BY customer_city ORDER BY n DESC, customer_city
          LIMIT 10)
""", NB)

# --------------------------------------------------------------------------
# README claims
# --------------------------------------------------------------------------

_DELIV_PAY = """
rev AS (
  SELECT c.customer_unique_id, SUM(p.payment_value) AS revenue
  FROM src_customers c JOIN src_orders o ON c.customer_id = o.customer_id
  JOIN src_payments p ON o.order_id = p.order_id
  WHERE o.order_status = 'delivered' GROUP BY c.customer_unique_id)
"""

SQL["clm_01_pareto_share"] = oracle("""
SELECT MAX(customers) AS customers, CAST(MAX(ceil(customers * 0.2)) AS BIGINT) AS top_customers,
       round(MAX(CASE WHEN rk = ceil(customers * 0.2) THEN cum_revenue END) * 100.0
             / MAX(total_revenue), 4) AS top_revenue_pct,
       MIN(CASE WHEN cum_revenue >= total_revenue * 0.8 THEN rk END) AS customers_for_revenue_share,
       round(MIN(CASE WHEN cum_revenue >= total_revenue * 0.8 THEN rk END) * 100.0
             / MAX(customers), 4) AS pct_customers_for_revenue_share
FROM cum
""", _DELIV_PAY + """,
cum AS (
  SELECT *, SUM(revenue) OVER (ORDER BY revenue DESC, customer_unique_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_revenue,
         ROW_NUMBER() OVER (ORDER BY revenue DESC, customer_unique_id) AS rk,
         COUNT(*) OVER () AS customers, SUM(revenue) OVER () AS total_revenue
  FROM rev)
""")

SQL["clm_02_best_selling_categories"] = oracle("""
SELECT coalesce(t.product_category_name_english, p.cat) AS category,
       COUNT(*) AS items_sold, round(SUM(i.price), 2) AS revenue
FROM src_items i JOIN src_orders o ON i.order_id = o.order_id
JOIN (SELECT product_id, TRIM(product_category_name) AS cat FROM src_products
      WHERE product_category_name IS NOT NULL AND TRIM(product_category_name) <> '') p
  ON i.product_id = p.product_id
LEFT JOIN src_translation t ON p.cat = t.product_category_name
WHERE o.order_status = 'delivered'
GROUP BY 1 ORDER BY items_sold DESC, category LIMIT 10
""")

SQL["clm_03_peak_month"] = oracle("""
SELECT DATE_TRUNC('month', o.order_purchase_timestamp) AS order_month,
       ROUND(SUM(p.payment_value), 2) AS monthly_revenue
FROM src_orders o JOIN src_payments p ON o.order_id = p.order_id
WHERE o.order_status = 'delivered'
GROUP BY order_month ORDER BY monthly_revenue DESC, order_month LIMIT 1
""")

SQL["clm_04_no_second_purchase"] = oracle("""
SELECT COUNT(*) AS customers, CAST(SUM(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT)
         AS single_order_customers,
       round(AVG(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_no_second_purchase
FROM (SELECT c.customer_unique_id, COUNT(DISTINCT o.order_id) AS n
      FROM src_customers c JOIN src_orders o ON c.customer_id = o.customer_id
      WHERE o.order_status = 'delivered' GROUP BY 1)
""")

SQL["clm_05_top_regions"] = oracle("""
SELECT c.customer_state, round(SUM(p.payment_value), 2) AS revenue
FROM src_orders o JOIN src_payments p ON o.order_id = p.order_id
JOIN src_customers c ON o.customer_id = c.customer_id
WHERE o.order_status = 'delivered'
GROUP BY c.customer_state ORDER BY revenue DESC, c.customer_state LIMIT 5
""")

SQL["clm_06_delivery_vs_review"] = oracle("""
SELECT COUNT(*) AS pairs,
       round(corr(date_diff('microsecond', o.order_purchase_timestamp,
                            o.order_delivered_customer_date) / 86400000000.0::DOUBLE,
                  CAST(r.review_score AS DOUBLE)), 6) AS correlation
FROM src_orders o JOIN src_reviews r ON o.order_id = r.order_id
WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL
""")


def _with_rfm(body: str) -> str:
    from revlens.plans.oracles import _FACTS, _RFM
    return oracle(body, _FACTS + "," + _RFM)


SQL["clm_07_rfm_repeat_rate"] = _with_rfm("""
SELECT COUNT(*) AS customers,
       CAST(SUM(CASE WHEN customer_segment <> 'Single Purchase' THEN 1 ELSE 0 END) AS BIGINT)
         AS repeat_customers,
       round(AVG(CASE WHEN customer_segment <> 'Single Purchase' THEN 1.0 ELSE 0.0 END) * 100, 4)
         AS repeat_rate_pct
FROM labelled
""")

# --------------------------------------------------------------------------
# Cleaning pipelines
# --------------------------------------------------------------------------

CL_REVIEWS = f"""
rv_filled AS (
  SELECT review_id, order_id, review_score,
         coalesce(review_comment_title, '') AS review_comment_title,
         coalesce(review_comment_message, '') AS review_comment_message,
         review_creation_date, review_answer_timestamp,
         ROW_NUMBER() OVER (PARTITION BY review_id
                            ORDER BY review_answer_timestamp, order_id) AS rn
  FROM src_reviews),
rv_clean AS (
  SELECT review_id, order_id, CAST(review_score AS INTEGER) AS review_score,
         {_strip("review_comment_title")} AS review_comment_title,
         {_strip("review_comment_message")} AS review_comment_message,
         review_creation_date, review_answer_timestamp
  FROM rv_filled WHERE rn = 1),
cl_reviews AS (
  SELECT review_id, order_id, review_score,
         CASE WHEN review_comment_title = '' THEN 'no_title' ELSE review_comment_title END
           AS review_comment_title,
         CASE WHEN review_comment_message = '' THEN 'no_comment' ELSE review_comment_message END
           AS review_comment_message,
         review_creation_date, review_answer_timestamp
  FROM rv_clean WHERE review_answer_timestamp >= review_creation_date)
"""

SQL["cln_01_customers"] = oracle("SELECT * FROM cl_customers2", CL_CUSTOMERS)
SQL["cln_02_translation"] = oracle(f"""
SELECT {_strip("product_category_name")} AS product_category_name,
       {_strip("product_category_name_english")} AS product_category_name_english
FROM src_translation""")
SQL["cln_04_products"] = oracle("SELECT * FROM cl_products", CL_PRODUCTS)
SQL["cln_03_sellers"] = oracle("SELECT * FROM cl_sellers", CL_SELLERS)
SQL["dup_06_seller_cities"] = oracle("SELECT DISTINCT seller_city FROM cl_sellers", CL_SELLERS)
SQL["cln_05_orders"] = oracle("SELECT * FROM cl_orders", CL_ORDERS)
SQL["cln_06_reviews"] = oracle("SELECT * FROM cl_reviews", CL_REVIEWS)
SQL["cln_07_geolocation"] = oracle("SELECT * FROM cl_geolocation", CL_GEO)
SQL["cln_08_items"] = oracle("SELECT * FROM cl_items", CL_ITEMS)
SQL["cln_09_payments"] = oracle("SELECT * FROM cl_payments", CL_PAYMENTS)

# --------------------------------------------------------------------------
# Profiling / quality reports
# --------------------------------------------------------------------------

# Column lists of the adapter tables (in adapter order).
ADAPTER_COLUMNS = {
    "customers": ["customer_id", "customer_unique_id", "customer_zip_code_prefix",
                  "customer_city", "customer_state"],
    "geolocation": ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng",
                    "geolocation_city", "geolocation_state"],
    "items": ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value",
              "shipping_limit_date"],
    "orders": ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
               "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"],
    "payments": ["order_id", "payment_sequential", "payment_type", "payment_installments",
                 "payment_value"],
    "products": ["product_id", "product_category_name", "product_name_lenght",
                 "product_description_lenght", "product_photos_qty", "product_weight_g",
                 "product_length_cm", "product_height_cm", "product_width_cm"],
    "reviews": ["review_id", "order_id", "review_score", "review_comment_title",
                "review_comment_message", "review_creation_date", "review_answer_timestamp"],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_city"],
    "translation": ["product_category_name", "product_category_name_english"],
}

SQL["prf_01_shapes"] = oracle("\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", COUNT(*) AS \"rows\", CAST({len(cols)} AS BIGINT) AS \"columns\" "
    f"FROM src_{t}" for t, cols in sorted(ADAPTER_COLUMNS.items())))

# DuckDB type names -> Spark's simple type names
_TYPE_NAME = ("CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
              "WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' "
              "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(typeof({c})) END")
SQL["prf_02_column_info"] = oracle("\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", {i} AS position, '{c}' AS \"column\", "
    f"(SELECT {_TYPE_NAME.format(c=c)} FROM src_{t} LIMIT 1) AS dtype, "
    f"COUNT({c}) AS non_null FROM src_{t}"
    for t, cols in sorted(ADAPTER_COLUMNS.items()) for i, c in enumerate(cols)))

SQL["prf_03_null_counts"] = oracle("\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", "
    f"CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM src_{t}"
    for t, cols in sorted(ADAPTER_COLUMNS.items()) for c in cols))


def _describe(col: str) -> str:
    stats = [("count", f"CAST(COUNT({col}) AS DOUBLE)"), ("mean", f"round(AVG({col}), 6)"),
             ("std", f"round(stddev_samp({col}), 6)"), ("min", f"CAST(MIN({col}) AS DOUBLE)"),
             ("25%", f"round(quantile_cont({col}, 0.25), 11)"),
             ("50%", f"round(quantile_cont({col}, 0.5), 11)"),
             ("75%", f"round(quantile_cont({col}, 0.75), 11)"), ("max", f"CAST(MAX({col}) AS DOUBLE)")]
    return "\nUNION ALL\n".join(
        f"SELECT '{col}' AS \"column\", '{name}' AS statistic, CAST({expr} AS DOUBLE) AS value "
        f"FROM cl_payments" for name, expr in stats)


SQL["prf_04_describe_payments"] = oracle(
    _describe("payment_value") + "\nUNION ALL\n" + _describe("payment_installments"), CL_PAYMENTS)


def _describe_text(col: str) -> str:
    return (f"SELECT '{col}' AS \"column\", (SELECT COUNT({col}) FROM ot) AS count, "
            f"(SELECT COUNT(DISTINCT {col}) FROM ot) AS \"unique\", "
            f"(SELECT arg_min(v, (-n, v)) FROM (SELECT {col} AS v, COUNT(*) AS n FROM ot "
            f"WHERE {col} IS NOT NULL GROUP BY 1)) AS top, "
            f"(SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM ot WHERE {col} IS NOT NULL "
            f"GROUP BY {col})) AS freq")


SQL["prf_04_describe_text_orders"] = oracle(
    "\nUNION ALL\n".join(_describe_text(c) for c in ADAPTER_COLUMNS["orders"]),
    "ot AS (SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in ADAPTER_COLUMNS["orders"])
    + " FROM src_orders)")

SQL["prf_05_payment_type_counts"] = oracle("""
SELECT payment_type, COUNT(*) AS count FROM src_payments WHERE payment_type IS NOT NULL
GROUP BY payment_type ORDER BY count DESC, payment_type
""")

SQL["prf_06_customer_cardinality"] = oracle("""
SELECT 'customer_unique_id' AS "column", COUNT(DISTINCT customer_unique_id) AS "distinct" FROM cl_customers2
UNION ALL SELECT 'customer_city', COUNT(DISTINCT customer_city) FROM cl_customers2
UNION ALL SELECT 'customer_state', COUNT(DISTINCT customer_state) FROM cl_customers2
""", CL_CUSTOMERS)

_PRODUCT_OUT = ADAPTER_COLUMNS["products"] + ["product_volume_cm3"]
SQL["prf_07_products_quality"] = oracle("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", "
    f"CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_count, "
    f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0 / COUNT(*) AS missing_pct, "
    + (f"CAST(SUM(CASE WHEN {c} = 'unknown' THEN 1 ELSE 0 END) AS BIGINT) AS unknown_count, "
       f"SUM(CASE WHEN {c} = 'unknown' THEN 1 ELSE 0 END) * 100.0 / COUNT(*) AS unknown_pct "
       if c == "product_category_name" else
       "CAST(0 AS BIGINT) AS unknown_count, 0.0::DOUBLE AS unknown_pct ")
    + "FROM cl_products_all" for c in _PRODUCT_OUT), CL_PRODUCTS)

SQL["prf_08_customer_rules"] = oracle("""
SELECT 'invalid_state' AS rule, CAST(SUM(CASE WHEN NOT coalesce(regexp_matches(customer_state,
         '^[A-Z]{2}$'), false) THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM cl_customers2
UNION ALL SELECT 'short_city', CAST(SUM(CASE WHEN coalesce(length(customer_city) < 3, false)
         THEN 1 ELSE 0 END) AS BIGINT) FROM cl_customers2
UNION ALL SELECT 'invalid_zip', CAST(SUM(CASE WHEN NOT coalesce(regexp_matches(
         customer_zip_code_prefix, '^\\d{5}$'), false) THEN 1 ELSE 0 END) AS BIGINT) FROM cl_customers2
""", CL_CUSTOMERS)

SQL["prf_09_duplicates"] = oracle("\nUNION ALL\n".join(
    [f"SELECT '{t}' AS \"check\", CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * "
     f"FROM src_{t})) AS BIGINT) AS duplicates FROM src_{t}" for t in sorted(ADAPTER_COLUMNS)]
    + [f"SELECT 'customers.{k}', CAST(COUNT(*) - COUNT(DISTINCT {k}) - "
       f"(CASE WHEN COUNT(*) > COUNT({k}) THEN 1 ELSE 0 END) AS BIGINT) FROM src_customers"
       for k in ("customer_id", "customer_unique_id")]))

SQL["prf_10_item_outliers"] = oracle("""
SELECT CAST(COUNT(*) AS BIGINT) AS "rows",
       CAST(SUM(CASE WHEN coalesce(price < pl OR price > pu, false)
                      OR coalesce(freight_value < fl OR freight_value > fu, false)
                THEN 1 ELSE 0 END) AS BIGINT) AS outliers,
       round(ANY_VALUE(pl), 11) AS price_lower, round(ANY_VALUE(pu), 11) AS price_upper,
       round(ANY_VALUE(fl), 11) AS freight_value_lower, round(ANY_VALUE(fu), 11) AS freight_value_upper,
       SUM(CASE WHEN coalesce(price < pl OR price > pu, false)
                  OR coalesce(freight_value < fl OR freight_value > fu, false)
                THEN 1 ELSE 0 END) * 100.0 / COUNT(*) AS outlier_pct
FROM src_items CROSS JOIN (
  SELECT q1 - 1.5 * (q3 - q1) AS pl, q3 + 1.5 * (q3 - q1) AS pu,
         f1 - 1.5 * (f3 - f1) AS fl, f3 + 1.5 * (f3 - f1) AS fu
  FROM (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3,
               quantile_cont(freight_value, 0.25) AS f1, quantile_cont(freight_value, 0.75) AS f3
        FROM src_items))
""")

SQL["prf_11_parse_failures"] = oracle("""
SELECT CAST(SUM(CASE WHEN shipping_limit_date IS NULL THEN 1 ELSE 0 END) AS BIGINT)
         AS unparsed_shipping_dates FROM cl_items
""", CL_ITEMS)

SQL["prf_12_payment_minima"] = oracle("""
SELECT CAST(MIN(payment_sequential) AS DOUBLE) AS min_payment_sequential,
       CAST(MIN(payment_installments) AS DOUBLE) AS min_payment_installments,
       CAST(MIN(payment_value) AS DOUBLE) AS min_payment_value FROM src_payments
""")

# --------------------------------------------------------------------------
# Single-operator queries
# --------------------------------------------------------------------------

_CO = """
sco AS (SELECT c.customer_unique_id, o.order_id, o.order_purchase_timestamp,
               o.order_delivered_customer_date
        FROM src_customers c JOIN src_orders o ON c.customer_id = o.customer_id
        WHERE o.order_status = 'delivered')
"""

SQL["win_01_order_value_ntile"] = oracle("""
SELECT order_id,
       CAST(NTILE(4) OVER (ORDER BY order_paid DESC NULLS FIRST, order_id) AS INTEGER) AS value_tile
FROM (SELECT order_id, SUM(payment_value) AS order_paid FROM src_payments GROUP BY order_id)
""")

SQL["win_02_order_sequence"] = oracle("""
SELECT customer_unique_id, order_id,
       ROW_NUMBER() OVER (PARTITION BY customer_unique_id
                          ORDER BY order_purchase_timestamp, order_id) AS order_number
FROM sco
""", _CO)

SQL["win_03_revenue_rank_first"] = oracle("""
SELECT customer_unique_id, ROW_NUMBER() OVER (ORDER BY revenue, customer_unique_id) AS revenue_rank
FROM (SELECT sco.customer_unique_id, SUM(p.payment_value) AS revenue
      FROM sco JOIN src_payments p ON sco.order_id = p.order_id GROUP BY 1)
""", _CO)

SQL["dup_02_first_delivered_order"] = oracle("""
SELECT customer_unique_id, order_id, order_purchase_timestamp FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_unique_id
                               ORDER BY order_purchase_timestamp, order_id) AS rn FROM sco)
WHERE rn = 1
""", _CO)

SQL["agg_14_zip_median_point"] = oracle("""
SELECT geolocation_zip_code_prefix, median(geolocation_lat) AS geolocation_lat,
       median(geolocation_lng) AS geolocation_lng
FROM cl_geolocation GROUP BY 1
""", CL_GEO)

SQL["agg_18_first_delivery_date"] = oracle("""
SELECT customer_unique_id,
       arg_min(order_delivered_customer_date, (order_purchase_timestamp, order_id))
         FILTER (WHERE order_delivered_customer_date IS NOT NULL) AS order_delivered_customer_date
FROM sco GROUP BY 1
""", _CO)

SQL["prf_05_category_counts_with_nulls"] = oracle("""
SELECT product_category_name, COUNT(*) AS count FROM src_products
GROUP BY product_category_name ORDER BY count DESC, product_category_name NULLS FIRST
""")
