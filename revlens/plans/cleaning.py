"""Cleaning pipelines, one ``clean_<table>(df) -> DataFrame`` per table.

Step order follows the notebook exactly (several steps are not idempotent
and their order changes the result). All steps are native column
expressions except title case and NFKD of seller cities (pandas UDFs).
Orders, reviews and items are read from their ``csv_`` tables, where times are
still text, if the table dict has them.

Documented difference: pandas ``astype(str)`` turns a missing value into the
text 'nan'; here NULL stays NULL. Identifier columns that are numeric in the
input keep their type (stripping the text of a number changes nothing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions import strings as S
from revlens.functions.dates import elapsed_hours, floored_days, parse_coerce, parse_strict
from revlens.operators.quantiles import exact_quantiles
from revlens.operators.relational import first_row_per_key, with_scalars

# ---- fixed values ----------------------------------------------------------
# Brazilian state -> region.
REGION_BY_STATE = {
    "AC": "Norte", "AP": "Norte", "AM": "Norte", "PA": "Norte", "RO": "Norte", "RR": "Norte",
    "TO": "Norte",
    "AL": "Nordeste", "BA": "Nordeste", "CE": "Nordeste", "MA": "Nordeste", "PB": "Nordeste",
    "PE": "Nordeste", "PI": "Nordeste", "RN": "Nordeste", "SE": "Nordeste",
    "DF": "Centro-Oeste", "GO": "Centro-Oeste", "MT": "Centro-Oeste", "MS": "Centro-Oeste",
    "ES": "Sudeste", "MG": "Sudeste", "RJ": "Sudeste", "SP": "Sudeste",
    "PR": "Sul", "RS": "Sul", "SC": "Sul",
}
# Seller city: first fix-up after title case.
SELLER_CITY_MAP_1 = {"Sao Paulo": "São Paulo", "Rio De Janeiro": "Rio de Janeiro"}
# Seller city: typo corrections (applied twice, as in the notebook).
SELLER_CITY_TYPOS = {
    "Sao Pauo": "Sao Paulo",
    "Sao Paluo": "Sao Paulo",
    "Sao Paulop": "Sao Paulo",
    "Garulhos": "Guarulhos",
    "Belo Horizont": "Belo Horizonte",
    "Cascavael": "Cascavel",
    "Floranopolis": "Florianopolis",
    "Mogi Das Cruses": "Mogi Das Cruzes",
    "Sao Jose Do Rio Pret": "Sao Jose Do Rio Preto",
    "Sao Bernardo Do Capo": "Sao Bernardo Do Campo",
    "Sando Andre": "Santo Andre",
    "Ao Bernardo Do Campo": "Sao Bernardo Do Campo",
    "Scao Jose Do Rio Pardo": "Sao Jose Do Rio Pardo",
    "Ribeirao Pretp": "Ribeirao Preto",
    "Robeirao Preto": "Ribeirao Preto",
    "Riberao Preto": "Ribeirao Preto",
}
# Seller city: values dropped as not being cities.
SELLER_CITY_INVALID = ["Centro", "Bahia", "Parana", "Santa Catarina", "Minas Gerais",
                       "Vendas@Creditparts.Com.Br"]
# Seller city: final corrections. The first two keys are stored decomposed
# ('a' + U+0303), so after NFKD they map back to the composed 'São Paulo'.
SELLER_CITY_MAP_2 = {
    "Sa\u0303O Paulo": "S\u00e3o Paulo",
    "Sa\u0303o Paulo": "S\u00e3o Paulo",
    "Sao Paulo Sp": "São Paulo",
    "Sp": "São Paulo",
    "Brasilia Df": "Brasilia",
    "Aguas Claras Df": "Aguas Claras",
    "Angra Dos Reis Rj": "Angra Dos Reis",
    "Balenario Camboriu": "Balneario Camboriu",
    "Juzeiro Do Norte": "Juazeiro Do Norte",
    "S Jose Do Rio Preto": "Sao Jose Do Rio Preto",
    "Sao Jose Dos Pinhas": "Sao Jose Dos Pinhais",
    "Portoferreira": "Porto Ferreira",
    "Sbc": "Sao Bernardo Do Campo",
}
# Coordinate box kept by the geolocation cleaning (Brazil, approximate).
LAT_RANGE = (-33.75, 5.25)
LNG_RANGE = (-73.5, -34.5)
PRODUCT_DIMENSIONS = ["product_weight_g", "product_length_cm", "product_height_cm",
                      "product_width_cm"]
PRODUCT_MEDIAN_FILL = ["product_name_lenght", "product_description_lenght", "product_photos_qty"]
ORDER_TIMESTAMPS = ["order_purchase_timestamp", "order_approved_at",
                    "order_delivered_carrier_date", "order_delivered_customer_date",
                    "order_estimated_delivery_date"]


def _is_string(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _ts(df: DataFrame, c: str, strict: bool) -> F.Column:
    """Text -> timestamp (strict or coerce); timestamps pass through."""
    if _is_string(df, c):
        return (parse_strict if strict else parse_coerce)(c)
    if isinstance(df.schema[c].dataType, T.TimestampType):
        return F.col(c)
    return F.col(c).cast("timestamp_ntz")


def region_of(state) -> F.Column:
    m = F.create_map(*[F.lit(x) for kv in REGION_BY_STATE.items() for x in kv])
    return m[state if isinstance(state, F.Column) else F.col(state)]


def clean_customers(df: DataFrame) -> DataFrame:
    """Strip quotes/spaces, zero-padded ZIP, region by state, ZIP first digit."""
    for c in ["customer_id", "customer_unique_id", "customer_city", "customer_state"]:
        if c in df.columns and _is_string(df, c):
            df = df.withColumn(c, S.py_strip(S.strip_char(c, '"')))
    df = df.withColumn("customer_zip_code_prefix",
                       S.zfill(S.digits_only("customer_zip_code_prefix"), 5))
    return (df.withColumn("region", region_of("customer_state"))
            .withColumn("zip_first_digit",
                        F.substring("customer_zip_code_prefix", 1, 1).cast("int")))


def clean_translation(df: DataFrame) -> DataFrame:
    return (df.withColumn("product_category_name", S.py_strip("product_category_name"))
            .withColumn("product_category_name_english",
                        S.py_strip("product_category_name_english")))


def clean_sellers(df: DataFrame) -> DataFrame:
    city = "seller_city"
    if _is_string(df, "seller_id"):
        df = df.withColumn("seller_id", S.py_strip("seller_id"))
    df = (df.withColumn(city, S.py_strip(city))
          .withColumn("seller_zip_code_prefix", S.clean_zip("seller_zip_code_prefix"))
          .withColumn(city, S.replace_values(S.title_case(S.py_strip(city)), SELLER_CITY_MAP_1))
          .where(~F.coalesce(S.is_digits(city), F.lit(False))))
    for sep in ("/", "-", ","):
        df = df.withColumn(city, S.before_first(city, sep))
    df = (df.withColumn(city, S.collapse_ws(city))
          .withColumn(city, S.replace_values(city, SELLER_CITY_TYPOS))
          .withColumn(city, S.replace_values(city, SELLER_CITY_TYPOS))
          .where(F.col(city).isNull() | ~F.col(city).isin(*SELLER_CITY_INVALID))
          .withColumn(city, S.nfkd(city))
          .withColumn(city, S.py_strip(city)))
    for sep in ("/", "\\", "-", ","):
        df = df.withColumn(city, S.before_first(city, sep))
    return df.withColumn(city, S.replace_values(city, SELLER_CITY_MAP_2))


def _kept_products(df: DataFrame) -> DataFrame:
    for c in df.columns:
        if _is_string(df, c):
            df = df.withColumn(c, S.null_tokens(c))
    return (df.withColumn("product_category_name",
                          F.coalesce("product_category_name", F.lit("unknown")))
            .where(_all_positive(PRODUCT_DIMENSIONS)))


def product_categories(df: DataFrame) -> DataFrame:
    """Id and category of the cleaned products, without the median fill of
    columns that this leaves out."""
    return (_kept_products(df).where(F.col("product_category_name") != "unknown")
            .select("product_id", "product_category_name"))


def clean_products(df: DataFrame, drop_unknown: bool = True) -> DataFrame:
    """Null tokens, 'unknown' category, drop non-positive dimensions, median
    fill (medians taken after the drop), volume, drop 'unknown' (the quality
    table is taken just before that last step: ``drop_unknown=False``)."""
    kept = _kept_products(df)
    medians = exact_quantiles(kept, PRODUCT_MEDIAN_FILL, [0.5]).select(
        *[F.col(f"{c}_q0").alias(f"_med_{c}") for c in PRODUCT_MEDIAN_FILL])
    filled = with_scalars(kept, medians)
    for c in PRODUCT_MEDIAN_FILL:
        filled = filled.withColumn(c, F.coalesce(F.col(c), F.col(f"_med_{c}")))
    filled = filled.drop(*[f"_med_{c}" for c in PRODUCT_MEDIAN_FILL])
    filled = filled.withColumn("product_volume_cm3",
                               F.col("product_length_cm") * F.col("product_height_cm")
                               * F.col("product_width_cm"))
    if not drop_unknown:
        return filled
    return filled.where(F.col("product_category_name") != "unknown")


def _all_positive(cols) -> F.Column:
    out = None
    for c in cols:
        cond = F.coalesce(F.col(c) > 0, F.lit(False))
        out = cond if out is None else out & cond
    return out


def clean_orders(df: DataFrame) -> DataFrame:
    """Coerce timestamps, strip status, derived durations, drop delivered
    before approved (unknown kept), drop missing customer / purchase time."""
    for c in ORDER_TIMESTAMPS:
        if c in df.columns:
            df = df.withColumn(c, _ts(df, c, strict=False))
    df = (df.withColumn("order_status", S.py_strip("order_status"))
          .withColumn("approval_hours", elapsed_hours("order_approved_at", "order_purchase_timestamp"))
          .withColumn("delivery_days",
                      floored_days("order_delivered_customer_date", "order_purchase_timestamp"))
          .withColumn("carrier_days",
                      floored_days("order_delivered_carrier_date", "order_approved_at"))
          .withColumn("delay_days",
                      floored_days("order_delivered_customer_date", "order_estimated_delivery_date")))
    illogical = F.coalesce(F.col("order_delivered_customer_date") < F.col("order_approved_at"),
                           F.lit(False))
    return df.where(~illogical).dropna(subset=["customer_id", "order_purchase_timestamp"])


def clean_reviews(df: DataFrame) -> DataFrame:
    """Empty text for missing, strict timestamps, one row per review_id (first
    by answer time, then order_id), strip, int score, drop answers before
    creation, placeholders for empty text."""
    df = (df.fillna({"review_comment_title": "", "review_comment_message": ""})
          .withColumn("review_creation_date", _ts(df, "review_creation_date", strict=True))
          .withColumn("review_answer_timestamp", _ts(df, "review_answer_timestamp", strict=True)))
    cols = [c for c in df.columns if c != "review_id"]
    df = first_row_per_key(df, ["review_id"], ["review_answer_timestamp", "order_id"], cols)
    df = (df.withColumn("review_comment_title", S.py_strip("review_comment_title"))
          .withColumn("review_comment_message", S.py_strip("review_comment_message"))
          .withColumn("review_score", F.col("review_score").cast("int"))
          .where(F.col("review_answer_timestamp") >= F.col("review_creation_date")))
    return (df.withColumn("review_comment_title",
                          F.when(F.col("review_comment_title") == "", "no_title")
                          .otherwise(F.col("review_comment_title")))
            .withColumn("review_comment_message",
                        F.when(F.col("review_comment_message") == "", "no_comment")
                        .otherwise(F.col("review_comment_message"))))


def clean_geolocation(df: DataFrame) -> DataFrame:
    """'sao paulo' -> 'são paulo' (before the strip, so padded names are
    missed), strip city, distinct rows, coordinate box, strip state,
    zero-padded ZIP text."""
    city = "geolocation_city"
    df = (df.withColumn(city, F.regexp_replace(city, r"(?i)^sao paulo$", "são paulo"))
          .withColumn(city, S.py_strip(city))
          .distinct()
          .where(F.col("geolocation_lat").between(*LAT_RANGE)
                 & F.col("geolocation_lng").between(*LNG_RANGE))
          .withColumn("geolocation_state", S.py_strip("geolocation_state")))
    return df.withColumn("geolocation_zip_code_prefix",
                         S.zfill(F.col("geolocation_zip_code_prefix").cast("string"), 5))


def clean_items(df: DataFrame) -> DataFrame:
    """Coerce shipping_limit_date; all rows kept (outliers are only reported)."""
    return df.withColumn("shipping_limit_date", _ts(df, "shipping_limit_date", strict=False))


def clean_payments(df: DataFrame) -> DataFrame:
    return df.where(F.col("payment_installments") >= 0).where(F.col("payment_value") > 0)


class _LazyTables(dict):
    """Mapping that builds the plan of each table on first access."""

    def __init__(self, builders):
        super().__init__()
        self._builders = builders

    def __missing__(self, key):
        value = self._builders[key]()
        self[key] = value
        return value

    def __contains__(self, key):
        return key in self._builders or super().__contains__(key)


def clean_tables(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Cleaned versions of every table, plus the raw reviews and translation
    the notebook re-reads for its analyses (built lazily on first use)."""
    return _LazyTables({
        "customers": lambda: clean_customers(t["customers"]),
        "translation": lambda: clean_translation(t["translation"]),
        "sellers": lambda: clean_sellers(t["sellers"]),
        "products": lambda: clean_products(t["products"]),
        "product_categories": lambda: product_categories(t["products"]),
        "orders": lambda: clean_orders(t.get("csv_orders", t["orders"])),
        "reviews": lambda: clean_reviews(t.get("csv_reviews", t["reviews"])),
        "geolocation": lambda: clean_geolocation(t["geolocation"]),
        "items": lambda: clean_items(t.get("csv_items", t["items"])),
        "payments": lambda: clean_payments(t["payments"]),
        "raw_reviews": lambda: t["reviews"],
        "raw_translation": lambda: t["translation"],
    })
