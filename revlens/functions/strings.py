"""String helpers with Python/pandas semantics (Column -> Column).

All but ``title_case`` and ``nfkd`` are native Spark expressions. Python's
title case and Unicode normalisation have no Spark built-in, so these two are
pandas UDFs over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions._col import as_col

# Python ``str.isspace`` characters, in a class both Java regex and RE2 accept.
PY_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def py_strip(c) -> Column:
    """Python ``str.strip()`` (all Unicode whitespace, both ends)."""
    return F.regexp_replace(as_col(c), rf"^{PY_WS}+|{PY_WS}+$", "")


def strip_char(c, chars: str) -> Column:
    """Python ``str.strip(chars)``."""
    return F.btrim(as_col(c), F.lit(chars))


def digits_only(c) -> Column:
    """``re.sub(r'\\D', '', s)``."""
    return F.regexp_replace(as_col(c).cast("string"), r"\D", "")


def zfill(c, width: int = 5) -> Column:
    """Python ``str.zfill``: left-pad with zeros, never shorten."""
    c = as_col(c)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def clean_zip(c, width: int = 5) -> Column:
    """ZIP cleaner: NULL stays NULL, keep digits, zero-pad, empty -> NULL."""
    d = digits_only(c)
    return F.when(as_col(c).isNull() | (d == ""), F.lit(None).cast("string")).otherwise(zfill(d, width))


@F.pandas_udf(T.StringType())
def _title(s: pd.Series) -> pd.Series:
    return s.str.title()


@F.pandas_udf(T.StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD")


def title_case(c) -> Column:
    """Python ``str.title()`` (Arrow-batched pandas UDF)."""
    return _title(as_col(c))


def nfkd(c) -> Column:
    """``Series.str.normalize('NFKD')`` (Arrow-batched pandas UDF)."""
    return _nfkd(as_col(c))


def before_first(c, sep: str) -> Column:
    """``s.str.split(sep).str[0]``."""
    return F.substring_index(as_col(c), sep, 1)


def collapse_ws(c) -> Column:
    """``re.sub(r'\\s+', ' ', s)`` with Python's Unicode whitespace."""
    return F.regexp_replace(as_col(c), f"{PY_WS}+", " ")


def replace_values(c, mapping: Mapping[str, str]) -> Column:
    """``Series.replace(dict)``: whole-value, simultaneous substitution."""
    c = as_col(c)
    if not mapping:
        return c
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[c], c)


def is_digits(c) -> Column:
    """Python ``str.isdigit()`` for non-empty strings of decimal digits."""
    return as_col(c).rlike(r"^\p{Nd}+$")


#: What pandas' ``read_csv`` takes for missing by default.
PANDAS_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def null_tokens(c, tokens=("", "null")) -> Column:
    """``read_csv(na_values=tokens)``: exact token -> NULL."""
    c = as_col(c)
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)
