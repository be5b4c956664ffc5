"""Numeric helpers and banding (Column -> Column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions._col import as_col

# Fixed value: mean Earth radius in km used by the distance analyses.
EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance in km; native expression (whole-stage codegen)."""
    lat1, lng1, lat2, lng2 = map(as_col, (lat1, lng1, lat2, lng2))
    a = (F.pow(F.sin(F.radians((lat2 - lat1) / 2)), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.pow(F.sin(F.radians((lng2 - lng1) / 2)), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def haversine_km_radians_first(lat1, lng1, lat2, lng2) -> Column:
    """Same distance with the notebook's operation order (radians first)."""
    lat1, lng1, lat2, lng2 = (F.radians(as_col(c)) for c in (lat1, lng1, lat2, lng2))
    a = (F.pow(F.sin((lat2 - lat1) / 2), 2)
         + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lng2 - lng1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def cut(x, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """pandas ``cut``: right-closed bins (lo, hi]; outside or NULL -> NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(edges) - 1 labels")
    x = as_col(x)
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def safe_ratio(num, den) -> Column:
    """num / NULLIF(den, 0) as double (ANSI division never raises)."""
    den = as_col(den)
    return as_col(num).cast("double") / F.when(den != 0, den.cast("double"))


def pct(num, den) -> Column:
    """100.0 * num / NULLIF(den, 0) as double."""
    return F.lit(100.0) * safe_ratio(num, den)


def flag(cond: Column) -> Column:
    """CASE WHEN cond THEN 1 ELSE 0 END (NULL counts as 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))
