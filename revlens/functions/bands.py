"""Fixed labels and banding rules of the analyses (Column -> Column).

SQL-side bands are left-closed CASE chains whose ELSE also takes NULL;
notebook-side bins are right-closed ``cut`` bins where NULL and values at or
below the lowest edge get no bin. The two families are kept apart on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions._col import as_col
from revlens.functions.maths import cut

# ---- fixed values: labels used by the SQL analyses -------------------------
SEG_SINGLE = "Single Purchase"
SEG_CHAMPIONS = "Champions"
SEG_AT_RISK = "At Risk Loyal"
SEG_RECENT_LOW = "Recent Low Frequency"
SEG_REGULAR = "Regular Repeat Buyers"

CHURNED = "Churned"
ACTIVE = "Active"
ONE_TIME = "One-time Buyer"
REPEAT = "Repeat Buyer"

DIST_LOCAL = "Local"
DIST_REGIONAL = "Regional"
DIST_LONG = "Long Distance"

RATING_POOR = "1-2 (poor)"
RATING_BELOW = "2-3 (below avg)"
RATING_GOOD = "3-4 (good)"
RATING_EXCELLENT = "4-5 (excellent)"

INST_SINGLE = "Single"
INST_2_6 = "Installments (2-6)"
INST_7_PLUS = "Installments (7+)"

AOV_LOW = "Low AOV (<100)"
AOV_MEDIUM = "Medium AOV (100-300)"
AOV_HIGH = "High AOV (>300)"

# ---- fixed values: bins used by the notebook analyses ----------------------
DIST_BIN_EDGES = (0.0, 100.0, 500.0, float("inf"))
DIST_BIN_LABELS = ("Local (<100 km)", "Regional (100-500 km)", "Long Distance (>500 km)")
RATING_BIN_EDGES = (0.0, 2.0, 3.0, 4.0, 5.0)
RATING_BIN_LABELS = ("1-2 (poor)", "2-3 (below avg)", "3-4 (good)", "4-5 (excellent)")
INST_BIN_EDGES = (0.0, 1.0, 6.0, 100.0)
INST_BIN_LABELS = ("Single", "2-6", "7+")
AOV_BIN_EDGES = (0.0, 100.0, 300.0, 1e6)
AOV_BIN_LABELS = ("Low", "Medium", "High")


def rfm_segment(frequency, r_score, f_score) -> Column:
    """Segment rule shared by the SQL RFM query, its view and the notebook RFM."""
    frequency, r, f = as_col(frequency), as_col(r_score), as_col(f_score)
    return (F.when(frequency == 1, SEG_SINGLE)
            .when((r >= 3) & (f >= 3), SEG_CHAMPIONS)
            .when((r <= 2) & (f >= 3), SEG_AT_RISK)
            .when((r >= 3) & (f <= 2), SEG_RECENT_LOW)
            .otherwise(SEG_REGULAR))


def distance_band(km) -> Column:
    km = as_col(km)
    return (F.when(km < 100, DIST_LOCAL)
            .when(km.between(100, 500), DIST_REGIONAL)
            .otherwise(DIST_LONG))


def rating_band(score) -> Column:
    s = as_col(score)
    return (F.when(s < 2, RATING_POOR).when(s < 3, RATING_BELOW)
            .when(s < 4, RATING_GOOD).otherwise(RATING_EXCELLENT))


def installment_group(n) -> Column:
    n = as_col(n)
    return (F.when(n == 1, INST_SINGLE).when(n.between(2, 6), INST_2_6)
            .otherwise(INST_7_PLUS))


def aov_segment(v) -> Column:
    v = as_col(v)
    return (F.when(v < 100, AOV_LOW).when(v.between(100, 300), AOV_MEDIUM)
            .otherwise(AOV_HIGH))


def distance_bin(km) -> Column:
    return cut(km, DIST_BIN_EDGES, DIST_BIN_LABELS)


def rating_bin(score) -> Column:
    return cut(score, RATING_BIN_EDGES, RATING_BIN_LABELS)


def installment_bin(n) -> Column:
    return cut(n, INST_BIN_EDGES, INST_BIN_LABELS)


def aov_bin(v) -> Column:
    return cut(v, AOV_BIN_EDGES, AOV_BIN_LABELS)
