"""Data-profiling operators. Each is one distributed aggregate pass whose
result is small (one row per column or per value) and returned as a
DataFrame; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.operators.quantiles import exact_quantiles
from revlens.operators.relational import with_scalars

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _long(one_row: DataFrame, names: Sequence[str], var: str = "column",
          val: str = "value") -> DataFrame:
    return one_row.unpivot([], list(names), var, val)


def shape(df: DataFrame) -> DataFrame:
    """``df.shape``: rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("bigint"))


def column_info(df: DataFrame) -> DataFrame:
    """``df.info()``: column, type, non-null count (one pass)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)],
        "column string, dtype string, position int")
    return (_long(counts, df.columns, "column", "non_null").join(F.broadcast(types), "column")
            .select("position", "column", "dtype", "non_null").orderBy("position"))


def null_counts(df: DataFrame) -> DataFrame:
    """``df.isnull().sum()``: column, nulls."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns])
    return _long(counts, df.columns, "column", "nulls")


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """``s.value_counts(dropna=...)``: value, count, most frequent first."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    return (src.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col).asc_nulls_first()))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``df[cols].nunique()``: column, distinct (NULL not counted).

    Each column is counted by itself, in two levels: its scan reads that column
    only, its values are made distinct in each task and meet by value. Several
    ``countDistinct`` in one aggregate would first write every row once for each
    column (``Expand``)."""
    cols = list(cols or df.columns)
    counts = [df.select(F.col(c).alias("v")).where("v is not null").distinct()
              .agg(F.count(F.lit(1)).alias("distinct"))
              .select(F.lit(c).alias("column"), "distinct") for c in cols]
    return reduce(DataFrame.unionByName, counts)


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``df.describe()`` for numeric columns in long form (column, statistic,
    value): count, mean, std (sample), min, 25%, 50%, 75%, max. Quartiles are
    exact linear-interpolated; the moments come with their first pass."""
    cols = list(cols or numeric_columns(df))
    moments = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = exact_quantiles(df, cols, [0.25, 0.5, 0.75], also=[
        f(c).cast("double").alias(f"{c}_{name}") for c in cols for name, f in moments.items()])
    statistics = {"count": "n", **{name: name for name in moments}, "25%": "q0", "50%": "q1", "75%": "q2"}
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(name).alias("statistic"),
                              F.col(f"{c}_{held}").cast("double").alias("value"))
                     for c in cols for name, held in statistics.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def describe_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``describe()`` of text columns: count, unique, top, freq per column
    (top ties broken by the smaller value). One scan: the columns are stacked
    as (column, value), counted per pair with a partial aggregate, and the
    per-column statistics are read off those counts."""
    cols = list(cols or text_columns(df))
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(c).alias("v"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*").where(F.col("v").isNotNull())
    pairs = stacked.groupBy("i", "column", "v").agg(F.count(F.lit(1)).alias("n"))
    stats = (pairs.groupBy("i", "column")
             .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
                  F.min_by(F.col("v"), F.struct(-F.col("n"), F.col("v"))).alias("top"),
                  F.max("n").alias("freq")))
    # columns without any non-null value still get a row (count 0)
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)],
                                            "i int, column string")
    return (F.broadcast(names).join(stats, ["i", "column"], "left")
            .select("column", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
                    F.coalesce("unique", F.lit(0)).cast("bigint").alias("unique"),
                    "top", F.col("freq").cast("bigint").alias("freq"), "i")
            .orderBy("i").drop("i"))


def quality_table(df: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Per column: missing count/pct and, for text columns, count/pct of the
    placeholder value (0 for other columns)."""
    text = set(text_columns(df))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in df.columns:
        aggs.append(F.sum(F.col(c).isNull().cast("bigint")).alias(f"m_{c}"))
        aggs.append((F.sum(F.coalesce((F.col(c) == unknown).cast("bigint"), F.lit(0)))
                     if c in text else F.lit(0).cast("bigint")).alias(f"u_{c}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                     F.col(f"m_{c}").alias("missing_count"),
                     F.col(f"u_{c}").alias("unknown_count")) for i, c in enumerate(df.columns)]
    long = one.select("_n", F.explode(F.array(*rows)).alias("r")).select("_n", "r.*")
    return long.select(
        "column", "missing_count",
        (F.col("missing_count") * 100.0 / F.col("_n")).cast("double").alias("missing_pct"),
        "unknown_count",
        (F.col("unknown_count") * 100.0 / F.col("_n")).cast("double").alias("unknown_pct"),
        "position").orderBy("position").drop("position")


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows violating each rule (``rule -> violation predicate``) in one pass;
    unknown (NULL) predicates count as not violated."""
    one = df.agg(*[F.sum(F.coalesce(p, F.lit(False)).cast("bigint")).alias(name)
                   for name, p in rules.items()])
    return _long(one, list(rules), "rule", "violations")


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows with any column outside [Q1 - k*IQR, Q3 + k*IQR]: one row with
    rows, outliers, outlier_pct and the bounds per column."""
    q = exact_quantiles(df, cols, [0.25, 0.75])
    iqr = {c: F.col(f"{c}_q1") - F.col(f"{c}_q0") for c in cols}
    bounds = q.select(*[x for c in cols for x in ((F.col(f"{c}_q0") - k * iqr[c]).alias(f"{c}_lower"),
                                                  (F.col(f"{c}_q1") + k * iqr[c]).alias(f"{c}_upper"))])
    outside = F.lit(False)
    for c in cols:
        outside = outside | F.coalesce((F.col(c) < F.col(f"{c}_lower")) | (F.col(c) > F.col(f"{c}_upper")),
                                       F.lit(False))
    # the bounds leave by the aggregate that uses them
    return (with_scalars(df.select(*cols), bounds)
            .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(outside.cast("bigint")), F.lit(0)).alias("outliers"),
                 *[F.max(b).alias(b) for b in bounds.columns])
            .withColumn("outlier_pct", F.col("outliers") * 100.0 / F.col("rows")))
