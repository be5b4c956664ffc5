"""Relational building blocks: first-per-key, mark joins, scalar attach,
duplicate counts, medians, joins on skewed keys. All but the last are
single-pass, partially aggregated ``groupBy`` plans, so a key holding a third of
all rows is combined map-side instead of landing whole in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions._col import as_col


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row relation (``CROSS JOIN snapshot``).

    ``one_row`` must be a global aggregate (exactly one row by construction),
    which is what makes the broadcast safe.
    """
    return df.crossJoin(F.broadcast(one_row))


def first_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                      cols: Sequence[str]) -> DataFrame:
    """``SELECT DISTINCT ON (keys) cols ... ORDER BY keys, order``.

    ``order`` must end with unique columns so the pick is deterministic. Uses
    ``min_by`` with a struct order key: partial aggregation per key, no sort
    of a whole group.
    """
    ordkey = F.struct(*[as_col(c) for c in order])
    payload = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*keys).agg(F.min_by(payload, ordkey).alias("_first"))
            .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in cols]))


def first_non_null_per_column(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                              cols: Sequence[str]) -> DataFrame:
    """pandas ``sort_values(order).groupby(keys).first()``: per column the
    first non-null value in order (values of different rows may mix)."""
    ordkey = F.struct(*[as_col(c) for c in order])
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), ordkey)).alias(c) for c in cols]
    return df.groupBy(*keys).agg(*aggs)


def mark_join(df: DataFrame, marks: DataFrame, key: str, flag: str) -> DataFrame:
    """``LEFT JOIN (distinct keys) ... CASE WHEN k IS NOT NULL THEN 1 ELSE 0``.

    Marks are de-duplicated first so the join never multiplies rows.
    """
    m = marks.select(F.col(key)).distinct().withColumn("_mark", F.lit(1))
    return (df.join(m, key, "left")
            .withColumn(flag, F.coalesce(F.col("_mark"), F.lit(0)))
            .drop("_mark"))


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """pandas ``df.duplicated(cols).sum()`` (NULLs compare equal) as one row."""
    cols = list(cols or df.columns)
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
            .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicates")))


def group_median(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per-group linear-interpolated median of each column (NULLs skipped; a
    group without values keeps its row).

    Exact and distributed: Spark's ``median`` would merge every distinct value
    of a group in one task.
    """
    from revlens.operators.quantiles import exact_quantiles
    med = exact_quantiles(df, cols, [0.5], groups=keys)
    return med.select(*keys, *[F.col(f"{c}_q0").alias(c) for c in cols])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (SQL GROUP BY keeps a
    NULL group; a plain join would drop it). Output keeps the left keys."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


#: A heavy key's rows are dealt out to this many salts for each partition that
#: they would fill.
SALTS_A_PARTITION = 16


def heavy_keys(df: DataFrame, keys: Sequence[str], parts: int) -> list[tuple[int, float]]:
    """Keys that hold over half of one of ``parts`` even partitions, as (hash of
    the key, share of all rows): at most ``2 * parts`` of them.

    One pass keeps a mergeable sketch of the most frequent hashes, so a task
    sends a bounded list however many keys there are. Shares may be too high by
    the sketch's error; nothing but the number of salts depends on them.
    """
    most, tracked = min(2 * parts, 50_000), min(max(64 * parts, 4_096), 1_000_000)
    found = (df.select(F.xxhash64(*keys).alias("h"))
             .agg(F.expr(f"approx_top_k(h, {most}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n")).first())
    return [(item["item"], item["count"] / found["n"]) for item in found["top"] or []
            if 2 * parts * item["count"] > found["n"]]


def heavy_hitter_join(left: DataFrame, right: DataFrame, keys: Sequence[str], *, spread: Sequence[str],
                      how: str = "inner", parts: int | None = None) -> DataFrame:
    """``left.join(right, keys, how)`` for a ``left`` in which a few keys may hold
    most of the rows; ``how`` is inner, left, left_semi or left_anti.

    Only the heavy keys are salted: their left rows are dealt out by a hash of
    ``spread``, columns that tell the rows of one key apart (a unique key, best),
    and their right rows are repeated for each salt, at most ``18 * parts``
    salts over all heavy keys. Every other key is joined as it is. The salt is a
    function of the row, so a task that runs again deals alike. Null keys match
    nothing, as in a plain join, and are spread too. If no key is heavy the plan
    is the plain join.

    Runs one job when it is called: the pass of :func:`heavy_keys` over the keys
    of ``left``. ``parts`` is ``spark.sql.shuffle.partitions`` if not given. Both
    sides must hold the keys in one type, as they meet by hash.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"only the left side's heavy keys are split; no {how} join")
    for k in keys:
        if left.schema[k].dataType != right.schema[k].dataType:
            raise ValueError(f"{k}: {left.schema[k].dataType} on the left, {right.schema[k].dataType} on the right")
    spark = left.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy = [(h, math.ceil(share * parts * SALTS_A_PARTITION)) for h, share in heavy_keys(left, keys, parts)]
    if not heavy:
        return left.join(right, list(keys), how)
    taken = {c.lower() for c in (*left.columns, *right.columns)}
    key_hash, salts, salt = (next(n for n in (f"_{name}{i}" for i in range(len(taken) + 1)) if n not in taken)
                             for name in ("key_hash", "salts", "salt"))
    split = F.broadcast(spark.createDataFrame(heavy, f"{key_hash} bigint, {salts} int"))
    number = F.coalesce(F.col(salts), F.lit(1))
    dealt = (left.withColumn(key_hash, F.xxhash64(*keys)).join(split, key_hash, "left")
             .withColumn(salt, F.pmod(F.xxhash64(*spread), number).cast("int")).drop(key_hash, salts))
    repeated = (right.withColumn(key_hash, F.xxhash64(*keys)).join(split, key_hash, "left")
                .withColumn(salt, F.explode(F.sequence(F.lit(0), number - 1))).drop(key_hash, salts))
    return dealt.join(repeated, [*keys, salt], how).drop(salt)
