"""Order-dependent operators that stay distributed.

``Window.orderBy`` without ``partitionBy`` (a global running total, rank over a
whole column) sends every row to one task. The operators here compute the same
values in one way at every size (tiles and quantiles, which need less, are
lazy plans of ``selection`` and ``quantiles``):

1. The order is made total by appending unique key columns; Spark's
   ``repartitionByRange`` deals the rows out by it and sorts each partition.
   Because the key is part of the order, a value shared by a third of all
   rows is still split across partitions.
2. ``monotonically_increasing_id`` gives each row its partition number and its
   place there. Both are stored with the rows in the shared checkpoint folder,
   so a partition that is computed again after an executor loss can't shift.
3. One count or sum for each partition gives the offsets (as many rows as
   partitions; they pass through the driver and are broadcast).
4. Place plus offset is the global position; a running sum needs one window
   within the partition, plus the offset.

Functions of this module therefore run jobs when they are called: a range
sample, a write and the counts for each different order. The number of
partitions is ``revlens.order.partitions``, by default
``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions._col import as_col
from revlens.operators.quantiles import exact_quantiles
from revlens.operators.relational import join_null_safe
from revlens.operators.selection import Sort, Tiles, as_sorts, ntile_ends, with_tiles
from revlens.session import cut_lineage, discard

PARTITIONS_CONF = "revlens.order.partitions"
#: ``monotonically_increasing_id`` keeps the place in a partition in its lower
#: 33 bits and the partition above.
_PLACE_BITS = 33


@dataclass(frozen=True)
class Rank:
    """One ordering to number (``weight`` None) or to sum ``weight`` over.

    ``out`` receives the inclusive running value under ``order + keys``;
    ``total`` (optional) the grand total.
    """
    order: Sequence[Sort | str]
    keys: Sequence[str]
    out: str
    weight: str | Column | None = None
    total: str | None = None


def _partitions(spark) -> int:
    return int(spark.conf.get(PARTITIONS_CONF, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def _placed(df: DataFrame, order: Sequence[Sort | str], keys: Sequence[str]) -> DataFrame:
    """The rows of ``df``, stored in range partitions of the total order, with
    partition ``_p`` and place ``_i`` (from 0) in it."""
    terms = [*[s.spark_order() for s in as_sorts(order)], *[F.col(k).asc() for k in keys]]
    stored = cut_lineage(df.repartitionByRange(_partitions(df.sparkSession), *terms)
                         .sortWithinPartitions(*terms).withColumn("_at", F.monotonically_increasing_id()))
    return (stored.withColumn("_p", F.shiftright("_at", _PLACE_BITS).cast("int"))
            .withColumn("_i", F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).drop("_at"))


def _offsets(placed: DataFrame, weight: Column) -> DataFrame:
    """``(_p, _off, _tot)``: what comes before each partition, and all."""
    sums = placed.groupBy("_p").agg(F.sum(weight).alias("_w"))
    kind = sums.schema["_w"].dataType
    rows, before = [], None
    for r in sorted(sums.collect(), key=lambda r: r["_p"]):  # one row per partition
        rows.append((r["_p"], before))
        if r["_w"] is not None:
            before = r["_w"] if before is None else before + r["_w"]
    schema = T.StructType([T.StructField("_p", T.IntegerType()), T.StructField("_off", kind),
                           T.StructField("_tot", kind)])
    table = placed.sparkSession.createDataFrame([(p, off, before) for p, off in rows], schema)
    return F.broadcast(table.withColumn("_off", F.coalesce("_off", F.lit(0).cast(kind))))


def running_totals(df: DataFrame, ranks: Sequence[Rank]) -> DataFrame:
    """Add one running row number / running sum column per ``Rank``.

    ``keys`` must make each order total for a deterministic result. Ranks of
    one order share its partitions; every other order is dealt out anew.
    """
    out, placed, last = df, None, None
    for r in ranks:
        order = (tuple(as_sorts(r.order)), tuple(r.keys))
        if placed is None or repr(order) != last:
            before, placed = placed, _placed(out.drop("_p", "_i"), r.order, r.keys)
            if before is not None:
                discard(before)
            out, last = placed, repr(order)
        w = F.lit(1).cast("bigint") if r.weight is None else as_col(r.weight)
        here = (F.col("_i") + 1 if r.weight is None else F.coalesce(F.sum(w).over(
            Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
        out = out.withColumn("_here", here).join(_offsets(placed, w), "_p").withColumn(
            r.out, F.col("_here") + F.col("_off"))
        if r.total:
            out = out.withColumn(r.total, F.col("_tot"))
        out = out.drop("_here", "_off", "_tot")
    return out.drop("_p", "_i")


def running_total(df: DataFrame, order: Sequence[Sort | str], keys: Sequence[str], *,
                  weight: str | Column | None = None, out: str = "_cum",
                  total: str | None = "_total") -> DataFrame:
    """Inclusive running total of ``weight`` (1 per row when None) under the
    total order ``order + keys``; optionally the grand total as ``total``."""
    return running_totals(df, [Rank(order, keys, out, weight, total)])


def global_position(df: DataFrame, order: Sequence[Sort | str], keys: Sequence[str], *,
                    out: str = "_pos", total: str | None = "_n") -> DataFrame:
    """1-based ROW_NUMBER over the whole DataFrame, computed distributed."""
    return running_total(df, order, keys, weight=None, out=out, total=total)


def ntile(df: DataFrame, k: int, order: Sequence[Sort | str], keys: Sequence[str], out: str) -> DataFrame:
    """Distributed ``NTILE(k) OVER (ORDER BY order..., keys...)``."""
    return ntiles(df, k, [(order, keys, out)])


def ntiles(df: DataFrame, k: int, specs: Sequence[tuple]) -> DataFrame:
    """Several ``NTILE(k)`` columns at once; ``specs`` = [(order, keys, out)].
    Tiles need no positions: :mod:`revlens.operators.selection` finds the rows
    that end them."""
    return with_tiles(df, [Tiles(order, keys, out, ntile_ends(k)) for order, keys, out in specs])


def _carried(placed: DataFrame, groups: Sequence[str], weight: Column) -> DataFrame:
    """``(_p, groups, _carry)``: for each partition that begins inside of a
    group, what the partitions before hold of that group. One row at most for
    each partition; only these groups cross an edge."""
    per = placed.groupBy("_p", *groups).agg(F.sum(weight).alias("_w"), F.min("_i").alias("_s"))
    edge = F.struct(*groups, "_w")
    edges = per.groupBy("_p").agg(F.min_by(edge, "_s").alias("first"), F.max_by(edge, "_s").alias("last"),
                                  F.count(F.lit(1)).alias("n")).collect()
    kind, rows, of, total = per.schema["_w"].dataType, [], None, None
    for r in sorted(edges, key=lambda r: r["_p"]):
        first, last = tuple(r["first"])[:-1], tuple(r["last"])[:-1]
        carry = total if first == of else None
        if carry is not None:
            rows.append((r["_p"], *first, carry))
        of, total = last, r["last"]["_w"]
        if r["n"] == 1 and carry is not None:
            total = carry + total
    schema = T.StructType([T.StructField("_p", T.IntegerType()), *[placed.schema[g] for g in groups],
                           T.StructField("_carry", kind)])
    return F.broadcast(placed.sparkSession.createDataFrame(rows, schema))


def group_row_number(df: DataFrame, groups: Sequence[str], order: Sequence[Sort | str],
                     keys: Sequence[str], out: str) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY groups ORDER BY order, keys)``
    without sending a whole group to one task: rows are dealt out by (groups,
    order, keys), numbered within (partition, group), and a group that began
    in an earlier partition adds what those hold of it."""
    placed = _placed(df, [*[Sort(g) for g in groups], *as_sorts(order)], keys)
    start = F.min("_i").over(Window.partitionBy("_p", *groups))
    met = join_null_safe(placed.withColumn("_start", start),
                         _carried(placed, groups, F.lit(1).cast("bigint")), ["_p", *groups], "left")
    return met.withColumn(out, F.col("_i") - F.col("_start") + 1 + F.coalesce("_carry", F.lit(0))).drop(
        "_p", "_i", "_start", "_carry")


def group_quantiles(df: DataFrame, groups: Sequence[str], col: str, qs: Sequence[float], *,
                    names: Sequence[str] | None = None) -> DataFrame:
    """Per-group linear-interpolated quantiles of ``col`` (NULLs skipped, groups
    without values left out), exact and distributed
    (:mod:`revlens.operators.quantiles`)."""
    names = list(names or [f"{col}_q{i}" for i in range(len(qs))])
    wide = exact_quantiles(df, [col], qs, groups=groups).where(F.col(f"{col}_n") > 0)
    return wide.select(*groups, *[F.col(f"{col}_q{i}").alias(name) for i, name in enumerate(names)])


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], *,
                     groups: Sequence[str] = ()) -> DataFrame:
    """Quantiles of several columns in one distributed pass, as rows (groups...,
    column, q0, q1, ...) of the columns that have values."""
    wide = exact_quantiles(df, cols, qs, groups=groups)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_n").alias("n"),
                              *[F.col(f"{c}_q{i}").alias(f"q{i}") for i in range(len(qs))]) for c in cols])
    return (wide.select(*groups, F.explode(rows).alias("r")).where("r.n > 0")
            .select(*groups, "r.column", *[f"r.q{i}" for i in range(len(qs))]))
