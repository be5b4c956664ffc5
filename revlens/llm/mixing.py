"""Mixing sources to target weights by cube-method balanced sampling.

Sizes are word counts. The sources, in code-point order with null last, weigh
``WEIGHTS`` in turn and share all words; a target stops at ``cap`` times its
source's size and the excess is shared again by weight until none is above.
A source with rate ``r`` (target / size) takes every document ``floor(r)``
times, and the fraction that is left becomes the inclusion probability of one
more copy of each of its documents.

The cube method decides those copies. It moves the fractional probabilities of
three documents at a time along the null space of their balancing constraints
(words and documents), so both totals of the source stay exact while one
document after the other reaches 0 or 1. Documents move from the largest to
the smallest, so the few that stay fractional are small ones. Shards of a
source (of at most about ``shard_rows`` documents, so a hot source is many
tasks) each leave two documents at most; these move together in a next round,
until one round holds all that a source has left and lands them: a dozen
documents of all sizes that the flight left alone and its last two are decided
together, so that the words of the source come nearest to the target.

Sharding, order and random directions depend on ids, texts and sizes alone,
so reruns agree. The driver holds one row per source (some 100 bytes each), which
must be labels, not free text: a million sources are 100 MB there.

Rows that are equal in id, source and text are one unit with a multiplicity, so
a row that repeats a million times is one row of its shard. Of its fractional
copies the whole ones are taken and the rest of one is drawn.

Defined results: a null or empty text has size 0 and takes 0 words; a source
without words has target 0. Rows that share a doc_id are rows of their own;
equal rows take copies that differ by one at most. Ties in size are moved in
the order of a hash. A very long text is only counted. An empty table gives no
rows. Other columns are kept by the mix, whatever their names, and not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import records, ship, written
from revlens.operators.ordering import Sort, group_row_number

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"

SHARD_ROWS = 4_000
#: Documents, besides the last two of the flight, that the landing decides.
LANDING = 12
#: Above this many sources their table is joined like any other table.
BROADCAST_SOURCES = 100_000
_EPS = 1e-9


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Words that each source gives to the mix."""
    total, capped = float(sum(sizes)), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(cap * sizes[i] for i in capped)
        weight = sum(weights[i] for i in free)
        share = {i: rest * weights[i] / weight for i in free}
        above = {i for i in free if share[i] > cap * sizes[i]}
        if not above:
            return [share.get(i, float(cap * sizes[i])) for i in range(len(sizes))]
        capped |= above


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move fractional ``p`` along the null space of (words, documents), three
    at a time in the order given, until at most two are fractional."""
    p = p.copy()
    fractional = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    draws = iter(rng.random(len(fractional) + 1).tolist())
    hold: list[list[float]] = []  # position, size, probability
    for k, s, v in zip(fractional.tolist(), size[fractional].tolist(), p[fractional].tolist()):
        hold.append([k, s, v])
        while len(hold) == 3:
            a, b, c = hold
            u = (b[1] - c[1], c[1] - a[1], a[1] - b[1])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = math.inf
            for x, d in zip(hold, u):
                if d > 0:
                    up, down = min(up, (1 - x[2]) / d), min(down, x[2] / d)
                elif d < 0:
                    up, down = min(up, x[2] / -d), min(down, (1 - x[2]) / -d)
            step = up if next(draws) * (up + down) < down else -down
            for x, d in zip(hold, u):
                x[2] += step * d
            left = []
            for x in hold:
                if _EPS < x[2] < 1 - _EPS:
                    left.append(x)
                else:
                    p[x[0]] = round(x[2])
            # rounding may leave none at the border; the nearest one goes
            if len(left) == 3:
                x = min(left, key=lambda y: min(y[2], 1 - y[2]))
                p[x[0]] = round(x[2])
                left.remove(x)
            hold = left
    for k, _, v in hold:
        p[k] = v
    return p


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Decide the last fractional documents (``LANDING`` and two at most): of
    all their subsets the one whose words, then documents, come nearest to
    the expected ones."""
    p = p.copy()
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    subsets = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(np.float64)
    words = np.abs(subsets @ size[left] - size[left] @ p[left])
    count = np.abs(subsets.sum(axis=1) - p[left].sum())
    p[left] = subsets[np.lexsort((count, words))[0]]
    return np.rint(p)


def flight_holding(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, n: int) -> np.ndarray:
    """A flight that leaves ``n`` fractional documents of all sizes alone."""
    fractional = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if not len(fractional) or not n:
        return flight(size, p, rng)
    kept = fractional[np.unique(np.linspace(0, len(fractional) - 1, n).round().astype(int))]
    rest = p.copy()
    rest[kept] = 0.0
    out = flight(size, rest, rng)
    out[kept] = p[kept]
    return out


def flight_and_landing(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A flight that leaves ``LANDING`` documents of all sizes for the
    landing, as a large one that stays fractional has to be made up for."""
    return landing(size, flight_holding(size, p, rng, LANDING))


def _round(units: DataFrame, last: bool, level: int) -> DataFrame:
    """One flight in every shard; the last one also lands. Until then the
    first shard of a source holds documents back for the landing."""

    def move(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "order", "doc_id", "text_hash"], ascending=[False, True, True, True])
        size = pdf["size"].to_numpy(np.float64)
        rng = np.random.default_rng([level, int(key[0]), int(key[1])])
        p = pdf["p"].to_numpy(np.float64)
        return pdf.assign(p=flight_and_landing(size, p, rng) if last else
                          flight_holding(size, p, rng, 0 if key[1] else LANDING))

    return units.groupBy("source_no", "shard").applyInPandas(move, units.schema)


def mix_units(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP,
              shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(doc_id, source, text_hash, size, rows, source_size, target, copies)``
    for every set of equal rows: how many there are, and all their copies."""
    if shard_rows < 3 * LANDING:  # what shards leave must shrink from round to round
        raise ValueError(f"shard_rows must be {3 * LANDING} or more")
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce("text", F.lit(""))
    # equal rows are one unit, however many they are
    sized = written(docs.select(
        "doc_id", "source", F.xxhash64(text).alias("text_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
        .groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("rows")))
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("s"), F.count("*").alias("n")).collect()
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["s"]) for r in sources]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], cap)
    rates = [min(float(cap), t / s) if s else 0.0 for t, s in zip(goal, sizes)]
    rates = [float(round(x)) if abs(x - round(x)) < _EPS else x for x in rates]
    shards = [-(-int(r["n"]) // shard_rows) for r in sources]
    table = spark.createDataFrame(
        [(r["source"], i, s, t, math.floor(x), x - math.floor(x), k)
         for i, (r, s, t, x, k) in enumerate(zip(sources, sizes, goal, rates, shards))],
        T.StructType([T.StructField("s_source", sized.schema["source"].dataType), *(
            T.StructField(c, t) for c, t in (
                ("source_no", T.IntegerType()), ("source_size", T.LongType()), ("target", T.DoubleType()),
                ("whole", T.IntegerType()), ("p", T.DoubleType()), ("shards", T.IntegerType())))]))
    if len(sources) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    order = F.xxhash64("doc_id", "text_hash")
    # of the fractional copies of a unit's rows only what is left of one is drawn
    drawn = F.col("rows") * F.col("p")
    surely = F.floor(drawn + _EPS)
    rest = F.when(drawn - surely > _EPS, drawn - surely).otherwise(0.0)
    units = sized.join(table, F.col("source").eqNullSafe(F.col("s_source"))).select(
        "doc_id", "source", "text_hash", "size", "rows", "source_no", "source_size", "target",
        (F.col("whole") * F.col("rows") + surely).alias("whole"), rest.alias("p"),
        F.pmod(order, F.col("shards").cast("long")).cast("int").alias("shard"),
        F.xxhash64(F.lit(1), "doc_id", "text_hash").alias("order"))
    decided = F.col("p").isin(0.0, 1.0)
    most, level, done = max(shards, default=0), 0, []
    while most > 1:
        moved = written(_round(units, False, level))
        done.append(moved.where(decided))
        # two documents at most are left of each shard, and those held back
        level, most = level + 1, -(-(2 * most + LANDING) // shard_rows)
        units = moved.where(~decided).withColumn("shard", F.pmod(F.col("order"), F.lit(most)).cast("int"))
    out = _round(units, True, level)
    for part in done:
        out = out.union(part)
    return out.select("doc_id", "source", "text_hash", "size", "rows", "source_size", "target",
                      (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def _share(row: Column) -> Column:
    """Copies of row number ``row`` (from 1) of a unit's equal rows."""
    return F.floor(F.col("copies") / F.col("rows")) + (row <= F.col("copies") % F.col("rows")).cast("long")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP,
             shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(doc_id, source, text_hash, size, source_size, target, copies)`` for
    every row; a unit's copies are dealt evenly over its equal rows."""
    each = mix_units(docs, weights, cap, shard_rows).withColumn(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "source", "text_hash", "size", "source_size", "target",
                       _share(F.col("row")).cast("int").alias("copies"))


def op5_mixing(docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, size, source_size, target, taken."""
    return mix_plan(docs).select("doc_id", "size", "source_size", "target",
                                 (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the plan takes it.
    Documents without words, of which a mix of words takes nothing, go. Rows
    of one id, source and text that differ in other columns share their copies
    evenly, what is left over in the order of a hash of all columns."""
    units = mix_units(docs).where("size > 0 and copies > 0").select(
        F.col("doc_id").alias("id"), "source", F.col("text_hash").alias("hash"), "rows", "copies")
    rows = records(docs).withColumn("text_hash", F.xxhash64(F.coalesce("record.text", F.lit(""))))
    met = rows.join(units, F.col("record.doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
                    & F.col("record.source").eqNullSafe(F.col("source"))).drop("text_hash")
    even = F.col("copies") % F.col("rows") == 0
    # only these need a place among their equals
    uneven = group_row_number(met.where(~even).withColumn("mark", F.xxhash64("record")),
                              ["id", "source", "hash"], [Sort("mark")], [], "row").drop("mark")
    dealt = met.where(even).withColumn("row", F.lit(1).cast("long")).unionByName(uneven)
    return (dealt.withColumn("copy", F.explode(F.array_repeat(F.lit(0), _share(F.col("row")).cast("int"))))
            .select(*[F.col(f"record.`{c}`").alias(c) for c in docs.columns]))
