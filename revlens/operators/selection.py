"""Exact tiles by rank without sorting all rows into one order.

A tile of ``NTILE`` or of a rank ``qcut`` ends at a known rank, so a row's tile
follows from comparing it with the rows at these ranks. Finding those takes two
lazy aggregates and no shuffle of the rows:

1. Every task sorts its own rows and sends each ``every``-th of them; from the
   sorted splitters the place of each wanted rank is known up to
   ``tasks * every`` rows, whatever the ties and however rows are dealt out.
2. One aggregate counts what lies before each bracket and gathers the keys
   inside of it; the wanted key is at a known place among these.

A last projection compares each row with the cut keys. Everything is part of
one plan: nothing runs before the result is read, nothing is stored, and the
result follows its tables.

State: ``rows / every + tasks`` splitters and at most ``tasks * every`` keys for
each cut, in one aggregate buffer. ``revlens.select.every`` (default 1,024) keeps
both near a million keys for 10**9 rows in 1,000 tasks; more rows want a
larger value.

The order is made total by unique keys. A descending term must be numeric.
Nulls go where the sort term says. An empty input gives no cuts and no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions._col import as_col
from revlens.operators.relational import with_scalars

EVERY_CONF, EVERY = "revlens.select.every", 1024
_PLACE_BITS = 33  # of monotonically_increasing_id


@dataclass(frozen=True)
class Sort:
    """One sort term."""
    col: str | Column
    desc: bool = False
    nulls_first: bool | None = None  # default: ASC nulls first, DESC nulls last (Spark)

    @property
    def null_first(self) -> bool:
        return (not self.desc) if self.nulls_first is None else self.nulls_first

    def spark_order(self) -> Column:
        c = as_col(self.col)
        if self.desc:
            return c.desc_nulls_first() if self.null_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.null_first else c.asc_nulls_last()


def as_sorts(order: Sequence[Sort | str]) -> list[Sort]:
    return [s if isinstance(s, Sort) else Sort(s) for s in order]


def ntile_ends(k: int) -> Callable[[Column], list[Column]]:
    """Ranks at which the tiles 1 .. k-1 of ``NTILE(k)`` end among n rows."""
    def ends(n: Column) -> list[Column]:
        return [t * F.floor(n / k) + F.least(F.lit(t), n % k) for t in range(1, k)]
    return ends


def qcut_rank_ends(q: int) -> Callable[[Column], list[Column]]:
    """Ranks at which the bins 1 .. q-1 of pandas' ``qcut(rank, q)`` end among
    n different ranks: the edges interpolate between 1 and n."""
    def ends(n: Column) -> list[Column]:
        return [F.when(n <= 1, n).otherwise(1 + F.floor(t * (n - 1) / q)) for t in range(1, q)]
    return ends


@dataclass(frozen=True)
class Tiles:
    """One tile column: rows by ``order``, ties by the unique ``keys``, cut
    after the ranks ``ends(number of rows)``."""
    order: Sequence[Sort | str]
    keys: Sequence[str]
    out: str
    ends: Callable[[Column], list[Column]] = field(default_factory=lambda: ntile_ends(4))

    def key(self, df: DataFrame) -> Column:
        """A struct that sorts ascending as the rows do."""
        fields = []
        for i, s in enumerate(as_sorts(self.order)):
            c = as_col(s.col)
            if s.desc:
                kind = df.select(c).schema[0].dataType
                if not isinstance(kind, T.NumericType):
                    raise TypeError(f"a descending order needs a number, not {kind.simpleString()}")
                c = -(c.cast("bigint") if isinstance(kind, T.IntegralType) else c)
            fields += [(as_col(s.col).isNotNull() if s.null_first else as_col(s.col).isNull()).alias(f"n{i}"),
                       c.alias(f"v{i}")]
        return F.struct(*fields, *[F.col(k).alias(f"k{i}") for i, k in enumerate(self.keys)])

    def n_cuts(self) -> int:
        return len(self.ends(F.lit(1)))


def _brackets(df: DataFrame, tiles: Tiles, every: int, j: int) -> DataFrame:
    """One row: for each cut its rank and the splitters around it."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    one = (df.select(tiles.key(df).alias("_k")).sortWithinPartitions("_k").withColumn("_at", place)
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_at") == 0).alias("tasks"),
                F.sort_array(F.collect_list(F.when(F.col("_at") % every == 0, F.col("_k")))).alias("at")))
    out = []
    for i, end in enumerate(tiles.ends(F.col("n"))):
        rank = end.cast("bigint")
        # rows before the c-th splitter: (c - 1) * every at most;
        # rows up to it: c * every - tasks * (every - 1) at least
        low = F.ceil(rank / every).cast("int") - 1
        high = F.ceil((rank + F.col("tasks") * (every - 1)) / every).cast("int") - 1
        out += [rank.alias(f"_rank_{j}_{i}"), F.get("at", low).alias(f"_low_{j}_{i}"),
                F.get("at", high).alias(f"_high_{j}_{i}")]
    return one.select(*out)


def cuts(df: DataFrame, specs: Sequence[Tiles]) -> DataFrame:
    """One row with the keys of the last rows of all tiles but the last:
    columns ``_cut_<spec>_<tile>``, null where the tile holds no rows and
    begins the order."""
    every = int(df.sparkSession.conf.get(EVERY_CONF, None) or EVERY)
    keyed = df.select(*[s.key(df).alias(f"_k{j}") for j, s in enumerate(specs)])
    for j, s in enumerate(specs):
        keyed = with_scalars(keyed, _brackets(df, s, every, j))
    aggs, picked = [], []
    for j, s in enumerate(specs):
        k = F.col(f"_k{j}")
        for i in range(s.n_cuts()):
            at, low, high = f"{j}_{i}", F.col(f"_low_{j}_{i}"), F.col(f"_high_{j}_{i}")
            inside = (k >= low) & (high.isNull() | (k <= high))
            aggs += [F.max(f"_rank_{at}").alias(f"_rank_{at}"), F.count_if(k < low).alias(f"_below_{at}"),
                     F.sort_array(F.collect_list(F.when(inside, k))).alias(f"_near_{at}")]
            place = (F.col(f"_rank_{at}") - F.col(f"_below_{at}") - 1).cast("int")
            picked.append(F.when(F.col(f"_rank_{at}") > 0, F.get(f"_near_{at}", place)).alias(f"_cut_{at}"))
    return keyed.agg(*aggs).select(*picked)


def tile(df: DataFrame, specs: Sequence[Tiles], j: int) -> Column:
    """Tile of a row of ``df`` that the columns of :func:`cuts` are attached to."""
    out, k = F.lit(1), specs[j].key(df)
    for i in range(specs[j].n_cuts()):
        cut = F.col(f"_cut_{j}_{i}")
        out = out + F.when(cut.isNull() | (k > cut), 1).otherwise(0)
    return out.cast("int")


def with_tiles(df: DataFrame, specs: Sequence[Tiles], among: Column | None = None) -> DataFrame:
    """``df`` with one tile column for each spec. With ``among``, only its rows
    are ranked; the others get null."""
    ranked = df if among is None else df.where(among)
    met = with_scalars(df, cuts(ranked, specs))
    columns = [tile(df, specs, j) for j in range(len(specs))]
    return met.select(*df.columns, *[(c if among is None else F.when(among, c)).alias(s.out)
                                     for c, s in zip(columns, specs)])
