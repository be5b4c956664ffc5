"""Exact top-k search by inner product: a KD-tree for each shard.

Vectors become integers, ``floor(scale * x)`` of each component as a double.
The candidates are dealt by the hash of their stored row number into shards of
about ``SHARD_ROWS`` vectors. A shard's tree splits at the median of the widest
dimension; each node has the tight bounding box of its vectors. For a query
``q`` no vector of a box has a larger inner product than
``sum(max(q * low, q * high))``, so a search visits the nodes of a tree best
bound first and stops when the next bound is below the k-th score so far.

That k-th score is propagated: each query first searches one bounded sample of
the candidates (``SAMPLE`` rows), and its k-th score there, which the true one
cannot be below, already bounds the search of every shard. Shards return at
most k results a query, ranked together at the end.

Queries are a stated set; they go in blocks of ``QUERY_ROWS`` to every shard
with a join on the shard number.

Defined results: a vector that is null or empty or has a null or non-finite
component takes no part; vectors of another length than the query's are not
compared with it. A row never finds rows of its own id. Ties go to the
smaller id; repeated rows of an id stay results of their own, and each query
row, repeated or not, gets k results of its own. An empty table gives no rows. Scores are exact
while they stay below 2**53. Other columns are never read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import bound_batches, written

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS, SAMPLE = 8192, 512, 128, 4096


# -------------------------------------------------------------------- trees

class Tree:
    """Median splits of the rows of ``x``, ids ascending within a leaf."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        place = np.arange(len(ids))
        self.low, self.high, self.child, self.rows = [], [], [], []
        if len(place):
            self._node(place)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _node(self, place: np.ndarray) -> int:
        number, x = len(self.child), self.x[place]
        low, high = x.min(axis=0), x.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.child.append(())
        self.rows.append(place)
        if len(place) > LEAF_ROWS:
            wide = int(np.argmax(high - low))
            by = np.argsort(x[:, wide], kind="stable")
            half = len(place) // 2
            # equal vectors stay in the order of their ids
            left, right = np.sort(place[by[:half]]), np.sort(place[by[half:]])
            self.rows[number] = place[:0]
            self.child[number] = (self._node(left), self._node(right))
        return number

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that each node may hold, for each query."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.high.T + down @ self.low.T

    def search(self, own: int, query: np.ndarray, bound: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The best ``(score, -id)``, at most k, of rows of other ids; scores
        below ``floor`` are left out."""
        best: list[tuple[float, int]] = []
        queue = [(-bound[0], 0)] if len(bound) else []
        while queue:
            b, node = heapq.heappop(queue)
            least = best[0][0] if len(best) == k else floor
            if -b < max(least, floor):
                break
            if self.child[node]:
                for c in self.child[node]:
                    if bound[c] >= max(least, floor):
                        heapq.heappush(queue, (-bound[c], c))
                continue
            rows = self.rows[node]
            score, ids = self.x[rows] @ query, self.ids[rows]
            fit = np.flatnonzero((score >= max(least, floor)) & (ids != own))
            if len(fit) > k:  # best scores, then smaller ids
                fit = fit[np.lexsort((ids[fit], -score[fit]))[:k]]
            for s, i in zip(score[fit].tolist(), ids[fit].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return best


# ------------------------------------------------------------------ packing

def _pack(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key and vector length: row numbers, ids and
    components as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers, ids, vectors = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int32()),
                     pa.array([np.concatenate(numbers).astype("<i8").tobytes()], pa.binary()),
                     pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
                     pa.array([zlib.compress(np.concatenate(vectors).astype("<f8").tobytes(), 1)], pa.binary())],
                    [key, "dim", "numbers", "ids", "vectors"])

        for batch in batches:
            number, dim = (batch.column(c).to_numpy() for c in (key, "dim"))
            cut = np.flatnonzero((number[1:] != number[:-1]) | (dim[1:] != dim[:-1])) + 1
            for a, b in zip(np.r_[0, cut], np.r_[cut, len(number)]):
                if a == b:
                    continue
                if held != (number[a], dim[a]):
                    yield from flush()
                    held, numbers, ids, vectors = (int(number[a]), int(dim[a])), [], [], []
                numbers.append(batch.column("row").slice(a, b - a).to_numpy())
                ids.append(batch.column("vec_id").slice(a, b - a).to_numpy())
                vectors.append(batch.column("v").slice(a, b - a).flatten().to_numpy())
        yield from flush()

    return (rows.repartition(key).sortWithinPartitions(key, "dim", "vec_id")
            .mapInArrow(pack, f"{key} int, dim int, numbers binary, ids binary, vectors binary"))


def _unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(zlib.decompress(vectors), "<f8").reshape(-1, dim)


def vectors(table: DataFrame, scale: float = 64.0) -> DataFrame:
    """``(vec_id, dim, v)`` of the rows that take part."""
    # floor() of a double gives a long; a component beyond its range takes
    # part as the nearest long
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    return table.where(usable).select(
        "vec_id", F.size("embedding").alias("dim"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def top_k(table: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows for each row for
    which ``is_query`` holds."""
    bound_batches(table.sparkSession)
    spark = table.sparkSession
    # numbers of stored rows: a task that runs again finds the same
    rows = written(vectors(table, scale).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    index = _pack(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "shard")
    asked = rows.where(is_query)
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    queries = written(_pack(asked.withColumn(
        "block", F.pmod(F.xxhash64(F.lit(1), F.col("row")), F.lit(blocks)).cast("int")), "block"))
    # one bounded sample, by hash of the id, for the first k-th scores
    sample = rows.orderBy(F.xxhash64(F.lit(2), F.col("row")), "row").limit(SAMPLE).toArrow()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in set(sample.column("dim").to_pylist()):
        part = sample.filter(pa.compute.equal(sample.column("dim"), dim))
        by_dim[dim] = (part.column("vec_id").to_numpy(),
                       part.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim))
    seeds = spark.sparkContext.broadcast(by_dim)

    def first_bounds(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            floors = []
            for row in range(len(pdf)):
                ids, q = _unpack(pdf["ids"].iloc[row], pdf["vectors"].iloc[row], int(pdf["dim"].iloc[row]))
                own, x = seeds.value.get(int(pdf["dim"].iloc[row]), (np.zeros(0, np.int64), np.zeros((0, q.shape[1]))))
                score = q @ x.T
                score[ids[:, None] == own[None]] = -np.inf
                floor = np.full(len(q), -np.inf)
                if score.shape[1] >= k:
                    floor = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
                floors.append(floor.astype("<f8").tobytes())
            yield pdf.assign(floors=floors)

    asked_all = (queries.mapInPandas(first_bounds, "block int, dim int, numbers binary, ids binary, vectors binary, floors binary")
                 .withColumnsRenamed({"numbers": "q_numbers", "ids": "q_ids", "vectors": "q_vectors"})
                 .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    met = index.drop("numbers").repartition(shards, "shard").join(asked_all.repartition(shards, "shard").hint("merge"), ["shard", "dim"])

    def search(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, of = None, None
        for pdf in pdfs:
            for row in range(len(pdf)):
                dim = int(pdf["dim"].iloc[row])
                if of != (pdf["shard"].iloc[row], dim):
                    of = (pdf["shard"].iloc[row], dim)
                    tree = Tree(*_unpack(pdf["ids"].iloc[row], pdf["vectors"].iloc[row], dim))
                ids, q = _unpack(pdf["q_ids"].iloc[row], pdf["q_vectors"].iloc[row], dim)
                bounds, floors = tree.bounds(q), np.frombuffer(pdf["floors"].iloc[row], "<f8")
                numbers = np.frombuffer(pdf["q_numbers"].iloc[row], "<i8")
                found = [(n, i, -v, s) for n, i, x, b, f in zip(numbers.tolist(), ids.tolist(), q, bounds, floors.tolist())
                         for s, v in tree.search(i, x, b, k, f)]
                columns = ["query_row", "query_id", "vec_id", "score"]
                yield pd.DataFrame(found, columns=columns).astype({c: "int64" for c in columns})

    found = met.mapInPandas(search, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op8_top_k(table: DataFrame) -> DataFrame:
    """Contract columns: query_id, rank, vec_id, score."""
    return top_k(table, F.col("vec_id") % 20 == 0)


#: DuckDB: every query against every row.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS number, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, q.number, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
