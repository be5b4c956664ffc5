"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: ``A``-``Z`` lower-cased, words split at ASCII white space,
``shingle`` words joined by one space, XXH64 (seed 42) of each shingle,
repeats included; a bit is 1 if it is set in more than half of the hashes. A
text with fewer words is one shingle; without words the fingerprint is 0.

Index: only distinct fingerprints are compared, so exact copies never pair
up. The 64 bits are cut into ``max_bits + 4`` blocks; two fingerprints within
``max_bits`` agree in four of them at least, so each fingerprint joins one
group for each choice of four blocks (15 choices for 2 bits). A group fixes
42 bits or more, so it holds at most 2**22 distinct fingerprints whatever the
data: that bounds the memory of its task. In a group the fingerprints are
sorted by Gray rank; runs of neighbours share bits, and a tree of runs keeps,
for each node, the bits it shares beyond its parent. A search adds up the
differences on the way down and drops a whole run once they exceed the limit.
A group emits a spanning forest of its links, never all of its pairs, and
:func:`revlens.llm.components.components` joins the forests.

Defined results: a null or empty text has no words. Rows with equal texts are
linked, rows that share a doc_id are rows of their own; a null doc_id is
ignored in the minimum (``component_id`` is null only if every id of the
component is). Other columns are never read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import LOWER, WHITE, bound_batches, chunks, flat, records, spans, written
from revlens.llm.components import components

#: Fixed value of the contract.
SEED = 42
_SHINGLES_AT_ONCE = 1 << 16


# ------------------------------------------------------------ fingerprints

def _shingle_hashes(part: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, and the document (from 0) of each."""
    part = LOWER[part]
    inside = ~WHITE[part]
    starts, ends, first = spans(inside, at)
    lengths = ends - starts
    word = np.arange(len(starts))
    joined = np.full(int(lengths.sum()) + len(starts), 0x20, np.uint8)
    joined[np.arange(len(joined) - len(starts)) + np.repeat(word, lengths)] = part[inside]
    new_ends = np.cumsum(lengths) + word
    new_starts = new_ends - lengths
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    end = first[1:][owner]
    last = np.minimum(word + k, end) - 1
    valid = (word + k <= end) | (word == first[:-1][owner])
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    a, b = new_starts[valid].tolist(), new_ends[last[valid]].tolist()
    hashes = np.fromiter((digest(raw[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(a))
    return hashes, owner[valid]


def fingerprint_array(texts: pa.Array, k: int) -> np.ndarray:
    data, offs = flat(texts)
    ones = np.zeros((len(offs) - 1, 64), np.int64)
    total = np.zeros(len(offs) - 1, np.int64)
    for i, j in chunks(offs):
        hashes, owner = _shingle_hashes(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], k)
        for s in range(0, len(hashes), _SHINGLES_AT_ONCE):
            h, own = hashes[s:s + _SHINGLES_AT_ONCE], owner[s:s + _SHINGLES_AT_ONCE] + i
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.flatnonzero(np.diff(own, prepend=-1))
            ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
            total[own[first]] += np.diff(first, append=len(own))
    return np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp)`` for every row; ``fp`` holds the 64 bits as
    a signed long, ``text_hash`` tells rows of one id apart."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("text_hash", T.LongType()),
                           T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprint_array(batch.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(run, schema)


# -------------------------------------------------------- Gray-order index

_LEAF, _FAN = 16, 8


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """From the root to the leaves: shared-bit mask and pattern of each run,
    and the run's length."""
    out, width = [], _LEAF
    while True:
        start = np.arange(0, len(codes), width)
        first = np.repeat(codes[start], width)[:len(codes)]
        mask = ~np.bitwise_or.reduceat(codes ^ first, start)
        out.append((mask, codes[start] & mask, width))
        if len(start) == 1:
            return out[::-1]
        width *= _FAN


def near_pairs(codes: np.ndarray, max_bits: int, at_once: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of all pairs within ``max_bits``, for codes in Gray
    order; yielded by blocks of queries."""
    levels, n = _levels(codes), len(codes)
    for lo in range(0, n, at_once):
        q = np.arange(lo, min(n, lo + at_once))
        mask, pattern, _ = levels[0]
        node = np.zeros(len(q), np.int64)
        acc = np.bitwise_count((codes[q] ^ pattern[0]) & mask[0]).astype(np.int64)
        keep = acc <= max_bits
        q, node, acc = q[keep], node[keep], acc[keep]
        for (above, _, _), (mask, pattern, width) in zip(levels, levels[1:]):
            child = (node[:, None] * _FAN + np.arange(_FAN)).ravel()
            q, acc, up = np.repeat(q, _FAN), np.repeat(acc, _FAN), np.repeat(node, _FAN)
            # a run that ends before its query holds no j > i
            real = (child < len(mask)) & ((child + 1) * width > q)
            q, acc, up, node = q[real], acc[real], up[real], child[real]
            acc = acc + np.bitwise_count((codes[q] ^ pattern[node]) & mask[node] & ~above[up])
            keep = acc <= max_bits
            q, acc, node = q[keep], acc[keep], node[keep]
        mask = levels[-1][0]
        j = (node[:, None] * _LEAF + np.arange(_LEAF)).ravel()
        q, acc, node = np.repeat(q, _LEAF), np.repeat(acc, _LEAF), np.repeat(node, _LEAF)
        real = (j < n) & (j > q)
        q, j, acc, node = q[real], j[real], acc[real], node[real]
        near = acc + np.bitwise_count((codes[q] ^ codes[j]) & ~mask[node]) <= max_bits
        yield q[near], j[near]


def spanning_links(codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly what the pairs within ``max_bits`` join, one
    for each code but one of each component."""
    codes = codes[np.argsort(gray_rank(codes), kind="stable")]
    label = np.arange(len(codes))
    for i, j in near_pairs(codes, max_bits):
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                jumped = label[label]
                if np.array_equal(jumped, label):
                    break
                label = jumped
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return codes[moved], codes[label[moved]]


def block_masks(max_bits: int) -> list[int]:
    """Masks of every choice of four among ``max_bits + 4`` blocks of bits."""
    n = max_bits + 4
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(four) for four in itertools.combinations(blocks, 4)]


def links(codes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``(u, v)`` among the distinct longs of column ``fp`` whose
    transitive closure is that of all pairs within ``max_bits``."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(max_bits)]
    keyed = codes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed]))
                         .alias("choice", "masked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, parts = None, []

        def found(groups: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            pairs = [spanning_links(g, max_bits) for g in groups if len(g) > 1]
            u, v = (np.concatenate([p[s] for p in pairs] or [np.zeros(0, np.uint64)]).view(np.int64) for s in (0, 1))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            choice, masked, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "masked", "fp"))
            if not len(fp):
                continue
            fp = fp.view(np.uint64)
            start = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (masked[1:] != masked[:-1])])
            end = np.r_[start[1:], len(fp)]
            groups = []
            if open_key == (choice[0], masked[0]):
                parts.append(fp[:end[0]])
            else:
                groups.append(np.concatenate(parts) if parts else fp[:0])
                parts = [fp[:end[0]]]
            if len(start) > 1:
                groups.append(np.concatenate(parts))
                several = np.flatnonzero(end[1:-1] - start[1:-1] > 1) + 1
                groups += [fp[start[g]:end[g]] for g in several.tolist()]
                parts = [fp[start[-1]:]]
            open_key = (choice[-1], masked[-1])
            yield from found(groups)
        yield from found([np.concatenate(parts)] if parts else [])

    return (keyed.repartition("choice", "masked").sortWithinPartitions("choice", "masked")
            .mapInArrow(run, "u long, v long"))


# ----------------------------------------------------------------- results

def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``(doc_id, text_hash, fp, label, component_id)`` for every row;
    ``label`` is the smallest fingerprint of the component."""
    prints = written(fingerprints(docs, shingle))
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    stars = components(links(least, max_bits))
    labelled = least.join(stars, least["fp"] == stars["node"], "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label"))
    component = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return prints.join(labelled.select("fp", "label").join(component, "label"), "fp").select(
        "doc_id", "text_hash", "fp", "label", "component_id")


def op6_simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, fingerprint, component_id."""
    return near_groups(docs, shingle=3, max_bits=2).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the
    row with the smallest doc_id stays (of repeated rows, one)."""
    groups = near_groups(docs, shingle, max_bits)
    stays = (groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy("label").agg(F.min("text_hash").alias("hash"), F.first("component_id").alias("id"))
             .groupBy("id", "hash").agg(F.lit(1).alias("one")).drop("one"))
    rows = records(docs).withColumn("text_hash", F.xxhash64(F.coalesce("record.text", F.lit(""))))
    met = rows.join(stays, F.col("record.doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    # one of rows that repeat; they differ in other columns at most
    first = F.min(F.struct(*[F.col(f"record.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]))
    return met.groupBy("id", "hash").agg(first.alias("first")).select(*[
        F.col(f"first.c{i}").alias(c) for i, c in enumerate(docs.columns)])
