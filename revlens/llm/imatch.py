"""Document fingerprints: I-Match over randomised lexicons.

Terms are the lower-cased runs of letters and digits. A term is kept if its
inverse document frequency, as a share of the largest possible one, lies in
``BAND``: of N documents it is in N**0.45 at least and in N**0.75 at most, so
terms of most documents go, and rare ones, those of a single document first.
The kept terms of a text, sorted and distinct, are hashed once for each of
``LEXICONS`` randomised lexicons.

A departure from plain I-Match: a fixed lexicon suits texts of one length only
(of a long text it keeps many terms, so every edit changes the hash; of a short
one it may keep none). So each lexicon is a family of nested subsets, each with
half of the terms of the one before, and a text uses the smallest subset that
holds any of its terms. Two texts then agree on about as many of the hashes as
they share terms, and ``likeness`` is that share: 1 for equal texts, near 0 for
unrelated ones.

Document frequencies cover all documents. They are counted in ``TABLES`` tables
of ``SLOTS`` slots by different bits of the terms' hashes, and a term has the
least of its slots' counts (count-min). That is never below its frequency, and
above it by what rare terms share both slots: some documents, while the band
begins at a power of all, which grows faster. So the tables have one
size for every corpus (16 MB counted, 0.5 MB broadcast as bits).

Defined results: a null text is an empty one. A text without a term in the
band is hashed over all its terms, a text without terms over its bytes, so
equal texts always have equal fingerprints. A very long text is handled with
its Arrow batch, whole. An empty table gives no rows. The next document follows in the
order of (doc_id, text), null ids last, and the first follows the last; rows
that share a doc_id are rows of their own. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import bound_batches, chunks, flat, mix, span_hashes, spans

LEXICONS = 48
BAND = (0.25, 0.55)
TABLES, SLOTS, _CHUNK = 2, 1 << 20, 1 << 14
#: Rows of a range of neighbouring documents, and the most ranges.
RANGE_ROWS, MOST_RANGES = 8192, 4096

#: Bytes of terms: ASCII letters and digits, and all bytes of other letters.
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SEEDS = mix(np.arange(1, LEXICONS + 1, dtype=np.uint64)) | np.uint64(1)


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of documents i..j: the sorted distinct term hashes of each
    document, and the document (from i) of each."""
    data, offs = flat(column)
    for i, j in chunks(offs):
        part, at = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        inside = _TERM[part]
        starts, ends, first = spans(inside, at)
        h = span_hashes(part[inside], ends - starts)
        owner = np.repeat(np.arange(j - i), np.diff(first))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        yield i, j, h[new], owner[new]


def _slot(h: np.ndarray, table: int) -> np.ndarray:
    return (h >> np.uint64(20 + 20 * table)).astype(np.int64) & (SLOTS - 1)


# ------------------------------------------------------ document frequencies

def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and for each table and slot the (document, term)
    pairs."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((TABLES, SLOTS), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, h, _ in _terms(batch.column("text")):
                for t in range(TABLES):
                    np.add.at(df[t], _slot(h, t), 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(TABLES * SLOTS // _CHUNK)], pa.int32()),
             pa.array([zlib.compress(np.array([n], "<i8").tobytes()),
                       *(zlib.compress(x.astype("<i8").tobytes(), 1) for x in np.split(df.ravel(), TABLES * SLOTS // _CHUNK))],
                      pa.binary())], ["chunk", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sum for each of the 129 chunks at most, however many rows come
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                x = np.frombuffer(zlib.decompress(data), "<i8")
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
            ["chunk", "counts"])

    fields = "chunk int, counts binary"
    found = docs.select("text").mapInArrow(count, fields).repartition("chunk").mapInArrow(total, fields).collect()
    by_chunk = {r["chunk"]: np.frombuffer(r["counts"], "<i8") for r in found}
    if not by_chunk:
        return 0, np.zeros((TABLES, SLOTS), np.int64)
    counts = np.concatenate([by_chunk[k] for k in range(TABLES * SLOTS // _CHUNK)])
    return int(by_chunk[-1][0]), counts.reshape(TABLES, SLOTS)


class Band:
    """Which terms are kept: bits of the slots that are frequent enough, and
    of those that are rare enough. The least count of a term's slots is in the
    band if all are frequent enough and one is rare enough."""

    def __init__(self, n_docs: int, df: np.ndarray, band: tuple[float, float] = BAND) -> None:
        if n_docs < 2:
            often = rare = np.ones(df.shape, bool)
        else:
            share = np.log(n_docs / np.maximum(df, 1)) / np.log(n_docs)
            often, rare = share <= band[1], share >= band[0]
        self.bits = np.packbits(np.stack([often, rare]))

    def keeps(self, h: np.ndarray) -> np.ndarray:
        often, rare = np.ones(len(h), bool), np.zeros(len(h), bool)
        for t in range(TABLES):
            slot = _slot(h, t)
            often &= self._bit(t * SLOTS + slot)
            rare |= self._bit((TABLES + t) * SLOTS + slot)
        return often & rare

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


# ------------------------------------------------------------- fingerprints

def fingerprint_array(column: pa.Array, kept: Band) -> np.ndarray:
    """``LEXICONS`` hashes of 32 bits for each text."""
    out = np.zeros((len(column), LEXICONS), np.uint32)
    data, offs = flat(column)
    for i, j, h, owner in _terms(column):
        keep = kept.keeps(h)
        has = np.zeros(j - i, bool)
        has[owner[keep]] = True
        keep |= ~has[owner]
        h, owner = h[keep], owner[keep]
        bare = np.setdiff1d(np.arange(j - i), owner)
        if len(bare):  # no terms at all: the bytes of the text
            raw = [data[offs[i + k]:offs[i + k + 1]].tobytes() for k in bare.tolist()]
            own = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in raw], np.uint64)
            owner = np.concatenate([owner, bare])
            order = np.argsort(owner, kind="stable")
            h, owner = np.concatenate([h, own])[order], owner[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for s in range(0, LEXICONS, 16):
            # place of each term in each lexicon family: the subset number is
            # the number of leading zeros
            place = h[:, None] * _SEEDS[None, s:s + 16]
            least = np.minimum.reduceat(place, first, axis=0)
            # the smallest subset with a term of the text: places below the
            # next power of two
            for shift in (1, 2, 4, 8, 16, 32):
                least |= least >> np.uint64(shift)
            place[place > least[owner]] = 0
            out[i:j, s:s + 16] = (mix(np.add.reduceat(place, first, axis=0)) >> np.uint64(32)).astype(np.uint32)
    return out


def as_text(prints: np.ndarray) -> pa.Array:
    raw = prints.astype(">u4").tobytes().hex()
    n = 8 * LEXICONS
    return pa.array([raw[k:k + n] for k in range(0, len(raw), n)], pa.string())


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """``(doc_id, fingerprint)`` for every row."""
    kept = docs.sparkSession.sparkContext.broadcast(Band(*document_frequencies(docs), band))
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), as_text(fingerprint_array(batch.column("text"), table))],
                ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("fingerprint", T.StringType())]))


# ---------------------------------------------------- next document and edit

_LAST = (1 << 63) - 1


def with_next(docs: DataFrame, n_docs: int) -> DataFrame:
    """``(range, tail, doc_id, text)`` in partitions of neighbouring
    documents, in order; each range ends with the first document of the next
    one (``tail``), the last range with the first document of all."""
    n = min(MOST_RANGES, max(1, -(-n_docs // RANGE_ROWS)))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("place"),
                       F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("place", F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(20 * n))
                    if n > 1 else F.lit(None)).first()[0] or []
    cuts = sorted(set(cuts))
    bound = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    ranged = rows.withColumn("range", F.size(F.filter(bound, lambda c: c < F.col("place"))))
    least = sorted((r["range"], r["place"]) for r in
                   ranged.groupBy("range").agg(F.min("place").alias("place")).collect())
    # the first place of each range, and the range before it
    owner = {place: least[k - 1][0] for k, (_, place) in enumerate(least)}
    if not owner:
        return ranged.select("range", F.lit(False).alias("tail"), "doc_id", "text")
    before = F.element_at(F.create_map(*[F.lit(x).cast(t) for place, k in owner.items()
                                         for x, t in ((place, "long"), (k, "int"))]), F.col("place"))
    out = ranged.select("*", F.explode(F.when(before.isNull(), F.array(F.struct("range", F.lit(False).alias("tail"))))
                                       .otherwise(F.array(F.struct("range", F.lit(False).alias("tail")),
                                                          F.struct(before.alias("range"), F.lit(True).alias("tail"))))
                                       ).alias("own"))
    return (out.select(F.col("own.range").alias("range"), F.col("own.tail").alias("tail"), "place", "doc_id", "text")
            .repartition(len(least), "range").sortWithinPartitions("range", "tail", "place", "text")
            .select("range", "tail", "doc_id", "text"))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first code points of the
    following text (or by all of it)."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def op2_imatch(docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    n_docs, df = document_frequencies(docs)
    kept = docs.sparkSession.sparkContext.broadcast(Band(n_docs, df))
    rows = with_next(docs, n_docs)
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept.value
        waiting: pa.RecordBatch | None = None
        for batch in batches:
            if waiting is not None:
                batch = pa.concat_batches([waiting, batch])
            if not batch.num_rows:
                continue
            waiting = batch.slice(batch.num_rows - 1)
            own = np.flatnonzero(~batch.column("tail").to_numpy(zero_copy_only=False)[:-1])
            if not len(own):
                continue
            texts = batch.column("text").to_pylist()
            prints = fingerprint_array(batch.column("text"), table)
            new = pa.array([edited(texts[k], texts[k + 1]) for k in own.tolist()], pa.string())
            new_prints = fingerprint_array(new, table)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(own)), pa.array([len(texts[k]) for k in own.tolist()], pa.int64()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new.to_pylist()], pa.string()),
                 as_text(prints[own]), as_text(new_prints), pa.array(likeness(prints[own], new_prints)),
                 pa.array(likeness(prints[own], prints[own + 1]))], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
