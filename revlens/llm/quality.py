"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

Terms describe how a text is written, not what it says: 4-grams of character
kinds (letters, capitals, digits, spaces, line ends and classes of
punctuation, runs of letters, digits and spaces counting once), the distance
of each word to its last occurrence, word lengths and the text's length. A
text's term frequencies, square-rooted and weighted by entropy, are projected
on the first ``RANK`` latent dimensions of the reference texts.

The reference is a bounded sample of labelled documents, the
``REFERENCE`` rows of each label with the smallest hash of their id; their
latent vectors (under 1 MB) are broadcast. Every document of the table then
meets all of them in blocked cosine products, and its ``NEIGHBOURS`` nearest
vote with a power of their similarity, weighted so that each label counts as
often as it occurs among all labelled rows.

Defined results: a null text is an empty one; an empty text has length terms
only and is scored like any other. Ties at the last neighbour all vote.
Without labelled rows every score is 0.5. Rows that share a doc_id are rows
of their own; labels with a null quality or id are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import WHITE, bound_batches, chunks, flat, free_name, held_out, mix, span_hashes, spans

REFERENCE, RANK, NEIGHBOURS, POWER = 2048, 48, 25, 12
#: Fixed value of the contract: the least score of a good document.
THRESHOLD = 0.3
SHAPES, GAPS, LENGTHS, SIZES = 2048, 9, 17, 24
TERMS = SHAPES + GAPS + LENGTHS + SIZES
#: Parts of a text's unit of frequency that the kinds of terms get.
_SHARE = (0.5, 0.35, 0.1, 0.05)

_KIND = np.full(256, 14, np.uint8)
_KIND[list(range(97, 123)) + list(range(128, 256))] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[WHITE] = 4
_KIND[10] = 5
for _code, _bytes in ((6, "."), (7, ","), (8, "!?"), (9, "|"), (10, "-_"), (11, ":;/\\"), (12, "'\"()[]{}<>"),
                      (13, "#$%&*@+=~^")):
    _KIND[[ord(c) for c in _bytes]] = _code
_ONCE = np.isin(np.arange(16), (1, 2, 3, 4))


def _add(out: np.ndarray, owner: np.ndarray, term: np.ndarray, base: int, size: int, share: float) -> None:
    n = len(out)
    count = np.bincount(owner * size + term, minlength=n * size).reshape(n, size)
    out[:, base:base + size] = count * (share / np.maximum(count.sum(axis=1, keepdims=True), 1))


def term_frequencies(part: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of each term in each text of a chunk."""
    n = len(at) - 1
    out = np.zeros((n, TERMS), np.float32)
    size = np.diff(at)
    kind = _KIND[part]
    owner = np.repeat(np.arange(n), size)
    keep = np.ones(len(kind), bool)
    keep[1:] = ~((kind[1:] == kind[:-1]) & _ONCE[kind[1:]] & (owner[1:] == owner[:-1]))
    kind, own = kind[keep].astype(np.uint64), owner[keep]
    if len(kind) > 3:
        gram = ((kind[:-3] * np.uint64(16) + kind[1:-2]) * np.uint64(16) + kind[2:-1]) * np.uint64(16) + kind[3:]
        same = own[:-3] == own[3:]
        _add(out, own[:-3][same], (mix(gram[same]) % np.uint64(SHAPES)).astype(np.int64), 0, SHAPES, _SHARE[0])
    inside = ~WHITE[part]
    starts, ends, first = spans(inside, at)
    n_words = np.diff(first)
    if len(starts):
        h = span_hashes(part[inside], ends - starts)
        word_of = np.repeat(np.arange(n), n_words)
        order = np.lexsort((h, word_of))
        gap = np.zeros(len(h), np.int64)
        again = (h[order][1:] == h[order][:-1]) & (word_of[order][1:] == word_of[order][:-1])
        gap[order[1:][again]] = (order[1:] - order[:-1])[again]
        bin_ = np.where(gap == 0, 0, np.minimum(1 + np.ceil(np.log2(np.maximum(gap, 1))).astype(np.int64), GAPS - 1))
        _add(out, word_of, bin_, SHAPES, GAPS, _SHARE[1])
        _add(out, word_of, np.minimum(ends - starts, LENGTHS - 1), SHAPES + GAPS, LENGTHS, _SHARE[2])
    length = np.minimum(np.ceil(np.log2(n_words + 1)).astype(np.int64), SIZES - 1)
    out[np.arange(n), SHAPES + GAPS + LENGTHS + length] = _SHARE[3]
    return np.sqrt(out)


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offs = flat(column)
    for i, j in chunks(offs):
        for a in range(i, j, 2048):  # very short texts: bound the dense rows too
            b = min(j, a + 2048)
            yield a, b, term_frequencies(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a])


def fit(docs: DataFrame, labels: DataFrame, bound: int = REFERENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Term weights times projection, unit reference vectors, their labels and
    vote weights; None without labelled rows."""
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(
        "doc_id is not null and quality is not null").where(~held_out("doc_id", 5, 0)).distinct()
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):  # a bounded sample of each label
        part = rows.where(F.col("label") == label).orderBy(order, "doc_id").limit(bound)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _features(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a),
                     pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["doc_id", "label", "x"])

    found = texts.mapInArrow(run, T.StructType([texts.schema["doc_id"], T.StructField("label", T.IntegerType()),
                                                T.StructField("x", T.BinaryType())])).toArrow()
    if not found.num_rows:
        return None
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float16).reshape(-1, TERMS).astype(np.float32)
    label = found.column("label").to_numpy()
    # repeated ids may bring more rows than the sample has; order fixes ties
    by = np.lexsort((x @ np.arange(1, TERMS + 1, dtype=np.float32), found.column("doc_id").to_numpy()))
    x, label = x[by], label[by]
    weight = entropy_weights(x)
    x = x * weight
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    projection = vectors[:, ::-1][:, :RANK]
    reference = unit(x @ projection.astype(np.float32))
    vote = np.array([total[k] / max(1, (label == k).sum()) for k in label.tolist()])
    return (weight[:, None] * projection).astype(np.float32), reference, label.astype(np.float32), vote.astype(np.float32)


def entropy_weights(x: np.ndarray) -> np.ndarray:
    """One minus the normalised entropy of each term over the texts: terms
    that all texts share alike say little."""
    p = x / np.maximum(x.sum(axis=0), 1e-12)
    h = -(p * np.log(np.maximum(p, 1e-12))).sum(axis=0) / np.log(max(2, len(x)))
    return (1.05 - np.minimum(h, 1.0)).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def votes(x: np.ndarray, model: tuple) -> np.ndarray:
    """Score of each row of term frequencies."""
    projection, reference, label, vote = model
    near = unit(x @ projection) @ reference.T
    k = min(NEIGHBOURS, near.shape[1])
    least = np.partition(near, near.shape[1] - k, axis=1)[:, -k]
    near = np.where(near >= least[:, None] - 1e-6, np.maximum(near, 1e-3) ** POWER, 0) * vote
    # rounded, as a matrix product's last bits vary with the rows beside it
    return np.round(np.clip((near @ label) / near.sum(axis=1), 0.0, 1.0).astype(np.float64), 5)


def scored(docs: DataFrame, labels: DataFrame, column: str = "score") -> DataFrame:
    """Every row of ``docs`` with its columns and ``column`` behind them."""
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if model.value is not None:
                for a, b, x in _features(batch.column(place)):
                    score[a:b] = votes(x, model.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    score = free_name(docs, "score")
    return scored(docs, labels, score).where(F.col(score) >= THRESHOLD).drop(score)
