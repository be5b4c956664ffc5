"""Language ID with error-correcting output codes.

Each learned language has a codeword; for each bit of the code a binary
classifier separates the languages whose bit is 1 from the others by the
log-odds of character n-grams (naive Bayes over hashed byte bigrams and
trigrams of the lower-cased words). The n-gram counts cover all training
documents and are one small table per language. A text's bit margins are
decoded by loss: the language whose codeword has the least weighted logistic
loss wins, bits weighing as much as they separate the languages; the codeword
that comes second tells how ambiguous the choice is.

Up to ``EXHAUSTIVE`` languages the code has every split of the languages;
beyond, random splits with the largest least distance of many draws.

Defined results: null texts and texts without a letter are ``und`` with score
0 and not ambiguous, and so is every text if nothing was learned. A null id
is never held out. Rows that share a doc_id are rows of their own. Other
columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import LOWER, bound_batches, chunks, flat, held_out

TERMS = 4096
EXHAUSTIVE = 7
#: A text's margins are its average log-odds times SHARPNESS; SHORT n-grams
#: halve them. PRIOR is the pseudo-count of an n-gram, AMBIGUOUS the lead in
#: loss under which a choice is flagged.
SHARPNESS, SHORT, PRIOR, AMBIGUOUS = 6.0, 20, 0.5, 0.25
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.where(_LETTER, LOWER, 32).astype(np.uint8)


def ngrams(part: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams: a row for each text of a chunk."""
    n = len(at) - 1
    folded, owner = _FOLD[part], np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (owner[1:] != owner[:-1])
    folded, owner = folded[keep].astype(np.uint32), owner[keep]
    out = np.zeros(n * TERMS)
    for width in (2, 3):
        if len(folded) < width:
            continue
        gram = np.full(len(folded) - width + 1, width, np.uint32)
        for k in range(width):
            gram = gram * np.uint32(256) + folded[k:len(folded) - width + 1 + k]
        same = owner[:len(gram)] == owner[width - 1:]
        term = (gram[same] * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(owner[:len(gram)][same] * TERMS + term, minlength=n * TERMS)
    return out.reshape(n, TERMS)


def _chunked(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offs = flat(column)
    for i, j in chunks(offs):
        for a in range(i, j, 512):
            b = min(j, a + 512)
            yield a, b, ngrams(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a])


def language_counts(docs: DataFrame, train: Column) -> dict[str, np.ndarray]:
    """n-gram counts of each language over all training documents."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            code = batch.column("lang").dictionary_encode()
            names, code = code.dictionary.to_pylist(), code.indices.to_numpy()
            for a, b, x in _chunked(batch.column("text")):
                for k in np.unique(code[a:b]).tolist():
                    sums[names[k]] = sums.get(names[k], 0) + x[code[a:b] == k].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()),
             pa.array([TaskContext.get().partitionId() % 64] * len(sums), pa.int32()),
             pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for x in sums.values()], pa.binary())],
            ["lang", "salt", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, salt, data in zip(*(c.to_pylist() for c in batch.columns)):
                sums[lang, salt] = sums.get((lang, salt), 0) + np.frombuffer(zlib.decompress(data), "<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()),
             pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["lang", "salt", "counts"])

    fields = "lang string, salt int, counts binary"
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    parts = rows.mapInArrow(count, fields).repartition("lang", "salt").mapInArrow(total, fields)
    found = parts.withColumn("salt", F.lit(0)).repartition("lang").mapInArrow(total, fields).collect()
    return {r["lang"]: np.frombuffer(zlib.decompress(r["counts"]), "<i8") for r in sorted(found, key=lambda r: r["lang"])}


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages."""
    if n <= EXHAUSTIVE:
        return np.array([[1 if k == 0 or s >> (k - 1) & 1 else -1 for s in range(max(1, 2 ** (n - 1) - 1))]
                         for k in range(n)])
    rng, bits = np.random.default_rng(0), 8 * int(np.ceil(np.log2(n)))
    best, distance = None, -1
    for _ in range(64):
        code = rng.choice([-1, 1], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]  # both sides of a split
        apart = ((code.shape[1] - code @ code.T) // 2 + np.eye(n, dtype=int) * bits).min()
        if apart > distance:
            best, distance = code, apart
    return best


def fit(counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None:
    """Languages, codewords, n-gram log-odds of each bit, weight of each bit."""
    if not counts:
        return None
    names = list(counts)
    table = np.array([counts[k] for k in names], float) + PRIOR
    p = table / table.sum(axis=1, keepdims=True)
    code = codewords(len(names))
    if len(names) == 1:
        return names, code, np.zeros((TERMS, 1), np.float32), np.ones(1)
    odds = np.stack([np.log(p[c > 0].mean(axis=0)) - np.log(p[c < 0].mean(axis=0)) for c in code.T], axis=1)
    apart = ((p @ odds) * code).min(axis=0)  # how surely a bit is right in its worst language
    weight = np.maximum(apart, 0.05 * np.abs(apart).max())
    return names, code, odds.astype(np.float32), weight / weight.sum()


def decode(x: np.ndarray, model: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score and ambiguity of each row of n-gram counts."""
    names, code, odds, weight = model
    margin = SHARPNESS * (x @ odds) / (x.sum(axis=1, keepdims=True) + SHORT)
    loss = np.logaddexp(0, -margin[:, None, :] * code[None]) @ weight
    likely = np.exp(loss.min(axis=1, keepdims=True) - loss)
    order = np.sort(loss, axis=1)
    close = order[:, 1] - order[:, 0] < AMBIGUOUS if len(names) > 1 else np.zeros(len(x), bool)
    # rounded, as a matrix product's last bits vary with the rows beside it
    return loss.argmin(axis=1), np.round(likely.max(axis=1) / likely.sum(axis=1), 6), close


def _has_letter(column: pa.Array) -> np.ndarray:
    data, offs = flat(column)
    ascii_letter = _LETTER[data] & (data < 128)
    upto = np.concatenate([[0], np.cumsum(ascii_letter)])[offs]
    out = np.diff(upto) > 0
    for k in np.flatnonzero(~out & (np.diff(offs) > 0)).tolist():
        out[k] = any(map(str.isalpha, column[k].as_py()))
    return out


def languages(docs: DataFrame, train: Column) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` for every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(language_counts(docs, train)))
    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            name, score, close = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n, bool)
            if model.value is not None:
                names = np.array(model.value[0], object)
                lettered = _has_letter(batch.column("text"))
                for a, b, x in _chunked(batch.column("text")):
                    own = np.flatnonzero(lettered[a:b])
                    if len(own):
                        k, s, c = decode(x[own].astype(np.float32), model.value)
                        name[a + own], score[a + own], close[a + own] = names[k], s, c
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score), pa.array(close)],
                [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def op4_language_id(docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, held_out, lang_pred, score; ambiguous."""
    out = languages(docs, ~held_out("doc_id", 5, 0))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")
