"""Language-model scoring with Brown class-based bigrams.

Every word has a class, and a text's probability is the product of
``P(class | class before) * P(word | class)`` over its words and one end.

Every training word is clustered by its own contexts, the counts of the classes
before and after it. Texts become blocks of word numbers with a block
dictionary; dictionaries are cut by hash into parts. A round of the exchange
counts contexts in the blocks and sums them in the parts, where each word goes
to the class that raises the class-bigram likelihood most; the new classes
return to the blocks by way of the checkpoint folder. Only the table of classes
by classes is broadcast. Words move at the same time, a half of them in each
round; a round after which the likelihood is lower is undone, and fewer words
move. Rounds go on until two raise the likelihood by less than ``RISE``. The ``SEEDS`` most frequent words, clustered among themselves
on the driver by one exchange after the other, only begin the rounds.

Smoothing: transitions are interpolated with the class shares; emissions use
absolute discounting within the class, and the discount's mass of all classes
goes to the unseen words, which are one class (what follows them is the mean of
the classes, weighted by their number of words); the result is interpolated
with the add-one unigram (``base_score``'s model), so no token is far below it.

Defined results: a null or empty text is one end token. Rows that share a
doc_id are rows of their own; a null id is never held out. Without training
rows the transitions are uniform and every token is unknown. Words are told apart
by 64-bit hashes. Other columns are never read.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from revlens.llm.common import WHITE, bound_batches, chunks, discard, flat, held_out, span_hashes, spans, written

SEEDS = 1024
CLASSES = 64
SWEEPS = 6
#: The end's class, the class of unseen words, and marks of a word without a
#: class yet and of one without training tokens.
END, UNSEEN, NONE, UNTRAINED = CLASSES, CLASSES + 1, 254, 255
#: Classes that are counted, and contexts of a word: the class after it and
#: the one before.
ALL = CLASSES + 1
CONTEXTS = 2 * ALL
#: Least rise of the likelihood, as a share, for one more round.
RISE = 0.002
#: One word in so many moves in the last rounds.
LEAST_SHARE = 16
#: Training tokens from which a word's gains are taken in full, not to the
#: first order (less where classes are small).
EXACT = 1024
#: Block words whose contexts are counted densely, words that a part handles at
#: once.
DENSE, AT_ONCE = 4096, 8192
#: Weight of the class model against the add-one unigram, and pseudo-counts of
#: the class shares in a transition.
CLASS_WEIGHT, TRANSITION_PRIOR = 0.8, 4.0
#: Text bytes of a block (a longer text is a block of its own), and dictionary
#: entries of a part.
BLOCK_BYTES, PART_WORDS = 8 << 20, 1 << 20


def _planes(values: np.ndarray) -> bytes:
    """Small unsigned numbers as compressed byte planes."""
    raw = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zlib.compress(raw.tobytes(), 1)


def _unplanes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


# ------------------------------------------------------------------ blocks

_BLOCK = ("block long, n_words int, hashes binary, counts binary, tokens binary, lengths binary, "
          "held binary")


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the number of words of each document."""
    data, offs = flat(column)
    hashes, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in chunks(offs):
        part, at = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        inside = ~WHITE[part]
        starts, ends, first = spans(inside, at)
        hashes.append(span_hashes(part[inside], ends - starts))
        n.append(np.diff(first))
    return np.concatenate(hashes), np.concatenate(n)


def encoded_blocks(docs: DataFrame, held: F.Column) -> DataFrame:
    """Blocks of documents: the dictionary of a block, its training counts and
    its documents as word numbers, the frequent words first."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", held.alias("held"), "text")
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType))]
                          + T._parse_datatype_string(_BLOCK).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        kept: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            parts = [_tokens(b.column("text")) for b in kept]
            hashes, lengths = (np.concatenate([p[k] for p in parts]) for k in range(2))
            train = ~np.concatenate([b.column("held").to_numpy(zero_copy_only=False) for b in kept])
            code, unique = pd.factorize(hashes)
            used = np.bincount(code, minlength=len(unique))
            counts = np.bincount(code[np.repeat(train, lengths)], minlength=len(unique))
            by_use = np.argsort(-used, kind="stable")
            rank = np.empty(len(by_use), np.int64)
            rank[by_use] = np.arange(len(by_use))
            ids = pa.concat_arrays([b.column("doc_id") for b in kept])
            values = [unique[by_use].astype("<u8").tobytes(),
                      _planes(counts[by_use]), _planes(rank[code]), _planes(lengths), np.packbits(~train).tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([number], pa.int64()),
                 pa.array([len(unique)], pa.int32()), *(pa.array([v], pa.binary()) for v in values)],
                [f.name for f in schema.fields])

        for batch in batches:
            _, offs = flat(batch.column("text"))
            for i, j in chunks(offs, BLOCK_BYTES):
                if kept and size + offs[j] - offs[i] > BLOCK_BYTES:
                    yield block()
                    kept, size, number = [], 0, number + 1
                kept.append(batch.slice(i, j - i))
                size += int(offs[j] - offs[i])
        if kept:
            yield block()

    return rows.mapInArrow(run, schema)


def _dictionary(pdf: pd.DataFrame, row: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(pdf["hashes"].iloc[row], "<u8"), _unplanes(pdf["counts"].iloc[row]).astype(np.int64)


# ------------------------------------------------------------- word counts

def counted_parts(blocks: DataFrame, parts: int) -> DataFrame:
    """For each part and block the training totals of the block's words and
    their numbers in the part, in the order of the block's dictionary; block -1
    has the part's vocabulary."""

    def cut(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in range(len(pdf)):
                hashes, counts = _dictionary(pdf, row)
                part = (hashes % np.uint64(parts)).astype(np.int64)
                for k in np.unique(part).tolist():
                    own = part == k
                    yield pd.DataFrame({
                        "part": [k], "block": [pdf["block"].iloc[row]], "hashes": [hashes[own].tobytes()],
                        "counts": [_planes(counts[own])]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [_dictionary(pdf, row) for row in range(len(pdf))]
        hashes, counts = (np.concatenate([e[k] for e in each]) for k in range(2))
        code, unique = pd.factorize(hashes, sort=True)
        sums = np.zeros(len(unique), np.int64)
        np.add.at(sums, code, counts)
        seen = np.flatnonzero(sums)
        ends = np.cumsum([len(e[0]) for e in each])
        codes = np.split(code, ends[:-1])
        return pd.DataFrame({
            "part": int(pdf["part"].iloc[0]), "block": [*pdf["block"], -1],
            "hashes": [b""] * len(pdf) + [unique[seen].tobytes()], "codes": [_planes(c) for c in (*codes, seen)],
            "totals": [_planes_long(sums[c]) for c in (*codes, seen)], "n_parts": parts})

    pieces = blocks.select("block", "hashes", "counts").mapInPandas(
        cut, "part int, block long, hashes binary, counts binary")
    return pieces.groupBy("part").applyInPandas(
        total, "part int, block long, hashes binary, codes binary, totals binary, n_parts int")


def _planes_long(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8).T
    return zlib.compress(raw.tobytes(), 1)


def _unplanes_long(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<i8").ravel()


# ----------------------------------------------------------- class training

def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def gains(table: np.ndarray, o: np.ndarray, i: np.ndarray, self_n: float) -> np.ndarray:
    """What the likelihood gains from a word in each class; ``table`` is
    without the word, ``o`` and ``i`` are its pairs to and from each class."""
    left, right = table.sum(axis=1), table.sum(axis=0)
    ow, iw = o.sum() + self_n, i.sum() + self_n
    gain = (_xlogx(table + o) - _xlogx(table)).sum(axis=1) + (
        _xlogx(table + i[:, None]) - _xlogx(table)).sum(axis=0)
    d = np.diagonal(table)
    gain += _xlogx(d + o + i + self_n) - _xlogx(d + o) - _xlogx(d + i) + _xlogx(d)
    gain -= _xlogx(left + ow) - _xlogx(left) + _xlogx(right + iw) - _xlogx(right)
    return gain


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item: exchange clustering that raises the likelihood of
    the class bigrams. Starts with the frequent items dealt in turn."""
    n = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n) % classes
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    table = member.T @ bigrams @ member
    out, into = bigrams @ member, bigrams.T @ member  # to and from each class
    for _ in range(sweeps):
        moved = 0
        for w in order.tolist():
            if not weight[w]:
                continue
            a, self_n, o, i = of[w], bigrams[w, w], out[w].copy(), into[w].copy()
            o[a] -= self_n
            i[a] -= self_n
            # without w
            table[a] -= o
            table[:, a] -= i
            table[a, a] -= self_n
            gain = gains(table, o, i, self_n)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            table[b] += o
            table[:, b] += i
            table[b, b] += self_n
            if b != a:
                moved += 1
                of[w] = b
                out[:, a] -= bigrams[:, w]
                out[:, b] += bigrams[:, w]
                into[:, a] -= bigrams[w]
                into[:, b] += bigrams[w]
        if not moved:
            break
    return of


class Model(NamedTuple):
    transition: np.ndarray  #: P(class | class before), the last row after unseen words
    mass: np.ndarray  #: training tokens of each class
    types: np.ndarray  #: training words of each class
    discount: float
    train_tokens: int
    vocabulary: int
    ends: int


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for what no classes change."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def _seed_classes(hashes: np.ndarray, seeds: np.ndarray, of: np.ndarray, other: int = NONE) -> np.ndarray:
    """Classes of the seeds (sorted hashes) among ``hashes``; others have none."""
    out = np.full(len(hashes), other, np.int64)
    if len(seeds):
        at = np.minimum(np.searchsorted(seeds, hashes), len(seeds) - 1)
        hit = seeds[at] == hashes
        out[hit] = of[at[hit]]
    return out


def _sequence(pdf: pd.DataFrame, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number of each token with the ends (-1: end), the number of tokens
    of each document, and whether it is held out."""
    tokens, lengths = (_unplanes(pdf[c].iloc[row]).astype(np.int64) for c in ("tokens", "lengths"))
    ends = np.cumsum(lengths + 1) - 1
    word = np.full(len(tokens) + len(lengths), -1, np.int64)
    inner = np.ones(len(word), bool)
    inner[ends] = False
    word[inner] = tokens
    held = np.unpackbits(np.frombuffer(pdf["held"].iloc[row], np.uint8))[:len(lengths)].astype(bool)
    return word, lengths + 1, held


def _summed(frame: DataFrame, size: int) -> np.ndarray:
    """Sum of the ``table`` columns, each a compressed table of ``size``
    numbers: added up in each task, then by place."""

    def add(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(size, np.int64)
        for pdf in pdfs:
            for data in pdf["table"]:
                out += _unplanes_long(data)
        at = np.flatnonzero(out)
        yield pd.DataFrame({"code": at, "n": out[at]})

    found = frame.select("table").mapInPandas(add, "code long, n long").groupBy("code").agg(
        F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out


def _seeds(blocks: DataFrame, vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and classes of the most frequent words."""

    def frequent(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in range(len(pdf)):
                hashes, sums = np.frombuffer(pdf["hashes"].iloc[row], "<u8"), _unplanes_long(pdf["totals"].iloc[row])
                top = np.lexsort((hashes, -sums))[:SEEDS]
                yield pd.DataFrame({"hash": hashes[top].astype(np.int64), "n": sums[top]})

    top = vocabulary.mapInPandas(frequent, "hash long, n long").orderBy(F.desc("n"), "hash").limit(SEEDS).collect()
    seeds = np.sort(np.array([r["hash"] for r in top], np.int64).view(np.uint64))
    # other words and the end stand beside the seeds
    items, numbers = SEEDS + 2, np.arange(2, len(seeds) + 2)

    def pairs(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(items * items, np.int64)
        for pdf in pdfs:
            for row in range(len(pdf)):
                word, n, held = _sequence(pdf, row)
                item = _seed_classes(np.frombuffer(pdf["hashes"].iloc[row], "<u8"), seeds, numbers, 0)
                item = np.append(item, 1)[word[np.repeat(~held, n)]]
                before = np.append(1, item[:-1])[:len(item)]
                out += np.bincount(before * items + item, minlength=len(out))
        at = np.flatnonzero(out)
        yield pd.DataFrame({"code": at, "n": out[at]})

    found = blocks.select("hashes", "tokens", "lengths", "held").mapInPandas(
        pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    bigrams = np.zeros(items * items)
    bigrams[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return seeds, exchange(bigrams.reshape(items, items))[2:2 + len(seeds)]


def block_contexts(word: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (word * CONTEXTS + context) and counts of the contexts of words
    with the ends (-1), and the table of classes by classes."""
    c = cls[word]
    before = np.append(END, c[:-1])[:len(c)]
    both = (before != NONE) & (c != NONE)
    table = np.bincount(before[both] * ALL + c[both], minlength=ALL * ALL)
    inner = word >= 0
    at, after, before = word[inner] * CONTEXTS, np.append(c[1:], END)[:len(c)][inner], before[inner]
    code = np.concatenate([(at + after)[after != NONE], (at + ALL + before)[before != NONE]])
    frequent = code < DENSE * CONTEXTS
    dense = np.bincount(code[frequent], minlength=DENSE * CONTEXTS)
    rare, n = np.unique(code[~frequent], return_counts=True)
    found = np.flatnonzero(dense)
    return np.concatenate([found, rare]), np.concatenate([dense[found], n]), table


_PIECE = "part int, block long, words binary, contexts binary, counts binary, table binary"


def _contexts(blocks: DataFrame, assigned: DataFrame | None, parts: int, seeds: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Contexts of the words of each block, cut into parts; part -1 has the
    block's table of classes by classes."""

    def cut(block: int, word: np.ndarray, cls: np.ndarray, part: np.ndarray) -> pd.DataFrame:
        code, n, table = block_contexts(word, np.append(cls, END))
        sizes = np.bincount(part, minlength=parts)
        by_part = np.argsort(part, kind="stable")
        local = np.empty(len(part), np.int64)
        local[by_part] = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = code // CONTEXTS
        own = part[at]
        order = np.argsort(own.astype(np.uint16) if parts <= 1 << 16 else own, kind="stable")
        local, context, n = local[at][order], (code % CONTEXTS)[order].astype(np.uint8), n[order]
        edges = np.searchsorted(own[order], np.arange(parts + 1))
        rows = [(-1, block, b"", b"", b"", _planes_long(table))]
        for k in np.flatnonzero(np.diff(edges)).tolist():
            i, j = edges[k], edges[k + 1]
            rows.append((k, block, _planes(np.diff(local[i:j], prepend=0)), zlib.compress(context[i:j].tobytes(), 1),
                         _planes(n[i:j]), b""))
        return pd.DataFrame(rows, columns=["part", "block", "words", "contexts", "counts", "table"])

    def parts_of(pdf: pd.DataFrame, row: int) -> np.ndarray:
        return (np.frombuffer(pdf["hashes"].iloc[row], "<u8") % np.uint64(parts)).astype(np.int64)

    def begin(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in range(len(pdf)):
                word, n, held = _sequence(pdf, row)
                yield cut(int(pdf["block"].iloc[row]), word[np.repeat(~held, n)],
                          _seed_classes(np.frombuffer(pdf["hashes"].iloc[row], "<u8"), *seeds), parts_of(pdf, row))

    def slim(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            own = [_planes(parts_of(pdf, row)) for row in range(len(pdf))]
            yield pdf.drop(columns="hashes").assign(part_of=own)

    def go_on(pdf: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=["part", "block", "words", "contexts", "counts", "table"])
        word, n, held = _sequence(pdf, 0)
        part = _unplanes(pdf["part_of"].iloc[0]).astype(np.int64)
        return cut(int(pdf["block"].iloc[0]), word[np.repeat(~held, n)], _classes(part, classes), part)

    if assigned is None:
        return blocks.select("block", "hashes", "tokens", "lengths", "held").mapInPandas(begin, _PIECE)
    rows = blocks.select("block", "hashes", "tokens", "lengths", "held").mapInPandas(
        slim, "block long, tokens binary, lengths binary, held binary, part_of binary")
    return rows.groupBy("block").cogroup(assigned.where("block >= 0").groupBy("block")).applyInPandas(go_on, _PIECE)


def _classes(part: np.ndarray, rows) -> np.ndarray:
    """Classes of a block's words from its rows of all parts."""
    cls = np.full(len(part), UNTRAINED, np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(part.max(initial=0) + 2))
    for k, data in zip(rows["part"], rows["classes"]):
        cls[order[edges[k]:edges[k + 1]]] = np.frombuffer(zlib.decompress(data), np.uint8)
    return cls


def choose(cls: np.ndarray, code: np.ndarray, context: np.ndarray, n: np.ndarray, table: np.ndarray,
           turn: int, share: int = 2) -> np.ndarray:
    """New classes of a part's words. ``turn`` 0 gives all words without a
    class one; later turns move every ``share``-th word."""
    out = cls.copy()
    log = np.log(table + 1)
    left, right = table.sum(axis=1), table.sum(axis=0)
    chunk = code // AT_ONCE
    order = np.argsort(chunk, kind="stable")
    edges = np.searchsorted(chunk[order], np.arange(-(-len(cls) // AT_ONCE) + 1))
    for k, lo in enumerate(range(0, len(cls), AT_ONCE)):
        a = cls[lo:lo + AT_ONCE]
        own = order[edges[k]:edges[k + 1]]
        x = np.bincount((code[own] - lo) * CONTEXTS + context[own], n[own], len(a) * CONTEXTS).reshape(-1, CONTEXTS)
        o, i = x[:, :ALL], x[:, ALL:]
        on, in_ = o.sum(axis=1), i.sum(axis=1)
        gain = o @ log[:CLASSES].T + i @ log[:, :CLASSES]
        known = gain.any(axis=1)
        # smoothed, or all words would go to the same empty class
        gain -= on[:, None] * np.log(left[:CLASSES] + ALL) + in_[:, None] * np.log(right[:CLASSES] + ALL)
        if not turn:
            best = np.where(known, gain.argmax(axis=1), (lo + np.arange(len(a))) % CLASSES)
            out[lo:lo + AT_ONCE] = np.where(a == NONE, best, a)
            continue
        moving = np.flatnonzero((a < CLASSES) & ((lo + np.arange(len(a)) + turn) % share == 0))
        mine, o, i, on, in_ = a[moving], o[moving], i[moving], on[moving], in_[moving]
        gain = gain[moving]
        # the word's own class without the word
        stay = ((o * np.log(np.maximum(table[mine] - o, 0) + 1)).sum(axis=1)
                + (i * np.log(np.maximum(table[:, mine].T - i, 0) + 1)).sum(axis=1)
                - on * np.log(np.maximum(left[mine] - on, 0) + ALL)
                - in_ * np.log(np.maximum(right[mine] - in_, 0) + ALL))
        gain[np.arange(len(moving)), mine] = stay
        for w in np.flatnonzero(on >= min(EXACT, left.mean() / 100)).tolist():
            without = table.copy()
            without[mine[w]] -= o[w]
            without[:, mine[w]] -= i[w]
            gain[w] = gains(np.maximum(without, 0), o[w], i[w], 0.0)[:CLASSES]
            stay[w] = gain[w, mine[w]]
        best = gain.argmax(axis=1)
        out[lo + moving] = np.where(gain[np.arange(len(moving)), best] > stay + 1e-9, best, mine)
    return out


def _chosen(parts: DataFrame, pieces: DataFrame, assigned: DataFrame | None, table: np.ndarray, turn: int,
            share: int, seeds: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(part, block, classes)``: the new classes of each block's words, and
    of all words of the part (block -1)."""
    shared = parts.sparkSession.sparkContext.broadcast((table, *seeds))

    def move(found: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        table, *seeds = shared.value
        codes = {b: _unplanes(x).astype(np.int64) for b, x in zip(known["block"], known["codes"]) if x is not None}
        size = max((int(x.max(initial=-1)) for x in codes.values()), default=-1) + 1
        before = [x for x in known["classes"] if x is not None]
        if before:
            cls = np.frombuffer(zlib.decompress(before[0]), np.uint8).astype(np.int64)
        else:
            cls = np.full(size, UNTRAINED, np.int64)
            hashes = next(h for b, h in zip(known["block"], known["hashes"]) if b == -1)
            cls[codes[-1]] = _seed_classes(np.frombuffer(hashes, "<u8"), *seeds)
        code, context, n = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for r in found.itertuples():
            code.append(codes[r.block][np.cumsum(_unplanes(r.words), dtype=np.int64)])
            context.append(np.frombuffer(zlib.decompress(r.contexts), np.uint8))
            n.append(_unplanes(r.counts))
        cls = choose(cls, np.concatenate(code), np.concatenate(context), np.concatenate(n), table, turn,
                     share).astype(np.uint8)
        del codes[-1]
        return pd.DataFrame({
            "part": int(known["part"].iloc[0]), "block": [*codes, -1],
            "classes": [zlib.compress(x.tobytes(), 1) for x in (*(cls[c] for c in codes.values()), cls)]})

    known = parts.select("part", "block", "hashes", "codes", F.lit(None).cast("binary").alias("classes"))
    if assigned is not None:
        none = F.lit(None).cast("binary")
        known = known.union(assigned.where("block = -1").select("part", "block", none, none, "classes"))
    return pieces.where("part >= 0").groupBy("part").cogroup(known.groupBy("part")).applyInPandas(
        move, "part int, block long, classes binary")


def clustered(blocks: DataFrame, parts: DataFrame) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Classes of all training words, the table of classes by classes, and the
    likelihood after each round."""
    n_parts = (parts.select("n_parts").first() or [1])[0]
    seeds = _seeds(blocks, parts.where("block = -1").select("hashes", "totals"))
    assigned = best = None
    course: list[float] = []
    turn, share = 0, 2
    while True:
        pieces = written(_contexts(blocks, assigned, n_parts, seeds))
        table = _summed(pieces.where("part = -1"), ALL * ALL).reshape(ALL, ALL)
        if best and likelihood(table) <= course[-1]:
            # too many words moved at the same time
            discard(pieces, assigned)
            if share >= LEAST_SHARE:
                return (*best, course)
            share *= 2
            assigned, table = best
            pieces = written(_contexts(blocks, assigned, n_parts, seeds))
        elif assigned is not None:
            if best:
                discard(best[0])
            best = assigned, table
            course.append(likelihood(table))
            if len(course) > 2 and course[-1] - course[-3] <= RISE * abs(course[-1]):
                discard(pieces)
                return (*best, course)
        assigned = written(_chosen(parts, pieces, assigned, table, turn, share, seeds))
        turn += 1
        discard(pieces)
        # shuffle files go when nothing refers to them
        gc.collect()
        blocks.sparkSession.sparkContext._jvm.System.gc()


def train(blocks: DataFrame, parts: DataFrame, train_docs: int) -> Model:
    """The model of :func:`fitted`."""
    return fitted(blocks, parts, train_docs)[0]


def fitted(blocks: DataFrame, parts: DataFrame, train_docs: int) -> tuple[Model, DataFrame]:
    """Class sums and transitions of the training text, and the words' classes."""
    assigned, moves, _ = clustered(blocks, parts)
    fields = ("types", "tokens", "once", "twice")

    def sums(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for r in pdf.itertuples():
                n = _unplanes_long(r.totals)
                cls = np.frombuffer(zlib.decompress(r.classes), np.uint8)[_unplanes(r.codes)]
                each = [np.bincount(cls, w, ALL).astype(np.int64) for w in (None, n, n == 1, n == 2)]
                yield pd.DataFrame({"table": [_planes_long(np.concatenate(each))]})

    vocabulary = parts.where("block = -1").select("part", "codes", "totals").join(
        assigned.where("block = -1").select("part", "classes"), "part")
    each = _summed(vocabulary.mapInPandas(sums, "table binary"), len(fields) * ALL).reshape(len(fields), ALL)
    each[:2, END] = int(train_docs > 0), train_docs
    types, mass = each[0], each[1]
    n = float(mass.sum())
    share = (mass + 1) / (n + ALL)
    transition = (moves + TRANSITION_PRIOR * share) / (moves.sum(axis=1, keepdims=True) + TRANSITION_PRIOR)
    weight = types[:CLASSES] + 1e-9
    transition = np.vstack([transition, (weight / weight.sum()) @ transition[:CLASSES]])
    once, twice = float(each[2].sum()), float(each[3].sum())
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    return Model(transition, mass, types, discount, int(n), int(types.sum()), train_docs), assigned


# ----------------------------------------------------------------- scoring

def score_tokens(model: Model, cls: np.ndarray, count: np.ndarray, n_tokens: np.ndarray):
    """log10 of the add-one unigram and of the model for each token."""
    cls = np.where(count > 0, cls, UNSEEN)
    # the end before a text is a class also where no text was trained on
    before = np.empty_like(cls)
    before[1:] = cls[:-1]
    before[np.cumsum(n_tokens) - n_tokens] = END
    base = (count + 1.0) / (model.train_tokens + model.vocabulary + 1.0)
    # a class without words gives all its mass to the unseen words
    unseen = model.transition @ np.where(model.mass > 0, model.discount * model.types / np.maximum(model.mass, 1.0), 1.0)
    own = np.minimum(cls, END)
    emission = model.transition[before, own] * (count - model.discount) / np.maximum(model.mass[own], 1.0)
    both = CLASS_WEIGHT * np.where(count > 0, emission, unseen[before]) + (1 - CLASS_WEIGHT) * base
    return np.log10(base), np.log10(both)


def lm_scores(docs: DataFrame, held: F.Column) -> DataFrame:
    """Contract columns for every row; rows with ``held`` take no part in
    training."""
    spark = docs.sparkSession
    blocks = written(encoded_blocks(docs, held))
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    train_docs = docs.where(~held).count()
    n_parts = max(1, -(-words // PART_WORDS))
    parts = written(counted_parts(blocks, n_parts))
    fit, assigned = fitted(blocks, parts, train_docs)
    model = spark.sparkContext.broadcast(tuple(fit))
    id_type = blocks.schema["doc_ids"].dataType.elementType

    def score(block: pa.Table, totals: pa.Table) -> pa.Table:
        m = Model(*model.value)
        if not block.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in arrow], names=names)
        pdf = block.drop_columns(["doc_ids"]).to_pandas()
        word, n, held_flag = _sequence(pdf, 0)
        count = np.zeros(int(pdf["n_words"].iloc[0]) + 1, np.int64)
        hashes = np.frombuffer(pdf["hashes"].iloc[0], "<u8")
        part = (hashes % np.uint64(n_parts)).astype(np.int64)
        rows = totals.to_pandas()
        for k, data in zip(rows["part"], rows["totals"]):
            if data is not None:
                count[np.flatnonzero(part == k)] = _unplanes_long(data)
        cls = np.append(_classes(part, rows[rows["classes"].notna()]), END)[word]
        count[-1] = m.ends
        count = count[word]
        base, own = score_tokens(m, cls, count, n)
        first = np.cumsum(n) - n
        return pa.Table.from_arrays(
            [block.column("doc_ids").combine_chunks().flatten(), pa.array(held_flag), pa.array(n),
             pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
             pa.array(np.full(len(n), m.train_tokens, np.int64)),
             pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(own, first))], names=names)

    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType())])
    names = schema.fieldNames()
    arrow = [to_arrow_type(f.dataType) for f in schema.fields]
    none = F.lit(None).cast("binary")
    returned = parts.where("block >= 0").select("block", "part", "totals", none.alias("classes")).union(
        assigned.where("block >= 0").select("block", "part", none, "classes"))
    return blocks.drop("counts").groupBy("block").cogroup(returned.groupBy("block")).applyInArrow(score, schema)


def op9_lm_scoring(docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    return lm_scores(docs.select("doc_id", "text"), held_out("doc_id", 7, 2))
