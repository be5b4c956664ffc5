"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of all different words of an Arrow batch lie in one flat array. A
round looks up the rank of each neighbouring pair, takes the smallest rank of
each word (a segmented minimum), merges all its leftmost non-overlapping
occurrences at once, and compacts the array; words without a pair left retire.
Rounds end when no pair remains.

The library merges one pair at a time, best score first, leftmost first. The
simultaneous merges give the same result: if a merge makes a pair with its
neighbours that ranks as well as the pair being merged or better, the word
stops at that merge for this round, as that new pair may come first.

Supported models: BPE with byte fallback, identity normalisation and a dummy
prefix (checked on loading). The driver reads the model file and broadcasts
its bytes, under ``MAX_MODEL_BYTES``.

Defined results: a null text is encoded like an empty one, as begin and end
ids only. Every row is encoded on its own, so repeated rows give repeated
results. Other columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import bound_batches, chunks, flat, span_hashes

#: Fixed value: the mark that stands for a space in pieces.
SPACE = "▁"
MAX_MODEL_BYTES = 64 << 20
_NONE = np.iinfo(np.int32).max
#: Text bytes whose different words are merged together.
_AT_ONCE = 8 << 20
#: Rounds after which the words that are left go on one merge at a time.
ROUNDS = 256


class Words:
    """Ids of the words that a worker met lately, by their 64-bit hash (two
    words of one block or of the memory are taken for one at odds of 1e-8)."""

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self.hashes, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def tokens(self, hashes: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and number of ids of each hash; ``encode`` gets the places
        of those that are new."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        old = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~old)
        ids, count = encode(new) if len(new) else (self.ids[:0], self.count[:0])
        begin, total = np.cumsum(self.count) - self.count, len(self.ids)
        all_ids = np.concatenate([self.ids, ids])
        where, n = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        where[new], n[new] = total + np.cumsum(count) - count, count
        where[old], n[old] = begin[at[old]], self.count[at[old]]
        out = _gather(all_ids, where, n)
        merged = np.concatenate([self.hashes, hashes[new]])
        if len(merged) <= self.most:
            order = np.argsort(merged, kind="stable")
            length = np.concatenate([self.count, count])
            self.hashes, self.count = merged[order], length[order]
            self.ids = _gather(all_ids, np.concatenate([begin, total + np.cumsum(count) - count])[order], self.count)
        elif len(hashes) <= self.most:
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.count = hashes[order], n[order]
            self.ids = _gather(out, (np.cumsum(n) - n)[order], self.count)
        return out, n


class Pieces:
    """Lookup tables of one model."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        byte_ids = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        probe = "  A ﬁ  bÅ "
        if len(byte_ids) != 256 or sp.decode(sp.encode(probe)) != probe or sp.encode("a") == sp.encode(" a"):
            raise ValueError("a BPE model with byte fallback, identity normalisation and a dummy prefix is needed")
        self.words = Words()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.byte_ids = np.array([byte_ids[f"<0x{b:02X}>"] for b in range(256)], np.int32)
        special = np.array([sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)])
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        normal = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece spans words")
        # symbols: pieces, and characters that occur only inside pieces
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p}):
            symbols.setdefault(c, len(symbols) + n)
        self.n = n
        self.width = max(symbols.values()) + 1
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[0x20] = self.of_char[ord(SPACE)]
        self.char_of = np.zeros(self.width, np.int32)
        for p, i in symbols.items():
            self.char_of[i] = ord(p[0])
        scores = {p: sp.get_score(i) for p, i in normal.items() if len(p) > 1}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = [(symbols[p[:k]] * self.width + symbols[p[k:]], rank[s], normal[p])
                 for p, s in scores.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        keys, ranks, merged = (np.array(x) for x in zip(*pairs))
        self._build(keys.astype(np.int64), ranks.astype(np.int32), merged.astype(np.int32))
        surface = [b"" if sp.is_control(i) else bytes([b]) if (b := self._byte(sp, i)) is not None
                   else " ⁇ ".encode() if sp.is_unknown(i)
                   else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.surface_len = np.array([len(s) for s in surface], np.int32)
        self.surface_at = np.concatenate([[0], np.cumsum(self.surface_len)[:-1]]).astype(np.int32)
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.marked = np.array([not special[i] and sp.id_to_piece(i).startswith(SPACE) for i in range(n)])

    @staticmethod
    def _byte(sp, i: int) -> int | None:
        return int(sp.id_to_piece(i)[3:5], 16) if sp.is_byte(i) else None

    def _build(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """Open-addressing hash table, filled round by round of probing."""
        self.bits = int(len(keys) * 4).bit_length()
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.ranks[slot[put]], self.merged[slot[put]] = keys[put], ranks[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)

    @functools.cached_property
    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        at = np.flatnonzero(self.keys >= 0)
        left, right = np.divmod(self.keys[at], self.width)
        return dict(zip(zip(left.tolist(), right.tolist()), zip(self.ranks[at].tolist(), self.merged[at].tolist())))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``_NONE`` if the two don't merge) and merged id."""
        keys = left.astype(np.int64) * self.width + right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        at = np.flatnonzero((found != keys) & (found != -1))
        while len(at):
            slot[at] = (slot[at] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[at]]
            at = at[(found != keys[at]) & (found != -1)]
        hit = self.keys[slot] == keys
        return np.where(hit, self.ranks[slot], _NONE), self.merged[slot]


@functools.lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def _merge_long(table: Pieces, sym: list[int]) -> list[int]:
    """The library's order, one merge at a time, for the rare word that needs
    very many rounds (long runs of one character)."""
    n = len(sym)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def push(i: int, j: int) -> None:
        if (found := table.pairs.get((sym[i], sym[j]))) is not None:
            heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

    for i in range(n - 1):
        push(i, i + 1)
    while heap:
        _, i, left, right, merged = heapq.heappop(heap)
        j = after[i] if sym[i] == left else n
        if j >= n or sym[j] != right:
            continue
        sym[i], sym[j] = merged, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            push(i, after[i])
        if before[i] >= 0:
            push(before[i], i)
    return [x for x in sym if x is not None]


def merge_words(table: Pieces, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of all words until no pair is left; ``word`` rises
    by word. Returns the symbols and their words, word by word."""
    out_sym, out_word = [], []

    def ranked(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nxt = np.minimum(i + 1, len(sym) - 1)
        r, m = table.pair(sym[i], sym[nxt])
        r[(word[i] != word[nxt]) | (nxt == i)] = _NONE
        return r, m

    if not len(sym):
        return sym, word
    rounds = 0
    rank, merged = ranked(np.arange(len(sym)))
    while True:
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(start, append=len(sym))
        least = np.minimum.reduceat(rank, start)
        alive = least < _NONE
        if not alive.all():
            stay = np.repeat(alive, size)
            out_sym.append(sym[~stay])
            out_word.append(word[~stay])
            sym, word, rank, merged = sym[stay], word[stay], rank[stay], merged[stay]
            least, size = least[alive], size[alive]
            if not len(sym):
                break
        rounds += 1
        if rounds > ROUNDS:
            for part in np.split(np.arange(len(sym)), np.cumsum(size)[:-1]):
                ids = _merge_long(table, sym[part].tolist())
                out_sym.append(np.array(ids, sym.dtype))
                out_word.append(np.full(len(ids), word[part[0]], word.dtype))
            break
        best = np.repeat(least, size)
        at = np.flatnonzero(rank == best)
        # leftmost without overlap: every second one of a run of neighbours
        new_run = np.r_[True, np.diff(at) > 1]
        head = np.flatnonzero(new_run)
        place = np.arange(len(at)) - np.repeat(head, np.diff(head, append=len(at)))
        at = at[place % 2 == 0]
        q, r = merged[at], best[at]
        # a merge after which a neighbouring pair ranks as well ends the round
        # of its word
        joined = np.r_[False, (at[1:] - at[:-1] == 2) & (word[at[1:]] == word[at[:-1]])]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
        left = np.where(joined, np.r_[0, q[:-1]], sym[before])
        stop = (table.pair(left, q)[0] <= r) & (at > 0) & (joined | (word[before] == word[at]))
        stop |= (table.pair(q, sym[after])[0] <= r) & (at + 2 < len(sym)) & (word[after] == word[at])
        if stop.any():
            owner = word[at]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.cumsum(stop) - stop
            kept = count == np.repeat(count[first], np.diff(first, append=len(at)))
            at, q = at[kept], q[kept]
        sym[at] = q
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new_at = at - np.arange(len(at))
        sym, word, rank, merged = sym[keep], word[keep], rank[keep], merged[keep]
        redo = np.concatenate([new_at, new_at[new_at > 0] - 1])
        rank[redo], merged[redo] = ranked(redo)
    sym, word = np.concatenate(out_sym), np.concatenate(out_word)
    order = np.argsort(word, kind="stable")
    return sym[order], word[order]


def _gather(flat_values: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat_values[at:at + length]``."""
    total = np.cumsum(length)
    where = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(at - (total - length), length)
    return flat_values[where]


def _word_tokens(table: Pieces, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words whose bytes follow one another in ``data``: flat ids
    and the number of ids of each word."""
    first = np.cumsum(length) - length
    chars = np.add.reduceat((data & 0xC0) != 0x80, first, dtype=np.int64)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int32)
    sym = table.of_char[code]
    sym = np.where(sym < 0, -1 - code, sym)
    sym, word = merge_words(table, sym, np.repeat(np.arange(len(length)), chars))
    odd = np.flatnonzero((sym < 0) | (sym >= table.n))
    count = np.ones(len(sym), np.int64)
    if len(odd):  # characters without a piece: their bytes
        code = np.where(sym[odd] < 0, -1 - sym[odd], table.char_of[np.maximum(sym[odd], 0)])
        raw = [chr(c).encode() for c in code.tolist()]
        count[odd] = [len(x) for x in raw]
        ids = np.repeat(sym, count)
        begin = np.cumsum(count) - count
        ids[np.repeat(begin[odd], count[odd]) + np.concatenate([np.arange(len(x)) for x in raw])] = \
            table.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    else:
        ids = sym
    return ids, np.bincount(word, weights=count, minlength=len(length)).astype(np.int64)


def encode_batch(table: Pieces, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of documents in order: flat ids with begin and end, and the
    number of ids of each document."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pc.any(pc.match_substring(texts, SPACE)).as_py():
        texts = pc.replace_substring(texts, SPACE, " ")  # the library encodes both alike
    data, offs = flat(texts)
    for i, j in chunks(offs, _AT_ONCE):
        at = offs[i:j + 1] - offs[i]
        filled = np.diff(at) > 0
        body = np.insert(data[offs[i]:offs[j]], at[:-1][filled], 0x20)  # dummy prefix
        begin = (at + np.concatenate([[0], np.cumsum(filled)]))
        if len(body):
            mark = body == 0x20
            opens = mark.copy()
            opens[1:] &= ~mark[:-1]
            opens[begin[:-1][filled]] = True
            start = np.flatnonzero(opens)
            length = np.diff(start, append=len(body))
            code, unique = pd.factorize(span_hashes(body, length, lower=False))
            sample = np.full(len(unique), -1, np.int64)
            sample[code[::-1]] = np.arange(len(code))[::-1]
            ids, count = table.words.tokens(unique, lambda new: _word_tokens(
                table, _gather(body, start[sample[new]], length[sample[new]]), length[sample[new]]))
            where = np.cumsum(count) - count
            n = count[code]
            first = np.searchsorted(start, begin)
            tokens = _gather(ids, where[code], n)
            upto = np.concatenate([[0], np.cumsum(n)])[first]
        else:
            tokens, upto = np.zeros(0, np.int32), np.zeros(len(begin), np.int64)
        per_doc = np.diff(upto)
        out = np.empty(len(tokens) + 2 * len(per_doc), np.int32)
        ends = np.cumsum(per_doc + 2)
        out[ends - 1] = table.eos
        out[ends - per_doc - 2] = table.bos
        out[np.arange(len(tokens)) + np.repeat(2 * np.arange(len(per_doc)) + 1, per_doc)] = tokens
        yield out, per_doc + 2


def decode_flat(table: Pieces, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the decoded documents, and the number of bytes of each."""
    length = table.surface_len[ids].astype(np.int64)
    data = _gather(table.surface, table.surface_at[ids], length)
    upto = np.concatenate([[0], np.cumsum(length)])
    edge = np.concatenate([[0], np.cumsum(count)])
    size = np.diff(upto[edge])
    # the dummy prefix goes: the space mark of the first piece with a surface
    has = np.flatnonzero(length > 0)
    k = np.searchsorted(has, edge[:-1])
    lead = has[np.minimum(k, max(len(has) - 1, 0))] if len(has) else np.zeros(len(count), np.int64)
    prefixed = (size > 0) & (table.marked[ids[lead]] if len(has) else False)
    if prefixed.any():
        data = np.delete(data, upto[edge[:-1]][prefixed])
        size = size - prefixed
    return data, size


def decode(table: Pieces, ids: list[int]) -> str:
    """Text of one id list; bytes that are no UTF-8 become U+FFFD each."""
    ids = np.asarray(ids, np.int32)
    data, _ = decode_flat(table, ids, np.array([len(ids)]))
    return data.tobytes().decode("utf-8", "surrogateescape").encode("utf-16", "surrogatepass").decode(
        "utf-16", "replace") if len(data) else ""


def load_model(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"the model is larger than {MAX_MODEL_BYTES} bytes")
    return model


def _mapped(docs: DataFrame, model_path: str, build, fields: list[T.StructField]) -> DataFrame:
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))
    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model.value)
        for batch in batches:
            done = 0
            for ids, count in encode_batch(table, batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(done, len(count)), *build(table, ids, count)],
                    [f.name for f in schema.fields])
                done += len(count)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: all ids of each text, begin and end
    included, and the text that they decode to."""

    def build(table: Pieces, ids: np.ndarray, count: np.ndarray) -> list[pa.Array]:
        data, size = decode_flat(table, ids, count)
        edges = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        return [pa.ListArray.from_arrays(edges(count), pa.array(ids)),
                pa.StringArray.from_buffers(len(size), edges(size).buffers()[1], pa.py_buffer(data.tobytes()))]

    return _mapped(docs, model_path, build, [T.StructField("ids", T.ArrayType(T.IntegerType())),
                                             T.StructField("decoded", T.StringType())])


def _digests(data: np.ndarray, size: np.ndarray) -> pa.Array:
    raw, upto = memoryview(np.ascontiguousarray(data)).cast("B"), np.concatenate([[0], np.cumsum(size)]).tolist()
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(upto, upto[1:])], pa.string())


def op3_sentencepiece(docs: DataFrame, model_path: str) -> DataFrame:
    """Contract columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def build(table: Pieces, ids: np.ndarray, count: np.ndarray) -> list[pa.Array]:
        return [pa.array(count), _digests(ids.astype("<u4"), 4 * count), _digests(*decode_flat(table, ids, count))]

    return _mapped(docs, model_path, build, [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())])


def default_model() -> str:
    """The public 32k model of the machine's tokenizer folder."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
