"""Spelling variant grouping by a trie of letter-group counts.

Words are maximal runs of ``A``-``Z``, ``a``-``z`` and U+00C0-U+00FF, ``A``-``Z``
lower-cased. Where 31 divides the CRC-32 of ``<doc_id>:<run>`` the run loses the
code point at CRC modulo length (the misspellings that the contract plants).
Results of ``min_chars`` code points and ``min_count`` occurrences are the words.

Two words are near if one inserted, deleted or replaced code point tells them
apart. Such an edit adds one letter at most and takes one away at most, so the
letter counts of near words differ by a surplus of one and a deficit of one at
most, in whatever groups the letters lie. The letters (90 at most) are dealt to
``GROUPS`` groups of even load, and the words form a trie by their counts in one
group after the other. A search goes down depth first, spends its surplus where
a branch counts one more and its deficit where one less, and verifies the words
of the leaves that it reaches letter by letter.

On Spark the trie is cut below its first levels: each node there is a shard, and
a word searches its own shard and those that its budget reaches and that come
later, so that each pair is met once. Levels are added until no shard holds more
than ``SHARD_WORDS`` words. If words still crowd one leaf, it is dealt to several
shards and every search visits all of them.

Shards return, for each word, its number of near words and the best of them; a
partially aggregated grouping joins these. Roots follow from pointer jumping:
each form has ten times its word's count, so few rounds end it.

Bounds: the driver sees 90 letter counts and one number for each level tried.
A task holds one shard and the words that search it, whatever the table.
A text is handled with its Arrow batch, whole.

Defined results: a null or empty text has no words; a null ``doc_id`` is written
as empty text in the CRC. A repeated row counts again. Forms that tie on ``n``
resolve to the smallest in code-point order. Words of any length are compared.
An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import LOWER, bound_batches, chunks, discard, flat, span_hashes, spans, written

#: Fixed values of the contract.
EDIT_MODULUS = 31
MIN_CHARS, MIN_COUNT, FORM_FACTOR = 7, 2, 10

#: Levels of the trie.
GROUPS = 16
SHARD_WORDS = 1 << 15
#: Words that a task counts before it hands them on.
HELD_WORDS = 1 << 19
#: (search, node) entries that one step of the depth-first search expands.
_STEP = 1 << 17
#: Letters of a word that are compared as a matrix; longer words are compared
#: one pair at a time.
_WIDTH = 32
_LONG_RUN = 64

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: In UTF-8 the code points U+00C0-U+00FF are this byte and one more.
_LEAD = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


# ------------------------------------------------------------ words, counts

def _crc_of_runs(part: np.ndarray, starts: np.ndarray, sizes: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, continued from the CRC-32 ``prefix`` of each."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    long = int(np.count_nonzero(sizes > _LONG_RUN))
    for i in order[:long].tolist():
        out[i] = zlib.crc32(part[starts[i]:starts[i] + sizes[i]].tobytes(), int(prefix[i]))
    order = order[long:]
    if not len(order):
        return out
    at, size = starts[order], sizes[order]
    reg = ~prefix[order]
    live = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # runs longer than k
    for k, m in enumerate(live.tolist()):
        reg[:m] = _CRC[(reg[:m] ^ part[at[:m] + k]) & 0xFF] ^ (reg[:m] >> 8)
    out[order] = ~reg
    return out


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The given byte ranges as a string column."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    place = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1] - starts, sizes)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[place].tobytes()))


class _Tally:
    """Counts of words, told apart by 64-bit hashes while they are held."""

    def __init__(self) -> None:
        self.keys, self.counts, self.words = np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.large_string())

    def add(self, keys: np.ndarray, counts: np.ndarray, words: pa.Array) -> None:
        keys = np.concatenate([self.keys, keys])
        counts = np.concatenate([self.counts, counts])
        words = pa.concat_arrays([self.words, words])
        self.keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
        self.counts = np.bincount(place, counts, len(first)).astype(np.int64)
        self.words = words.take(pa.array(first))

    def flush(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([self.words.cast(pa.string()), pa.array(self.counts)], ["word", "n"])
        self.__init__()
        return out


def _count_words(ids: list, texts: pa.Array, min_chars: int, tally: _Tally, edited: Counter) -> None:
    data, offs = flat(texts)
    prefixes = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    for i, j in chunks(offs):
        part = LOWER[data[offs[i]:offs[j]]]
        lead = part == _LEAD
        inside = _ASCII_LETTER[part] | lead
        inside[1:] |= lead[:-1]
        starts, ends, first = spans(inside, offs[i:j + 1] - offs[i])
        leads = np.zeros(len(part) + 1, np.int32)
        np.cumsum(lead, out=leads[1:])
        sizes = ends - starts
        chars = sizes - (leads[ends] - leads[starts])
        owner = np.repeat(np.arange(i, j), np.diff(first))
        keep = chars >= min_chars
        starts, sizes, chars, owner = starts[keep], sizes[keep], chars[keep], owner[keep]
        if not len(starts):
            continue
        crc = _crc_of_runs(part, starts, sizes, prefixes[owner])
        hit = crc % EDIT_MODULUS == 0
        for s, n, c, h in zip(starts[hit].tolist(), sizes[hit].tolist(), chars[hit].tolist(), crc[hit].tolist()):
            if c > min_chars:
                run = part[s:s + n].tobytes().decode()
                edited[run[:h % c] + run[h % c + 1:]] += 1
        starts, sizes = starts[~hit], sizes[~hit]
        if not len(starts):
            continue
        offsets = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(offsets - starts, sizes)
        keys, at, n = np.unique(span_hashes(part[place], sizes, lower=False), return_index=True, return_counts=True)
        tally.add(keys, n, _gather(part, starts[at], sizes[at]))


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(word, n)``: the results of at least ``min_chars`` code points, with
    their occurrences."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, edited = _Tally(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            if len(tally.keys):
                yield tally.flush()
            if edited:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(edited), pa.string()), pa.array(list(edited.values()), pa.int64())], ["word", "n"])
                edited.clear()

        for batch in batches:
            _count_words(batch.column("doc_id").to_pylist(), batch.column("text"), min_chars, tally, edited)
            if len(tally.keys) + len(edited) > HELD_WORDS:
                yield from out()
        yield from out()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ vectors

def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Latin-1 codes of all words, and the offset of each (one more)."""
    data, offs = flat(words)
    lead = data == _LEAD
    gone = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=gone[1:])
    codes = data[~lead]
    return codes + np.where(codes >= 0x80, 0x40, 0).astype(np.uint8), offs - gone[offs]


def _vectors(codes: np.ndarray, offs: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Letter-group counts of each word."""
    word = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    flat_counts = np.bincount(word * GROUPS + group[codes], minlength=(len(offs) - 1) * GROUPS)
    return flat_counts.reshape(-1, GROUPS).astype(np.int32)


def letter_groups(dictionary: DataFrame) -> np.ndarray:
    """Group of each Latin-1 code: letters by falling frequency, each to the
    group that holds least so far."""
    letters = (dictionary.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
               .groupBy("letter").agg(F.count("*").alias("n")).collect())
    load, group = [0] * GROUPS, np.zeros(256, np.int64)
    for r in sorted(letters, key=lambda r: (-r["n"], r["letter"])):
        g = load.index(min(load))
        load[g] += r["n"]
        group[ord(r["letter"])] = g
    return group


def _later(prefix: np.ndarray) -> list[np.ndarray]:
    """The prefixes that a surplus and a deficit of one each reach from the
    given ones, and that come later: the first change is a surplus."""
    out, depth = [], prefix.shape[1]
    for i in range(depth):
        more = prefix.copy()
        more[:, i] += 1
        out.append(more)
        for j in range(i + 1, depth):
            less = more.copy()
            less[:, j] -= 1
            out.append(less)
    return out


def _dealt(dictionary: DataFrame, group: np.ndarray, depth: int, cuts: int) -> DataFrame:
    """``(shard, cut, role, word, n)``: role 0 stands in the shard, role 1
    searches it from another one, role 2 from its own (only with cuts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word"), batch.column("n")
            prefix = _vectors(*_letters(words), group)[:, :depth]

            def rows(shard: np.ndarray, role: int) -> pa.RecordBatch:
                real = np.flatnonzero((shard >= 0).all(axis=1))
                keys = np.ascontiguousarray(shard[real].astype(">u4"))
                key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * depth), len(real), [None, pa.py_buffer(keys)])
                at = pa.array(real)
                return pa.RecordBatch.from_arrays(
                    [key.cast(pa.binary()), pa.array(np.full(len(real), role, np.int32)), words.take(at), n.take(at)],
                    ["shard", "role", "word", "n"])

            yield rows(prefix, 0)
            if cuts > 1:
                yield rows(prefix, 2)
            for shard in _later(prefix):
                yield rows(shard, 1)

    out = dictionary.mapInArrow(run, "shard binary, role int, word string, n long")
    if cuts == 1:
        return out.withColumn("cut", F.lit(0))
    own = F.pmod(F.xxhash64("word"), F.lit(cuts)).cast("int")
    return out.withColumn("cut", F.explode(F.when(F.col("role") == 0, F.array(own))
                                           .otherwise(F.sequence(F.lit(0), F.lit(cuts - 1)))))


def shard_depth(dictionary: DataFrame, group: np.ndarray) -> tuple[int, int]:
    """Levels above the shards, and the shards that each crowded leaf is
    dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _vectors(*_letters(batch.column("word")), group)
            yield pa.RecordBatch.from_arrays([pa.array(counts.tolist(), pa.list_(pa.int32()))], ["v"])

    leaves = written(dictionary.select("word").mapInArrow(run, "v array<int>").groupBy("v").agg(F.count("*").alias("n")))
    depth, most = 0, SHARD_WORDS + 1
    while depth < GROUPS and most > SHARD_WORDS:
        depth += 1
        most = (leaves.groupBy(F.slice("v", 1, depth).alias("p")).agg(F.sum("n").alias("n"))
                .agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    discard(leaves)
    return depth, max(1, -(-most // SHARD_WORDS))


# ------------------------------------------------------------ trie, search

class Trie:
    """Words sorted by their counts from level ``depth`` on; ``nodes[l]`` has
    the sorted (parent, count) keys of a level."""

    def __init__(self, vectors: np.ndarray, depth: int) -> None:
        rest = vectors[:, depth:]
        self.order = (np.lexsort(rest.T[::-1]) if rest.shape[1] else np.arange(len(vectors)))
        rest = rest[self.order]
        self.stride = int(rest.max(initial=0)) + 2
        fresh = np.zeros(len(rest), bool)
        fresh[:1] = True
        parent = np.zeros(len(rest), np.int64)
        self.nodes = []
        for level in range(rest.shape[1]):
            fresh[1:] |= rest[1:, level] != rest[:-1, level]
            first = np.flatnonzero(fresh)
            self.nodes.append(parent[first] * self.stride + rest[first, level])
            parent = np.cumsum(fresh) - 1
        # words of each leaf: start[k] to start[k + 1]
        self.start = np.append(np.flatnonzero(fresh), len(rest))

    def search(self, wanted: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(search, leaf) pairs within the budgets, depth first: of the pieces
        on the stack the deepest is expanded next, a wide one in parts."""
        n = len(wanted)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), plus, minus)]
        while stack:
            level, q, node, up, down = stack.pop()
            if len(q) > _STEP:
                stack.append((level, q[_STEP:], node[_STEP:], up[_STEP:], down[_STEP:]))
                q, node, up, down = q[:_STEP], node[:_STEP], up[:_STEP], down[:_STEP]
            if level == len(self.nodes):
                if len(q):
                    yield q, node
                continue
            count = wanted[q, level]
            found = []
            for change, allowed in ((0, None), (1, up), (-1, down)):
                at = np.arange(len(q)) if allowed is None else np.flatnonzero(allowed)
                value = count[at] + change
                at = at[(value >= 0) & (value < self.stride - 1)]
                key = node[at] * self.stride + count[at] + change
                place = np.searchsorted(self.nodes[level], key)
                real = self.nodes[level][np.minimum(place, len(self.nodes[level]) - 1)] == key
                at, place = at[real], place[real]
                found.append((q[at], place, up[at] & (change != 1), down[at] & (change != -1)))
            stack.append((level + 1, *(np.concatenate(c) for c in zip(*found))))


def near(codes: np.ndarray, offs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of words one edit tells apart: what they share at
    the front and at the back leaves one letter of the longer."""
    out = np.zeros(len(a), bool)
    size = np.diff(offs)
    longer = np.maximum(size[a], size[b])
    apart = np.abs(size[a] - size[b]) <= 1
    wide = apart & (longer > _WIDTH)
    for i in np.flatnonzero(wide).tolist():
        x, y = (codes[offs[k]:offs[k + 1]] for k in (a[i], b[i]))
        m = min(len(x), len(y))
        front = np.flatnonzero(np.append(x[:m] != y[:m], True))[0]
        back = np.flatnonzero(np.append(x[::-1][:m] != y[::-1][:m], True))[0]
        out[i] = front < longer[i] and front + back >= longer[i] - 1
    at = np.flatnonzero(apart & ~wide)
    if not len(at):
        return out
    padded = np.append(codes, np.zeros(2 * _WIDTH, np.uint8))
    step = np.arange(_WIDTH)
    for lo in range(0, len(at), 1 << 14):
        part = at[lo:lo + (1 << 14)]
        x, y, m = a[part], b[part], longer[part]
        shorter = np.minimum(size[x], size[y])
        inside = step < shorter[:, None]
        differ = (padded[offs[x][:, None] + step] != padded[offs[y][:, None] + step]) | ~inside
        front = np.where(differ.any(axis=1), differ.argmax(axis=1), shorter)
        differ = (codes[np.maximum(offs[x + 1][:, None] - 1 - step, 0)]
                  != codes[np.maximum(offs[y + 1][:, None] - 1 - step, 0)]) | ~inside
        back = np.where(differ.any(axis=1), differ.argmax(axis=1), shorter)
        out[part] = (front < m) & (front + back >= m - 1)
    return out


def _near_in_shard(table: pa.Table, group: np.ndarray, depth: int) -> pa.Table:
    """For each word of a shard, or that searches it, with near words met
    there: their number and the best of them."""
    role = table.column("role").to_numpy()
    words, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
    codes, offs = _letters(words)
    vectors = _vectors(codes, offs, group)
    stands, seeks = np.flatnonzero(role == 0), np.arange(len(role))
    if (role == 2).any():
        seeks = np.flatnonzero(role != 0)
    left, right = [], []
    if len(stands):
        trie = Trie(vectors[stands], depth)
        change = vectors[stands[0], :depth] - vectors[seeks, :depth]
        pieces = trie.search(vectors[seeks, depth:], ~(change > 0).any(axis=1), ~(change < 0).any(axis=1))
        rank = None
        for q, leaf in pieces:
            many = trie.start[leaf + 1] - trie.start[leaf]
            for lo, hi in _runs(many, _STEP):
                k = many[lo:hi]
                a = np.repeat(seeks[q[lo:hi]], k)
                row = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(trie.start[leaf[lo:hi]], k)
                b = stands[trie.order[row]]
                once = (role[a] != 0) | (a < b)  # in one shard each pair is met from both sides
                a, b = a[once], b[once]
                ok = near(codes, offs, a, b)
                a, b = a[ok], b[ok]
                if len(a) and (role[a] == 2).any():
                    rank = np.argsort(np.argsort(np.array(words.to_pylist(), object))) if rank is None else rank
                    once = (role[a] != 2) | (rank[a] < rank[b])
                    a, b = a[once], b[once]
                left.append(a)
                right.append(b)
    a = np.concatenate([*left, *right] or [np.zeros(0, np.int64)])
    b = np.concatenate([*right, *left] or [np.zeros(0, np.int64)])
    met, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    text = words.take(pa.array(met)).to_pylist()
    rank = np.argsort(np.argsort(np.array(text, object), kind="stable"), kind="stable")
    a, b = place[:len(a)], place[len(a):]
    order = np.lexsort((rank[b], -n[met[b]], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    return pa.table({
        "word": pa.array([text[k] for k in a[first].tolist()], pa.string()),
        "n_near": pa.array(np.diff(first, append=len(a)), pa.int64()),
        "form": pa.array([text[k] for k in b[first].tolist()], pa.string()),
        "form_n": pa.array(n[met[b[first]]], pa.int64())})


def _runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes sum to ``limit`` or are one entry."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield lo, hi
        lo = hi


# ------------------------------------------------------------------ results

def near_words(dictionary: DataFrame) -> DataFrame:
    """``(word, n_near, best)`` of each word with near words; ``best`` has
    their largest count, negated, and its word."""
    group = letter_groups(dictionary)
    depth, cuts = shard_depth(dictionary, group)
    dealt = _dealt(dictionary, group, depth, cuts)
    found = dealt.groupBy("shard", "cut").applyInArrow(
        lambda table: _near_in_shard(table, group, depth), "word string, n_near long, form string, form_n long")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("form_n")).alias("minus_n"), F.col("form").alias("form"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words that have a form: the end of its chain."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        following = written(now.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(now)
        now = following.select("word", "root")
        if following.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
                      factor: int = FORM_FACTOR) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word."""
    dictionary = written(word_counts(docs, min_chars).where(F.col("n") >= min_count))
    best = F.when(-F.col("best.minus_n") >= factor * F.col("n"), F.col("best"))
    rows = written(dictionary.join(near_words(dictionary), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best.alias("best")).select(
        "word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus_n")).alias("form_n")))
    return rows.join(roots(rows.where("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(docs: DataFrame) -> DataFrame:
    """Contract columns: word, form, root, n, n_near, form_n."""
    return spelling_variants(docs)
