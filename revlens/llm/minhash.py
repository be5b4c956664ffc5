"""MinHash near-dedup with an LSH forest.

Sets: ``A``-``Z`` lower-cased, words split at ASCII white space, the distinct
``SHINGLE``-word shingles; fewer words are one shingle, no word is the empty set,
which is linked with nothing. Shingles are told apart by 64-bit hashes. Texts
with the same set (equal size and 128-bit digest) form one class, and only
classes are compared, so exact copies never pair up.

Forest: a class has a signature of ``TREES`` x ``DEPTH`` MinHash values, a byte
each. Tree ``t`` sorts the classes by its ``DEPTH`` values. Classes that agree in
the first ``LEAST_DEPTH`` form a region. In the first pass every class proposes two
candidates: of its neighbours in the sorted orders the one with the longest
common prefix, and the smallest of its neighbours and its regions' first
classes. They are confirmed as below, and confirmed links give the components
so far.

The second pass loses no pair that a region holds: wherever a region still
holds classes of different components, each class outside the region's largest
component is compared with all classes of the region. Signatures rule out pairs
that agree in less than ``LEAST_AGREE`` of all values (a pair at the threshold
passes with probability 1 - 2e-7). A region is dealt to units of ``BLOCK`` rows
and as many loose ones; classes with candidates bring their full sets to their
units, where candidates are confirmed and only links that join components
leave. So pairs are compared but never listed.
The depth of a region adapts: where more than ``LOOSE`` classes lie outside of
the largest component it grows by one value, which parts unlike classes, up to
the tree's whole prefix. There is no cap.

A pair at the threshold shares a region of ``LEAST_DEPTH`` in no tree with
probability (1 - 0.85**4)**16 = 7e-6, one of the deepest in none with 0.6 %.

On Spark: sorted orders are range partitions by (tree, prefix, class), a region
that spans several is met in pieces, and the second pass joins the pieces.
Texts of classes with candidates move once in each pass to become sets; a pair
of the first pass meets its two sets by joins in which frequent classes are
salted. Nothing but counts
and checksums reaches the driver.

Defined results: a null text has no words. Rows that share a ``doc_id`` are rows
of their own; a null id is ignored in the minimum (``component_id`` is null, and
``kept`` with it, only if every id of the component is). Equal rows give equal
results. A very long text is handled with its Arrow batch, whole. An empty
table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import LOWER, WHITE, bound_batches, chunks, discard, flat, mix, span_hashes, spans, written
from revlens.llm.components import components

#: Fixed values of the contract.
SHINGLE, PERCENT = 5, 85

TREES, DEPTH, LEAST_DEPTH = 16, 8, 4
#: Of 128 values a pair at the threshold agrees in 109 on average, in fewer
#: than 88 with probability 2e-7.
LEAST_AGREE = 88
#: Classes outside its largest component above which a region grows deeper.
LOOSE = 1 << 14
#: Rows and shingles of one block of the second pass.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Pairs of a class above which the class is salted.
FREQUENT = 256
_SHINGLES_AT_ONCE = 1 << 15

_ODD = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


# --------------------------------------------------------------------- sets

def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of documents i..j: the distinct shingle hashes, sorted by
    document and value, and the document (from 0 at i) of each."""
    data, offs = flat(texts)
    for i, j in chunks(offs):
        part, at = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        inside = ~WHITE[part]
        starts, ends, first = spans(inside, at)
        words = span_hashes(part[inside], ends - starts)
        n = np.diff(first)
        owner = np.repeat(np.arange(j - i), n)
        place = np.arange(len(words)) - first[:-1][owner]
        real = (place + k <= n[owner]) | (place == 0)
        h = np.zeros(len(words), np.uint64)
        for step in range(k):
            # a shorter text's only shingle ends with its words
            inside_text = place + step < n[owner]
            following = np.append(words[step:], np.zeros(min(step, len(words)), np.uint64))
            h = np.where(inside_text, mix(h + following), h)
        h, owner = h[real], owner[real]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        yield i, j, h[fresh], owner[fresh]


def signature_array(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size, 128-bit digest (two columns) and signature (bytes) of each."""
    n_docs = len(texts)
    size = np.zeros(n_docs, np.int64)
    digest = np.zeros((n_docs, 2), np.uint64)
    least = np.full((TREES * DEPTH, n_docs), np.iinfo(np.uint64).max, np.uint64)
    for i, _, hashes, owners in _sets(texts, k):
        for s in range(0, len(hashes), _SHINGLES_AT_ONCE):
            h, owner = hashes[s:s + _SHINGLES_AT_ONCE], owners[s:s + _SHINGLES_AT_ONCE] + i
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            doc = owner[first]
            size[doc] += np.diff(first, append=len(h))
            digest[doc, 0] += np.add.reduceat(h, first)
            digest[doc, 1] += np.add.reduceat(mix(h ^ _ODD[0]), first)
            for f in range(TREES * DEPTH):
                least[f, doc] = np.minimum(least[f, doc], np.minimum.reduceat(h * _ODD[f], first))
    # the least values share their upper bits; a byte of their hash tells them apart
    return size, digest, (mix(least) & np.uint64(0xFF)).astype(np.uint8).T


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_hash, n, d0, d1, sig)`` for every row; ``sig`` is the
    signature as bytes, ``text_hash`` tells rows of one id apart."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, t) for c, t in (
        ("text_hash", T.LongType()), ("n", T.LongType()), ("d0", T.LongType()), ("d1", T.LongType()),
        ("sig", T.BinaryType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig = signature_array(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n),
                 pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)),
                 pa.array([row.tobytes() for row in np.ascontiguousarray(sig)], pa.binary())],
                ["doc_id", "text_hash", "n", "d0", "d1", "sig"])

    return rows.mapInArrow(run, schema)


# --------------------------------------------------------------- first pass

def forest(classes: DataFrame, *columns: str) -> DataFrame:
    """``(tree, prefix, node)`` and more columns: the place of each class in
    each tree."""
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", t * DEPTH + 1, DEPTH).alias("prefix"))
                      for t in range(TREES)])
    return classes.select("node", *columns, F.explode(trees).alias("at")).select(
        "at.tree", "at.prefix", "node", *columns)


def proposals(places: DataFrame) -> DataFrame:
    """``(node, other, shared)`` from the sorted orders: each class with the
    one before it and with the first of its region (of the piece of it that
    lies in a partition), in both directions, and the length of the prefix
    they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, None  # (tree, prefix, node) of the row before, and of the region's first
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node = (batch.column(c).to_numpy() for c in ("tree", "node"))
            prefix = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.uint8).reshape(-1, DEPTH)
            if last is not None:
                tree, node = np.append(last[0], tree), np.append(last[2], node)
                prefix = np.vstack([last[1][None], prefix])
            differ = prefix[1:] != prefix[:-1]
            shared = np.where(differ.any(axis=1), differ.argmax(axis=1), DEPTH)
            shared[tree[1:] != tree[:-1]] = 0
            begins = np.append(True, shared < LEAST_DEPTH)
            at = np.maximum.accumulate(np.where(begins, np.arange(len(node)), 0))
            first_node, first_prefix = node[at], prefix[at]
            if last is not None:
                held = at == 0  # the region began in an earlier batch
                first_node = np.where(held, pivot[2], first_node)
                first_prefix = np.where(held[:, None], pivot[1], first_prefix)
            far = prefix != first_prefix
            with_first = np.where(far.any(axis=1), far.argmax(axis=1), DEPTH)
            new = np.arange(len(node)) > 0 if last is not None else np.ones(len(node), bool)
            a = np.flatnonzero(new & ~begins)
            here, there = np.concatenate([node[a], node[a]]), np.concatenate([node[a - 1], first_node[a]])
            shares = np.concatenate([shared[a - 1], with_first[a]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([here, there])), pa.array(np.concatenate([there, here])),
                 pa.array(np.concatenate([shares, shares]))], ["node", "other", "shared"])
            last = (tree[-1], prefix[-1], node[-1])
            pivot = (tree[-1], first_prefix[-1], first_node[-1])

    order = ["tree", "prefix", "node"]
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (places.repartitionByRange(n, *order).sortWithinPartitions(*order)
            .mapInArrow(run, "node long, other long, shared int"))


def first_candidates(classes: DataFrame) -> DataFrame:
    """Distinct ``(a, b)``, a > b: for each class its neighbour with the
    longest common prefix (the smallest, if several) and its smallest one."""
    met = proposals(forest(classes)).where("node <> other").groupBy("node", "shared").agg(F.min("other").alias("other"))
    best = met.groupBy("node").agg(F.max_by("other", "shared").alias("closest"), F.min("other").alias("least"))
    pairs = (best.select("node", F.explode(F.array("closest", "least")).alias("other"))
             .select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct())
    sig = classes.select("node", "sig")
    met = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_bytes(batch.column(c)) for c in ("sig_a", "sig_b"))
            at = pa.array(np.flatnonzero((left == right).sum(axis=1) >= LEAST_AGREE))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _bytes(sig: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(-1, TREES * DEPTH)


# ------------------------------------------------------------- second pass

def _region(depth: int) -> Column:
    return F.substring("prefix", 1, depth)


def loose_regions(placed: DataFrame) -> DataFrame:
    """The rows of ``placed`` (tree, prefix, node, label, size) that lie in
    regions of several components, each with its ``region``, whether it is
    ``loose`` (outside the largest component), and the region's ``blocks`` and
    ``parts``: into how many its rows and its loose rows are dealt. Each region
    is as deep as it must be."""
    out, rest = None, placed
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        rest = rest.withColumn("region", _region(depth))
        found = written(rest.groupBy("tree", "region", "label").agg(F.count("*").alias("m"), F.sum("size").alias("z"))
                        .groupBy("tree", "region")
                        .agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("most"),
                             F.sum("m").alias("n"), F.sum("z").alias("z")).where("n > most")
                        .select("tree", "region", "main", (F.col("n") - F.col("most")).alias("k"),
                                _dealt_to(F.col("n")).alias("blocks"), _dealt_to(F.col("n") - F.col("most")).alias("parts")))
        crowded = F.col("k") > LOOSE if depth < DEPTH else F.lit(False)
        done = rest.join(found.where(~crowded), ["tree", "region"]).select(
            "tree", "region", "node", "label", (F.col("label") != F.col("main")).alias("loose"), "blocks", "parts")
        out = done if out is None else out.union(done)
        rest = rest.join(found.where(crowded), ["tree", "region"], "left_semi").drop("region")
        if found.where(crowded).isEmpty():
            break
    return out


def _dealt_to(rows: Column) -> Column:
    """Blocks for so many rows of a region of ``z`` shingles and ``n`` rows."""
    shingles = F.col("z") * rows / F.col("n")
    return F.ceil(F.greatest(rows / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def units(classes: DataFrame) -> DataFrame:
    """The second pass as units of bounded size, ``(unit, tree, node, label,
    loose, seeks, sig)``: a block of a region's rows, and a part of its loose
    rows, which seek among them."""
    places = forest(classes, "label", "size")
    # most regions hold one component: two numbers for each tell which
    mixed = (places.groupBy("tree", _region(LEAST_DEPTH).alias("region"))
             .agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("tree", "region"))
    placed = written(places.withColumn("region", _region(LEAST_DEPTH)).join(mixed, ["tree", "region"], "left_semi")
                     .drop("region"))
    met = written(loose_regions(placed).join(classes.select("node", "sig"), "node"))

    def dealt(salt: int, n: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n).cast("long")).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    stand = met.withColumn("block", dealt(1, "blocks")).withColumn("part", every("parts"))
    seek = met.where("loose").withColumn("part", dealt(2, "parts")).withColumn("block", every("blocks"))
    columns = [F.xxhash64("tree", "region", "block", "part").alias("unit"), "tree", "node", "label", "loose"]
    return stand.select(*columns, F.lit(False).alias("seeks"), "sig").union(
        seek.select(*columns, F.lit(True).alias("seeks"), "sig"))


def _candidates(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each seeking row of a unit, and the standing ones of other components
    whose signatures agree enough and which it meets in no earlier tree."""
    node, label, tree, loose, seeks = (table.column(c).to_numpy() for c in ("node", "label", "tree", "loose", "seeks"))
    sig = _bytes(table.column("sig"))
    r = np.flatnonzero(~seeks)
    for i in np.flatnonzero(seeks).tolist():
        # two loose classes meet from both sides
        at = r[(label[r] != label[i]) & (tree[r] == tree[i]) & (~loose[r] | (node[r] < node[i]))]
        same = sig[at] == sig[i]
        near = same.sum(axis=1) >= LEAST_AGREE
        at, same, here = at[near], same[near], int(tree[i])
        earlier = same[:, :here * DEPTH].reshape(len(at), here, DEPTH)[:, :, :LEAST_DEPTH].all(axis=2).any(axis=1)
        at = at[~earlier]
        if len(at):
            yield i, at


def _with_candidates(table: pa.Table) -> pa.Table:
    """The rows of a unit that have any candidate."""
    has = np.zeros(table.num_rows, bool)
    for i, at in _candidates(table):
        has[i] = True
        has[at] = True
    return table.select(["unit", "node", "seeks"]).filter(pa.array(has))


def _links_in_unit(table: pa.Table, percent: int) -> pa.Table:
    """Candidates confirmed on the full sets: of the links found in a unit
    those that join components, so their number stays below that of its rows."""
    node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
    sets = table.column("shingles").combine_chunks()
    # sorted as unsigned numbers
    values, offsets = sets.flatten().to_numpy().view(np.uint64), sets.offsets.to_numpy() - sets.offsets[0].as_py()
    part = {x: x for x in label.tolist()}

    def find(x: int) -> int:
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    u, v = [], []
    for i, at in _candidates(table):
        own = values[offsets[i]:offsets[i + 1]]
        for j in at.tolist():
            a, b = find(int(label[i])), find(int(label[j]))
            if a == b:
                continue
            other = values[offsets[j]:offsets[j + 1]]
            most = min(len(own), len(other))
            if 100 * most < percent * (len(own) + len(other) - most):
                continue
            place = np.searchsorted(own, other)
            shared = int((own[np.minimum(place, len(own) - 1)] == other).sum())
            if 100 * shared >= percent * (len(own) + len(other) - shared):
                part[max(a, b)] = min(a, b)
                u.append(int(node[i]))
                v.append(int(node[j]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


# -------------------------------------------------------------- confirmation

def sets_of(docs: DataFrame, wanted: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(node, n, shingles)``: the full set of each wanted class, from the
    text of its first row (``wanted``: node, first_id, first_hash)."""
    rows = docs.select(F.col("doc_id").alias("first_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("first_hash"), "text")
    texts = (rows.join(wanted, rows["first_id"].eqNullSafe(wanted["first_id"]) & (rows["first_hash"] == wanted["first_hash"]))
             .select("node", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, owner in _sets(batch.column("text"), k):
                offsets = np.searchsorted(owner, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(i, j - i), pa.array(np.diff(offsets)),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.view(np.int64)))],
                    ["node", "n", "shingles"])

    # rows that repeat give their class's set once
    return texts.mapInArrow(run, "node long, n long, shingles array<long>").dropDuplicates(["node"])


def _with_set(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """``pairs`` with the set of their class ``side``. A class in more than
    ``FREQUENT`` pairs has its pairs dealt to salts and its set to each."""
    often = (pairs.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("k")).where(F.col("k") > FREQUENT)
             .select("node", F.ceil(F.col("k") / FREQUENT).cast("int").alias("salts")))
    other = "a" if side == "b" else "b"
    spread = (pairs.join(often.withColumnRenamed("node", side), side, "left")
              .withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1)).cast("long")).cast("int"))
              .drop("salts"))
    copies = sets.join(often, "node", "left").select(
        F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("shingles").alias(f"set_{side}"),
        F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return spread.join(copies, [side, "salt"]).drop("salt")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(u, v)``: the pairs whose full sets are alike enough."""
    met = _with_set(_with_set(pairs, sets, "a"), sets, "b")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return (met.withColumn("shared", shared)
            .where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared")))
            .select(F.col("a").alias("u"), F.col("b").alias("v")))


# ------------------------------------------------------------------ results

def near_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, node, label, component_id)`` for
    every row; ``node`` is its class, ``label`` the smallest of its component."""
    prints = written(signatures(docs, shingle))
    key = ["n", "d0", "d1"]
    # ids of written rows stay as they are when a task runs again; the empty set is no class
    classes = written(prints.where("n > 0").groupBy(*key).agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("first"),
        F.first("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()))

    def sets(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(nodes.distinct(), "node", "left_semi").select(
            "node", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
        return written(sets_of(docs, wanted, shingle))

    pairs = written(first_candidates(classes))
    held = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    first = components(written(confirmed(pairs, held, percent)))
    discard(held, pairs)
    joined = written(classes.join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
                     .withColumn("size", F.col("n")))
    # what the second pass links are components of the first
    seeking = units(joined)
    met = written(seeking.groupBy("unit").applyInArrow(_with_candidates, "unit long, node long, seeks boolean"))
    held = sets(met.select("node"))
    more = written(seeking.join(met, ["unit", "node", "seeks"]).join(held.select("node", "shingles"), "node")
                   .groupBy("unit").applyInArrow(lambda table: _links_in_unit(table, percent), "u long, v long"))
    label = joined.select("node", "label")
    between = more.join(label.toDF("u", "x"), "u").join(label.toDF("v", "y"), "v").select(
        F.col("x").alias("u"), F.col("y").alias("v"))
    second = components(between).toDF("label", "over")
    labelled = joined.join(second, "label", "left").select(
        *key, "node", "least_id", F.coalesce("over", "label").alias("label"))
    ids = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    member = labelled.join(ids, "label").select(*key, "node", "label", "component_id")
    return prints.join(member, key, "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "node", "label",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_minhash_near_dedup(docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, n_shingles, component_id, kept."""
    return near_groups(docs).select("doc_id", "n_shingles", "component_id",
                                    (F.col("doc_id") == F.col("component_id")).alias("kept"))
