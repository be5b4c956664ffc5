"""Shared helpers: scratch tables, Arrow batch limits, byte-level tokens.

Texts reach Python as Arrow batches and are handled as flat byte arrays, so
word splitting, lower-casing and hashing cost a few numpy passes over the
bytes instead of one Python object for each word.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import cut_lineage, discard, ensure_checkpoint_dir  # noqa: F401

#: Rows and bytes of one Arrow batch sent to a Python worker. Documents may
#: hold 100 kB and more, so Spark's default of 10,000 rows would not bound a
#: worker's memory.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20
#: Text bytes that the numpy helpers handle at once, so that their arrays stay
#: in the cache (a longer document is
#: handled alone).
CHUNK_BYTES = 1 << 18


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever they run, by way of
    the shared checkpoint folder."""
    sc = spark.sparkContext
    name = f"{__package__.partition('.')[0]}.zip"
    if name in sc._python_includes:
        return
    root, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(path.toString())


def bound_batches(spark: SparkSession) -> None:
    """Limit the Arrow batches that this session sends to Python workers, and
    send them this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    return cut_lineage(df)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def records(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as one column ``record``, so that no column of it
    can clash with those that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))


def held_out(doc_id: Column | str, buckets: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id is
    never held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % buckets == remainder,
                      F.lit(False))


# ------------------------------------------------------------- flat texts

#: Fixed value of the contracts: the six ASCII white-space bytes.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each (one more than texts); a
    null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents that hold at most ``limit`` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of ``inside`` bytes that stays within one
    document, and the first run of each document (one more than documents)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[offs] = True
    change = edge[:-1].copy()
    change[1:] |= ~inside[:-1]
    starts = np.flatnonzero(inside & change)
    change = edge[1:].copy()
    change[:-1] |= ~inside[1:]
    ends = np.flatnonzero(inside & change) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every
    input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0xD1342543DE82EF95


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(inside_bytes: np.ndarray, lengths: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each of the byte strings that follow one another in
    ``inside_bytes``: a polynomial over random byte codes, then :func:`mix`.
    Every length is positive."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.zeros(len(lengths), np.int32)
    np.cumsum(lengths[:-1], out=first[1:])
    place = np.arange(len(inside_bytes), dtype=np.int32)
    place -= np.repeat(first, lengths)
    value = (_CODES[LOWER] if lower else _CODES)[inside_bytes]
    value *= _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, first))


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each chunk of documents i..j: i, j, the 64-bit hashes of all its
    lower-cased words, and the first word of each document."""
    data, offs = flat(column)
    for i, j in chunks(offs):
        part, at = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        inside = ~WHITE[part]
        starts, ends, first = spans(inside, at)
        yield i, j, span_hashes(part[inside], ends - starts), first
