"""Line dedup (native: DataFrame functions only).

Each text is split at ``\\n``; a line's key is the line without ASCII white
space at both ends, ``A``-``Z`` lower-cased. Keys of ``min_chars`` code points
or more that at least ``min_docs`` documents hold lose all their lines except
in the smallest ``doc_id`` that holds them.

Method: explode the key hashes, pre-aggregate per hash before the shuffle,
join the few repeated hashes back to the lines (a line that many documents hold
is dealt out over the tasks by :func:`heavy_hitter_join`), gather each document's
dropped positions, and rebuild the text from the other positions. Only hashes
and positions move per line; a text moves once, to meet its positions.

Defined results: a null text and an empty text are one empty line. Rows that
share a ``doc_id`` count as one document (a null id is one document, after
all others), but every row is rebuilt on its own; exact repeats of a row give
exact repeats of the result. Keys are told apart by 96 bits of two hashes. A
very long text is split and joined whole in its row. An empty table gives no
rows. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import records, written
from revlens.operators.relational import heavy_hitter_join

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WHITE = " \t\n\x0b\x0c\r"


def _ascii_lower(text: Column) -> Column:
    # lower() folds other letters too, so it serves only for ASCII text
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dropped_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``(doc_id, text_hash, dropped)``: the positions (from 0) of the lines
    that go, for each document that loses any."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = F.transform(_lines(_ascii_lower(text)), lambda line: F.btrim(line, F.lit(_WHITE)))
    hashed = F.transform(keys, lambda k: F.when(
        F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.hash(k).alias("b"))))
    lines = written(
        docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(hashed).alias("pos", "key"))
        .where("key is not null")
        .select("doc_id", "text_hash", "pos", F.col("key.a").alias("a"), F.col("key.b").alias("b")))
    if min_docs == 2:
        # two documents or more: the least and the greatest id differ
        held = lines.groupBy("a", "b").agg(
            F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"),
            F.bool_or(F.col("doc_id").isNull()).alias("in_null"))
        several = F.col("keeper").isNotNull() & (F.col("in_null") | (F.col("keeper") != F.col("last")))
    else:
        held = (lines.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one"))
                .groupBy("a", "b").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")))
        several = F.col("n") >= min_docs
    repeated = held.where(several).select("a", "b", "keeper")
    met = heavy_hitter_join(lines, repeated, ["a", "b"], spread=["doc_id", "text_hash", "pos"])
    return (met
            .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped")))


def rebuilt_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``(record, text, n_lines, n_dropped)`` for every row; ``text`` is null
    where no line went."""
    gone = dropped_lines(docs, min_chars, min_docs).select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "dropped")
    text = F.coalesce("record.text", F.lit(""))
    rows = records(docs).withColumn("text_hash", F.xxhash64(text))
    met = rows.join(gone, F.col("text_hash").eqNullSafe(F.col("hash")) & F.col("record.doc_id").eqNullSafe(F.col("id")), "left")

    def rebuild(lines: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        kept = F.transform(F.array_except(places, F.col("dropped")), lambda p: F.get(lines, p))
        return F.struct(F.size(lines).cast("long").alias("n"), F.when(
            F.col("dropped").isNotNull(), F.array_join(kept, "\n")).alias("text"))

    # the lambda binds the split lines once; named in the lambda over the
    # positions, split() would run again for each of them
    met = met.withColumn("built", F.transform(F.array(_lines(text)), rebuild)[0])
    return met.select("record", "built.text", F.col("built.n").alias("n_lines"),
                      F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Every row of ``docs`` with its columns, ``text`` rebuilt."""
    return rebuilt_lines(docs, min_chars, min_docs).select(*[
        (F.coalesce("text", "record.text") if c == "text" else F.col(f"record.`{c}`")).alias(c) for c in docs.columns])


def op10_line_dedup(docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, n_lines, n_dropped, kept_sha256."""
    return rebuilt_lines(docs.select("doc_id", "text"), 10, 2).select(
        "record.doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", "record.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: the same rule as relational SQL over whole texts.
LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM {docs}) d,
       LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS pos) u
), held AS (
  SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.*, (h.k IS NOT NULL AND l.doc_id <> h.keeper) AS gone
  FROM lines l LEFT JOIN held h ON l.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
