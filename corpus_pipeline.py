"""Corpus pipeline over ``documents``: each stage calls one operator of
``revlens.llm`` on all rows that the stage before it kept.

All stages but the last return the columns of ``documents``. ``run`` writes
each stage to the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import discard, read, written
from revlens.llm.line_dedup import dedup_lines
from revlens.llm.mixing import mix_documents
from revlens.llm.pieces import default_model, op3_sentencepiece
from revlens.llm.quality import drop_rejected
from revlens.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return drop_rejected(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; ``n_chars``
    follows the text. A document keeps its row even if no line is left."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates."""
    return drop_near_duplicates(docs, shingle=3, max_bits=2)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three equal rows, or
    none."""
    return mix_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mix, a row for each of its documents."""
    return op3_sentencepiece(docs, default_model())


STAGES = [("quality_classifier", quality), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
          ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: SQL cannot express the classifier, the fingerprints, the mix or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
