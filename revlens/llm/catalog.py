"""Queries of the subpackage: name -> (spark, sf_dir) -> DataFrame, and the
DuckDB statements of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.llm.brown import op9_lm_scoring
from revlens.llm.common import read
from revlens.llm.html_text import op7_html_text
from revlens.llm.imatch import op2_imatch
from revlens.llm.langid import op4_language_id
from revlens.llm.line_dedup import LINE_DEDUP_SQL, op10_line_dedup
from revlens.llm.minhash import op13_minhash_near_dedup
from revlens.llm.mixing import op5_mixing
from revlens.llm.pieces import default_model, op3_sentencepiece
from revlens.llm.quality import op1_quality
from revlens.llm.simhash import op6_simhash_near_dedup
from revlens.llm.spelling import op11_spelling
from revlens.llm.topk import TOP_K_SQL, op8_top_k
from revlens.llm.whitening import op12_whitening

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_quality_classifier": lambda spark, d: op1_quality(read(spark, d, "documents"), read(spark, d, "labels")),
    "op2_imatch_fingerprints": lambda spark, d: op2_imatch(read(spark, d, "documents")),
    "op3_sentencepiece": lambda spark, d: op3_sentencepiece(read(spark, d, "documents"), default_model()),
    "op4_language_id": lambda spark, d: op4_language_id(read(spark, d, "documents")),
    "op5_mixing": lambda spark, d: op5_mixing(read(spark, d, "documents")),
    "op6_simhash_near_dedup": lambda spark, d: op6_simhash_near_dedup(read(spark, d, "documents")),
    "op7_html_text": lambda spark, d: op7_html_text(read(spark, d, "pages")),
    "op8_exact_top_k": lambda spark, d: op8_top_k(read(spark, d, "embeddings")),
    "op9_lm_scoring": lambda spark, d: op9_lm_scoring(read(spark, d, "documents")),
    "op10_line_dedup": lambda spark, d: op10_line_dedup(read(spark, d, "documents")),
    "op11_spelling_variants": lambda spark, d: op11_spelling(read(spark, d, "documents")),
    "op13_minhash_near_dedup": lambda spark, d: op13_minhash_near_dedup(read(spark, d, "documents")),
    "op12_embedding_whitening": lambda spark, d: op12_whitening(read(spark, d, "embeddings")),
}

ORACLE_SQL: dict[str, str] = {
    "op8_exact_top_k": TOP_K_SQL,
    "op10_line_dedup": LINE_DEDUP_SQL.format(docs="documents"),
}
