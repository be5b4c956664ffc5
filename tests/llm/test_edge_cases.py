"""Every operator on nulls, empty and very long texts, repeated rows, empty
tables and extra columns with clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from revlens.llm import (brown, html_text, imatch, langid, line_dedup, minhash, mixing, pieces, quality, simhash, spelling,
                         topk, whitening)


def _run(op, docs, labels):
    return {
        1: lambda: quality.op1_quality(docs, labels([(i, i % 2, 0) for i in range(9)])),
        2: lambda: imatch.op2_imatch(docs), 3: lambda: pieces.op3_sentencepiece(docs, pieces.default_model()),
        4: lambda: langid.op4_language_id(docs), 5: lambda: mixing.op5_mixing(docs),
        6: lambda: simhash.op6_simhash_near_dedup(docs), 9: lambda: brown.op9_lm_scoring(docs),
        10: lambda: line_dedup.op10_line_dedup(docs), 11: lambda: spelling.op11_spelling(docs),
        13: lambda: minhash.op13_minhash_near_dedup(docs)}[op]()


@pytest.mark.parametrize("op", [1, 2, 3, 4, 5, 6, 9, 10, 13])
def test_a_row_for_each_document(edge_docs, labels, op):
    out = _run(op, edge_docs, labels).toPandas()
    assert sorted(out.doc_id.dropna()) == [0, 0, *range(1, 9)] and out.doc_id.isna().sum() == 1
    # exact repeats of a row get equal results
    repeated = out[out.doc_id == 0].drop(columns=[c for c in ("near_next", "near_edited", "edited_sha256",
                                                              "edited_fingerprint", "taken") if c in out])
    assert len(repeated.drop_duplicates()) == 1
    row = {r.doc_id: r for r in out.itertuples()}
    if op == 1:
        assert out.score.between(0, 1).all() and row[1].score == row[2].score
    if op == 2:
        assert row[1].n_chars == 0 and row[1].fingerprint == row[2].fingerprint
    if op == 3:
        assert row[1].n_tokens == row[2].n_tokens == 2
    if op == 4:
        assert [row[k].lang_pred for k in (1, 2, 3, 8)] == ["und"] * 4 and row[8].score == 0
    if op == 5:
        assert row[1].size == row[2].size == row[3].size == 0 and (out.taken <= 3 * out["size"]).all()
    if op == 6:
        assert row[1].fingerprint == row[2].fingerprint == row[3].fingerprint == "0" * 16
        assert row[1].component_id == row[2].component_id == row[3].component_id == 1 and row[6].component_id == 0
    if op == 9:
        assert row[1].n_tokens == row[2].n_tokens == row[3].n_tokens == 1
    if op == 10:
        assert row[1].n_lines == row[2].n_lines == 1 and row[6].n_dropped == 2 and row[0].n_dropped == 0
        assert row[6].kept_sha256 == hashlib.sha256(b"").hexdigest()
    if op == 13:
        assert [row[k].n_shingles for k in (1, 2, 3)] == [0, 0, 0] and [row[k].component_id for k in (1, 2, 3)] == [1, 2, 3]
        assert row[6].component_id == 0 and not row[6].kept and row[0].kept and row[5].n_shingles == 1


@pytest.mark.parametrize("op", [1, 2, 3, 4, 5, 6, 9, 10, 11, 13])
def test_empty_tables(no_docs, labels, op):
    assert _run(op, no_docs, labels).count() == 0


def test_nothing_learned(make_docs, labels):
    docs = make_docs(["some words", "other words"], langs=[None, None])
    assert [r.score for r in quality.op1_quality(docs, labels([])).collect()] == [0.5, 0.5]
    assert {r.lang_pred for r in langid.op4_language_id(docs).collect()} == {"und"}


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (2, "<p>a", "u"), (None, "<b>x</b>", "u")],
                                  "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text) for r in html_text.op7_html_text(pages).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (2, "a"), (None, "x")], key=str)
    assert html_text.op7_html_text(pages.limit(0)).count() == 0
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]),
            (6, [None, 1.0]), (7, []), (8, [1.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (40, [nan, 0.0])]
    vectors = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.op8_top_k(vectors).collect())
    assert got == [(0, 1, 1, 2048), (0, 2, 2, 2048), (0, 3, 20, 0), (20, 1, 1, 2048), (20, 2, 2, 2048), (20, 3, 0, 0)]
    assert topk.op8_top_k(vectors.limit(0)).count() == 0


CLASHES = ("_score", "score", "_id", "_hash", "_text_hash", "_dropped", "_n_lines", "_n_dropped", "_built", "_row", "_copies",
           "_source", "_copy", "record", "text_hash", "id", "hash", "rows", "copies", "row", "mark", "copy", "first", "one",
           "label", "node", "dropped", "built", "n_lines", "size", "p")


def test_pipeline_stages_on_edge_cases(spark, edge_docs, no_docs, labels, tmp_path):
    import corpus_pipeline

    labels([(i, 1, 0) for i in range(9)]).write.parquet(f"{tmp_path}/labels.parquet")
    clashing = no_docs.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES])
    named = edge_docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", *[f"'x' AS `{c}`" for c in CLASHES])
    for docs in (named, edge_docs, no_docs, clashing):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.collect()
            docs = out if k < len(corpus_pipeline.STAGES) - 1 else docs


def test_equal_rows_share_their_copies(make_docs):
    """Half of the rows are equal: one unit of its shard; and rows that differ
    in other columns only share its copies."""
    words = [" ".join(["w"] * (1 + i % 9)) for i in range(600)]
    docs = make_docs(["same text of five words"] * 600 + words, ids=[-1] * 600 + list(range(600)),
                     sources=["a"] * 900 + ["b"] * 300)
    plan = mixing.mix_plan(docs, shard_rows=50).toPandas()
    assert len(plan) == 1200 and mixing.mix_units(docs, shard_rows=50).count() == 601
    equal = plan[plan.doc_id == -1].copies
    assert equal.max() - equal.min() <= 1 and plan.copies.max() <= 3
    taken = (plan["size"] * plan.copies).groupby(plan.source).sum()
    assert all(abs(taken[s] - plan[plan.source == s].target.iloc[0]) <= 10 for s in "ab")
    other = docs.withColumn("note", F.when(F.col("doc_id") == -1, F.monotonically_increasing_id()))
    mixed = mixing.mix_documents(other).toPandas()
    assert len(mixed) == plan[plan["size"] > 0].copies.sum()
    assert mixed[mixed.doc_id == -1].groupby("note").size().max() == equal.max()
    again = mixing.mix_documents(other).toPandas()
    assert sorted(mixed.note.dropna()) == sorted(again.note.dropna())
