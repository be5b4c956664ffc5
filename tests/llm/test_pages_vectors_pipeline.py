"""HTML rendering, top-k search and the pipeline."""

import numpy as np
import pytest

from revlens.llm import html_text, topk
from revlens.llm.common import read

CASES = [
    ("plain text", "plain text"),
    ("<p>One\n two <b>three<p>Four<br>five", "One two three\n\nFour\nfive"),
    ("<head><title>T</title><style>p{}</style></head>x<script>var t='</p>'</script>y", "xy"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>10</table>z", "Name   Qty\napple  10\n\nz"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2<tr><td colspan=2>wide</table>", "r  1\n   2\nwide"),
    ("<table><td>x<td>y<br>z</table>", "x  y\n   z"),
    ("<pre>\n a  b\n   c\n</pre>", " a  b\n   c"),
    ("<p hidden>no</p><i style='display: none'>no</i><b>yes</b>", "yes"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("a &lt; b &copy; <!-- no --> c < d", "a < b © c < d"),
    ("<a title=\"x > y\">t</a><noscript>no</noscript><template>no</template>", "t"),
    ("<dl><dt>t<dd>d</dl><blockquote>q<br>r</blockquote>", "t\n  d\n\n  q\n  r"),
    ("</p></div>x</b><br></br>y", "x\n\ny"),
    ("<textarea>a <b>\n c</textarea>", "a <b>\n c"),
    ("<p>a</p>\n\n<p>b</p>", "a\n\nb"),
    ("", ""), ("<", "<"), ("<p", "<p"), ("<!-- open", ""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_rendering(page, text):
    assert html_text.render(page) == text


def test_deep_and_broken_pages_end():
    assert html_text.render("<div>" * 5000 + "x") == "x"
    assert "x" in html_text.render("<ul><li>" * 3000 + "x")
    assert html_text.render("<table><tr><td>" * 500 + "x").strip() == "x"
    html_text.render('<a b="' * 3000)
    html_text.render("<" * 20000)


def test_all_words_of_real_pages(spark):
    import re
    pages = read(spark, "/root/testdata/sf0.001", "pages")
    got = {r.page_id: r.text for r in html_text.op7_html_text(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", r.html)
        import html
        want = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        have = [w for w in got[r.page_id].split() if w != "-"]
        assert have == [w for w in want if w != "-"]


def test_tree_search_equals_brute_force():
    rng = np.random.default_rng(0)
    ids = rng.permutation(3000)
    x = np.floor(64 * rng.normal(size=(3000, 6)) / 4)
    x[:900] = x[0]  # a very common vector
    tree = topk.Tree(ids, x)
    queries = np.vstack([x[::100], np.zeros((1, 6))])
    own = np.append(ids[::100], -1)
    for i, q, b in zip(own.tolist(), queries, tree.bounds(queries)):
        score = x @ q
        want = sorted(((-s, v) for s, v in zip(score.tolist(), ids.tolist()) if v != i))[:20]
        assert sorted(((-s, -v) for s, v in tree.search(i, q, b, 20, -np.inf))) == want
        kth = -want[-1][0]
        assert sorted(((-s, -v) for s, v in tree.search(i, q, b, 20, kth))) == want
        low, high = tree.low, tree.high
        assert (b >= 0 - 1e18).all() and len(low) == len(high) == len(b)


def test_top_k_over_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 70)
    monkeypatch.setattr(topk, "QUERY_ROWS", 10)
    monkeypatch.setattr(topk, "SAMPLE", 50)
    table = read(spark, "/root/testdata/sf0.001", "embeddings")
    rows = {r.vec_id: np.floor(64 * np.array(r.embedding, float)) for r in table.collect()}
    got = {}
    for r in topk.op8_top_k(table).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {k for k in rows if k % 20 == 0}
    for q, found in got.items():
        want = sorted((-int(rows[q] @ v), k) for k, v in rows.items() if k != q)[:20]
        assert [found[i + 1] for i in range(20)] == [(k, -s) for s, k in want]


def test_top_k_of_repeated_rows(spark, monkeypatch):
    """Every query row has its own k results, whatever rows share its id."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(100)] + [(7, [1.0, 0.0, 0.0])] * 200
    rows += [rows[20]] * 3 + [(40, [0.0, 1.0, 0.0])]
    got = {}
    for r in topk.op8_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    want = {}
    for i, q in whole:
        if i % 20 == 0:
            found = sorted((-int(q @ v), j) for j, v in whole if j != i)[:20]
            want.setdefault(i, []).extend((n + 1, j, -s) for n, (s, j) in enumerate(found))
    assert len(want[20]) == 80 and {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_pipeline_equals_its_stages_in_plain_python(spark):
    import hashlib

    import sentencepiece
    import corpus_pipeline
    from revlens.llm import mixing, pieces, quality
    from test_text_operators import _components, _dedup, _fingerprint

    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    score = {r.doc_id: r.score for r in quality.op1_quality(docs, read(spark, sf, "labels")).collect()}
    kept = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if score[r.doc_id] >= 0.3)
    lines = _dedup([(d, t) for d, t, _ in kept])
    kept = [(d, lines[d][2], s) for d, _, s in kept]
    part = _components([_fingerprint(t) for _, t, _ in kept], 2)
    kept = [kept[k] for k in sorted(set(part))]
    frame = spark.createDataFrame(kept, "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(frame).collect() if r["size"]}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = []
    for d, t, _ in kept:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        want += [(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(sp.decode(ids).encode()).hexdigest())] * copies.get(d, 0)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(want)


def test_rules_hold_at_any_depth():
    for deep in ("<font>" * 300, "<div>" * 300, "<ul><li>" * 300):
        def text(x):
            return html_text.render(deep + x).lstrip("- ")
        assert text("a<script>var x = '<b>no';</script><style>p{}</style>b") == "ab"
        assert text("a<b hidden>no<i>no</i></b><template>no</template>b") == "ab"
        assert text("<b style='display:none'><b>no</b>no</b>yes") == "yes"
    assert html_text.render("<font>" * 300 + "<table><tr><td>a<td>b<tr><td>c<td>d</table>") == "a  b\nc  d"
    out = html_text.render("<font>" * 300 + "<div hidden><span>no</span></div><div>yes</div>")
    assert out == "yes"
    lines = html_text.render("<ol><li>x" * 250).split("\n")
    assert len(lines) == 250 and all(x.endswith("1. x") for x in lines)
    assert html_text.render("<ul><li>" * 250 + "<li>b").count("b") == 1
    assert html_text.render("<font>" * 60_000 + "<div>x</div>" * 20_000).count("x") == 20_000


@pytest.mark.parametrize("page,text", [
    ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math>.",
     "so x=2."),
    ("<svg><title/><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata>"
     "<g><text x=1>one</text><path d='M0'/><text>two</text></g></svg>z<desc>w</desc>", "one\ntwo\nzw"),
    ("<svg><defs/><title>no<b></title><text>a</text></svg>b", "a\nb"),
    ("<svg><foreignObject><div/>in</foreignObject></svg>", "in"),
    ("<table><tr style='visibility:hidden'><td>no<td style='visibility:visible'>yes<tr><td>a</table>", "   yes\na"),
    ("<table><caption style='visibility:hidden'>no</caption><tbody style='visibility:collapse'><tr><td>no"
     "<tbody><tr><td>yes</table>", "yes"),
    ("<table><tr><td rowspan=0>r<td>1<tr><td>2<tr><td>3<tbody><tr><td>4</table>", "r  1\n   2\n   3\n4"),
    ("<table><tr><td rowspan='²'>a<td>b</table>", "a  b"),
])
def test_visible_and_hidden_parts(page, text):
    assert [x.rstrip() for x in html_text.render(page).split("\n") if x] == [x for x in text.split("\n") if x]


@pytest.mark.parametrize("page,text", [
    ("<span><div hidden></span>secret</div>after", "after"),
    ("<a><div style='display:none'></a>secret</div>after", "after"),
    ("<a hidden>no<div>no</a>yes</div>", "yes"),
    ("<a>1<div>2</a>3</div>4", "1\n23\n4"),
    ("<b><p>q</b>r</p>s<script>x</script></b>t", "qr\nst"),
    ("<button hidden><div>no</button>yes", "yes"),
    ("<table><form><tr><td>aa<td>b<tr><td>c<td>d</form></table>", "aa  b\nc   d"),
    ("<table><tr><form><td>aa<td>b</form><tr><td>c<td>d</table>", "aa  b\nc   d"),
])
def test_end_tags_across_blocks_and_forms_in_tables(page, text):
    assert [x.rstrip() for x in html_text.render(page).split("\n") if x] == text.split("\n")


def test_a_cell_may_cover_thousands_of_rows():
    lines = html_text.render("<table><tr><td rowspan=3000>r<td>0" + "<tr><td>x" * 2999 + "<tr><td>end</table>").split("\n")
    assert lines[0] == "r    0" and set(lines[1:3000]) == {"     x"} and lines[3000] == "end"
