"""Spelling variants, whitening and MinHash near-dedup against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from revlens.llm import minhash, spelling, whitening
from revlens.llm.common import read

SF = "/root/testdata/sf0.001"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ----------------------------------------------------------------- spelling

def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    shared = defaultdict(set)
    for w in n:
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            shared[key].add(w)
    near = {w: set() for w in n}
    for words in shared.values():
        for a in words:
            near[a] |= {b for b in words if a != b and _near(a, b)}
    form = {w: min(b, key=lambda x: (-n[x], x)) for w, b in near.items() if b}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}


def _found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_of_documents(spark):
    docs = read(spark, SF, "documents")
    assert _found(spelling.op11_spelling(docs)) == _variants([(r.doc_id, r.text) for r in docs.collect()])


@pytest.fixture(scope="module")
def crowded(make_docs):
    """Few letters and chains of forms: crowded leaves and long ways to roots."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice((7, 8)))) for _ in range(1500)]
    text = words + words[:900] + ["aaaaaaaa"] * 3000 + ["aaaaaaab"] * 290 + ["aaaaaaba"] * 25 + ["x" * 50 + "y"] * 8
    text += ["x" * 50] * 200 + ["STRASSEß", "STRASSEß", "StraßenÉe"] * 2 + ["z" * 200] * 3
    rng.shuffle(text)
    parts = [" ".join(text[i::40]) for i in range(40)]
    return make_docs([*parts, None, "", "x1y2 z", parts[0]], ids=[*range(42), None, 0])


@pytest.mark.parametrize("shard", [1 << 15, 200, 40])
def test_crowded_tries(spark, crowded, shard, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    got = _found(spelling.op11_spelling(crowded))
    assert got == _variants([(r.doc_id, r.text) for r in crowded.collect()])
    assert got["x" * 50 + "y"][:2] == ("x" * 50, "x" * 50)
    if shard == 40:
        dictionary = spelling.word_counts(crowded).where("n >= 2")
        assert spelling.shard_depth(dictionary, spelling.letter_groups(dictionary))[1] > 1


def test_search_in_small_steps(monkeypatch, crowded):
    monkeypatch.setattr(spelling, "_STEP", 50)
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (400, 5)).astype(np.int32)
    trie = spelling.Trie(counts, 0)
    budget = np.ones(400, bool)
    got = set()
    for q, leaf in trie.search(counts, budget, budget):
        for i, k in zip(q.tolist(), leaf.tolist()):
            got |= {(i, int(j)) for j in trie.order[trie.start[k]:trie.start[k + 1]]}
    d = counts[None] - counts[:, None]
    fits = (d.clip(0).sum(axis=2) <= 1) & ((-d).clip(0).sum(axis=2) <= 1)
    assert got == {(int(i), int(j)) for i, j in np.argwhere(fits)}


# ---------------------------------------------------------------- whitening

def _matrix(rows):
    return [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows]


def test_whitening_of_embeddings(spark):
    table = read(spark, SF, "embeddings")
    got = whitening.op12_whitening(table).toPandas().sort_values(["vec_id", "component"])
    rows = sorted(_matrix([(r.vec_id, r.embedding) for r in table.collect()]), key=lambda r: r[0])
    x = np.array([v for _, v in rows])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    deviation = ((n * x - total) ** 2).sum(axis=1)
    assert len(got) == 4 * len(rows) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    for k in range(1, 5):
        mine = got[got.component == k]
        want = (x - total / n) @ v[:, -k] / np.sqrt(e[-k])
        assert min(abs(mine.whitened.to_numpy() - want).max(), abs(mine.whitened.to_numpy() + want).max()) < 1e-9
        assert mine.explained.to_numpy() == pytest.approx(e[-k] / e.sum())
        assert mine.deviation.tolist() == deviation.tolist()


def test_polynomial_and_roots_of_small_matrices(spark):
    a = [[2, 1, 0], [1, 2, 0], [0, 0, 3]]  # 1, 3, 3
    m = whitening.Moments(1, [0, 0, 0], a)
    e = whitening.elementary(spark, m)
    assert e == [1, 7, 15, 9]
    roots = whitening.largest_roots(e, 3)
    assert [(r.times, float(r.value)) for r in roots] == [(2, 3.0), (1, 1.0)]
    assert [whitening.roots_beyond(e, t, 0) for t in (-1, 0, 1, 2, 3)] == [3, 3, 2, 2, 0]
    c = whitening.components_of(spark, m, 3)
    assert np.allclose(c.vectors @ np.array(a) @ c.vectors.T, np.diag([3, 3, 1]))
    rng = np.random.default_rng(0)
    b = rng.integers(-9, 9, (12, 12))
    for p in whitening.primes_beyond(1 << 60):
        got = whitening.polynomial_modulo(b, p)
        want = [int(round(x)) % p for x in np.poly(b.astype(float))[::-1]]
        assert got.tolist()[-5:] == want[-5:]


def test_close_roots_are_told_apart(spark):
    # eigenvalues 10**9 + 1 and 10**9 - 1 apart from 10**9
    a = [[10 ** 9, 1, 0], [1, 10 ** 9, 0], [0, 0, 10 ** 9]]
    c = whitening.components_of(spark, whitening.Moments(1, [0, 0, 0], a), 3)
    assert np.allclose(np.abs(c.vectors), [[0.5 ** 0.5, 0.5 ** 0.5, 0], [0, 0, 1], [0.5 ** 0.5, 0.5 ** 0.5, 0]], atol=1e-15)


def test_sums_are_exact_for_large_entries():
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 62), 1 << 62, (700, 3))
    total = whitening.sums_and_products(x)
    rows = [[1, *map(int, r)] for r in x]
    assert total.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(4)] for i in range(4)]


def test_whitening_on_edge_cases(spark):
    kind = "vec_id long, embedding array<double>, x int, component int, n int"

    def run(rows):
        return whitening.op12_whitening(spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], kind)).toPandas()

    axes = [(10 * j + s, [3.0 * s if i == j else 0.0 for i in range(5)]) for j in range(5) for s in (1, -1)]
    odd = [(90, None), (91, [None] * 5), (92, [float("nan")] * 5), (93, [float("inf")] * 5), (94, [1.0]), (95, [])]
    got = run([*axes, *odd, axes[0], (None, [0.0] * 5)])
    assert sorted(got.vec_id.dropna().unique()) == sorted(i for i, _ in axes) and got.vec_id.isna().sum() == 4
    assert len(got) == 48 and set(got.n) == {11} and got.identity_error.max() < 1e-12
    assert len(got[got.vec_id == axes[0][0]].drop_duplicates()) == 4
    assert len(run([])) == len(run(odd[:4])) == len(run([(1, [1.0, 2.0])] * 3)) == 0
    one = run([(1, [1.0, 2.0]), (2, [1.0, 3.0])])
    assert sorted(one.whitened) == [-1, 1] and set(one.explained) == {1.0} and set(one.deviation) == {256 ** 2}
    huge = run([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 1.0])])
    assert huge.deviation.isna().sum() == 4 and huge.identity_error.max() < 1e-9


# ------------------------------------------------------------------ minhash

def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _classes(rows, percent=85):
    sets = [_set(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(k):
        while part[k] != k:
            part[k] = part[part[k]]
            k = part[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            shared = len(a & b)
            if a and b and 100 * shared >= percent * (len(a) + len(b) - shared):
                part[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [x for x in least[find(k)] if x is not None]
        c = min(ids) if ids else None
        out.append((i, len(sets[k]), c, None if i is None or c is None else i == c))
    return sorted(out, key=str)


def _near_docs(rng, n_bases=25, words=120):
    texts = []
    for b in range(n_bases):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(rng.choice((1, 2, 12))):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(words)] = f"v{rng.randrange(10 ** 6)}"
            texts.append(" ".join(copy))
    return texts


def _result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_near_dedup_against_all_pairs(spark, make_docs):
    rng = random.Random(11)
    texts = _near_docs(rng) + ["", None, "one two", "One TWO", " \n", "a b c d e", "a b c d f"]
    texts += texts[:5]
    rng.shuffle(texts)
    ids = list(range(len(texts)))
    ids[3], ids[9] = None, ids[8]
    docs = make_docs(texts, ids=ids, extra=True)
    assert _result(minhash.op13_minhash_near_dedup(docs)) == _classes(list(zip(ids, texts)))


def test_deep_and_crowded_regions(spark, make_docs, monkeypatch):
    """One group of near copies and unlike texts that share much: regions with
    many loose classes, dealt to many blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 6)
    monkeypatch.setattr(minhash, "FREQUENT", 4)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(90):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(150)] = f"v{rng.randrange(10 ** 6)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    got = _result(minhash.op13_minhash_near_dedup(make_docs(texts)))
    want = _classes(rows)
    assert len({c for _, _, c, _ in want}) > 3 and got == want
    # regions that grow deeper lose few links and find no others
    monkeypatch.setattr(minhash, "LOOSE", 6)
    deep = {i: c for i, _, c, _ in _result(minhash.op13_minhash_near_dedup(make_docs(texts)))}
    kept = [i for i, _, c, _ in want if deep[i] == c]
    assert len(kept) >= 0.9 * len(texts) and all(deep[i] >= c for i, _, c, _ in want)


def test_signatures_estimate_likeness():
    import pyarrow as pa
    rng = random.Random(3)
    base = [f"w{i}" for i in range(2000)]
    other = [w if rng.random() > 0.02 else w + "x" for w in base]
    a, b = " ".join(base), " ".join(other)
    n, digest, sig = minhash.signature_array(pa.array([a, b, a.upper(), None]))
    x, y = _set(a), _set(b)
    assert n.tolist() == [len(x), len(y), len(x), 0]
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.13
    assert (sig[0] == sig[2]).all() and (digest[0] == digest[2]).all() and (digest[0] != digest[1]).all()
