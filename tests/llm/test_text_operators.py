"""Operators on texts against plain Python versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash

from revlens.llm import brown, common, imatch, langid, line_dedup, mixing, pieces, quality, simhash
from revlens.llm.common import read

SF = "/root/testdata/sf0.001"
_LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def _words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(_LOW)) if w]


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in docs.collect()))


def _by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_words_of_flat_bytes():
    texts = ["Hello  world\n x", None, "", "   ", "hello x", "é b É\tHELLO", "a" * 500_000 + " b"]
    seen = {}
    for i, j, h, first in common.words(pa.array(texts)):
        for k in range(i, j):
            own = h[first[k - i]:first[k - i + 1]].tolist()
            assert len(own) == len(_words(texts[k]))
            for word, value in zip(_words(texts[k]), own):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


# ------------------------------------------------------------------ op1, op4

def test_quality_on_held_out_rows(spark, docs):
    labels = read(spark, "/root/testdata/sf0.01", "labels")
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = _by_id(quality.op1_quality(docs, labels))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [(got[k]["score"], q) for k, q in truth.items() if k in got and got[k]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    x, ref = rng.random((40, quality.TERMS)).astype(np.float32), quality.unit(rng.normal(size=(60, 8)).astype(np.float32))
    model = (rng.normal(size=(quality.TERMS, 8)).astype(np.float32), ref, rng.integers(0, 2, 60).astype(np.float32),
             rng.random(60).astype(np.float32) + 0.5)
    got = quality.votes(x, model)
    for row, score in zip(x, got):
        v = row @ model[0]
        near = sorted(((float(v @ r / np.linalg.norm(v)), lab, w) for r, lab, w in zip(ref, model[2], model[3])), reverse=True)
        near = [(max(s, 1e-3) ** quality.POWER * w, lab) for s, lab, w in near[:quality.NEIGHBOURS]]
        assert score == pytest.approx(sum(w * lab for w, lab in near) / sum(w for w, _ in near), rel=1e-3)


def test_language_on_held_out_rows(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = _by_id(langid.op4_language_id(docs))
    held = [k for k, r in got.items() if r["held_out"]]
    assert held and all(zlib.crc32(str(k).encode()) % 5 == 0 for k in held)
    assert np.mean([got[k]["lang_pred"] == truth[k] for k in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_codewords_separate_languages():
    for n in (2, 3, 5, 7, 8, 40):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n
        assert all(abs(c.sum()) < n for c in code.T)  # both sides of each split
    counts = np.zeros((3, langid.TERMS), int)
    counts[0, :40], counts[1, 30:70], counts[2, 60:99] = 9, 9, 9
    model = langid.fit(dict(zip("abc", counts)))
    k, score, close = langid.decode(np.vstack([counts, counts[:1] * 0]).astype(float), model)
    assert k[:3].tolist() == [0, 1, 2] and (score[:3] > 0.6).all()
    assert close.tolist() == [False, False, False, True]  # no evidence at all


# ----------------------------------------------------------------------- op2

def test_imatch_contract(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 40)  # several ranges
    got = _by_id(imatch.op2_imatch(docs))
    texts = [t for _, t, _, _ in rows]
    for k, (doc_id, text, _, _) in enumerate(rows):
        after = texts[(k + 1) % len(texts)]
        half = len(text) // 2
        new = text[:len(text) - half] + after[:half]
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
    by_text = {}
    for doc_id, text, _, _ in rows:
        assert by_text.setdefault(text, got[doc_id]["fingerprint"]) == got[doc_id]["fingerprint"]
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.2 > 0.05 > np.mean([r["near_next"] for r in got.values()])
    plain = _by_id(imatch.fingerprints(docs))
    assert {k: r["fingerprint"] for k, r in plain.items()} == {k: r["fingerprint"] for k, r in got.items()}


def test_imatch_document_frequencies(docs, rows):
    n, df = imatch.document_frequencies(docs)
    term = lambda t: set(re.findall(rb"[0-9a-z\x80-\xff]+", t.translate(_LOW).encode()))
    count = Counter(w for _, t, _, _ in rows for w in term(t))
    want = np.zeros((imatch.TABLES, imatch.SLOTS), int)
    hashes = {w: common.span_hashes(np.frombuffer(w, np.uint8), np.array([len(w)])) for w in count}
    for w, c in count.items():
        for t in range(imatch.TABLES):
            want[t, imatch._slot(hashes[w], t)] += c
    assert n == len(rows) and (df == want).all()
    band = imatch.Band(n, df)
    for w, c in count.items():
        least = min(want[t, imatch._slot(hashes[w], t)][0] for t in range(imatch.TABLES))
        assert least >= c and band.keeps(hashes[w])[0] == (n ** 0.45 <= least <= n ** 0.75)
    assert sum(min(want[t, imatch._slot(hashes[w], t)][0] for t in range(imatch.TABLES)) == c
               for w, c in count.items()) > 0.999 * len(count)


@pytest.mark.parametrize("terms", [10 ** 4, 10 ** 6])
def test_single_document_terms_go_at_every_size(spark, terms):
    """Of terms in one document only none is kept, however many there are;
    those within the band are."""
    shared = " ".join(f"s{k}" for k in range(20))
    docs = spark.range(1000).selectExpr("id AS doc_id", f"""concat(if(id < 100, '{shared}', ''), ' ', array_join(
        transform(sequence(1L, {terms // 1000}L), k -> concat('t', id * {terms} + k)), ' ')) AS text""")
    band = imatch.Band(*imatch.document_frequencies(docs))
    texts = [r.text.split() for r in docs.where("doc_id < 300").collect()]
    once = [w for t in texts for w in t if w[0] == "t"]
    kept = [band.keeps(common.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([len(w)])))[0]
            for w in once[::max(1, len(once) // 3000)]]
    assert len(kept) >= 2900 and not any(kept)
    assert all(band.keeps(common.span_hashes(np.frombuffer(f"s{k}".encode(), np.uint8), np.array([len(f"s{k}")])))[0]
               for k in range(20))


def _plain_fingerprint(text, band):
    """The definition, term by term: in every family the smallest subset that
    holds a term of the text, and the hash of all terms inside."""
    words = set(re.findall(rb"[0-9a-z\x80-\xff]+", text.translate(_LOW).encode()))
    h = sorted(int(common.span_hashes(np.frombuffer(w, np.uint8), np.array([len(w)]))[0]) for w in words)
    h = [x for x in h if band.keeps(np.array([x], np.uint64))[0]] or h
    if not h:
        h = [int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")]
    out = []
    for seed in imatch._SEEDS.tolist():
        place = [x * seed % 2 ** 64 for x in h]
        top = 1 << min(place).bit_length()
        total = sum(p for p in place if p < top) % 2 ** 64
        out.append(int(common.mix(np.array([total], np.uint64))[0]) >> 32)
    return "".join(f"{x:08x}" for x in out)


def test_imatch_fingerprints_equal_the_definition(docs, rows):
    band = imatch.Band(*imatch.document_frequencies(docs))
    got = _by_id(imatch.fingerprints(docs))
    for doc_id, text, _, _ in rows:
        assert got[doc_id]["fingerprint"] == _plain_fingerprint(text, band)


# ----------------------------------------------------------------------- op3

def test_sentencepiece_equals_the_library(docs, rows):
    path = pieces.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = _by_id(pieces.op3_sentencepiece(docs, path))
    for doc_id, text, _, _ in rows:
        ids = sp.encode(text, add_bos=True, add_eos=True)
        r = got[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    full = {r.doc_id: r for r in pieces.encode(docs, path).limit(20).collect()}
    text = {d: t for d, t, _, _ in rows}
    for k, r in full.items():
        assert list(r.ids) == sp.encode(text[k], add_bos=True, add_eos=True) and r.decoded == sp.decode(list(r.ids))


def test_merge_rounds_on_odd_texts():
    table = pieces.Pieces(pieces.load_model(pieces.default_model()))
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(5)
    parts = ["a", "b", "th", "e", " ", "  ", "▁", "\n", "é", "日", "本", "\x00", "𝄞", "ﬁ", "the ing", " " * 9, "=", "--",
             "...", "aaaa", "0"]
    texts = ["", " ", " " * 5000, "=" * 3000, "<s> <unk> <0x41>", "".join(rng.choice("abcdefgh") for _ in range(9000))]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(2000)]
    got = [ids[e - n:e].tolist() for ids, count in pieces.encode_batch(table, pa.array(texts))
           for n, e in zip(count, np.cumsum(count))]
    want = [sp.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert got == want
    assert [pieces.decode(table, ids) for ids in want] == [sp.decode(ids) for ids in want]


# ----------------------------------------------------------------------- op5

def test_mix_meets_its_targets(docs, rows):
    got = [r.asDict() for r in mixing.op5_mixing(docs).collect()]
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in mixing.op5_mixing(docs).collect())
    source = {d: s for d, _, s, s in rows}
    size = {d: len(_words(t)) for d, t, _, _ in rows}
    total = Counter()
    for d, n in size.items():
        total[source[d]] += n
    names = sorted(total)
    goal = dict(zip(names, mixing.targets([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    assert sum(goal.values()) == pytest.approx(sum(total.values()))
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and r["target"] == pytest.approx(goal[s])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - goal[s]) <= max(n for d, n in size.items() if source[d] == s)


def test_targets_reshare_the_excess():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.targets([1, 10, 10], [5, 2, 1]) == pytest.approx([3, 12, 6])
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], [5]) == []
    assert mixing.targets([1, 1, 100], [5, 2, 1]) == pytest.approx([3, 3, 96])


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 400):
        size, p = np.sort(rng.integers(0, 500, n))[::-1].astype(float), np.full(n, 0.37)
        out = mixing.flight(size, p, rng)
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
        assert out @ size == pytest.approx(p @ size, abs=1e-4) and out.sum() == pytest.approx(p.sum(), abs=1e-6)
    mean = np.mean([mixing.flight_and_landing(np.arange(40.0, 0, -1), np.full(40, 0.3), np.random.default_rng(s))
                    for s in range(300)], axis=0)
    assert abs(mean.mean() - 0.3) < 0.02  # every document keeps a chance


def test_mix_over_many_shards(make_docs):
    rng = random.Random(6)
    texts = ["w " * (5000 if k % 60 == 0 else rng.randrange(1, 300)) for k in range(900)]
    docs = make_docs(texts, sources=["hot" if k % 3 else "a" if k % 2 else None for k in range(900)])
    plan = mixing.mix_plan(docs, shard_rows=40).collect()  # a dozen shards and more of the hot source
    for source in ("hot", "a", None):
        own = [r for r in plan if r.source == source]
        # the last decisions are off by less than the largest document
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) < 5000
        rate = own[0].target / own[0].source_size
        assert all(r.copies in (int(rate), int(rate) + 1) for r in own)
        assert abs(sum(r.copies for r in own) / len(own) - rate) < 0.1


# ----------------------------------------------------------------------- op6

def _fingerprint(text, k=3):
    w = _words(text)
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def _components(codes, limit):
    label = list(range(len(codes)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= limit:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(codes))]


def test_simhash_against_all_pairs(docs, rows):
    got = _by_id(simhash.op6_simhash_near_dedup(docs))
    codes = [_fingerprint(t) for _, t, _, _ in rows]
    assert [got[d]["fingerprint"] for d, *_ in rows] == ["%016x" % c for c in codes]
    assert [got[d]["component_id"] for d, *_ in rows] == [rows[k][0] for k in _components(codes, 2)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {r["component_id"] for r in got.values()}


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 5])
def test_gray_index_finds_all_links(spark, limit):
    rng = random.Random(limit)
    codes = [rng.getrandbits(64) for _ in range(60)]
    for c in codes[:20]:  # chains and dense groups
        for _ in range(8):
            c ^= 1 << rng.randrange(64)
            codes.append(c)
    codes = list(dict.fromkeys([*codes, *(codes[0] ^ b for b in range(200)), 0, (1 << 64) - 1]))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), limit)
    stars = {r.node: r.label for r in simhash.components(edges).collect()}
    want = _components(codes, limit)
    groups = {}
    for c, k in zip(signed, want):
        groups.setdefault(k, []).append(c)
    for group in groups.values():
        assert {stars.get(c, c) for c in group} == {min(group)}
    arr = np.array(codes, np.uint64)
    arr = arr[np.argsort(simhash.gray_rank(arr))]
    found = {(i, j) for a, b in simhash.near_pairs(arr, limit, at_once=50) for i, j in zip(a.tolist(), b.tolist())}
    assert found == {(i, j) for j in range(len(arr)) for i in range(j) if int(arr[i] ^ arr[j]).bit_count() <= limit}


# ----------------------------------------------------------------------- op9

def test_lm_scores(docs, rows, monkeypatch):
    monkeypatch.setattr(brown, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(brown, "PART_WORDS", 3000)
    got = _by_id(brown.op9_lm_scoring(docs))
    words = {d: [*_words(t), None] for d, t, _, _ in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    count = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    for d, ws in words.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[d], len(ws), n)
        assert r["n_known"] == sum(count[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
    test = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def test_model_is_a_distribution(docs):
    from revlens.llm.common import held_out, written
    blocks = written(brown.encoded_blocks(docs, held_out("doc_id", 7, 2)))
    parts = written(brown.counted_parts(blocks, 2))
    n = docs.where(~held_out("doc_id", 7, 2)).count()
    m = brown.train(blocks, parts, n)
    assert np.allclose(m.transition.sum(axis=1), 1)
    # words of a class and its unseen word share the class's emissions
    used = m.mass > 0
    assert np.allclose((m.mass[used] - m.discount * m.types[used]) / m.mass[used] + m.discount * m.types[used] / m.mass[used], 1)
    assert int(m.mass.sum()) == m.train_tokens and int(m.types.sum()) == m.vocabulary


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    kind = np.arange(60) % 3  # words follow words of the next kind
    bigrams = rng.poisson(20, (60, 60)) * (kind[:, None] == (kind[None] - 1) % 3) + 0.0

    def likelihood(of):
        member = np.eye(6)[of]
        t = member.T @ bigrams @ member
        return brown._xlogx(t).sum() - brown._xlogx(t.sum(0)).sum() - brown._xlogx(t.sum(1)).sum()
    of = brown.exchange(bigrams, classes=6)
    start = np.empty(60, int)
    start[np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")] = np.arange(60) % 6
    assert likelihood(of) > likelihood(start)
    assert all(len(set(kind[of == c])) <= 1 for c in range(6))


# ---------------------------------------------------------------------- op10

def _dedup(rows, min_docs=2):
    held = {}
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(_LOW)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(d)
    out = {}
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or min(held[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup_against_plain_python(make_docs, min_docs):
    rng = random.Random(4)
    pool = ["Shared line number one", " shared LINE number one\t", "short", "", "ÉCOLE FRANÇAISE A", "école française a",
            "École française A", "x" * 10, "X" * 10, *(f"only line {k} of many" for k in range(40))]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(80)]
    docs = make_docs(texts)
    text = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_docs=min_docs).collect()}
    got = {r.record.doc_id: (r.n_lines, r.n_dropped, text[r.record.doc_id])
           for r in line_dedup.rebuilt_lines(docs, 10, min_docs).collect()}
    assert got == _dedup(list(enumerate(texts)), min_docs)


def test_line_dedup_deals_out_a_line_of_every_document(make_docs):
    texts = [f"A banner on every page\nonly line {k} of many" + "\na footer of some" * (k % 3) for k in range(300)]
    docs = make_docs(texts)
    gone = line_dedup.dropped_lines(docs)
    plan = gone._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "_salt0" in plan and "python" not in plan and "arrow" not in plan
    got = {r.record.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.rebuilt_lines(docs, 10, 2).collect()}
    want = _dedup(list(enumerate(texts)))
    # a null text: no line went
    assert {d: (n, k, texts[d] if t is None else t) for d, (n, k, t) in got.items()} == want


def test_every_word_is_clustered_by_its_contexts(make_docs, monkeypatch):
    # two kinds of rare words, alike in spelling, told apart by their contexts only; more words than seeds
    monkeypatch.setattr(brown, "SEEDS", 8)
    monkeypatch.setattr(brown, "PART_WORDS", 50)
    rng = random.Random(1)
    texts = []
    for k in range(600):
        a, b = f"w{rng.randrange(60):03d}xyz", f"v{rng.randrange(60):03d}xyz"
        texts.append(f"the {a} runs and the {a} sleeps" if k % 2 else f"we {b} them so you {b} it")
    docs = make_docs(texts)
    blocks = common.written(brown.encoded_blocks(docs, common.held_out("doc_id", 7, 2)))
    parts = common.written(brown.counted_parts(blocks, 3))
    assigned, table, course = brown.clustered(blocks, parts)
    assert len(course) > 1 and course == sorted(course) and course[-1] == pytest.approx(brown.likelihood(table))
    cls = {}
    classes = {r.part: np.frombuffer(zlib.decompress(r.classes), np.uint8) for r in assigned.where("block = -1").collect()}
    for r in parts.where("block = -1").collect():
        for h, k in zip(np.frombuffer(r.hashes, "<u8").tolist(), brown._unplanes(r.codes).tolist()):
            cls[h] = classes[r.part][k]

    def of(kind):
        names = [f"{kind}{k:03d}xyz".encode() for k in range(60)]
        hashes = [int(common.span_hashes(np.frombuffer(w, np.uint8), np.array([len(w)]))[0]) for w in names]
        return Counter(int(cls[h]) for h in hashes if h in cls)
    w, v = of("w"), of("v")
    assert sum(w.values()) > 50 and sum(v.values()) > 50 and max([*w, *v]) < brown.CLASSES
    # nearly all classes hold words of one kind, though all are spelled alike
    assert sum(max(w[c], v[c]) for c in range(brown.CLASSES)) > 0.9 * sum((w + v).values()), (w, v, course)
