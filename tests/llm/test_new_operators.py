"""Sketches, whitening and tokenizer alignment beside plain versions, and on the odd cases their docstrings name."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate, combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyhire.llm import alignment, neighbours, sketching, whitening
from tallyhire.operators.settle import settled

DOC_SCHEMA = "doc_id long, text string, place long, cid long, digest string, u long, key string, n_a long"
WORDS = [f"{a}{b}" for a in "ka lo mi ru se to va".split() for b in "ne pi dor gal xu".split()]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def frame(spark, texts: list, schema: str = DOC_SCHEMA, repeat: tuple = ()):
    rows = [(i, t, 1, 2, "x", 3, "k", 4) for i, t in enumerate(texts)]
    rows += [rows[i] for i in repeat] + [(None, texts[-1], None, None, None, None, None, None), (None, None, 0, 0, "", 0, "", 0)]
    return spark.createDataFrame(rows, schema).repartition(3)


# 11 --------------------------------------------------------------------------------------------------------------------

def similar_classes(rows: list[tuple], link: int = 80) -> dict:
    """Component of every doc_id by comparing all pairs of sets."""
    def words(t):
        return (t or "").encode().lower().split()

    sets = {(i, t): frozenset(zip(w, w[1:])) if len(w := words(t)) > 1 else frozenset(w) for i, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, y in combinations(sets, 2):
        a, b = sets[x], sets[y]
        common = len(a & b)
        if common and 100 * common >= link * (len(a) + len(b) - common):
            parent[root(x)] = root(y)
    least = defaultdict(list)
    for k in sets:
        least[root(k)].append(k[0])
    return {k: (len(sets[k]), min((i for i in least[root(k)] if i is not None), default=None) if sets[k] else k[0]) for k in sets}


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    base = prose(rng, 300)
    texts = [None, "", " \n\t ", "one", "ONE", "one two", "one two", base, base.upper(), base.replace(" ", "\n ")]
    texts += [edited(rng, base, share) for share in (0.01, 0.03, 0.05, 0.08, 0.09, 0.1, 0.11, 0.12, 0.2) for _ in range(6)]
    chain = [prose(rng, 120)]
    for _ in range(12):
        chain.append(edited(rng, chain[-1], 0.07))
    short = [prose(rng, 9) for _ in range(20)]
    short += [edited(rng, t, 0.1) for t in short]
    return texts + chain + short + [prose(rng, 30_000), "tail tail tail", "tail tail"]


def test_sketch_components_match_all_pairs(spark, odd_texts):
    df = frame(spark, odd_texts, repeat=(7, 7, 0))
    got = sketching.near_duplicates(df).collect()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = similar_classes(rows)
    assert Counter(map(tuple, got)) == Counter((i, *want[(i, t)], i == want[(i, t)][1]) for i, t in rows)


def test_buckets_cut_into_parts_lose_no_link(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        base = prose(rng, 150)
        texts += [edited(rng, base, rng.choice((0.04, 0.1, 0.14))) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = settled(sketching.sketched(docs))
    classes = rows.selectExpr("place cid", "row_key", "bands")
    found = dict(map(tuple, sketching.linked_classes(classes, docs, part_size=400).collect()))
    place = {r.place: r.doc_id for r in rows.select("place", "doc_id").collect()}
    want = similar_classes(list(enumerate(texts)))
    groups = {p: want[(i, texts[i])][1] for p, i in place.items()}
    ours = {p: found.get(p, p) for p in place}
    assert {frozenset(p for p in place if ours[p] == r) for r in ours.values()} == {
        frozenset(p for p in place if groups[p] == r) for r in groups.values()}


@pytest.mark.parametrize("size", [1, 2, 7, 60, 900])
def test_sketches_are_full_and_agree_as_often_as_sets(size):
    rng = np.random.default_rng(size)
    agreed, meant = [], []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, size, np.uint64)
        extra = rng.integers(0, 1 << 63, max(1, size // 4), np.uint64)
        x, y = sketching.sketch(np.unique(both)), sketching.sketch(np.unique(np.concatenate([both, extra])))
        assert x.all() and y.all() and len(x) == sketching.BINS
        agreed.append(np.mean(x == y))
        meant.append(size / (size + len(extra)))
    assert abs(np.mean(agreed) - np.mean(meant)) < 0.03
    if size >= 60:
        assert np.std(agreed) < 1.5 * np.sqrt(0.8 * 0.2 / sketching.BINS)


def test_sketch_of_no_documents(spark):
    assert sketching.near_duplicates(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    assert [tuple(r) for r in sketching.near_duplicates(frame(spark, ["a b c"]).where("doc_id = 0")).collect()] == [(0, 2, 0, True)]


# 12 --------------------------------------------------------------------------------------------------------------------

VEC_SCHEMA = "vec_id long, embedding array<float>, n long, component int, dim int"


def vectors_frame(spark, vectors: list, kind: str = VEC_SCHEMA):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in enumerate(vectors)], kind).repartition(5)


def check_whitening(rows: list, kept: dict, components: int = 32):
    """Rows of one length against numpy's own eigenvectors."""
    ids = sorted(kept)
    x = np.floor(64 * np.array([kept[i] for i in ids], np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), [sum(c) for c in zip(*x.tolist())]
    centred = x - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    many = min(components, int((values > 1e-10 * values[0]).sum())) if values[0] > 0 else 0
    got = defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    assert len(rows) == n * many and (not many or sorted(got) == ids)
    for k in range(many):
        mine = np.array([got[i][k + 1].whitened for i in ids])
        plain = centred @ vectors[:, k] / np.sqrt(values[k])
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < 1e-6
    for i, row in zip(ids, x.tolist()):
        for r in got[i].values():
            assert r.n == n and r.deviation == sum((n * e - s) ** 2 for e, s in zip(row, sums))
            assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-4 * r.explained
            assert r.identity_error < 1e-6


def test_whitening_matches_eigenvectors_per_length(spark):
    rng = np.random.default_rng(1)
    long = (rng.standard_normal((300, 90)) * np.linspace(3, 0.2, 90)).astype(np.float32).tolist()
    short = (rng.standard_normal((40, 7)) * np.arange(1, 8)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None, 2.0], [float("nan")] * 7, [float("inf")] + [0.0] * 6]
    rows = whitening.whitened(vectors_frame(spark, long + short + odd)).collect()
    check_whitening([r for r in rows if r.vec_id < 300], dict(enumerate(long)))
    check_whitening([r for r in rows if r.vec_id >= 300], {300 + i: v for i, v in enumerate(short)})


@pytest.mark.parametrize("vectors", [
    [[1.0, 2.0, 3.0]], [[1.0, 2.0]] * 5, [[0.0] * 40, [1.0] * 40, [2.0] + [1.0] * 39],
    [[float(i % 3), float(i), 2.0 * i, 0.0] for i in range(30)], [[float(i)] for i in range(9)],
])
def test_whitening_leaves_out_components_without_variance(spark, vectors):
    check_whitening(whitening.whitened(vectors_frame(spark, vectors)).collect(), dict(enumerate(vectors)))


def test_whitening_of_equal_eigenvalues_and_huge_entries(spark):
    axes = [[float(s * (k == j)) for j in range(50)] for k in range(50) for s in (-1, 1)]
    rows = whitening.whitened(vectors_frame(spark, axes)).collect()
    assert len(rows) == 100 * 32 and max(r.identity_error for r in rows) < 1e-9
    values = np.zeros((100, 32))
    for r in rows:
        values[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(values.T @ values / 100 - np.eye(32)).max() < 1e-9
    huge = whitening.whitened(vectors_frame(spark, [[3e38, 1.0], [-3e38, 2.0], [0.0, 5.0]])).collect()
    assert {r.vec_id for r in huge if r.deviation is None} == {0, 1} and {r.vec_id for r in huge} == {0, 1, 2}


def test_whitening_filter_converges_without_widening(spark, monkeypatch):
    """A flat spectrum is certified by the filter: the block stays narrower than the vectors."""
    rng = np.random.default_rng(4)
    flat = rng.standard_normal((400, 80)).astype(np.float32).tolist()
    monkeypatch.setattr(whitening, "widened", lambda *a: pytest.fail("widened"))
    fits = whitening.fitted(whitening.packed(vectors_frame(spark, flat), "vec_id", "embedding"))
    f = fits[80]
    assert f.q.shape == (80, whitening.COMPONENTS + whitening.GUARD) and 0 < f.lower < f.values[-1] and f.cycles > 1


def test_whitening_of_no_vectors(spark):
    assert whitening.whitened(spark.createDataFrame([], VEC_SCHEMA)).count() == 0
    assert whitening.whitened(vectors_frame(spark, [None, [None]])).count() == 0


# 13 --------------------------------------------------------------------------------------------------------------------

PATHS = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))


def plain_alignment(texts: list) -> list[tuple]:
    """All columns but the id, from whole texts, decoded bytes alone and a loop over all overlapping tokens."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    spelt_a = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if i != 50256}
    spelt_b = {i: bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
               for i in range(b.get_piece_size()) for p in [b.id_to_piece(i)]}
    per, counts = [], Counter()
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if not x or b"".join(spelt_a[i] for i in x) != whole or b"".join(spelt_b[i] for i in y) != whole:
            per.append(None)
            continue
        ends_x, ends_y = list(accumulate(len(spelt_a[i]) for i in x)), list(accumulate(len(spelt_b[i]) for i in y))
        links, first = [], 0
        for i, (start, stop) in enumerate(zip([0, *ends_x], ends_x)):
            while ends_y[first] <= start:
                first += 1
            j = first
            while j < len(y) and (ends_y[j - 1] if j else 0) < stop:
                links.append((x[i], y[j]))
                j += 1
        groups = defaultdict(lambda: ([], []))
        shared = sorted(set(ends_x) & set(ends_y))
        for side, (ids, ends) in enumerate(((x, ends_x), (y, ends_y))):
            for k, e in zip(ids, ends):
                groups[next(s for s in shared[np.searchsorted(shared, e):])][side].append(k)
        written = ";".join("|".join(",".join(map(str, s)) for s in groups[g]) for g in shared)
        counts.update(links)
        per.append((len(x), len(y), len(shared), links, hashlib.sha256(written.encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else (
        *p[:3], len(p[3]), sum(counts[k] == best[k[1]] for k in p[3]), sum(counts[k] for k in p[3]), p[4]) for p in per]


def alignment_texts() -> list:
    rng = random.Random(2)
    letters = "ab é中😀  '’.,0\n\t  ▁<>|s½ก́"
    texts = [None, "", " ", "  a", "a ", "<|endoftext|> x</s> <s>", "<0x41> a", "x▁y", "b▁ c", "naïve 😀😀 \U00013080z", "it's  we'll 's",
             "\x00 a", "中文 中文", "a" * 3000, "ab " * 4000, "tail"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return texts + [prose(rng, 200)] * 3


def test_alignment_matches_plain_version(spark):
    texts = alignment_texts()
    df = frame(spark, texts, repeat=(9, 9))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = alignment.digests(df, *PATHS).collect()
    assert Counter(map(tuple, got)) == Counter((i, *w) for (i, _), w in zip(rows, plain_alignment([t for _, t in rows])))


def test_alignment_counts_beyond_the_head(spark, monkeypatch):
    texts = alignment_texts()[:200]
    monkeypatch.setattr(alignment, "HEAD", 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in alignment.digests(df, *PATHS).collect()} == {(i, *w) for i, w in enumerate(plain_alignment(texts))}


def test_units_are_encoded_as_in_their_texts():
    own = alignment.Aligner(*PATHS)
    assert own.by_words
    for text in alignment_texts():
        whole = own.text(text) if text else None
        units = next(own.documents([text]))
        if whole is None:
            assert units is None
        else:
            assert b"".join(u.written for u in units) == b"".join(own.written(whole)[0])
    own.by_words = False
    assert next(own.documents(["a b c"]))[0].n_a == 3


def test_alignment_groups_spell_the_text(spark):
    texts = ["naïve 😀 words, it's", "plain words", None, "x▁"]
    rows = alignment.groups(frame(spark, texts), *PATHS).where("doc_id is not null").orderBy("doc_id", "ordinal").collect()
    own = alignment.Aligner(*PATHS)
    for i in (0, 1):
        mine, at = [r for r in rows if r.doc_id == i], 0
        for k, r in enumerate(mine):
            data = (" " + texts[i]).encode()[r.start:r.stop]
            assert r.ordinal == k and r.start == at
            assert b"".join(own.a_bytes[t] for t in r.a_ids) == data == b"".join(own.b_bytes[t] for t in r.b_ids)
            at = r.stop
        assert at == len((" " + texts[i]).encode())
    assert {r.doc_id for r in rows} == {0, 1}


def test_alignment_of_no_documents(spark):
    assert alignment.digests(spark.createDataFrame([], DOC_SCHEMA), *PATHS).count() == 0
    got = alignment.digests(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *PATHS).collect()
    assert {tuple(r) for r in got} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)}


# 8: small tables, several lengths, queries that meet too few -----------------------------------------------------------

def nearest_by_force(vectors: dict, nearest: int = 20) -> dict:
    def product(a, b):
        total = 0.0  # one after the other: sum() compensates for rounding
        for x, y in zip(a, b):
            total += x * y
        return total

    out = {}
    for q, a in vectors.items():
        if q % 20 == 0:
            near = [(-product(a, b), i) for i, b in vectors.items() if i != q and len(b) == len(a)]
            out[q] = [(i, -s) for s, i in sorted(near)[:nearest]]
    return {q: v for q, v in out.items() if v}


def searched(spark, vectors: dict) -> dict:
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in sorted(neighbours.search(frame).collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return dict(got)


@pytest.mark.parametrize("rows", [1, 2, 15, 21])
def test_neighbours_of_a_small_table_are_all_found(spark, rows):
    rng = np.random.default_rng(rows)
    vectors = {i * 4: rng.standard_normal(6).tolist() for i in range(rows)}
    assert searched(spark, vectors) == nearest_by_force(vectors)


def test_neighbours_of_several_lengths_and_large_norms(spark):
    rng = np.random.default_rng(9)
    vectors = {i: rng.standard_normal(8).tolist() for i in range(0, 500, 5)}
    vectors |= {1000 + 10 * i: (rng.standard_normal(64) * 8e6).tolist() for i in range(12)}
    vectors |= {2000 + i: v for i, v in enumerate([[1e-3, 2.0], [1e5, -1.0], [1e5, -1.0], [0.5, 0.5]])}
    assert searched(spark, vectors) == nearest_by_force(vectors)


def test_neighbours_met_too_rarely_are_searched_exactly(spark, monkeypatch):
    """Without the exact way for small lengths and with one probe, hashing finds too few; the rest comes from all axes."""
    monkeypatch.setattr(neighbours, "EXACT_ROWS", 0)
    monkeypatch.setattr(neighbours, "probes_needed", lambda *a: 1)
    rng = np.random.default_rng(3)
    vectors = {i: rng.standard_normal(32).tolist() for i in range(0, 600, 2)}
    got, want = searched(spark, vectors), nearest_by_force(vectors)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
