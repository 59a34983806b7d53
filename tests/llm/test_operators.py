"""Every operator beside a brute-force version, and on the odd cases each docstring names."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyhire.llm import chat, components, mixing, neighbours, packing, pages, quality, rules, simhash, toxicity, warc
from tallyhire.operators.settle import run_folder

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = "alpha beta gamma delta the of and to in is river stone cloud paper light green over under quick slow".split()
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, _words string, score double"


def prose(rng: random.Random, n: int) -> str:
    out = [rng.choice(WORDS) + (rng.choice(["", "", ",", "."])) for _ in range(n)]
    return " ".join(out).replace(". ", ".\n")


@pytest.fixture(scope="module")
def docs():
    """Odd documents: nulls, empties, repeats, near copies, a very long text, and columns whose names clash."""
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "Same Same", "<|endoftext|> x", "中文 ½ é", "!!! ### $$$"]
    base = prose(rng, 200)
    texts += [base, base, base.upper(), base + " end", " ".join(base.split()), base.replace("river", "lake", 1)]
    texts += [prose(rng, rng.randint(5, 400)) for _ in range(60)]
    texts += ["spam ham eggs toast jam tea milk bread " * 30, prose(rng, 40_000)]
    rows = [(i, t, "en", "hot" if i % 3 else (None if i % 2 else f"s{i % 7}"), len(t or ""), 1, "w", 0.5) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def documents(spark, docs):
    return spark.createDataFrame(docs, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


# 1 ---------------------------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""),
            (5, "http://e", "z" * 500_000), (5, "http://e", "z" * 500_000), (None, "http://n", "only"), (None, "u", "<p>é</p>")]
    pages_in = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    got = warc.round_trip(spark, pages_in).collect()
    best = defaultdict(lambda: None)
    for page, _, html in rows:
        if page is not None:
            best[html or ""] = max(best[html or ""] or -1, page)
    want = []
    for page, _, html in rows:
        data, first = (html or "").encode(), best[html or ""]
        own = first is None or first == page
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "response" if own else "revisit", None if own else first))
    assert Counter(map(tuple, got)) == Counter(want)
    assert warc.round_trip(spark, pages_in.limit(0)).collect() == []


def test_warc_reads_selected_records_with_their_payload(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i + 1)) for i in range(50)]
    folder = run_folder(spark, "warc-test")
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    found = {r.page_id: r for r in warc.read(index.where("page_id % 7 = 0"), folder).collect()}
    assert sorted(found) == list(range(0, 50, 7))
    assert all(bytes(r.payload).decode() == rows[i][2] and r.url == rows[i][1] for i, r in found.items())


def test_ranges_coalesce_sorted_places():
    places = [(0, 10), (10, 5), (15 + warc.GAP, 5), (21 + 2 * warc.GAP, warc.READ), (21 + 2 * warc.GAP + warc.READ, 1)]
    got = list(warc.ranges(places))
    assert [m for *_, m in got] == [[0, 1, 2], [3], [4]]
    assert all(a <= places[i][0] and places[i][0] + places[i][1] <= b for a, b, m in got for i in m)


# 2 ---------------------------------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    import xxhash

    words = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_match_brute_force(documents, docs, no_documents):
    got = Counter(map(tuple, simhash.near_duplicates(documents).collect()))
    fps = [brute_fingerprint(r[1]) for r in docs]
    groups = defaultdict(list)
    for row, g in zip(docs, brute_components(fps)):
        groups[g].append(row[0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    assert got == Counter((r[0], f"{f:016x}", least[g]) for r, f, g in zip(docs, fps, brute_components(fps)))
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.values())
    assert simhash.near_duplicates(no_documents).collect() == []
    assert simhash.one_of_each(no_documents).collect() == []


def test_links_connect_dense_and_sparse_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SUBTRIE", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        seed = rng.getrandbits(64)
        fps |= {seed} | {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(5)}
    hot = rng.getrandbits(64)
    fps = sorted(fps | {hot ^ sum(1 << b for b in rng.sample(range(12), 3)) for _ in range(120)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(frame)).collect()}
    want = defaultdict(set)
    for s, g in zip(signed, brute_components(fps)):
        want[g].add(s)
    got = defaultdict(set)
    for s in signed:
        got[found.get(s, s)].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5, 5), (7, 6)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(1, 301)) and all(found[1001 + i] == 1000 for i in range(200))
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


# 3, 10 -----------------------------------------------------------------------------------------------------------------

def labelled(spark, rng, bad):
    rows, labels = [], []
    for i in range(400):
        y = rng.random() < 0.4
        rows.append((i, bad(rng) if y else prose(rng, rng.randint(30, 120))))
        labels.append((i, int(not y), int(y), "clash"))
    return (spark.createDataFrame(rows + rows[:3] + [(None, None), (1000, "")], "doc_id long, text string"),
            spark.createDataFrame(labels + [(None, 1, 1, "x"), (5000, None, None, "x")], "doc_id long, quality int, toxic int, text string"))


def test_quality_learns_and_scores_every_row(spark):
    rng = random.Random(1)
    documents, labels = labelled(spark, rng, lambda r: " ".join([r.choice(WORDS) + "###"] * r.randint(20, 60)))
    forest = quality.fitted(documents, labels)
    rows = quality.scored(documents, forest).collect()
    assert len(rows) == 405 and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    wide = documents.withColumn("score", F.lit("x"))
    passed = quality.passing(wide, forest)
    assert passed.columns == wide.columns and passed.count() == sum(r.predicted for r in rows)
    empty = quality.fitted(documents.limit(0), labels)
    assert [r.score for r in quality.scored(documents.limit(2), empty).collect()] == [0.5, 0.5]
    assert quality.scored(documents.limit(0), forest).collect() == []


def test_forest_walk_matches_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.fit(x, y)

    def walk(row):
        total = forest.bias
        for feature, threshold, value in zip(forest.features, forest.thresholds, forest.values):
            node = 0
            while 2 * node + 2 < len(value):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97


def test_toxicity_finds_passages_and_scores_every_row(spark):
    rng = random.Random(2)

    def bad(r):
        words = prose(r, r.randint(60, 120)).split(" ")
        at = r.randrange(len(words))
        return " ".join(words[:at] + [r.choice(["vilest", "vilely", "nastier"]) for _ in range(4)] + words[at:])

    documents, labels = labelled(spark, rng, bad)
    model = toxicity.fitted(documents, labels)
    rows = toxicity.scored(documents, model).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 405 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in rows:
        if r.predicted:
            words = toxicity.TOKEN.findall(texts[r.doc_id].lower())
            assert any(w.startswith(("vil", "nast")) for p in r.passages for w in words[p.first:p.after])
    assert all(r.predicted == 0 for r in rows if r.doc_id in (None, 1000))
    assert toxicity.scored(documents.limit(0), model).collect() == []
    nothing = toxicity.fitted(documents, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.scored(documents, nothing).collect()} == {0}


def test_maximal_segments_match_the_recursive_definition():
    rng = random.Random(4)

    def best(scores, a, b):
        found = max(((sum(scores[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if found[0] <= 0:
            return []
        s, i, j = found
        return best(scores, a, i) + [(i, j, s)] + best(scores, j, b)

    for _ in range(300):
        scores = [rng.uniform(-1, 1) for _ in range(rng.randint(0, 12))]
        got = [(a, b, round(s, 9)) for a, b, s in toxicity.maximal_segments(scores)]
        assert got == [(a, b, round(s, 9)) for a, b, s in best(scores, 0, len(scores))]


# 4 ---------------------------------------------------------------------------------------------------------------------

def test_frames_deviate_by_less_than_a_block():
    rng = random.Random(9)
    for _ in range(30):
        quotas = {f"l{i}": rng.randint(1, 40) for i in range(rng.randint(1, 12))}
        slots, done = sum(quotas.values()), Counter()
        for t, (lane, i) in enumerate(mixing.frame(quotas), 1):
            assert i == done[lane]
            done[lane] += 1
            assert all(abs(done[n] - q * t / slots) < 1 for n, q in quotas.items())


def test_segments_place_every_block_once():
    blocks = {"a": 1000, "b": 37, "c": 1, "d": 0, "e": 400}
    plan = mixing.segments(blocks, {"a": 5.0, "b": 1.0, "c": 1.0, "d": 9.0, "e": 5.0}, 64)
    placed = Counter()
    at = 0
    for s in plan:
        assert s.start == at and s.slots == sum(s.quotas.values())
        at += s.slots * s.repeats
        for lane, q in s.quotas.items():
            assert s.first[lane] == placed[lane]
            placed[lane] += q * s.repeats
    assert placed == Counter({k: n for k, n in blocks.items() if n})


def test_mixing_keeps_every_row_and_the_shares(spark, documents, no_documents):
    rows = [(i, "x" * 10, "big" if i < 3000 else "small", i) for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, mixed long").repartition(5)  # written first
    got = mixing.mixed(frame, {"big": 1.0, "small": 1.0}, block_size=100, slots=16).collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    by_slot = Counter((r.mix_slot, r.source) for r in got)
    seen = Counter()
    for slot in range(200):  # both sources last for 200 slots
        for source in ("big", "small"):
            seen[source] += by_slot[slot, source] / 10
        assert abs(seen["big"] - seen["small"]) < 2
    ordered = mixing.in_order(documents)
    assert ordered.columns == documents.columns
    assert Counter(r.doc_id for r in ordered.collect()) == Counter(r.doc_id for r in documents.collect())
    assert mixing.mixed(no_documents).collect() == []


def test_mixing_gives_every_source_its_lane_and_weight(spark):
    rows = [(f"s{i}", "xxxx") for i in range(600) for _ in range(6)]
    frame = spark.createDataFrame(rows, "source string, text string")
    weights = {f"s{i}": 599.0 if i == 99 else 1.0 for i in range(600)}  # s99 has half of the weight
    got = mixing.mixed(frame, weights, block_size=4).collect()
    assert sorted(r.mix_slot for r in got) == list(range(3600))
    assert max(r.mix_slot for r in got if r.source == "s99") < 13
    assert len({r.source for r in got if r.mix_slot < 1200}) == 600


def test_schedule_stays_within_a_block_of_the_weights():
    rng = random.Random(4)
    cases = [{f"l{i}": 0.5 if not i else 0.5 / 19 for i in range(20)}, {f"l{i}": 0.5 if not i else 0.5 / 510 for i in range(511)},
             {"a": 0.7, "b": 0.2999, "c": 0.0001}, *[{f"l{i}": rng.random() ** 4 + 1e-4 for i in range(40)} for _ in range(4)]]
    for weights in cases:
        blocks = {n: 1 + int(20_000 * w / sum(weights.values()) * rng.uniform(0.3, 2)) for n, w in weights.items()}
        done = Counter()
        exact = {n: Fraction(w) for n, w in weights.items()}
        ends = sorted((Fraction(blocks[n]) / w, n) for n, w in exact.items())
        moving, over, at = sum(exact.values()), 0, 0
        for t, (lane, i) in enumerate(mixing.placed(blocks, weights), 1):
            assert i == done[lane]
            done[lane] += 1
            if t % 97 and t % 1024:
                continue
            while at < len(ends) and over + ends[at][0] * moving <= t:  # the fluid by definition, lane by lane
                over, moving, at = over + blocks[ends[at][1]], moving - exact[ends[at][1]], at + 1
            virtual = (t - over) / moving if moving else ends[-1][0]
            assert all(abs(done[n] - min(blocks[n], w * virtual)) < 1 for n, w in exact.items())
        assert done == blocks


# 5 ---------------------------------------------------------------------------------------------------------------------

def brute_counts(text):
    words = SPACE.findall(text or "")
    lines = [line for line in (text or "").split("\n") if SPACE.search(line)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    n, repeated = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated,
            n < 20 or 100 * repeated > 30 * n)


def test_rules_match_brute_force_without_python(documents, docs, no_documents):
    judged = rules.judged(documents)
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter((r.doc_id, *[r[c] for c in columns]) for r in judged.collect())
    assert got == Counter((r[0], *brute_counts(r[1])) for r in docs)
    kept = rules.kept(documents)
    assert kept.columns == documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in judged.where("kept").collect())
    assert rules.judged(no_documents).collect() == [] and rules.kept(no_documents).collect() == []


# 6 ---------------------------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_CHARS", 200)
    rng = random.Random(6)
    pool = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<\\|im_end|>", "<", "|", "\\", "\n", " ", "é", "中", "😀", "a", "assistant", "<|endoftext|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|im_sep|>"]), rng.choice([None, "", "".join(rng.choices(pool, k=12))]))
            for c in [None, *range(40)] for t in range(rng.randint(1, 6))]
    rows += [rows[0], rows[0]] + [(99, t, "assistant", "long " * 50) for t in range(30)]
    frame = chat.with_probe(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    groups = defaultdict(list)
    for c, t, role, text in rows + [(-1, t, r, "<|im_end|><|im_start|>assistant ok") for t, r in enumerate(("user", "assistant"))]:
        groups[c].append((t, role or "", text or ""))
    want = set()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want.add((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest()))
    got = chat.digests(frame, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    assert chat.digests(frame.limit(0), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_escape_is_reversible_and_hides_controls():
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choices("<|\\ >im_end", k=rng.randint(0, 20)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


# 7 ---------------------------------------------------------------------------------------------------------------------

def test_page_lines_and_difference(spark):
    html = ("<html><head><title>t</title></head><body><header>Site</header><nav><li>a</li></nav><div class='cookie-notice'>ok</div>"
            "<article><header><h1>Head &amp; more</h1></header><p>One\n two<p>Three<br>four<script>x='<p>'</script>"
            "<aside>ad</aside><form>f</form><section id=comments><article class=comment><p>me</p></article></section></article>"
            "<footer>&copy;</footer>")
    furniture = "<div>Welcome to our shop</div><div>{}</div><div>All rights reserved</div>"
    rows = [(1, "http://h/a/1", html), (2, "http://p/x/1", furniture.format("first story")),
            (3, "http://p/x/2", furniture.format("second story")), (4, None, None), (5, "http://q/", ""),
            (6, "http://q/z", "<p>tail <b>open"), (6, "http://q/z", "<p>tail <b>open"), (7, "bad url", "plain <3 text <foo")]
    got = {r.page_id: r for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[1].text == "Head & more\nOne two\nThree\nfour" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "first story" and got[3].text == "second story"
    assert [got[i].text for i in (4, 5, 6, 7)] == ["", "", "tail open", "plain <3 text"]


def test_alignment_decides_on_lines_outside_of_an_article(spark):
    page = ("<div>Welcome</div><nav>Home {0}</nav><article>Teaser {0}</article><div>Story {0}</div>"
            "<article>Quoted by all</article><div>All rights reserved</div>")
    rows = [(n, f"http://t/x/{n}", page.format(n)) for n in (1, 2, 3)]
    rows += [(4, "http://alone/1", page.format(4)), (5, "http://u/1", page.format(5)), (6, "http://u/2", page.format(5))]
    got = {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert [got[n] for n in (1, 2, 3)] == [f"Teaser {n}\nStory {n}\nQuoted by all" for n in (1, 2, 3)]
    # no neighbour, and copies of each other: the article alone
    assert got[4] == "Teaser 4\nQuoted by all" and got[5] == got[6] == "Teaser 5\nQuoted by all"


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(10)

    def longest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randint(0, 10)) for _ in range(2))
        at = sorted(pages.shared(a, b))
        assert len(at) == longest(a, b)
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in at))


# 8 ---------------------------------------------------------------------------------------------------------------------

def dot(a, b):
    total = 0.0  # one after the other: sum() compensates for rounding
    for x, y in zip(a, b):
        total += x * y
    return total


def nearest(rows, k=20):
    out = {}
    for i, v in rows.items():
        if i % 20 == 0:
            scored = sorted(((-dot(v, w), j) for j, w in rows.items() if j != i and len(w) == len(v)))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.mark.parametrize("uneven", [False, True])
def test_neighbours_recall_and_order(spark, uneven, monkeypatch):
    monkeypatch.setattr(neighbours, "EXACT_ROWS", 0)  # hashed, small as it is
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True) / (rng.uniform(0.5, 2, (900, 1)) if uneven else 1)
    x[100:400] = x[100]  # a hot vector: a third of all rows
    rows = {i: [float(np.float32(c)) for c in v] for i, v in enumerate(x)}
    odd = [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] + [1.0] * 15), (2080, [None] + [1.0] * 15), (None, [1.0] * 16),
           (5, rows[5]), (3000, [1.0, 0.0]), (3001, [0.5, 0.5])]
    frame = spark.createDataFrame([*rows.items(), *odd], "vec_id long, embedding array<float>").withColumn("bucket", F.lit(1))
    rows |= {3000: [1.0, 0.0], 3001: [0.5, 0.5]}
    got = defaultdict(list)
    for r in sorted(neighbours.search(frame).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    want = nearest(rows)
    assert got.keys() == want.keys()
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / len(want[q]) for q in want]) > 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and len({j for j, _ in found}) == len(found)
        assert all(s == dot(rows[q], rows[j]) for j, s in found)
    assert [j for j, _ in got[100]] == list(range(101, 121))
    assert neighbours.search(frame.limit(0)).collect() == []


def test_hadamard_matches_the_matrix():
    h = np.array([[1.0]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(neighbours.hadamard(x), x @ h)


# 9 ---------------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_encoder_matches_the_tokenizer(tokenizer):
    encode, rng = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(12)
    pool = [" ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "a", "B", "é", "É", "é", "́", "ß", "İ", "Σ", "'s", "'S", "'ll",
            "<|endoftext|>", "<|", "1", "23", "½", "²", "ª", "µ", "Å", "中文", "😀", "!!", "%%%", "_", "\x00", "ſ", "ﬁ", "×", "ñ"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(3000)]
    for text, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_a_worker_keeps_few_parts_of_words_between_tasks(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PARTS", 2000)
    monkeypatch.setattr(packing, "IDLE_PARTS", 300, raising=False)
    monkeypatch.setattr(packing, "_encoders", {})
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(int)}))
    rng, path = random.Random(13), public_tokenizers.path("word_bpe_49k.json")
    texts = ["the same"] * 300 + ["the same " + " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(40)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    for _ in range(2):
        got = pa.Table.from_batches(packing.packer(path, 64)(iter([batch]))).to_pylist()
        n = Counter()
        for r in got:
            n[r["doc_id"]] += r["length"]
        assert n == {i: len(tokenizer.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(texts)}
        parts = packing.word_encoder(path).parts
        assert len(parts) <= 300 and "the" in parts


def test_packing_places_every_id_once(documents, docs, no_documents, tokenizer, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(documents, path).collect()
    ids = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in docs]
    assert sum(r.length for r in got) == sum(len(t) for _, t in ids)
    of = defaultdict(list)
    for r in got:
        of[r.doc_id, r.doc_tokens].append(r)
    for (doc, n), pieces in of.items():
        own = [t for i, t in ids if i == doc and len(t) == n]
        spans = sorted((p.start, p.start + p.length) for p in pieces)
        assert Counter(a for a, _ in spans)[0] == len(own)
        assert sum(b - a for a, b in spans) == n * len(own)
        for p in pieces:
            assert p.ids_crc32 in {zlib.crc32(np.array(t[p.start:p.start + p.length], "<u4").tobytes()) for t in own}
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # full, or a smaller power of two: no padding at all
    assert packing.pack(no_documents, path).collect() == []


def test_best_fill_is_the_closest_sum():
    rng = random.Random(13)
    for _ in range(200):
        counts = Counter(rng.choices(range(1, 30), k=rng.randint(1, 8)))
        room = rng.randint(1, 60)
        sums = {0}
        for n, c in counts.items():
            sums |= {s + n * k for s in sums for k in range(c + 1)}
        picked = packing.best_fill(sorted(counts), lambda n: counts[n], room)
        assert all(c <= counts[n] for n, c in picked.items())
        assert sum(n * c for n, c in picked.items()) == max(s for s in sums if s <= room)


def test_pages_read_on_after_elements_that_are_not_closed():
    def read(html):
        return [text for text, _, _ in pages.lines(html)]

    for name in ("svg", "math", "iframe", "object", "noscript"):
        assert read(f"<p>a<{name}/>b</p><p>c</p>") == ["ab", "c"]
        assert read(f"<p>a<{name} width='1'>b</p><p>c</p>") == ["ab", "c"]
        assert read(f"<p>a<{name}>b</{name}>c</p>") == ["ac"]
    assert read("<p>a</p><script>if (a < b) { x = '<p>' }") == ["a"]
