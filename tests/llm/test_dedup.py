"""Near duplicates, repeated passages and vector search against brute force on small tables."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest

from workboard.llm import embedding_dedup, exact_topk, minhash_dedup, substring_dedup
from workboard.llm.components import components


def _find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _classes(ids, linked):
    parent = {i: i for i in ids}
    for a, b in linked:
        x, y = _find(parent, a), _find(parent, b)
        parent[max(x, y)] = min(x, y)
    return {i: _find(parent, i) for i in ids}


def _shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def _words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng, docs = random.Random(5), []
    for _ in range(120):
        docs.append(_words(rng, rng.randrange(3, 120)))
    for base in range(8):  # copies with few and with many changed words
        for _ in range(12):
            w = list(docs[base * 3])
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            docs.append(w)
    passage = _words(rng, 50)
    for i in range(20):
        docs[i] = docs[i][:10] + passage + docs[i][10:]
    docs += [docs[40]] * 7 + [["only"] * 90, ["A", "b"], ["a", "B"], ["solo"]]
    texts = [" ".join(w) for w in docs] + ["", None, " \t\n ", "tab\tand\nline"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def _frame(spark, rows, extra=True):
    if extra:  # further columns, some with the names of results
        return spark.createDataFrame([(i, t, "de", "s", 1, "p") for i, t in rows],
                                     "doc_id long, text string, lang string, component_id string, kept int, print string")
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicates_match_brute_force(spark, corpus):
    sets = {i: _shingles(t) for i, t in corpus}
    linked = [(a, b) for a, b in combinations(sets, 2)
              if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = _classes(sets, linked)
    got = minhash_dedup.near_duplicates(_frame(spark, corpus)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(got) == len(corpus)


def test_near_duplicates_with_branching_and_blocks(spark, corpus, monkeypatch):
    """Tiny bounds send every group through branches and blocks; the classes stay the same."""
    want = {(r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(_frame(spark, corpus)).collect()}
    for name, value in (("SMALL_NODE", 4), ("MAX_LEVELS", 2), ("TASK_SHINGLES", 150), ("TASK_ROWS", 40)):
        monkeypatch.setattr(minhash_dedup, name, value)
    assert {(r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(_frame(spark, corpus)).collect()} == want


def test_near_duplicates_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, None), (4, ""), (None, "x y"),
            (7, "p q r s t u"), (7, "k l m n o p"), (8, "k l m n o p"), (9, "p q r s t u")]
    got = minhash_dedup.near_duplicates(_frame(spark, rows, False)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, None: None, 7: 7, 8: 7, 9: 7}
    kept = minhash_dedup.keep_one(_frame(spark, rows, True))
    assert kept.columns == _frame(spark, rows, True).columns
    stays = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(t or "" for _, t in stays) == ["", "", "a b c d e f", "k l m n o p", "p q r s t u", "x y"]
    assert {i for i, t in stays if t in (None, "", "a b c d e f", "x y")} == {1, 3, 4, None}
    assert {i for i, t in stays if t == "k l m n o p"} <= {7, 8} and {i for i, t in stays if t == "p q r s t u"} <= {7, 9}
    assert minhash_dedup.near_duplicates(_frame(spark, rows, False).limit(0)).count() == 0
    assert minhash_dedup.keep_one(_frame(spark, rows, False).limit(0)).count() == 0


def test_long_text_and_its_near_copy(spark):
    w = _words(random.Random(3), 30_000, 20_000)
    rows = [(5, " ".join(w)), (6, " ".join(w[:-100])), (7, " ".join(w[::-1]))]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(_frame(spark, rows, False)).collect()}
    assert got == {5: 5, 6: 5, 7: 7}


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(200, 201), (201, 202), (202, 200)]
    links += [(300 + rng.randrange(80), 300 + rng.randrange(80)) for _ in range(60)]
    want = _classes({x for e in links for x in e}, links)
    rng.shuffle(links)
    got = components(spark.createDataFrame(links + [(None, 3), (5, 5)], "a long, b long")).collect()
    mine = {r.id: r.component for r in got}
    assert len(got) == len(mine) and all(want[i] == c for i, c in mine.items())
    assert set(mine) == {x for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _brute_repeats(texts, k=35):
    split = [(t or "").encode().split() for t in texts]
    seen = {}
    for d, w in enumerate(split):
        for s in range(len(w) - k + 1):
            seen.setdefault(tuple(w[s:s + k]), []).append((d, s))
    gone = [set() for _ in split]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                gone[d].update(range(s, s + k))
    return [(len(w), len(g), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in g)).hexdigest())
            for w, g in zip(split, gone, strict=True)]


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(9)
    texts = [" ".join(_words(rng, rng.randrange(1, 160), 60)) for _ in range(60)]
    long = _words(rng, 70)
    for n in (34, 35, 36, 50, 70):
        for _ in range(3):
            s = rng.randrange(0, 71 - n)
            texts.append(" ".join(_words(rng, rng.randrange(0, 30)) + long[s:s + n] + _words(rng, rng.randrange(0, 30))))
    for period in (1, 2, 3, 4, 5, 7):  # repeats inside one document, and runs
        unit = _words(rng, period)
        texts.append(" ".join(_words(rng, 9) + unit * (60 // period) + _words(rng, 9)))
        texts.append(" ".join(unit * (37 // period) + _words(rng, 5)))
    texts += [texts[3]] * 3 + ["a " * 34, "b " * 35, "c " * 36, "", None, "  ", texts[70] + " end"]
    texts += ["x y " * 40, "  " + texts[5]]
    return list(enumerate(texts))


def test_repeated_passages_match_brute_force(spark, passages):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
           for r in substring_dedup.remove_repeats(_frame(spark, passages)).collect()}
    assert got == dict(enumerate(_brute_repeats([t for _, t in passages])))


def test_marks_of_equal_windows_are_equal():
    """Any window has the mark it has when it stands alone: its surroundings do not matter."""
    rng = np.random.default_rng(4)
    words = substring_dedup.mix(rng.integers(1, 6, 3000).astype(np.uint64))
    starts = np.array([0, 500, 501, 1700])
    value, pos = substring_dedup.window_marks(words, starts)
    for s in rng.integers(0, len(value), 400):
        if any(s < x < s + 35 for x in starts):
            continue
        alone, p = substring_dedup.window_marks(words[s:s + 35], np.array([0]))
        assert alone[0] == value[s] and p[0] == pos[s] - s


def test_blocks_are_named_alike_everywhere():
    """A passage has the same blocks in its interior in every text; names follow from symbols, not from places."""
    rng = np.random.default_rng(8)
    fresh = lambda n: substring_dedup.mix(rng.integers(1, 1 << 60, n).astype(np.uint64))
    passage = fresh(200)
    one = np.concatenate([fresh(31), passage, fresh(40)])
    two = np.concatenate([fresh(5), fresh(90), passage])
    a = substring_dedup.blocks(one, np.array([0]))[31:231]
    b = substring_dedup.blocks(two, np.array([0, 5]))[95:295]
    c, none = substring_dedup.CONTEXT, substring_dedup._NONE
    inner = slice(c, 200 - c - substring_dedup.BLOCK - substring_dedup.SYMBOL + 1)
    assert (a[inner] == b[inner]).all()
    named = a[inner][a[inner] != none]
    assert len(named) > 60 and len(set(named.tolist())) == len(named)
    starts = np.flatnonzero(a[inner] != none)
    assert np.diff(starts).max() <= substring_dedup.SYMBOL


def test_long_repeats_runs_and_periods(spark):
    """Repeats of 10,000 words, a run and a period of many thousand words, with clashing columns, against brute force."""
    rng = random.Random(3)
    long = _words(rng, 10_000, 3000)
    texts = [" ".join(_words(rng, 300) + long + _words(rng, 100)), " ".join(long[17:9_900]), " ".join(["run"] * 9_000),
             " ".join(["p", "q", "r"] * 4_000 + _words(rng, 60)), " ".join(["q", "r", "p"] * 20 + _words(rng, 60)),
             " ".join(_words(rng, 5_000, 100_000))]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 5, "k", "d", 7) for i, t in rows],
                               "doc_id long, text string, n_words int, key string, digest string, copies int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(_brute_repeats(texts)))


def test_repeated_passages_edges(spark):
    t = " ".join(f"k{i}" for i in range(40))
    rows = [(1, t), (1, t), (2, None), (2, "few words"), (None, "few words")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed)
                 for r in substring_dedup.remove_repeats(_frame(spark, rows, False)).collect())
    assert got == [(0, 2, 0), (1, 40, 40), (1, 40, 40), (2, 0, 0), (2, 2, 0)]
    assert substring_dedup.remove_repeats(_frame(spark, rows, False).limit(0)).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    v = [rng.standard_normal(16) for _ in range(900)]
    for i in range(40):  # near copies, some across the threshold
        for _ in range(5):
            v.append(v[i] + rng.standard_normal(16) * rng.uniform(0.05, 0.45))
    v += [v[7]] * 30 + [v[8] * 3.0, -v[9], np.zeros(16), v[0][:8], v[0][:8] * 1.01]
    rows = [(i, [float(np.float32(x)) for x in w]) for i, w in enumerate(v)]
    rows += [(len(rows), None), (len(rows) + 1, []), (len(rows) + 2, [1.0, None]), (len(rows) + 3, [float("nan")] * 16),
             (len(rows) + 4, [float("inf")] + [0.0] * 15)]
    return rows


def _usable(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all()


@pytest.mark.parametrize("bucket", [2048, 24])
def test_vector_links_match_brute_force(spark, vectors, monkeypatch, bucket):
    monkeypatch.setattr(embedding_dedup, "AIM", 64)  # several signs and tables at this size
    monkeypatch.setattr(embedding_dedup, "BUCKET", bucket)
    df = spark.createDataFrame([(i, v, 0, "z") for i, v in vectors], "vec_id long, embedding array<float>, label int, kept string")
    linked, count = [], {i: 0 for i, _ in vectors}
    good = [(i, np.float32(v).astype(float)) for i, v in vectors if _usable(v) and np.any(v)]
    for (i, a), (j, b) in combinations(good, 2):
        if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
            linked.append((i, j))
            count[i] += 1
            count[j] += 1
    want = _classes(count, linked)
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(linked) > 500 and len(got) == len(vectors)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {
        i: (count[i], want[i], want[i] == i) for i in count}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("bins", "enough"), [(1024, 1000), (1024, 0), (8, 3)])
def test_top_k_matches_brute_force(spark, vectors, monkeypatch, bins, enough):
    monkeypatch.setattr(exact_topk, "BINS", bins)
    monkeypatch.setattr(exact_topk, "ENOUGH", enough)
    monkeypatch.setattr(exact_topk, "CANDIDATE_BLOCK", 200)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(exact_topk, "QUERY_TILE", 3)
    rows = vectors + [(5000, [0.1] * 8), (5050, [0.2] * 5), (0, vectors[3][1]), (1, vectors[2][1]), (1, vectors[2][1])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, rank long")
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if _usable(v)]
    want = []
    for a, (q, x) in enumerate(whole):
        if q % 50 == 0:
            scored = sorted((-sum(m * n for m, n in zip(x, y, strict=True)), i) for b, (i, y) in enumerate(whole)
                            if a != b and len(x) == len(y))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    got = exact_topk.top_k(df, lambda i: i % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert exact_topk.top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_top_k_beyond_exact_doubles(spark):
    """Products that a double does not hold are summed as integers; fewer than k candidates are all returned."""
    big = [2.0 ** 20, 2.0 ** -8]
    df = spark.createDataFrame([(0, big), (1, [2.0 ** 20, 2.0 ** -7]), (2, big), (3, [2.0 ** 20, 0.0])],
                               "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df, lambda i: i % 50 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2 ** 56 + 2), (2, 2 ** 56 + 1), (3, 2 ** 56)]


def test_histograms_of_a_hot_vector(spark, monkeypatch):
    """A third of all rows is one vector: its score is one integer, and ties go to the smallest ids."""
    monkeypatch.setattr(exact_topk, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(exact_topk, "ENOUGH", 10)
    rng = np.random.default_rng(2)
    rows = [(i, [0.5, 0.5] if i % 3 == 0 else rng.uniform(-0.5, 0.4, 2).tolist()) for i in range(600)]
    got = exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 300).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 0), (2, 3), (3, 6), (4, 9), (5, 12)]
