"""Quality, personal data, mixing, packing, url filter and licence scan on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from workboard.llm import license_scan, mixing, packing, pii, quality, url_filter


def _prose(rng, n):
    return " ".join(rng.choice(["the", "river", "under", "stone", "walks", "slowly", "evening", "letter", "market"])
                    for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled():
    rng, docs, labels = random.Random(2), [], []
    for i in range(400):
        good = rng.random() < 0.7
        n = rng.randrange(20, 90)
        kind = rng.randrange(3)
        text = _prose(rng, n) if good else (" ".join([rng.choice(["buy", "now"])] * n) if kind == 0 else
                                           " ".join(f"{w}!!" for w in _prose(rng, n).upper().split()) if kind == 1 else
                                           " | ".join(_prose(rng, n).split()))
        if good and rng.random() < 0.15:
            text += " you worthless scum"
            toxic = 1
        else:
            toxic = 0
        docs.append((i, text))
        labels.append((i, int(good), toxic))
    return docs, labels


def _frames(spark, labelled):
    docs, labels = labelled
    d = spark.createDataFrame([(i, t, "en", "s", 0.5) for i, t in docs],
                              "doc_id long, text string, lang string, source string, score double")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_documents(spark, labelled):
    d, labels = _frames(spark, labelled)
    got = {r.doc_id: r for r in quality.classify(d, labels).collect()}
    truth = {i: q for i, q, _ in labelled[1]}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_quality_ignores_labels_of_held_out_rows(spark, labelled):
    d, labels = _frames(spark, labelled)
    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality"))
                              .otherwise(F.col("quality")))
    score = lambda x: {r.doc_id: r.score for r in quality.classify(d, x).collect()}
    assert score(labels) == score(wrong)


def test_compiled_rules_equal_the_model(spark, labelled):
    d, labels = _frames(spark, labelled)
    rules = quality.fit(d, labels)
    rows = quality.with_stats(d, "text").withColumn("p", rules.column()).collect()
    x = np.array([r["__stats"] for r in rows])
    margin = rules.bias + sum(w * quality._holds(r, x) for r, w in zip(rules.rules, rules.weights, strict=True))
    assert rules.fitted and np.allclose(1 / (1 + np.exp(-margin)), [r["p"] for r in rows])


def test_quality_edges(spark, labelled):
    d, labels = _frames(spark, labelled)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (None, "word"), (1002, "x " * 200_000), (1001, "")],
                                "doc_id long, text string")
    got = quality.score(odd, quality.fit(d, labels)).collect()
    assert len(got) == 5 and all(0 <= r["__score"] <= 1 for r in got)
    flat = quality.classify(d, labels.where("quality = 1")).select("score").distinct().collect()
    assert len(flat) == 1
    assert quality.classify(d, labels.limit(0)).select("score").distinct().collect()[0][0] == pytest.approx(0.5)
    assert quality.keep_good(d, labels.limit(0)).count() == d.count()
    assert quality.classify(d.limit(0), labels).count() == 0
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()


_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def _plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(_PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if ((kind == "ip" and max(map(int, m[0].split("."))) > 255)
                    or (kind == "card" and not (14 <= len(d) <= 19 and _luhn(d)))
                    or (kind == "phone" and not 10 <= len(d) <= 15)):
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def _pii_texts():
    rng = random.Random(6)
    bits = ["a.b@c.de", "x@y", "a@b.co_x@y.zz", "a@b.c@d.e", "é@ä.de ü", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.1.2.3",
            "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (555) 123-4567", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
            "😀", "\n", " ", ".", "-", "@", "+", "12", "5500000000000004", "1 2", "--", "user [at] host [dot] org", "a@b.c..d", "٣"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(1, 14))) for _ in range(250)]
    return texts + ["", None, "no data here", "9" * 50_000, "a" * 50_000 + "@" + "b" * 50_000 + ".c" * 20_000,
                    "+" + "1 " * 30_000, "1." * 40_000, "mail me: someone@example.org"]


def test_base_spans_match_the_plain_patterns(spark):
    texts = _pii_texts()
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.digests(pii.find(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = _plain_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (t or "")[:200]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert not joined or set(joined.split(",")) <= set(got[i].spans.split(","))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to a.b@c.de and +1 (555) 123-4567.", 34), (2, None, None), (3, "", 0), (4, "é 1.2.3.4 ü", 11)],
                               "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert got == {1: ("to [EMAIL] and [PHONE].", 23), 2: (None, None), 3: ("", 0), 4: ("é [IP] ü", 8)}
    assert pii.redact(df.limit(0)).count() == 0 and pii.redact(df).columns == df.columns


def test_trees_add_spans_like_base_spans(spark):
    """Card-like numbers that fail the check stand where passing ones stand nearly always: they are added."""
    rng, rows = random.Random(8), []
    for i in range(300):
        d = [rng.randrange(10) for _ in range(15)]
        last = next(x for x in range(10) if _luhn("".join(map(str, [*d, x]))))
        rows.append((i, "card " + "".join(map(str, [*d, last if i else (last + 1) % 10])) + " end"))
    rows += [(i, f"order token={rng.randrange(10 ** 9, 10 ** 10)}x") for i in range(300, 500)]
    got = {r.doc_id: r for r in pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[0].n_card == 0 and got[0].spans == "card:5:21"
    assert all(got[i].n_card == 1 for i in range(1, 300)) and all(got[i].spans == "" for i in range(300, 500))


def test_mixing_meets_targets(spark, labelled):
    d, labels = _frames(spark, labelled)
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    model = mixing.fit_domains(d, labels, domain)
    rows = mixing.cut(mixing.members(d, model).select("__tokens", "__p"), "t")
    targets = {"clean": 0.7, "low": 0.2, "toxic": 0.1}
    _, got, want = mixing.fit_rates(rows, [targets[n] for n in model.names], steps=60)
    assert np.allclose(got, want, rtol=0.02)
    out = mixing.mix(d, labels, domain, targets).collect()
    truth = {i: "toxic" if t else "clean" if q else "low" for i, q, t in labelled[1]}
    assert sum(r.domain == truth[r.doc_id] for r in out) >= 0.95 * len(out)
    # the fitted rates are those of a plain projected gradient over the same posteriors
    p, t = np.array([r.posterior for r in out]), np.array([r.n_tokens for r in out], dtype=float)
    goal = np.array([targets[n] for n in model.names])
    rate, total, share = np.ones(len(t)), t.sum(), t @ p / t.sum()
    for _ in range(4000):
        gap = (t * rate) @ p / total - goal
        rate = np.maximum(0, rate - 0.1 * (2 * p @ (gap / share) + 2 * mixing.RIDGE * (rate - 1)))
    assert np.allclose((t * rate) @ p, (t * np.array([r.rate for r in out])) @ p, rtol=0.02)
    assert all(r.rate >= 0 for r in out)


def test_mixing_edges(spark, labelled):
    d, labels = _frames(spark, labelled)
    domain = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    odd = d.select("doc_id", "text").unionAll(spark.createDataFrame([(None, None), (9000, ""), (3, "again again")], "doc_id long, text string"))
    out = mixing.mix(odd, labels, domain, {"clean": 1.0, "toxic": 0.0}).collect()
    assert len(out) == 403 and all(r.rate == 1.0 for r in out if r.n_tokens == 0)
    assert all(r.rate == 1.0 for r in mixing.mix(d, labels.limit(0), domain, {"clean": 1.0}).collect())
    assert mixing.mix(d.limit(0), labels, domain, {"clean": 1.0}).count() == 0
    kept = mixing.resample(d, labels, domain, {"clean": 0.97, "toxic": 0.03})
    truth = {i: t for i, _, t in labelled[1]}
    left = {r.doc_id for r in kept.collect()}
    assert kept.columns == d.columns and all(i in left for i in truth if not truth[i])
    assert sum(i in left for i in truth if truth[i]) < 0.7 * sum(truth.values())


def test_shares_after_thinning(spark):
    """Kept shares are within 2 % of the targets, those of a plain projected gradient, and main documents stay."""
    rng = np.random.default_rng(4)
    n = 40_000
    truth = rng.choice(3, n, p=[0.77, 0.12, 0.11])
    p = np.full((n, 3), 0.004)
    p[np.arange(n), truth] = 0.992
    p[:4000] = rng.dirichlet([4, 1, 1], 4000)  # some of no clear domain
    t = rng.integers(1, 400, n)
    t[7] = 0
    df = mixing.cut(spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(n)],
                                          "id long, __tokens long, __p array<double>"), "rows")
    goal = np.array([0.95, 0.03, 0.02])
    rate, kept, want = mixing.fit_shares(df, goal.tolist())
    assert np.allclose(kept, goal, rtol=0.02) and np.allclose(want, goal)
    got = dict(df.select("id", rate).collect())
    r = np.array([got[i] for i in range(n)])
    assert 0 <= r.min() and r.max() <= 1 and r[7] == 1
    main = p[:, 0] > 0.99
    assert (r[main] == 1).mean() > 0.99 and r[truth == 1].mean() < 0.4
    u = rng.random(n)
    drawn = (t * (r + u >= 1)) @ p
    assert np.allclose(drawn / drawn.sum(), goal, rtol=0.1)
    # the same objective by plain steps
    total, share, plain = t.sum(), t @ p / t.sum(), np.ones(n)
    for _ in range(mixing.STEPS):
        now = (t * plain) @ p / total
        gap = (now - goal * now[0] / goal[0]) / share
        gap[0] = mixing.HOLD * (now[0] - share[0]) / share[0]
        plain = np.clip(plain - 0.5 / (1 + mixing.RIDGE) * (2 * p @ gap + 2 * mixing.RIDGE * (plain - 1)), 0, 1)
    assert np.allclose((t * plain) @ p, (t * r) @ p, rtol=0.01)


def test_scarce_domains_stay_whole(spark):
    """A domain below its target is no reason to drop the main one; without tokens or targets nothing is dropped."""
    rows = [(100, [0.999, 0.001])] * 50 + [(3, [0.001, 0.999])]
    df = mixing.cut(spark.createDataFrame(rows, "__tokens long, __p array<double>"), "rows")
    rate, _, _ = mixing.fit_shares(df, [0.7, 0.3])
    assert {r[0] for r in df.select(rate).collect()} == {1.0}
    for frame, goal in ((df, [0.0, 0.0]), (df.limit(0), [0.7, 0.3])):
        rate, _, _ = mixing.fit_shares(frame, goal)
        assert {r[0] for r in frame.select(rate).collect()} <= {1.0}


def test_thinning_null_ids(spark, labelled):
    """Rows without an id are drawn by their texts, not all alike."""
    d, labels = _frames(spark, labelled)
    domain = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    nameless = d.withColumn("doc_id", F.lit(None).cast("long"))
    kept = mixing.resample(d.unionAll(nameless), labels, domain, {"clean": 0.97, "toxic": 0.03})
    bad = sum(t for _, _, t in labelled[1])
    assert 0 < kept.where("doc_id is null").count() - (len(labelled[1]) - bad) < bad


def test_packing_places_every_token_once(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 60, 300, 511, 700, 2500]))) for i in range(700)] + [(7, "w w"), (7, "w w")]
    rows += [(900, None), (901, ""), (902, " \n"), (None, "w"), (903, "w " * 20_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bin int")
    lengths = (64, 256, 512, 1024)
    out = packing.best_fit(df, lengths, shard_pieces=400).collect()
    bins, tokens = defaultdict(list), defaultdict(int)
    for r in out:
        tokens[r.doc_id] += r.n_tokens
        if r.n_tokens:
            bins[(r.shard, r.bin)].append(r)
        else:
            assert r.bin is None and r.capacity is None
    want = defaultdict(int)
    for i, t in rows:
        n = len((t or "").split())
        want[i] += n + 1 if n else 0
    assert dict(tokens) == dict(want) and len({r.shard for r in out if r.bin is not None}) > 1
    for content in bins.values():
        at = 0
        for r in sorted(content, key=lambda r: r.offset):  # side by side from 0, without overlap
            assert r.offset == at
            at += r.n_tokens
        assert {r.capacity for r in content} == {min(n for n in lengths if n >= at)}
    used = sum(r.n_tokens for c in bins.values() for r in c)
    assert used >= 0.97 * sum(c[0].capacity for c in bins.values())
    whole = sorted((r.piece, r.start, r.n_tokens) for r in out if r.doc_id == 903)
    assert whole == [(k, k * 1024, min(1024, 20_001 - k * 1024)) for k in range(20)]
    assert packing.best_fit(df.limit(0), lengths).count() == 0


def test_best_fit_takes_the_least_room():
    where, offset, final = packing.pack(np.array([6, 5, 3, 2, 2]), (4, 8), 0)
    assert list(where) == [0, 1, 1, 0, 2] and list(offset) == [0, 0, 5, 6, 0] and list(final) == [8, 8, 4]


def test_url_rules(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/")]
    urls = {"http://a.com/x": ("a.com", "/x", "com/", "allow"), "https://b.EXAMPLE.com/en/1?q": ("b.example.com", "/en/1", "example.com/en/", "block"),
            "ftp://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
            "http://a.com": ("a.com", "", None, "allow"), "http://net/es/a#b": ("net", "/es/a", "net/es/", "block"),
            "http://a.com:80/x": ("a.com:80", "/x", None, "allow"), "http://ÄB.com?x://y": ("Äb.com", "", None, "allow"),
            "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
            "x://notcom/es/": ("notcom", "/es/", None, "allow"), "a://b.net/es": ("b.net", "/es", None, "allow")}
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge(df, F.lit(None).cast("boolean"), rules).collect()
    assert {i: (r.host, r.path, r.rule, r.verdict) for r in got for i in [r.page_id]} == dict(enumerate(urls.values()))
    assert url_filter.judge(df.limit(0), F.lit(None).cast("boolean"), rules).count() == 0


def test_url_templates(spark):
    rng, rows = random.Random(3), []
    for i in range(600):  # on one host, one branch is bad; names and numbers below it vary
        part = rng.choice(["news", "spam", "blog"])
        bad = part == "spam" if rng.random() < 0.95 else part != "spam"
        rows.append((i, f"http://h.org/{part}/{rng.randrange(10 ** 6)}/{rng.choice('abcdef')}.html", bad if i % 2 else None))
    rows += [(1000, "http://other.org/spam/1", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in url_filter.judge(df, F.col("bad"), []).collect()}
    for i, u, _ in rows:
        assert got[i].verdict == ("block" if "h.org/spam/" in u else "allow")
    assert {r.template for r in got.values() if "/spam/" in r.path and r.host == "h.org"} == {"/spam/*/*"}
    assert len({r.template for r in got.values()}) <= 5


def test_url_deep_templates(spark, monkeypatch):
    """Branches of the sixth segment are told apart; long paths, long segments, repeated and null urls have a result."""
    rows = [(i, f"http://h.org/a/b/c/d/e/{'spam' if i % 3 == 0 else 'news'}/{i}", i % 3 == 0) for i in range(300)]
    rows += [(1000, "http://h.org" + "/x" * 3000, None), (1001, "http://h.org/" + "ab1" * 4000, None),
             (1002, "http://h.org/" + "ab" * 6000, None), (0, rows[0][1], None), (0, rows[0][1], None), (None, None, True)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    for chars in (url_filter.BROADCAST_CHARS, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_CHARS", chars)
        got = url_filter.judge(df, F.col("bad"), []).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.verdict == ("block" if "/spam/" in r.path else "allow")
        assert {r.template for r in got if "/spam/" in r.path} == {"/*/*/*/*/*/spam/*"}
        assert {r.template for r in got if r.page_id == 1000} == {"/*" * 3000}
    shapes = df.select(url_filter.shape(F.lit("/" + "ab1" * 4000 + "/12ab/a1b/face/x9"))).first()[0]
    assert shapes == ["<hex>", "<n>ab", "<hex>", "face", "x<n>"]


def _plain_best_fit(sizes, lengths, overhead):
    """Best-fit by looking at every open sequence for each piece: (bin, offset, capacity) by piece."""
    bins, out = [], []  # [length, used, step of the last change]
    for i, size in enumerate(sizes):
        fitting = [(b[0] - b[1], -b[2], k) for k, b in enumerate(bins) if b[0] - b[1] >= size]
        if fitting:
            k = min(fitting)[2]
        else:
            def cost(n):
                rest = sum(x for x in sizes[i + 1:] if x <= n - size)  # noqa: B023
                return (overhead + n + n * n / packing.ATTENTION) / (size + min(n - size, rest)), n  # noqa: B023
            bins.append([min((n for n in lengths if n >= size), key=cost), 0, 0])
            k = len(bins) - 1
        out.append((k, bins[k][1]))
        bins[k][1:] = [bins[k][1] + size, i + 1]
    return [(k, at, min(n for n in lengths if n >= bins[k][1])) for k, at in out]


def test_packing_against_plain_best_fit(spark):
    """Every shard of a packed table is what a plain best-fit of its pieces gives; ties and repeated rows included."""
    rng = random.Random(21)
    rows = [(i, rng.choice([1, 2, 7, 7, 40, 63, 64, 65, 200, 255, 300, 513, 1500]) + rng.randrange(3)) for i in range(900)]
    rows += rows[:40] + [(None, 12), (950, None), (951, 0)]
    df = spark.createDataFrame([(i, n, 3) for i, n in rows], "doc_id long, n long, shard int")
    lengths = (64, 256, 512)
    shards = defaultdict(list)
    for r in packing.best_fit(df, lengths, tokens=F.col("n"), shard_pieces=300).where("bin is not null").collect():
        shards[r.shard].append(r)
    assert len(shards) > 2
    for placed in shards.values():
        sizes = sorted((r.n_tokens for r in placed), reverse=True)
        want = sorted((n, *w) for n, w in zip(sizes, _plain_best_fit(sizes, lengths, packing.OVERHEAD), strict=True))
        assert sorted((r.n_tokens, r.bin, r.offset, r.capacity) for r in placed) == want


def _kl_evidence(b, n, q):
    return sum(k * math.log(k / (n * p)) for k, p in ((b, q), (n - b, 1 - q)) if k)


def test_url_tree_against_brute_force(spark):
    """Templates, purities and verdicts of two-segment paths by a plain loop; random labels reject nothing."""
    rng, rows = random.Random(12), []
    for i in range(1500):
        host = rng.choice(["a.x.org", "b.x.org", "c.y.org", "lone"])
        one, two = rng.choice("pqr"), rng.choice("st")
        risk = 0.9 if (host, one) == ("b.x.org", "q") else 0.02 if (host, one) == ("c.y.org", "r") else 0.15
        rows.append((i, f"http://{host}/{one}/{two}", (rng.random() < risk) if rng.random() < 0.7 else None))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    seen = [(u[7:].split("/"), b) for _, u, b in rows]
    template = [""] * len(rows)
    for d in (1, 2):
        count = {}
        for (s, b), t in zip(seen, template, strict=True):
            for k in ((s[0], t), (s[0], t, s[d])):
                c = count.setdefault(k, [0, 0])
                c[0] += b is not None
                c[1] += bool(b)
        tests = sum(1 for k, c in count.items() if len(k) == 3 and c[0])
        keep = {k for k, (n, b) in count.items() if len(k) == 3 and 0 < n < count[k[:2]][0]
                and _kl_evidence(b, n, count[k[:2]][1] / count[k[:2]][0]) > math.log(2 * tests / url_filter.ERROR)}
        template = [f"{t}/{s[d] if (s[0], t, s[d]) in keep else '*'}" for (s, _), t in zip(seen, template, strict=True)]

    def tally(key):
        out = {}
        for (s, b), t in zip(seen, template, strict=True):
            c = out.setdefault(key(s[0], t), [0, 0])
            c[0] += b is not None
            c[1] += bool(b)
        return out

    domain = lambda h: {"lone": "lone"}.get(h, h[2:])
    own, hosts, domains = tally(lambda h, t: (h, t)), tally(lambda h, t: h), tally(lambda h, t: domain(h))
    (n, b), = tally(lambda h, t: 0).values()
    base = b / n
    least = min(0.5, 3 * base / (1 - base) / (1 + 3 * base / (1 - base)))
    smooth = lambda c, prior: (c[1] + 10 * prior) / (c[0] + 10)
    want = {}
    for (h, t), c in own.items():
        purity = smooth(c, smooth(hosts[h], smooth(domains[domain(h)], base)))
        out = c[1] > c[0] * base and _kl_evidence(c[1], c[0], base) > math.log(len(own) / url_filter.ERROR)
        want[h, t] = (purity, "block" if out and purity >= least else "allow")
    got = url_filter.judge(df, F.col("bad"), []).collect()
    assert len(got) == len(rows)
    assert {(r.host, r.template) for r in got} == set(want)
    for r in got:
        purity, verdict = want[r.host, r.template]
        assert r.verdict == verdict and abs(r.purity - purity) < 1e-9
    assert {(r.host, r.path[:2]) for r in got if r.verdict == "block"} == {("b.x.org", "/q")}

    noise = df.withColumn("bad", F.col("bad").isNotNull() & (F.xxhash64("page_id", F.lit(5)) % 4 == 0))
    assert {r.verdict for r in url_filter.judge(noise, F.col("bad"), []).collect()} == {"allow"}


def test_licence_scores_against_brute_force(spark):
    """Best template and cosine of every notice by a plain loop; equal cosines, repeated and very long notices included."""
    rng = random.Random(17)
    fill = ["file", "of", "the", "work", "is", "terms", "version", "2.0", "license", "copyright", "Apache", "public", "c++"]
    notices = [t for _, t in license_scan.TEMPLATES] + [t.upper() + "..." for _, t in license_scan.TEMPLATES]
    notices += [" ".join(rng.choice(fill) for _ in range(rng.randrange(1, 25))) for _ in range(120)]
    notices += [f"{t} {' '.join(rng.choice(fill) for _ in range(rng.randrange(12)))}" for _, t in license_scan.TEMPLATES * 3]
    notices += ["Licensed under the License", "Released", "-- . --", "license " * 30_000, license_scan._ISC, license_scan._PERMISSION]
    notices += notices[:5]

    def terms(text):
        out = defaultdict(int)
        for w in re.findall("[a-z0-9][a-z0-9.+-]*", text.lower()):
            out[re.sub("[.-]+$", "", w)] += 1
        return out

    known = [(n, terms(t)) for n, t in license_scan.TEMPLATES + license_scan.BODIES]
    texts = {t: terms(t) for t in notices}
    every = list(texts.values()) + [x for _, x in known]
    df = defaultdict(int)
    for x in every:
        for w in x:
            df[w] += 1
    weigh = lambda x: {w: n * (math.log((len(every) + 1) / (df[w] + 1)) + 1) for w, n in x.items()}
    norm = lambda x: math.sqrt(sum(v * v for v in x.values()))
    known = [(n, weigh(x)) for n, x in known]
    want = {}
    for t, x in texts.items():
        x = weigh(x)
        scores = [(-round(sum(v * y.get(w, 0.0) for w, v in x.items()) / (norm(x) * norm(y)), 9), n) for n, y in known if x]
        if scores and -min(scores)[0] >= license_scan.THRESHOLD:
            want[t] = min(scores)
    found = spark.createDataFrame([(1, t, "x") for t in notices], "file long, notice string, license string")
    got = license_scan.best_templates(found).collect()
    assert len(got) == len(want) > 80
    for r in got:
        score, name = want[r.notice]
        assert r.license == name and abs(r.score + score) < 1e-8


def test_licences(spark):
    files = [(1, "/a/LICENSE", "MIT stuff\nReleased under the MIT License.\nmore"), (2, "/a/b/x.txt", "plain words"),
             (3, "/a/b/y.txt", "Some prose. Licensed under the Apache License, Version 2.0. And more prose here"), (4, "/a/c/COPYING", None),
             (5, "/z/q.txt", "no word"), (6, "/a/d/LICENSE.md", "This work is licensed under the GNU General Public License, version 3."),
             (7, "/a/d/e/f/g.c", ""), (8, None, "Licensed under CC BY-NC 4.0."), (9, "/a/d/h.c", "driving licence of the town of long prose and many rivers flowing"),
             (9, "/a/d/h.c", "driving licence of the town of long prose and many rivers flowing")]
    df = spark.createDataFrame([(*f, "x") for f in files], "doc_id long, path string, text string, license string")
    got = license_scan.scan(df, F.col("path"), F.col("text")).collect()
    assert len(got) == len(files)
    assert {r.doc_id: (r.license, r.effective, r.origin) for r in got} == {
        1: ("MIT", "MIT", "/a/LICENSE"), 2: (None, "MIT", "/a"), 3: ("Apache-2.0", "Apache-2.0", "/a/b/y.txt"), 4: (None, "MIT", "/a"),
        5: (None, None, None), 6: ("GPL-3.0", "GPL-3.0", "/a/d/LICENSE.md"), 7: (None, "GPL-3.0", "/a/d"),
        8: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 9: (None, "GPL-3.0", "/a/d")}
    assert license_scan.scan(df.limit(0), F.col("path"), F.col("text")).count() == 0
