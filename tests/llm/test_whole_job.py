"""Operators do the whole job: cases that were once left out, on small tables."""

import pathlib
import random
import subprocess
import sys
import uuid

from pyspark.sql import functions as F

from workboard.llm import license_scan, minhash_dedup, pii, queries, store


def _spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(s.kind, s.s) for s in r.spans] for r in pii.find(df).collect()}


def test_pii_beside_other_digits(spark):
    got = _spans(spark, ["x 1234567812345678 4845168114407329 y", "+1 (826) 555-4081 190.137.223.204", "12 4111 1111 1111 1111 z",
                         "1234567890 +1 (826) 555-4081 99 1234567890", "nothing 1234567812345678 1234567812345678",
                         "1234 1234 " * 2_000])
    assert got[0] == [("card", "4845168114407329")]
    assert got[1] == [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")]
    assert got[2] == [("card", "4111 1111 1111 1111")]
    assert got[3][0][0] == "phone" and got[3][0][1].startswith("+1 (826) 555-4081")
    assert got[4] == []


def _number(rng, n):
    return str(rng.randrange(1, 10)) + "".join(str(rng.randrange(10)) for _ in range(n - 1))


def test_pii_of_forms_that_base_cannot_match(spark):
    rng, texts = random.Random(4), []
    texts += [f"write to u{i}.x@host.example.org now" for i in range(380)]
    texts += [f"write to u{i}.x [at] host [dot] org now" for i in range(20)]
    texts += [f"call +1 ({_number(rng, 3)}) 555-{_number(rng, 4)} now" for _ in range(200)]
    texts += [f"call ({_number(rng, 3)}) 555-{_number(rng, 4)} now" for _ in range(30)]
    texts += [f"order {_number(rng, rng.randrange(8, 13))} came" for _ in range(300)]
    got = _spans(spark, texts)
    assert all(got[i] == [("email", f"u{i - 380}.x [at] host [dot] org")] for i in range(380, 400))
    assert all(len(got[i]) == 1 and got[i][0] == ("phone", texts[i][5:-4]) for i in range(400, 630))
    assert all(got[i] == [] for i in range(630, 930))


def test_pii_adds_no_random_numbers(spark):
    """Where random numbers stand like the known spans, nothing is added."""
    rng, texts = random.Random(5), []
    texts += [f"and +1 ({_number(rng, 3)}) 555-{_number(rng, 4)} went" for _ in range(200)]
    texts += [f"and {_number(rng, rng.randrange(8, 13))} went" for _ in range(200)]
    texts += ["and 4111111111111111 went"] * 60 + ["and 4111111111111112 went"] * 60
    texts += ["look u@host.org here"] * 50 + ["look (in) the.end here"] * 40 + ["look (at) the.end here"] * 40
    got = _spans(spark, texts)
    assert all(got[i] == [] for i, t in enumerate(texts) if "+" not in t and "4111111111111111" not in t and "@" not in t)


def test_licences_are_inherited_in_the_registered_query(spark, tmp_dir):
    rng, rows = random.Random(7), []
    for i in range(3000):
        mark = rng.choice(["Released under the MIT License.", "Licensed under the Apache License, Version 2.0."])
        rows.append((i, "Plain prose of a file." + (f"\n{mark}" if rng.random() < 0.03 else ""), f"l{i % 2}", f"s{i % 3}"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_dir}/documents.parquet")
    got = queries.op9_license_scan(spark, tmp_dir).collect()
    assert len(got) == len(rows)
    speaks = {}
    for r in got:
        folder, _, name = r.path.rpartition("/")
        if r.license and name.startswith("LICENSE"):
            speaks[folder] = min(speaks.get(folder, (1, "")), (-r.score, r.license))
    twice, depths = 0, set()
    for r in got:
        if r.license:
            assert (r.effective, r.origin) == (r.license, r.path)
            continue
        parts = r.path.split("/")[:-1]
        above = ["/".join(parts[:n]) for n in range(len(parts), 0, -1)]
        above = [a for a in above if a in speaks]
        assert (r.effective, r.origin) == ((speaks[above[0]][1], above[0]) if above else (None, None))
        twice += len(above) > 1
        depths |= {a.count("/") for a in above[:1]}
    assert depths == {1, 2, 3} or depths == {2, 3}
    assert twice > 0 and sum(r.license is None and r.effective is not None for r in got) > len(got) / 2


def test_licence_texts_and_broken_notices(spark):
    isc = license_scan._ISC.replace("hereby granted, ", "hereby granted,\n").replace(". ", ".\n\n")
    three = (license_scan._BSD + license_scan._BSD_3 + license_scan._BSD_END).replace(". ", ".\n")
    two = (license_scan._BSD + license_scan._BSD_END).replace(". ", ".\n")
    files = [(1, "/i/LICENSE", "Copyright (c) 2019, A. Person\n\n" + isc), (2, "/i/x.c", "code"),
             (3, "/m/COPYING", "Copyright (c) 2020 Some One\n\n" + license_scan._PERMISSION.replace(", ", ",\n")), (4, "/m/y/z.c", "code"),
             (5, "/b/LICENSE.txt", "Copyright 2001 Us. All rights kept.\r\n\r\n" + three.replace("\n", "\r\n")), (6, "/c/LICENSE", "Copyright 2001 Us\n" + two),
             (7, "/h/a.py", "# This work is licensed under the\n# GNU General Public\n# License, version 3\n\nimport os\n"),
             (8, "/h/b.c", "/*\n * Licensed under the Apache\n * License, Version 2.0\n */\nint x;\n"), (9, "/h/c.c", "int copyright;\n"),
             (10, "/n/LICENSE", "nothing of the kind"), (11, "/u/LICENSE", None)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r.doc_id: r.effective for r in license_scan.scan(df, F.col("path"), F.col("text")).collect()}
    assert got == {1: "ISC", 2: "ISC", 3: "MIT", 4: "MIT", 5: "BSD-3-Clause", 6: "BSD-2-Clause", 7: "GPL-3.0", 8: "Apache-2.0",
                   9: None, 10: None, 11: None}


def test_sketch_tasks_do_not_grow_with_a_hot_node(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SMALL_NODE", 16)
    monkeypatch.setattr(minhash_dedup, "TASK_ROWS", 16)
    monkeypatch.setattr(minhash_dedup, "MAX_LEVELS", 0)
    monkeypatch.setattr(minhash_dedup, "_pivot_links", lambda *a: None)  # which would leave nothing to deal
    real = minhash_dedup._likely

    def counted(t, percent):
        with open(f"{tmp_dir}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(t.num_rows))
        return real(t, percent)

    monkeypatch.setattr(minhash_dedup, "_likely", counted)
    common = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(i, f"{common} end{i}") for i in range(120)], "doc_id long, text string")
    assert {r.component_id for r in minhash_dedup.near_duplicates(df).collect()} == {0}
    sizes = [int(p.read_text()) for p in pathlib.Path(tmp_dir).iterdir()]
    assert sum(sizes) > 1000 and max(sizes) <= 8 * 16


def _texts(rng, n, common, own):
    """``n`` near copies: a shared run of words, and a few of their own."""
    return [" ".join([f"w{i}" for i in range(common)] + [f"x{rng.randrange(10 ** 9)}" for _ in range(own)]) for _ in range(n)]


def test_a_member_like_the_pivot_still_links_one_unlike_it(spark, monkeypatch):
    for name, value in (("SMALL_NODE", 8), ("MAX_LEVELS", 1), ("PIVOTS", 1), ("TASK_ROWS", 20), ("TASK_SHINGLES", 2000)):
        monkeypatch.setattr(minhash_dedup, name, value)
    rng = random.Random(8)
    texts = _texts(rng, 60, 200, 12)
    for step in range(12):  # each like the one before, ever less like the rest
        words = texts[-1].split()
        texts.append(" ".join(words[25:] + [f"y{step}-{i}" for i in range(25)]))
    texts += _texts(rng, 20, 60, 150)  # unlike all, with a shared start
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert len(set(root[:72])) == 1 and len(set(root)) == 21
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df).collect()} == dict(enumerate(root))


def test_rows_grow_with_a_hot_group_not_with_its_square(spark, monkeypatch):
    for name, value in (("SMALL_NODE", 16), ("MAX_LEVELS", 3), ("TASK_ROWS", 64)):
        monkeypatch.setattr(minhash_dedup, name, value)
    seen, real = [], minhash_dedup.cut

    def counted(df, name):
        out = real(df, name)
        seen[-1] += out.count()
        return out

    monkeypatch.setattr(minhash_dedup, "cut", counted)
    rng = random.Random(9)
    for n in (100, 400):
        seen.append(0)
        texts = _texts(rng, n, 200, 6) + _texts(rng, 10, 60, 150)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert len({r.component_id for r in minhash_dedup.near_duplicates(df).collect()}) == 11
    assert seen[1] <= 4.4 * seen[0]


def test_sets_are_compared_about_once(spark, tmp_dir, monkeypatch):
    """Near copies meet in many nodes of many trees; their full sets are dealt out for about one of them, and never written."""
    names, real, real_cut = [], minhash_dedup._exact, minhash_dedup.cut

    def counted(t, percent):
        with open(f"{tmp_dir}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(t.num_rows))
        return real(t, percent)

    def named(df, name):
        names.append(df.dtypes)
        return real_cut(df, name)

    monkeypatch.setattr(minhash_dedup, "_exact", counted)
    monkeypatch.setattr(minhash_dedup, "cut", named)
    rng, rows = random.Random(12), []
    for base in range(40):
        words = [f"b{base}-{i}" for i in range(150)]
        for _ in range(6):  # about 0.6 alike: likely partners, but no links
            text = list(words)
            for i in rng.sample(range(150), 8):
                text[i] = f"x{rng.randrange(10 ** 9)}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert minhash_dedup.near_duplicates(df).count() == len(rows)
    assert sum(int(p.read_text()) for p in pathlib.Path(tmp_dir).iterdir()) <= 1.6 * len(rows)
    assert not any(kind == "array<bigint>" and name == "shingles" for cols in names for name, kind in cols)


def test_left_out_groups_lie_in_others(spark):
    rng = random.Random(13)
    old = {100 + g: set(rng.sample(range(30), rng.randrange(2, 9))) for g in range(10)}
    groups = {g: set(rng.sample(range(30), rng.randrange(1, 9))) for g in range(60)}
    groups |= {60 + g: set(list(groups[g])[:3]) for g in range(20)}
    old[110] = {50, 51, 52, 53}
    groups |= {80: {40, 41, 42}, 81: {40, 41, 42, 43}, 82: {41, 43}, 83: {40, 41, 42, 43}, 84: {50, 51, 52, 53}, 85: {51, 53}}
    rows = spark.createDataFrame([(g, r, 5) for g, m in groups.items() for r in m], "grp long, rep long, n_shingles long")
    earlier = spark.createDataFrame([(g, r, len(m)) for g, m in old.items() for r in m], "grp long, rep long, n long")
    pairs = lambda sets: {(a, b) for m in sets for a in m for b in m if a < b}
    for seen in (None, earlier):
        kept = {}
        for r in minhash_dedup._open_groups(rows, seen).collect():
            kept.setdefault(r.grp, set()).add(r.rep)
        assert all(groups[g] == m for g, m in kept.items())
        assert len({81, 83} & set(kept)) == 1 and not {80, 82, 85} & set(kept) and (84 in kept) == (seen is None)
        assert pairs(groups.values()) <= pairs(kept.values()) | (pairs(old.values()) if seen else set())


def test_rows_are_sifted_before_a_join_on_many_ids(spark, monkeypatch):
    monkeypatch.setattr(store, "BROADCAST_ROWS", 40)  # 2,560 bits
    df = spark.createDataFrame([(i, i % 7) for i in range(2000)] + [(None, 1)], "id long, x long")
    side = spark.createDataFrame([(i, -i) for i in range(0, 2000, 20)], "id long, y long")
    may, other = store.sifted(df, "id", side)
    got = {r.id for r in may.collect()}
    assert set(range(0, 2000, 20)) <= got and len(got) < 300 and may.count() + other.count() == 2001
    for how in ("inner", "left", "left_anti"):
        want = sorted(map(str, df.join(side, "id", how).collect()))
        assert len(want) and sorted(map(str, store.joined(df, side, "id", how).collect())) == want


def test_classes_are_the_same_where_no_side_is_small(spark, monkeypatch):
    rng = random.Random(14)
    texts = [t for base in range(12) for t in _texts(rng, 5, 40 + 10 * base, rng.randrange(3, 30))] + [None, "", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (None, texts[8])], "doc_id long, text string")
    rows = lambda: sorted(map(str, minhash_dedup.near_duplicates(df).collect()))
    kept = lambda: sorted(map(str, minhash_dedup.keep_one(df).collect()))
    want, stay = rows(), kept()
    monkeypatch.setattr(store, "BROADCAST_ROWS", 1)
    assert (rows(), kept()) == (want, stay)


def test_recall_of_pairs_at_the_threshold(spark):
    """3,000 pairs between 0.75 and 0.77, among nothing else that is alike: all are found."""
    rng, rows = random.Random(10), []
    for i in range(3000):
        n, own = 200, 28  # 196 shingles each; 28 changed words at the end leave 168 shared of 224: exactly 0.75
        words = [f"p{i}-{j}" for j in range(n)]
        cut_at = n - own + rng.randrange(3)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:cut_at] + [f"q{i}-{j}" for j in range(n - cut_at)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(3000)) == 3000


_FILTER = """
import sys
from pyspark.sql import functions as F
from workboard.session import get_session
from workboard.llm import quality
from workboard.llm.store import table
spark = get_session("local[2]", 4, extra={"spark.checkpoint.dir": sys.argv[1]})
docs, labels = (table(spark, sys.argv[2], t) for t in ("documents", "labels"))
kept = quality.keep_good(docs, labels).count()
wanted = quality.classify(docs, labels).agg(F.sum("predicted")).first()[0]
print(len(quality.fit(docs, labels).rules), kept, wanted)
"""


def test_quality_filter_compiles(tmp_dir):
    """The pipeline's filter keeps what op8 predicts, and Spark never tries a method over 64 KB for it."""
    root = pathlib.Path(__file__).parents[2]
    out = subprocess.run([sys.executable, "-c", _FILTER, tmp_dir, "/root/testdata/sf0.01"], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]
    n, kept, wanted = map(int, out.stdout.split())
    assert n > 20 and kept == wanted
    assert "64 KB" not in out.stderr and "failed to compile" not in out.stderr
