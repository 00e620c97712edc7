"""Operators 11 to 13 against brute force: edge rows, tiny bounds that split every group, and generated tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from workboard.llm import conversation_repair, prefix_trie, rotated_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "conv_id long, turn long, role string, text string, part string, n int, symbols int"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DDL)  # columns whose names the operators use themselves


def _sort_key(r):
    return (r[0] is not None, r[0] or 0)


# ------------------------------------------------------------------ 12

def _best_edits(rows):
    """All edit sequences by states, cheapest first, then ASCII-least: (faults, cost, audit, lines)."""
    seen, faults = set(), []
    for _, role, text in rows:
        words = WORD.findall(text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else
                      "truncated" if words[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    onward = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def inserted(ways):
        for _ in range(3):
            for q, (c, a, o) in list(ways.items()):
                role, to = onward[q]
                way = (c + 2, a + "I", [*o, role + ":"])
                if to not in ways or way[:2] < ways[to][:2]:
                    ways[to] = way
        return ways

    ways = inserted({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for q, (c, a, o) in ways.items():
            options = [(q, c + 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                more, (to_role, to) = fault == "truncated", onward[q]
                options.append((to, c + 2 + more, "R", [f"{to_role}:{text}"]))
                if role[:1] == to_role[0]:
                    options.append((to, c + more, "K", [f"{role}:{text}"]))
                if q == 0 and role[:1] == "s":
                    options.append((1, c + more, "K", [f"{role}:{text}"]))
            for to, cost, op, line in options:
                way = (cost, a + op, o + line)
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        ways = inserted(new)
    return faults, *min((ways[q] for q in (0, 3) if q in ways), key=lambda w: w[:2])


def _repaired(convs):
    out = {}
    for conv, rows in convs.items():
        faults, cost, audit, lines = _best_edits(rows)
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _some_conversations(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in sorted(rng.sample(range(longest * 2), rng.randrange(1, longest))):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why?", "", " \t", "Go on!", f"Text {rng.random()}.", f"open {rng.random()}", None, "\x0b.\n"])
            rows.append((c, t, role, text))
    return rows


def _plain(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t, " " if r is None else r, " " if x is None else x))
    for v in convs.values():
        v.sort(key=_sort_key)
    return convs


@pytest.mark.parametrize("bound", [3, 2048])
def test_repair_matches_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(conversation_repair, "CHUNK_ROWS", bound)
    rng = random.Random(bound)
    rows = _some_conversations(rng, 60, 40)
    rows += [(None, t, "user" if t % 3 else "assistant", f"null {t % 9}.") for t in range(40)]  # a null id, repeated texts
    rows += [(99, None, "system", "First."), (99, 5, "user", "a" * 200_000), (99, 9, "assistant", "Done.")]
    rng.shuffle(rows)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(_frame(spark, rows)).collect()}
    assert got == _repaired(_plain(rows))


def test_a_hot_conversation_is_chunked(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "CHUNK_ROWS", 16)
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(300)}{rng.choice(['.', ''])}") for t in range(1500)]
    rows += [(c, 1, "user", "Hi.") for c in [*range(5), *range(100, 200)]]
    rows.sort(key=lambda r: rng.random())
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(_frame(spark, rows).repartition(6)).collect()}
    assert got == _repaired(_plain(rows))


def test_repair_of_gone_repeated_and_no_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."),
            (2, 0, "user", "gone"), (3, None, None, None)]
    df = _frame(spark, rows)
    got = {r.conv_id: r for r in conversation_repair.repair(df, F.col("text") == "gone").collect()}
    assert (got[1].duplicate, got[1].audit, got[1].cost) == (2, "KDDK", 6)
    assert (got[2].audit, got[2].cost, got[2].gaps, got[2].repaired_sha256) == ("", 0, 0, hashlib.sha256().hexdigest())
    assert (got[3].blank, got[3].audit, got[3].cost) == (1, "D", 3)
    lines = conversation_repair.repaired(df, F.col("text") == "gone").orderBy("conv_id", "part", "no", "pos").collect()
    assert [(r.conv_id, r.role, r.text) for r in lines] == [(1, "user", "Hi."), (1, "assistant", "Yes.")]
    assert conversation_repair.repair(df.limit(0)).collect() == []


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(3)] + [(None, None, None, None)]
    got = collections.Counter(tuple(r) for r in conversation_repair.damage(_frame(spark, rows)).collect())
    want = collections.Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[c, t, "user" if kind == 4 else role, text, kind == 0] += 2 if kind == 3 else 1
    assert got == want


def test_block_tables_agree_with_single_steps():
    t, rng = conversation_repair.Tables(), np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 37):
        s = rng.integers(0, conversation_repair.SYMBOLS, n).astype(np.uint8)
        for v in range(len(t.vectors)):
            at = v
            for x in s[::-1]:
                at = t.step[at, x]
            assert t.map(s)[v] == at


# ------------------------------------------------------------------ 13

def _trie(seqs):
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        words = len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * words
            leaves[k[:d]] += not children[k]
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k)).encode()).hexdigest())
        for k, m in members.items())


def _sequences(rows, graft=True):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t, r or "", x or ""))
    own = {c: [z[1:] for z in sorted(v, key=_sort_key)] for c, v in own.items()}
    if not graft:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - int(math.fmod(c, 20)), [])[:h[c]] + s[h[c]:] for c, s in own.items()}


def _rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("local", [5, 10_000])
def test_trie_matches_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(prefix_trie, "LOCAL", local)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rng, rows = random.Random(local), []
    for c in [*range(-25, 60), *range(200, 210), 10_000_000_019]:  # negative ids, a base that is absent
        for t in range(rng.randrange(0, 6)):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["a b", "c", "", None])))
    rows += [(61, t, "user", f"deep {t}") for t in range(60)]  # one long path
    rows += [(c, 0, "user", "same") for c in range(300, 340)]  # many ends at one node
    rows += [(70, 0, "user", "twice"), (70, 0, "user", "twice"), (71, None, "user", "x " * 30_000), (None, 0, "user", "nobody")]
    rng.shuffle(rows)
    assert _rows_of(prefix_trie.prefix_trie(_frame(spark, rows))) == _trie(_sequences(rows))


def test_trie_of_plain_sequences_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LOCAL", 3)
    rows = [(c, t, "user", f"{c >> (4 - t)}") for c in range(16) for t in range(5)]
    got = prefix_trie.prefix_trie(_frame(spark, rows), prefix_trie.as_they_are)
    assert _rows_of(got) == _trie(_sequences(rows, graft=False))
    assert prefix_trie.prefix_trie(_frame(spark, rows).limit(0)).collect() == []


def test_decompose_sums_subtrees():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        parent = np.array([-1] + [int(rng.integers(max(0, i - 3), i)) for i in range(1, n)])
        own, size = rng.integers(0, 9, (n, 2)), np.ones(n, np.int64)
        want = own.copy()
        for i in range(n - 1, 0, -1):
            want[parent[i]] += want[i]
            size[parent[i]] += size[i]
        assert (prefix_trie.decompose(parent, np.zeros(n, np.int64), size, own) == want).all()


# ------------------------------------------------------------------ 11

VEC = "vec_id long, embedding array<float>, row int, q string"


def _nearest(rows, every, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (q, x) in enumerate(ok):
        if q % every == 0:
            far = sorted((_far(x, y), i, b) for b, (i, y) in enumerate(ok) if b != at and len(y) == len(x))
            out.append([(q, n + 1, i, d) for n, (d, i, _) in enumerate(far[:k])])
    return sorted(r for rs in out for r in rs)


def _far(x, y):
    total = 0.0
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        total += (a - b) * (a - b)
    return math.sqrt(total)


def _search(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VEC)
    got = rotated_codes.nearest(df, lambda i: i % 10 == 0, **more)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())


def test_codes_find_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(rotated_codes, "QUERY_BLOCK", 7)
    monkeypatch.setattr(rotated_codes, "CODE_BLOCK", 64)
    monkeypatch.setattr(rotated_codes, "STEP", 4)
    rng = np.random.default_rng(5)
    middle = rng.standard_normal((5, 24))
    rows = [(i, [float(x) for x in (middle[i % 5] + 0.4 * rng.standard_normal(24)).astype(np.float32)]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a third are copies: ties to the smaller id
    got, want = _search(spark, rows), _nearest(rows, 10, 10)
    hit = len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in want})
    assert len(got) == len(want) and hit >= 0.99 * len(want)
    exact = {(q, i): s for q, _, i, s in want}
    assert all(exact.get((q, i), s) == s for q, _, i, s in got)


def test_codes_of_edge_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]),
            (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0]), (20, [3e38, -3e38]),
            (21, [-3e38, 3e38]), (30, [1.0, 2.0, 3.5]), (40, [5.0])]
    assert _search(spark, rows) == _nearest(rows, 10, 10)
    assert _search(spark, rows, k=1) == _nearest(rows, 10, 1)
    assert _search(spark, []) == []


def test_rotation_keeps_lengths_and_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turned = rotated_codes.rotated(x, 256)
    assert np.allclose((turned ** 2).sum(axis=1), 1) and np.allclose(turned @ turned.T, x @ x.T)
    signs = np.where(turned > 0, 1, -1) / 16
    fit = (signs * turned).sum(axis=1)
    error = np.abs(turned @ signs.T / fit - x @ x.T)
    assert (error > rotated_codes.EPS * np.sqrt(1 - fit ** 2) / (fit * np.sqrt(255))).mean() < 0.005
