"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens (operator 1).

Every document is the set of its distinct word shingles, and a sketch of ``COORDINATES`` minwise tokens (for each
coordinate the token with the smallest hash). A tree starts at one coordinate: documents with the same token there
meet in a node. A small node is compared exhaustively; a large one branches again: each document follows
``BRANCHES`` further coordinates, chosen by the node's path, and so goes to child nodes named by path and token.
``TREES`` trees start at different coordinates. A pair of similarity s meets in a root node with probability
1 - (1-s)^TREES (1 - 6e-8 at s = 0.75), and each branch keeps it with probability s.

Dense groups come first. In every large node at the start of a tree all members are compared with PIVOTS of them (sketches, then
full sets), which connects a group of near copies by one row per member and pivot. From then on only pairs of different
components have to meet: a node of one component is finished, and in a large node whose members mostly belong to one
component, its rows are dealt to chunks, once each, which the few others join; it is never set against itself. All rows stay, as
a member may still be what links a document unlike the pivot.

Nodes with equal members are looked at once. In a node, sketches are compared first: documents without a partner that
agrees in at least ``MIN_AGREE`` coordinates leave (a pair at the threshold agrees less with probability below 1e-7),
and the rest splits into groups of possible partners. Groups with equal members are again looked at once, and a group
whose members all lie in one other group, of this round or the one before, is left out; in the rest the full shingle sets are
compared by counting over an inverted index, so a returned link is always exact, and links that span the group's components
are returned, not all pairs. Trees run in two rounds, so the second works on what the first left open.

The full sets are the bulk of what is shuffled: they are made from the texts wanted, go straight to the task that compares them,
once for each group, and are not written. Where ids are too many to broadcast, their bits sift the texts (``store.sifted``).

Documents with equal sets are one representative. A node or group is handled in one task only up to a fixed number of
members or shingles; a larger one branches, and what stays larger at the last level (very many near copies) is dealt in
blocks, every pair of blocks to some task, so no task grows with a group and nothing is left out.

Edge cases: null, empty or blank text has the empty set, links with nothing and is its own component. Fewer words
than a shingle: the whole sequence is one shingle. Rows that repeat an id with the same text get equal results; rows
that share an id with different texts are connected through it. A null id gets a null component and is kept. An empty
table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.llm.components import components
from workboard.llm.store import cut, is_small, joined, sifted, small
from workboard.llm.words import batches, lists, mix, segments, window_hashes, word_hashes

COORDINATES = 64
TREES = 12
#: Trees of the first round.
FIRST_TREES = 3
BRANCHES = 2
#: A node of more members branches.
SMALL_NODE = 2048
#: Members of a large node that all others are compared with.
PIVOTS = 3
MAX_LEVELS = 6
#: Rows with sketches, and shingles, that a task takes at a time.
TASK_ROWS = 2_000
TASK_SHINGLES = 500_000
#: P(Binomial(64, 0.75) < 28) < 1e-7.
MIN_AGREE = 28

_SALTS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _shingle_sets(texts: list, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text: (flat, offsets)."""
    split = [(t or b"").lower().split() for t in texts]  # bytes: lower() and split() know ASCII only
    starts = segments(np.array([len(w) for w in split]))
    h = word_hashes(list(chain.from_iterable(split)))
    windows = mix(window_hashes(h, words))
    sets = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        n = b - a
        if n >= words:
            sets.append(np.unique(windows[a:b - words + 1]))
        elif n:
            sets.append(mix(window_hashes(h[a:b], n) + np.uint64(n)))
        else:
            sets.append(np.empty(0, np.uint64))
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), segments(np.array([len(s) for s in sets]))


def _binary(batch: pa.RecordBatch, i: int) -> list:
    return batch.column(i).cast(pa.binary()).to_pylist()


def _sketch(it: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    a, s = _SALTS[:COORDINATES] | np.uint64(1), _SALTS[COORDINATES:]
    for batch in batches(it, "text"):
        flat, off = _shingle_sets(_binary(batch, 1), words)
        n = np.diff(off)
        full = np.flatnonzero(n)
        sig, roots = np.zeros((len(n), COORDINATES), np.int16), np.zeros((len(n), TREES), np.int64)
        if len(full):
            for j in range(COORDINATES):
                low = np.minimum.reduceat((flat ^ s[j]) * a[j], off[full])
                sig[full, j] = (mix(low) >> np.uint64(48)).astype(np.uint16).view(np.int16)
                if j < TREES:
                    roots[full, j] = low.view(np.int64)
        prints = [xxhash.xxh3_128_digest(flat[x:y].tobytes()) if y > x else None
                  for x, y in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()),
             lists(sig.ravel(), np.arange(len(n) + 1) * COORDINATES, pa.int16()),
             lists(roots.ravel(), np.arange(len(n) + 1) * TREES, pa.int64())],
            names=["doc_id", "n_shingles", "print", "sig", "roots"])


def _sets(it: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, "text"):
        flat, off = _shingle_sets(_binary(batch, 1), words)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(flat.view(np.int64), off, pa.int64())],
                                         names=["rep", "shingles"])


def _sets_of(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) of the texts whose id is in ``ids`` (doc_id, distinct), and of a few others if the ids are many."""
    wanted = texts.join(F.broadcast(ids), "doc_id", "left_semi") if is_small(ids) else sifted(texts, "doc_id", ids)[0]
    return wanted.select("doc_id", "text").mapInArrow(partial(_sets, words=words), "rep long, shingles array<long>")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, print, sig, roots): size and 128-bit fingerprint of each document's set, its minwise tokens
    (16 bits of each), and the whole tokens of the coordinates at which trees start."""
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(partial(_sketch, words=words),
                        "doc_id long, n_shingles long, print binary, sig array<short>, roots array<long>"))


def _connect(n: int, pairs: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """Smallest member of each one's component; ``pairs`` yields (i, its neighbours)."""
    root = np.arange(n)
    for i, others in pairs:
        if len(others):
            roots = np.unique(root[np.append(others, i)])
            if len(roots) > 1:
                root[np.isin(root, roots[1:])] = roots[0]
    return root


def _likely(t: pa.Table, percent: int) -> pa.Table:
    """Possible partners in nodes: rows (node, rep, comp, n_shingles, sig) -> (grp, rep, n_shingles)."""
    order = np.argsort(t["node"].to_numpy(), kind="stable")
    node, rep, comp, n = (t[c].to_numpy()[order] for c in ("node", "rep", "comp", "n_shingles"))
    sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)[order]
    at = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    group, keep = np.zeros(len(node), np.uint64), np.zeros(len(node), bool)
    for a, b in zip(at, np.append(at[1:], len(node)), strict=True):
        s, size, c = np.ascontiguousarray(sig[a:b].T), n[a:b], comp[a:b]
        partner = np.zeros(b - a, bool)

        def rows(s=s, size=size, c=c, partner=partner, m=b - a):
            for i in range(m - 1):
                agree = np.zeros(m - i - 1, np.uint8)
                for j in range(COORDINATES):
                    agree += s[j, i + 1:] == s[j, i]
                other = size[i + 1:]
                good = ((agree >= MIN_AGREE) & (c[i + 1:] != c[i])
                        & (np.minimum(other, size[i]) * 100 >= np.maximum(other, size[i]) * percent))
                found = np.flatnonzero(good) + i + 1
                if len(found):
                    partner[i] = True
                    partner[found] = True
                yield i, found

        root = _connect(b - a, rows())
        keep[a:b] = partner
        group[a:b] = mix(node[a:b].view(np.uint64) ^ mix(rep[a:b][root].astype(np.uint64)))
    return pa.table({"grp": group[keep].view(np.int64), "rep": rep[keep], "n_shingles": n[keep]})


def _exact(t: pa.Table, percent: int) -> pa.Table:
    """Links in groups: rows (part, rep, shingles) -> (a, b), spanning the components of each part."""
    t = t.sort_by([("part", "ascending"), ("rep", "ascending")])
    part, rep = t["part"].to_numpy(), t["rep"].to_numpy()
    sets = t["shingles"].combine_chunks()
    flat, off = sets.flatten().to_numpy(), segments(np.diff(sets.offsets.to_numpy()))
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    left, right = [], []
    for a, b in zip(at, np.append(at[1:], len(part)), strict=True):
        size = np.diff(off[a:b + 1])
        _, word = np.unique(flat[off[a]:off[b]], return_inverse=True)
        owner = np.repeat(np.arange(b - a), size)
        by_word = np.argsort(word, kind="stable")
        starts = segments(np.bincount(word))
        posted = owner[by_word]

        def rows(size=size, word=word, starts=starts, posted=posted, lo=off[a], first=a, m=b - a):
            for i in range(m - 1):
                mine = word[off[first + i] - lo:off[first + i + 1] - lo]
                mine = mine[starts[mine + 1] - starts[mine] > 1]
                if not len(mine):
                    continue
                both = np.bincount(np.concatenate([posted[starts[w]:starts[w + 1]] for w in mine]), minlength=m)
                both[:i + 1] = 0
                yield i, np.flatnonzero((both > 0) & (both * 100 >= (size + size[i] - both) * percent))

        root = _connect(b - a, rows())
        linked = np.flatnonzero(root != np.arange(b - a))
        left.append(rep[a:b][root[linked]])
        right.append(rep[a:b][linked])
    none = np.empty(0, np.int64)
    return pa.table({"a": np.concatenate(left or [none]), "b": np.concatenate(right or [none])})


def _n_blocks(weight: Column, most: int) -> Column:
    """Into how many blocks a group is dealt, which is also how often each of its rows is repeated."""
    return F.when(weight > most, F.ceil(weight * 2 / most)).otherwise(1).cast("int")


def _blocks(df: DataFrame, key: str, out: str, weight, most: int) -> DataFrame:
    """``df`` with ``out``: the task groups of each row of group ``key``, whose members weigh ``weight`` in all.

    Up to ``most`` a group is one task group. Beyond, its rows are dealt into blocks of about half of that by a hash,
    and a row goes to the pairs of its block with every block.
    """
    n = _n_blocks(weight, most)
    mine = F.pmod(F.xxhash64("rep", F.lit(5)), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.when(n == 1, F.col(key)).otherwise(
        F.xxhash64(F.col(key), F.least(x, mine), F.greatest(x, mine))))
    return df.withColumn(out, F.explode(pairs))


def _distinct_groups(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """One of the groups with equal members: (key, weight, n), of groups of two and more (n) in rows (key, rep)."""
    h = F.xxhash64("rep")
    seen = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), F.bit_xor(h).alias("x"),
                                 F.sum(F.shiftright(h, 16)).alias("y"))
    return cut(seen.where("n > 1").groupBy("n", "x", "y", "weight").agg(F.min(key).alias(key)).select(key, "weight", "n"),
               "groups")


def _open_groups(rows: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """Members (grp, rep, n_shingles, weight, n) of the groups in rows (grp, rep, n_shingles) that have to be compared: no group
    whose members all lie in another one, be it one of these or of ``earlier`` (grp, rep, n), which was compared.

    Each member names the largest group it is in. If all members of a group name the same other group, that one holds
    them all; it stays, as these members name it.
    """
    members = cut(rows.join(_distinct_groups(rows, "grp", "n_shingles"), "grp"), "members")
    named = members.select("rep", F.struct("n", F.lit(False).alias("old"), "grp").alias("g"))
    if earlier is not None:
        named = named.unionAll(earlier.select("rep", F.struct("n", F.lit(True).alias("old"), "grp").alias("g")))
    most = named.groupBy("rep").agg(F.max("g").alias("g")).select("rep", F.col("g.grp").alias("most"))
    inside = cut(members.join(most, "rep").groupBy("grp").agg(F.min("most").alias("x"), F.max("most").alias("y"))
                 .where("x = y and x <> grp").select("grp"), "inside")
    return cut(joined(members, inside, "grp", "left_anti").select(*members.columns), "wanted")


def _starts(reps: DataFrame, first: int, last: int) -> DataFrame:
    """(path, rep) of the nodes at which trees first..last-1 start."""
    return reps.select("rep", F.posexplode(F.slice("roots", first + 1, last - first)).alias("tree", "token")).select(
        F.xxhash64(F.col("tree") + first, "token").alias("path"), "rep")


def _pivot_links(texts: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Confirmed links (a, b) between the members of large starting nodes and their pivots; None without large nodes."""
    rows = _starts(reps, 0, FIRST_TREES)
    large = cut(rows.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_NODE).select("path"), "large")
    if large.isEmpty():
        return None
    members = rows.join(small(large), "path")
    pivots = cut(members.groupBy("path").agg(F.array_distinct(F.array(
        *[F.min_by("rep", F.xxhash64("rep", F.lit(i))) for i in range(PIVOTS)])).alias("pivots")), "pivots")
    pairs = (members.join(small(pivots), "path").select("rep", F.explode("pivots").alias("pivot"))
             .where("rep <> pivot").distinct())
    mine = reps.select("rep", "sig", "n_shingles")
    ends = cut(pivots.select(F.explode("pivots").alias("pivot")).distinct(), "pivot-ids")
    theirs = mine.join(small(ends), F.col("rep") == F.col("pivot")).select("pivot", F.col("sig").alias("with"), F.col("n_shingles").alias("m"))
    agree = F.aggregate(F.zip_with("sig", "with", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    likely = cut(pairs.join(mine, "rep").join(theirs, "pivot")
                 .where((F.least("n_shingles", "m") * 100 >= F.greatest("n_shingles", "m") * percent) & (agree >= MIN_AGREE))
                 .select("rep", "pivot"), "pivot-pairs")
    ids = cut(likely.select("rep").union(ends).distinct().withColumnRenamed("rep", "doc_id"), "ids")
    sets = cut(_sets_of(texts, ids, words), "sets")
    held = sets.join(small(ends), F.col("rep") == F.col("pivot")).select("pivot", F.col("shingles").alias("other"))
    both = F.size(F.array_intersect("shingles", "other"))
    found = (likely.join(sets, "rep").join(held, "pivot")
             .where(both * 100 >= (F.size("shingles") + F.size("other") - both) * percent))
    return cut(found.select(F.col("pivot").alias("a"), F.col("rep").alias("b")), "pivot-links")


def _chunked(large: DataFrame, main: DataFrame) -> DataFrame:
    """Leaves (path, rep, comp) for nodes that consist of one component ``main`` (of ``d`` members) and few others: chunks of
    the component that all others join, and the others among themselves. In a chunk the others count as one component."""
    node = large.drop("n").join(main, "path")
    chunks = F.ceil(F.col("d") * 2 / SMALL_NODE).cast("int")
    own, other = node.where("comp = main"), node.where("comp <> main")
    one = own.select(F.xxhash64("path", F.pmod(F.xxhash64("rep", F.lit(7)), chunks).cast("int")).alias("path"), "rep", "comp")
    each = other.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select(
        F.xxhash64("path", "chunk").alias("path"), "rep", F.bitwise_not("main").alias("comp"))
    rest = other.select(F.xxhash64("path", F.lit(-1)).alias("path"), "rep", "comp")
    return one.unionAll(each).unionAll(rest)


def _tree_nodes(reps: DataFrame, comp: DataFrame | None, first: int, last: int) -> DataFrame:
    """(path, rep, comp) in the leaves of trees first..last-1: nodes of several components that are small, mostly of one
    component, or at the last level. ``comp`` (id, component) is what is connected so far."""
    rows = _starts(reps, first, last)
    if comp is None:
        rows = rows.withColumn("comp", F.col("rep"))
    else:
        rows = joined(rows, comp.withColumnRenamed("id", "rep"), "rep", "left").select(
            "path", "rep", F.coalesce("component", "rep").alias("comp"))
    leaves = []
    for level in range(MAX_LEVELS + 1):
        sizes = cut(rows.groupBy("path").agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y"))
                    .where("n > 1 and x <> y").select("path", "n"), "sizes")
        live = cut(joined(rows, sizes, "path").select("path", "rep", "comp", "n"), "nodes")
        leaves.append(live.where(F.col("n") <= SMALL_NODE).select("path", "rep", "comp"))
        if sizes.where(F.col("n") > SMALL_NODE).isEmpty():
            break
        large = live.where(F.col("n") > SMALL_NODE)
        main = cut(large.groupBy("path", "comp").agg(F.count("*").alias("d")).groupBy("path")
                   .agg(F.max_by("comp", F.struct("d", "comp")).alias("main"), F.max("d").alias("d"), F.sum("d").alias("all"))
                   .where(F.col("all") - F.col("d") <= SMALL_NODE // 2).drop("all"), "main")
        leaves.append(_chunked(large, main))
        large = large.join(main, "path", "left_anti")
        if level == MAX_LEVELS:
            leaves.append(large.select("path", "rep", "comp"))
            break
        pick = [F.pmod(F.xxhash64("path", F.lit(b)), F.lit(COORDINATES)).cast("int") for b in range(BRANCHES)]
        step = F.array(*[F.struct(p.alias("j"), F.element_at("sig", p + 1).alias("t")) for p in pick])
        rows = cut(joined(reps.select("rep", "sig"), large, "rep").select("rep", "comp", "path", F.explode(step).alias("c"))
                   .select(F.xxhash64("path", "c.j", "c.t").alias("path"), "rep", "comp").distinct(), "branches")
    return reduce(DataFrame.unionAll, leaves)


def _search(texts: DataFrame, reps: DataFrame, comp: DataFrame | None, earlier: DataFrame | None, first: int, last: int,
            words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links found by trees first..last-1 between representatives that ``comp`` (id, component) does not connect, and the
    groups compared; those of ``earlier`` are not compared again."""
    leaves = _tree_nodes(reps, comp, first, last)
    nodes = _distinct_groups(leaves.withColumn("one", F.lit(1)), "path", "one")
    dealt = cut(_blocks(joined(leaves, nodes.drop("n"), "path"), "path", "node", F.col("weight"), SMALL_NODE)
                .select("node", "rep", "comp"), "dealt")
    dealt = joined(reps.select("rep", "n_shingles", "sig"), dealt, "rep").select("node", "rep", "comp", "n_shingles", "sig")

    def likely(t: pa.Table) -> pa.Table:
        return _likely(t, percent)

    def exact(t: pa.Table) -> pa.Table:
        return _exact(t, percent)

    # rows as they are dealt, each repeated once for each block of its node
    total = nodes.agg(F.sum(F.col("weight") * _n_blocks(F.col("weight"), SMALL_NODE))).first()[0] or 0
    n = -(-total // TASK_ROWS) or 1
    groups = cut(dealt.groupBy(F.pmod(F.xxhash64("node"), F.lit(n)).alias("task"))
                 .applyInArrow(likely, "grp long, rep long, n_shingles long"), "likely")
    wanted = _open_groups(groups, earlier)
    ids = cut(wanted.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    parts = cut(_blocks(wanted, "grp", "part", F.col("weight"), TASK_SHINGLES).select("part", "rep", "n_shingles"), "parts")
    total = parts.agg(F.sum("n_shingles")).first()[0] or 0
    n = -(-total // TASK_SHINGLES) or 1
    found = cut(_sets_of(texts, ids, words).join(small(parts.drop("n_shingles")), "rep").select("part", "rep", "shingles")
                .groupBy(F.pmod(F.xxhash64("part"), F.lit(n)).alias("task")).applyInArrow(exact, "a long, b long"),
                "links")
    return found, wanted


def links(texts: DataFrame, reps: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Confirmed links (a, b) whose components are those of all links between ``reps`` (rep, n_shingles, sig)."""
    dense = _pivot_links(texts, reps, words, percent)
    found, compared = _search(texts, reps, None if dense is None else components(dense), None, 0, FIRST_TREES, words, percent)
    found = found if dense is None else found.unionAll(dense)
    more, _ = _search(texts, reps, components(found), compared, FIRST_TREES, TREES, words, percent)
    return found.unionAll(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Linked are documents whose sets of ``words``-word shingles have at least ``percent`` / 100 of their union in
    common. ``component_id`` is the smallest id reachable over links; ``kept`` marks that document.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sk = cut(sketches(texts, words=words), "sketches")
    rep_of = cut(sk.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")
    classed = cut(sk.select("doc_id", "n_shingles", "print").join(rep_of, "print", "left").drop("print"), "classed")
    reps = cut(sk.where("print is not null and doc_id is not null").groupBy("print")
               .agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "sig", "roots")])
               .drop("print"), "reps")
    found = links(texts, reps, words, percent)
    # an id with several texts belongs to several classes
    split_ids = (classed.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"))
                 .where("a <> z").select("doc_id"))
    across = classed.join(split_ids, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = components(found.unionAll(across))
    return (joined(classed, comp.withColumnRenamed("id", "rep"), "rep", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one row of each group of near-duplicate texts, columns unchanged.

    Groups are of rows, not of ids: rows that share an id but hold unlike texts each stay, rows without an id are
    compared like all others, and rows without words all stay.
    """
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    own, text = F.col(id_col).cast("long"), F.col(text_col)
    # ids that do not tell rows apart: null, or several texts; such rows get a hash of id and text instead
    unclear = cut(docs.select(own.alias("__id"), F.xxhash64(text).alias("h")).groupBy("__id")
                  .agg(F.min("h").alias("x"), F.max("h").alias("y")).where("__id is not null and x <> y").select("__id"), "unclear")
    hashed = F.xxhash64(F.lit(11), own, text)
    if unclear.isEmpty():
        keyed = docs.withColumn("__key", F.coalesce(own, hashed))
    else:
        keyed = docs.join(small(unclear), own == F.col("__id"), "left").withColumn(
            "__key", F.when(own.isNull() | F.col("__id").isNotNull(), hashed).otherwise(own)).drop("__id")
    found = cut(near_duplicates(keyed, id_col="__key", text_col=text_col, **options), "near")
    gone = cut(found.where("not kept").select(F.col("doc_id").alias("__key")).distinct(), "gone")
    out = joined(keyed, gone, "__key", "left_anti").select(*keyed.columns)
    twice = cut(found.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1")
                .select(F.col("doc_id").alias("__twice")), "twice")
    if not twice.isEmpty():
        repeats = F.col("__key") == F.col("__twice")
        out = out.join(twice, repeats, "left_anti").unionByName(out.join(twice, repeats, "left_semi").dropDuplicates(["__key"]))
    return out.drop("__key")
