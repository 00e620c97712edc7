"""Conversation prefix trie, rolled up by centroid decomposition of its parent edges (operator 13).

Every sequence of first turns is a node, named by 128 bits that fold the hashes of (position, turn) so far; a group-by over
the steps of all conversations gives each node's members, its smallest member and its parent. Sums over subtrees follow
from a centroid decomposition:

* A node's weight is the number of steps of its members from it on, known from the same group-by: it is the sum of members
  over its subtree, so it falls strictly from the top of a component down any path.
* In each component the nodes with more than half of the weight of its top form a path; its lowest node is the
  centroid, whose subtree holds more than half, and the subtrees of its children at most half.
* The centroid's total (an aggregate over the nodes below it) is its own result and is added to the nodes of the path above,
  which are all of its ancestors. The component falls apart into the children's subtrees and the rest, each of at most half
  the weight, so the rounds grow with the logarithm of the input, not with the depth of the trie.
* Whether a node lies below the centroid, and below which child, is read from the steps of the node's smallest member: a
  join, not a walk.

Components of at most LOCAL nodes are finished in tasks by the same decomposition; larger ones are split by Spark rounds. No
task holds a conversation, a node's members or a larger component. Only the digest of a node's ends reads its members one
after the other, joined to pieces beforehand, in bounded memory.

Edge cases: rows without conv_id take no part. Null turns come first; rows of equal turn are ordered by role, a hash of the
row, then the text; repeated rows are turns of their own. A null role or text is empty. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.llm.runs import batched, in_order, rows_of, running, streamed
from workboard.llm.store import cut, small

#: Nodes of a component that is finished in one task, and of a task.
LOCAL = 10_000
TASK_NODES = 40_000
#: Members joined to one piece of a digest.
PIECE = 16_384

WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """(conv_id, n, a, b, words): each turn's position from 1, its 128-bit name, and the words of its text."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = (conversations.where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                    role.alias("role"), text.alias("text"))
            .withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(1), "text", "role"),
                          "words": F.regexp_count("text", F.lit(WORD)).cast("long")}))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("a").asc()]
    return running(in_order(rows, order, [F.col("text").asc()]).select("conv_id", "part", "a", "b", "words"), "conv_id", [],
                   "turns").drop("part")


def grafted(own: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Steps of rebuilt conversations: the first h turns of conversation c - c % ``every`` in the place of c's own first h,
    with h = crc32(c) % (``most`` + 1). (conv_id, depth, a, b, words, length), with a row of depth 0 for each."""
    c = F.col("conv_id")
    lengths = own.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = lengths.withColumns({"h": F.crc32(c.cast("string").cast("binary")) % (most + 1), "base": c - c % every})
    bases = lengths.where(c % every == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    convs = cut(convs.withColumn("length", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
                .select("conv_id", "base", "h", "m", "length"), "convs")
    tails = (own.join(convs, "conv_id").where("n > h")
             .select("conv_id", (F.col("m") + F.col("n") - F.col("h")).alias("depth"), "a", "b", "words", "length"))
    heads = own.where((c % every == 0) & (F.col("n") <= most)).withColumnRenamed("conv_id", "base")
    heads = (heads.join(convs.where("m > 0"), "base").where("n <= m")
             .select("conv_id", F.col("n").alias("depth"), "a", "b", "words", "length"))
    nought = F.lit(0).cast("long")
    roots = convs.select("conv_id", nought.alias("depth"), nought.alias("a"), nought.alias("b"), nought.alias("words"), "length")
    return roots.unionByName(heads).unionByName(tails)


def _named(steps: DataFrame) -> DataFrame:
    """Steps with the name (x, y) of the node they lead to and that of its parent (px, py); the root is (0, 0)."""
    own = F.when(F.col("depth") == 0, F.lit(0).cast("long"))
    s = steps.withColumns({"x": own.otherwise(F.xxhash64("depth", "a", "b")),
                           "y": own.otherwise(F.xxhash64(F.lit(3), "b", "depth", "a"))}).drop("a", "b")
    s = s.withColumns({"px": F.col("x"), "py": F.col("y")})
    s = in_order(s, [F.col("conv_id").asc(), F.col("depth").asc()])
    return running(s, "conv_id", ["x", "y"], "steps").drop("part", "n").withColumns(
        {"px": F.col("px").bitwiseXOR(F.col("x")), "py": F.col("py").bitwiseXOR(F.col("y"))})


def _nodes(steps: DataFrame) -> DataFrame:
    """One row for each node, with its own share of the sums."""
    found = cut(steps.groupBy("x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), F.max("words").alias("words"),
        F.min("px").alias("px"), F.min("py").alias("py")), "nodes")
    inner = F.col("depth") > 0
    above = found.where(inner).groupBy("px", "py").agg(F.count("*").alias("n_children"))
    above = found.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id")).join(
        above, ["px", "py"])
    own = found.join(above.select(F.col("px").alias("x"), F.col("py").alias("y"), "n_children"), ["x", "y"], "left")
    own = own.join(above.drop("n_children"), ["px", "py"], "left")
    return own.select(
        "x", "y", "conv_id", "depth", F.when(inner, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "weight", "px", "py",
        F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_FINISHED = "x long, y long, " + ", ".join(f"{c} long" for c in OUT)
_FINISHED_ARROW = pa.schema([(c, pa.int64()) for c in ["x", "y", *OUT]])


def decompose(parent: np.ndarray, top: np.ndarray, weight: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums of ``own`` over subtrees. ``parent`` are indexes (-1 at the tops), smaller than those of their children; ``top`` is
    the index of each component's top; ``weight`` falls strictly down each path."""
    n = len(parent)
    comp, weight, added = top.copy(), weight.copy(), np.zeros_like(own)
    live = np.arange(n)
    while len(live):
        path = live[2 * weight[live] > weight[comp[live]]]
        centre = np.full(n, -1)
        np.maximum.at(centre, comp[path], path)  # the lowest of a path has the largest index
        z = centre[comp[live]]
        # each node's highest ancestor below the centroid, or its top, by doubling
        hop = np.arange(n)
        onward = (parent[live] >= 0) & (parent[live] != z) & (comp[live] != live)
        hop[live[onward]] = parent[live][onward]
        while True:
            far = hop[hop[live]]
            if (far == hop[live]).all():
                break
            hop[live] = far
        child = hop[live]
        below = parent[child] == z
        below &= child != comp[live]  # the top's parent is in another component
        total = np.zeros_like(own)
        inside = below | (live == z)
        np.add.at(total, z[inside], own[live[inside]])
        over = path[path != centre[comp[path]]]
        over_z = centre[comp[over]]
        added[over] += total[over_z]
        weight[over] -= weight[over_z]
        centres = live[live == z]
        added[centres] += total[centres]
        comp[live[below]] = child[below]
        live = live[live != z]
    return added


def _finish(t: pa.Table) -> pa.Table:
    """Components that lie wholly in ``t``, by the same decomposition."""
    t = t.sort_by("depth")
    names = list(zip(t["x"].to_pylist(), t["y"].to_pylist(), strict=True))
    comps = list(zip(t["cx"].to_pylist(), t["cy"].to_pylist(), strict=True))
    at = {name: i for i, name in enumerate(names)}
    up = list(zip(t["px"].to_pylist(), t["py"].to_pylist(), strict=True))
    top = np.array([at[c] for c in comps], np.int64)
    parent = np.array([-1 if c == me else at[p] for me, c, p in zip(names, comps, up, strict=True)], np.int64)
    own = np.stack([t["leaf"].to_numpy(), t["saved"].to_numpy()], axis=1)
    sums = decompose(parent, top, t["weight"].to_numpy(), own)
    cols = {c: t[c] for c in ("x", "y", *OUT[:5])}
    return pa.table({**cols, "n_leaves": sums[:, 0] + t["more_leaves"].to_numpy(),
                     "saved_tokens": sums[:, 1] + t["more_saved"].to_numpy()}, schema=_FINISHED_ARROW)


def rolled_up(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Nodes with n_leaves and saved_tokens, the sums of ``leaf`` and ``saved`` over their subtrees."""
    zero = F.lit(0).cast("long")
    active = cut(nodes.withColumns({"cx": zero, "cy": zero, "more_leaves": zero, "more_saved": zero}), "active")
    done, rest = [], []
    comp = ["cx", "cy"]
    while True:
        big = cut(active.groupBy(*comp).agg(F.count("*").alias("size"), F.max("weight").alias("total"))
                  .where(F.col("size") > LOCAL).drop("size"), "components")
        if big.isEmpty():
            rest.append(active)
            break
        tagged = active.join(small(big), comp, "left")
        rest.append(tagged.where("total is null").drop("total"))
        work = tagged.where("total is not null")
        path = 2 * F.col("weight") > F.col("total")
        centres = cut(work.where(path).groupBy(*comp).agg(F.min_by(F.struct("x", "y", "depth", "weight"), "weight").alias("z"))
                      .select(*comp, F.col("z.x").alias("zx"), F.col("z.y").alias("zy"), F.col("z.depth").alias("zd"),
                              F.col("z.weight").alias("zw")), "centres")
        # members that go on below a centroid, with the child they go through
        through = (steps.select("conv_id", F.col("x").alias("kx"), F.col("y").alias("ky"), F.col("px").alias("zx"),
                                F.col("py").alias("zy"), "depth").where("depth > 0").drop("depth")
                   .join(small(centres).select(*comp, "zx", "zy"), ["zx", "zy"])
                   .select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("conv_id").alias("through"), "kx", "ky"))
        own = work.join(small(centres), comp)
        split = cut(own.join(through, (F.col("cx") == F.col("tx")) & (F.col("cy") == F.col("ty"))
                             & (F.col("conv_id") == F.col("through")) & (F.col("depth") > F.col("zd")), "left")
                    .drop("tx", "ty", "through"), "split")
        is_centre = (F.col("x") == F.col("zx")) & (F.col("y") == F.col("zy"))
        below = F.col("kx").isNotNull()
        totals = cut(split.where(below | is_centre).groupBy(*comp).agg(F.sum("leaf").alias("z_leaves"), F.sum("saved").alias("z_saved")),
                     "totals")
        known = split.join(small(totals), comp)
        above = path & ~is_centre
        done.append(known.where(is_centre).select(
            "x", "y", *OUT[:5], (F.col("more_leaves") + F.col("z_leaves")).alias("n_leaves"),
            (F.col("more_saved") + F.col("z_saved")).alias("saved_tokens")))
        active = cut(known.where(~is_centre).select(
            *nodes.drop("weight").columns,
            (F.col("weight") - F.when(above, F.col("zw")).otherwise(0)).alias("weight"),
            F.when(below, F.col("kx")).otherwise(F.col("cx")).alias("cx"),
            F.when(below, F.col("ky")).otherwise(F.col("cy")).alias("cy"),
            (F.col("more_leaves") + F.when(above, F.col("z_leaves")).otherwise(0)).alias("more_leaves"),
            (F.col("more_saved") + F.when(above, F.col("z_saved")).otherwise(0)).alias("more_saved")), "active")
    left = cut(_union(rest), "left")
    tasks = -(-left.count() // TASK_NODES) or 1
    finished = (left.withColumn("task", F.pmod(F.xxhash64(*comp), F.lit(tasks))).groupBy("task")
                .applyInArrow(_finish, _FINISHED))
    return _union([*done, finished])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


_PIECES = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("part", pa.int32()), ("no", pa.int64()), ("alone", pa.bool_()),
                     ("ids", pa.string())])


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each node of a range, joined by commas, at most PIECE to a row; ``alone``: all there are."""
    def walk():
        no, first = 0, True
        runs = itertools.groupby(rows_of(it, ["x", "y", "part", "conv_id"]), key=lambda r: r[:3])
        held = None  # a run's last piece, until the next run shows that the range does not end with it
        for (x, y, part), rows in runs:
            if held is not None:
                yield held
            whole = True
            for ids in itertools.batched((str(r[3]) for r in rows), PIECE):
                if len(ids) == PIECE:
                    whole = False
                    yield x, y, part, no, False, ",".join(ids)
                    held = None
                else:
                    held = x, y, part, no, whole and not first, ",".join(ids)
                no += 1
            first = False
        if held is not None:
            yield *held[:4], False, held[5]
    return batched(walk(), _PIECES, lambda r: 40 + len(r[5]))


_DIGESTS = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def walk():
        for (x, y), rows in itertools.groupby(rows_of(it, ["x", "y", "ids"]), key=lambda r: r[:2]):
            digest, comma = hashlib.sha256(), b""
            for _, _, ids in rows:
                digest.update(comma + ids.encode())
                comma = b","
            yield x, y, digest.hexdigest()
    return batched(walk(), _DIGESTS, lambda r: 90)


def ends(steps: DataFrame) -> DataFrame:
    """(x, y, ends_sha256) of the nodes at which sequences end: the digest of their ids in order, joined by commas."""
    last = steps.where("depth = length").select("x", "y", "conv_id")
    order = [F.col("x").asc(), F.col("y").asc(), F.col("conv_id").asc()]
    pieces = cut(in_order(last, order).mapInArrow(_pieces, "x long, y long, part int, no long, alone boolean, ids string"), "ends")
    alone = pieces.where("alone").select("x", "y", F.sha2("ids", 256).alias("ends_sha256"))
    others = streamed(pieces.where("not alone"), ["x", "y"], [F.asc("part"), F.asc("no")], _digests,
                      "x long, y long, ends_sha256 string")
    return alone.unionByName(others)


def trie(steps: DataFrame) -> DataFrame:
    """The nodes of sequences given as ``steps`` (conv_id, depth, a, b, words, length: depth 0 and 1..length of each, (a, b) the
    name of the step): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    named = _named(steps)
    named = cut(named, "named")
    nodes = rolled_up(_nodes(named), named)
    none = hashlib.sha256().hexdigest()
    return nodes.join(ends(named), ["x", "y"], "left").select(*OUT, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, rebuild=grafted, **cols: str) -> DataFrame:
    """The trie of ``conversations``; ``rebuild`` turns positioned turns into steps."""
    return trie(rebuild(turns(conversations, **cols)))


def as_they_are(own: DataFrame) -> DataFrame:
    """Steps of the conversations as they stand, for :func:`prefix_trie`."""
    lengths = own.groupBy("conv_id").agg(F.count("*").alias("length"))
    nought: Column = F.lit(0).cast("long")
    roots = lengths.select("conv_id", nought.alias("depth"), nought.alias("a"), nought.alias("b"), nought.alias("words"), "length")
    return roots.unionByName(own.join(lengths, "conv_id").select("conv_id", F.col("n").alias("depth"), "a", "b", "words", "length"))
