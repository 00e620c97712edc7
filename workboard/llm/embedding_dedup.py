"""Near-duplicate vectors by random-hyperplane sign hashing (operator 3).

Equal vectors are one representative that carries its number of copies. Several hash tables sign a vector against
random hyperplanes; vectors with equal signs in a table meet in a bucket, where all cosines are computed as matrix
products in double precision. The number of signs grows with the logarithm of the number of vectors, so buckets keep
their size, and the number of tables follows from the recall wanted for a pair exactly at the threshold (``MISS``).
A pair counts in the first table in which it meets, so each link is counted once, and only counts and links that span
the components of a bucket leave a task. Links at or above the threshold are exact; none below it is made.

A bucket larger than ``BUCKET`` vectors is dealt in blocks, every pair of blocks to a task: no task grows with a hot
bucket and nothing is left out. Components are found by distributed rounds.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing: no links, own
component. Only vectors of one length are compared. Rows that repeat an id count as vectors of their own. A null id
has a null component and is kept. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workboard.llm.components import components
from workboard.llm.store import cut
from workboard.llm.words import mix

BUCKET = 2048
#: Signs are chosen so that a bucket of evenly spread vectors holds about this many.
AIM = 512
#: Chance that a pair exactly at the threshold meets in no table.
MISS = 1e-6
TASK_ROWS = 4096
SEED = 20240229


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """(signs in a table, tables) for ``n`` vectors."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / AIM)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(MISS) / math.log(1 - meet))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _signs(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Signs of unit vectors as one number for each row and table."""
    if bits == 0:
        return np.zeros((len(x), tables), np.int64)
    s = (x @ _planes(x.shape[1], bits, tables) > 0).reshape(len(x), tables, bits)
    return s @ (1 << np.arange(bits, dtype=np.int64))


def _vectors(col: pa.Array) -> list:
    """Usable vectors as float64 arrays, None for the others."""
    out = []
    for v in col:
        x = None
        if v.is_valid and len(v) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 and 0.0 are equal
            if not np.isfinite(x).all() or not x.any():
                x = None
        out.append(x)
    return out


def _prints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        p = [None if x is None else xxhash.xxh3_128_digest(x.tobytes()) for x in _vectors(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.binary())], names=["vec_id", "print"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(it: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """(bucket, tab, rep) for each vector and table."""
    for b in it:
        x = _vectors(b.column(1))
        rep = b.column(0).to_numpy()
        dims = np.array([len(v) for v in x])
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            s = _signs(_unit(np.stack([x[i] for i in own])), bits, tables)
            t = np.broadcast_to(np.arange(tables), s.shape)
            key = mix(mix(s.astype(np.uint64)) ^ mix(t.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(d)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(t.ravel().astype(np.int32)),
                 pa.array(np.repeat(rep[own], tables))], names=["bucket", "tab", "rep"])


def _pairs(t: pa.Table, bits: int, tables: int, threshold: float) -> pa.Table:
    """Links in nodes: rows (node, tab, blk, across, rep, copies, vec) -> (a, b, links): each vector's number of new
    links, and its link towards the smallest of its component in the node."""
    order = np.argsort(t["node"].to_numpy(), kind="stable")
    node, tab, blk, across, rep, copies = (t[c].to_numpy()[order] for c in
                                           ("node", "tab", "blk", "across", "rep", "copies"))
    vec = t["vec"].combine_chunks()
    dim = np.diff(vec.offsets.to_numpy())[order]
    flat, at0 = vec.flatten().to_numpy().astype(np.float64) + 0.0, vec.offsets.to_numpy()[:-1][order]
    at0 = at0 - vec.offsets[0].as_py()
    at = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else []
    out = []
    for a, b in zip(at, np.append(at[1:], len(node)), strict=True):
        x = _unit(flat[at0[a:b, None] + np.arange(dim[a])])
        s = _signs(x, bits, tables) if tab[a] else None
        i, j = [], []
        for k in range(0, b - a, 512):
            close = x[k:k + 512] @ x.T >= threshold - 1e-9
            u, v = np.nonzero(close)
            up = u + k < v
            i.append(u[up] + k)
            j.append(v[up])
        i, j = np.concatenate(i), np.concatenate(j)
        if across[a]:
            other = blk[a:b][i] != blk[a:b][j]
            i, j = i[other], j[other]
        if tab[a]:
            new = ~(s[i, :tab[a]] == s[j, :tab[a]]).any(axis=1)
            i, j = i[new], j[new]
        keep = np.concatenate([(x[i[k:k + 65536]] * x[j[k:k + 65536]]).sum(axis=1) >= threshold
                               for k in range(0, len(i), 65536)] or [np.empty(0, bool)])
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        m, c = b - a, copies[a:b].astype(np.float64)
        links = np.bincount(i, c[j], m) + np.bincount(j, c[i], m)
        root = np.arange(m)
        while True:  # the smallest index spreads over the links
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        has = np.flatnonzero(links)
        out.append((rep[a:b][has], rep[a:b][root[has]], np.rint(links[has]).astype(np.int64)))
    none = [np.empty(0, np.int64)] * 3
    a, b, n = (np.concatenate(x) for x in zip(*(out or [none]), strict=True))
    return pa.table({"a": a, "b": b, "links": n})


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``; links are cosines of ``threshold`` and more."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    prints = cut(rows.mapInArrow(_prints, "vec_id long, print binary"), "prints")
    classes = cut(prints.where("print is not null and vec_id is not null").groupBy("print")
                  .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # one row for each class: an id that repeats may carry several vectors
    reps = cut(rows.mapInArrow(_with_print, "vec_id long, print binary, vec " + rows.schema["vec"].dataType.simpleString())
               .join(classes.withColumnRenamed("print", "p"), (F.col("vec_id") == F.col("rep")) & (F.col("print") == F.col("p")))
               .dropDuplicates(["print"]).select(F.xxhash64("print").alias("key"), "rep", "copies", "vec"), "reps")
    n = reps.count()
    bits, tables = tables_for(n, threshold)
    keys = cut(reps.select("key", "vec").mapInArrow(partial(_keys, bits=bits, tables=tables),
                                                    "bucket long, tab int, rep long")
               .withColumnRenamed("rep", "key"), "keys")
    sizes = cut(keys.groupBy("bucket").count().where("count > 1"), "sizes")
    blocks = F.when(F.col("count") > BUCKET, F.ceil(F.col("count") * 2 / BUCKET)).otherwise(1).cast("int")
    mine = F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int")
    dealt = (keys.join(sizes, "bucket").withColumn("blocks", blocks).withColumn("blk", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.xxhash64("bucket", F.least("blk", "other"), F.greatest("blk", "other")).alias("node"), "tab", "blk",
                     (F.col("blk") != F.col("other")).alias("across"), "key"))
    # a pair of different blocks needs the rows of both: each row is sent with its own block to every pair
    total = dealt.count()
    tasks = -(-total // TASK_ROWS) or 1

    def pairs(t: pa.Table) -> pa.Table:
        return _pairs(t, bits, tables, threshold)

    found = cut(dealt.join(reps, "key").withColumn("task", F.pmod(F.xxhash64("node"), F.lit(tasks)))
                .drop("key").groupBy("task").applyInArrow(pairs, "a long, b long, links long"), "found")
    per_rep = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    own = prints.join(classes, "print", "left")
    split_ids = own.where("rep is not null and vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    comp = components(found.select("a", "b").unionAll(split_ids)).withColumnRenamed("id", "rep")
    return (own.join(per_rep, "rep", "left").join(comp, "rep", "left")
            .select("vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).alias("n_links"),
                    F.coalesce("component", "rep", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def _with_print(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        p = [None if x is None else xxhash.xxh3_128_digest(x.tobytes()) for x in _vectors(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.binary()), b.column(1)],
                                         names=["vec_id", "print", "vec"])
