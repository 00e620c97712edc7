"""Nearest neighbours by randomly rotated one-bit codes (operator 11).

Vectors, less the mean of all, are scaled to length one, padded to a power of two, and turned by random signs and
Hadamard transforms; the signs of what comes out are a vector's code, packed into bytes. With the code go two scalars: the
length, and ``fit``, the inner product of the turned vector with its code. The inner product of a turned query with the
code, over ``fit``, estimates the inner product with the vector, with an error of about
``sqrt(1 - fit^2) / (fit * sqrt(bits - 1))``; EPS times that bounds it. Every row is indexed; only the mean is fitted, on
all rows.

1. Codes are dealt in blocks and queries in blocks by a hash. A cell (block of queries, block of codes) estimates all its
   distances and reports, for each query, its ``k`` least. The exact distances of the ``k`` least of all cells are
   taken; the k-th neighbour is no farther than the largest of them, the query's reach.
2. The cells run again and report the rows whose lower bound is within the reach.
3. These are joined with their vectors and ranked by the exact distance.

Nothing is capped: a neighbour is missed only if its error bound fails (about one in a thousand a pair at EPS = 3, and then
only near the k-th distance). Cells are bounded by the block sizes; every query meets every code, as an exhaustive search does, but
the vectors themselves are read for the few rows of step 3 only.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do null ids.
Only vectors of one length are compared. Rows that repeat an id are rows of their own: a query that repeats has a list for
each of its rows, and its other rows are candidates. Fewer than k candidates: all are returned. Vectors whose squares overflow
have no finite bounds and are compared exactly. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workboard.llm.store import cut

QUERY_BLOCK = 4096
CODE_BLOCK = 16_384
#: Queries scored at once inside a cell.
STEP = 64
#: Bits of a code, at least; longer vectors have the next power of two.
MIN_BITS = 512
#: Standard errors that the bounds allow.
EPS = 3.0
SEED = 20240611


def bits_of(dim: int, least: int = MIN_BITS) -> int:
    return max(least, 1 << (dim - 1).bit_length())


def rotated(x: np.ndarray, bits: int) -> np.ndarray:
    """Rows padded with zeros to ``bits`` and turned: three rounds of random signs and a normalised Hadamard transform."""
    out = np.zeros((len(x), bits))
    out[:, :x.shape[1]] = x
    for r in range(3):
        out *= np.random.default_rng([SEED, bits, r]).choice([-1.0, 1.0], bits)
        h = 1
        while h < bits:
            pair = out.reshape(len(x), -1, 2, h)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), bits)
            h *= 2
        out /= np.sqrt(bits)
    return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length one, lengths); a row of length zero stays zero, one of infinite length is not a number."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
        return x / np.where(norm == 0, 1, norm)[:, None], norm


def _by_length(col: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, vectors in double precision) for each length of vector."""
    offsets = col.offsets.to_numpy().astype(np.int64)
    dims, flat = np.diff(offsets), col.values.to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield at, flat[offsets[at][:, None] + np.arange(d)].astype(np.float64)


def _sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at, x in _by_length(b.column(0)):
            with np.errstate(over="ignore", invalid="ignore"):
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([x.sum(axis=0)]),
                                                  pa.array([len(at)])], names=["dim", "sums", "n"])


def _encode(it: Iterator[pa.RecordBatch], means: dict, least: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        row, vec_id = b.column(0).to_numpy(), b.column(1).to_numpy()
        for at, x in _by_length(b.column(2)):
            d = x.shape[1]
            bits = bits_of(d, least)
            unit, norm = _unit(x - means[d])
            turned = rotated(unit, bits)
            fit = np.abs(turned).sum(axis=1) / np.sqrt(bits)
            codes = np.packbits(turned > 0, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[at]), pa.array(vec_id[at]), pa.array(np.full(len(at), d, np.int32)),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(fit)],
                names=["row", "vec_id", "dim", "code", "norm", "fit"])


def _estimates(q: pa.Table, c: pa.Table, dim: int, means: dict, least: int) -> Iterator[tuple]:
    """(query rows, estimates, lower bounds) of squared distances to all codes of a cell, STEP queries at a time. The own row of
    a query is infinitely far; a distance whose squares overflow is estimated as 0 and bounded by nothing."""
    bits = bits_of(dim, least)
    codes = np.frombuffer(b"".join(c["code"].to_pylist()), np.uint8).reshape(c.num_rows, bits // 8)
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    norm, fit, rows = c["norm"].to_numpy(), c["fit"].to_numpy(), c["row"].to_numpy()
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        error = EPS * np.sqrt(np.maximum(1 - fit * fit, 0)) / (fit * np.sqrt(bits - 1)) + 1e-5
        scale = 1 / (fit * np.sqrt(bits))
        x = q["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64) - means[dim]
        unit, length = _unit(x)
        turned, q_rows = rotated(unit, bits).astype(np.float32), q["row"].to_numpy()
        for i in range(0, len(x), STEP):
            guess = (turned[i:i + STEP] @ signs.T) * scale
            both = norm * norm + (length[i:i + STEP] ** 2)[:, None]
            cross = 2 * norm * length[i:i + STEP, None]
            # a vector at the mean has no direction: its distance is the query's length
            near = np.where(cross > 0, both - cross * np.minimum(guess, 1), both)
            low = np.where(cross > 0, both - cross * np.minimum(guess + error, 1), both) - 1e-6 * both
            near[~np.isfinite(near)], low[~np.isfinite(low)] = 0, -np.inf
            own = q_rows[i:i + STEP, None] == rows[None, :]
            near[own] = low[own] = np.inf
            yield q_rows[i:i + STEP], near, low


def _likely(q: pa.Table, c: pa.Table, dim: int, means: dict, least: int, k: int) -> pa.Table:
    """The k least estimates of each query."""
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    codes = c["row"].to_numpy()
    for q_rows, near, _ in _estimates(q, c, dim, means, least):
        at = np.argpartition(near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
        value = np.take_along_axis(near, at, axis=1)
        i, j = np.nonzero(value < np.inf)
        parts.append((q_rows[i], codes[at[i, j]], value[i, j]))
    rows, found, near = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.table({"q": rows, "c": found, "near": near})


def _within(q: pa.Table, c: pa.Table, dim: int, means: dict, least: int) -> pa.Table:
    """The rows whose lower bound is within the reach of a query."""
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    codes, at, reach = c["row"].to_numpy(), 0, q["reach"].to_numpy()
    for q_rows, _, low in _estimates(q, c, dim, means, least):
        i, j = np.nonzero((low <= reach[at:at + len(q_rows), None]) & (low < np.inf))
        parts.append((q_rows[i], codes[j]))
        at += len(q_rows)
    rows, found = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.table({"q": rows, "c": found})


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision, summed from the first component on."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding", min_bits: int = MIN_BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of each query, ties to the smaller id."""
    rows = cut(vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
               .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
                       F.col(vector_col).alias("v")).withColumn("dim", F.size("v")), "vectors")
    # one mean for each length of vector
    sums = rows.select("v").mapInArrow(_sums, "dim int, sums array<double>, n long")
    per_dim = sums.groupBy("dim").agg(F.sum("n").alias("n"))
    total = (sums.select("dim", F.posexplode("sums").alias("pos", "x")).groupBy("dim", "pos").agg(F.sum("x").alias("x"))
             .groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("s")).join(per_dim, "dim"))
    means, n = {}, 0
    for r in total.collect():
        means[r.dim] = np.array([p.x for p in r.s]) / r.n
        n += r.n
    codes = cut(rows.select("row", "vec_id", "v").mapInArrow(
        partial(_encode, means=means, least=min_bits), "row long, vec_id long, dim int, code binary, norm double, fit double"), "codes")
    queries = cut(rows.where(is_query(F.col("vec_id"))), "queries")
    q_blocks, c_blocks = -(-queries.count() // QUERY_BLOCK) or 1, -(-n // CODE_BLOCK) or 1

    def block(salt: int, blocks: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(blocks)).cast("int")

    def all_of(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    cell = ["dim", "qb", "cb"]
    dealt = codes.withColumn("cb", block(1, c_blocks)).withColumn("qb", all_of(q_blocks)).groupBy(*cell)

    def against(q: DataFrame, body: Callable, ddl: str) -> DataFrame:
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            return body(left, right, key[0].as_py(), means, min_bits)

        asked = q.withColumn("qb", block(2, q_blocks)).withColumn("cb", all_of(c_blocks)).groupBy(*cell)
        return asked.cogroup(dealt).applyInArrow(run, ddl)

    mine = queries.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    theirs = rows.select(F.col("row").alias("c"), "vec_id", "v")

    def scored(pairs: DataFrame) -> DataFrame:
        return (pairs.join(theirs, "c").join(mine, "q")
                .select("q", "query_id", "c", "vec_id", distance(F.col("qv"), F.col("v")).alias("score")))

    best = Window.partitionBy("q").orderBy("near", "c")
    likely = cut(against(queries, partial(_likely, k=k), "q long, c long, near double")
                 .withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select("q", "c"), "likely")
    reach = (scored(likely).groupBy("q").agg(F.count("*").alias("n"), F.max("score").alias("far"))
             .where(F.col("n") == k).select(F.col("q").alias("row"), F.col("far")))
    # the reach as a square, and a little more for rounding; a query with fewer than k candidates reaches all
    asked = cut(queries.join(reach, "row", "left").withColumn("reach", F.coalesce(F.col("far") * F.col("far") * (1 + 1e-9), F.lit(float("inf"))))
                .drop("far"), "reach")
    pairs = cut(against(asked, _within, "q long, c long"), "pairs")
    order = Window.partitionBy("q").orderBy("score", "vec_id", "c")
    return (scored(pairs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
