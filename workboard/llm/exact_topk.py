"""Exact top-k search by inner product: distributed selection over histograms of scores (operator 10).

Queries are dealt into large blocks and candidates into smaller ones; each cell (block of queries, block of candidates)
computes all its scores, a tile of queries at a time. A round narrows, for every query, the interval that holds its k-th
highest score: a cell counts all its scores by bins of the query's interval, Spark adds the histograms over all cells, and
the bin in which the k-th falls becomes the next interval. Rounds end when every interval holds at most ``ENOUGH`` scores or is
one integer wide. A last pass filters the scores from the interval's lower end on, and ranks them, the smaller id first among
equal ones.

A cell sends its histogram from the top down to the bin where its own count reaches k: the k-th of all candidates is never
below that of a cell, so the bins that decide are complete. Memory is bounded by the block sizes. Every query meets every
candidate, so the work grows with their product, as the task demands; queries, the smaller side, are copied to the blocks of
candidates, and a candidate is copied once for each ``QUERY_BLOCK`` queries.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, neither do null ids. Rows
that share an id are rows of their own: each is a candidate for all others, and each query row gets its own ranks. Only
vectors of one length are scored with each other. Fewer than k candidates: all are returned. An empty table gives no
rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workboard.llm.store import cut

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
#: Queries whose scores with a block of candidates are held at once.
QUERY_TILE = 256
BINS = 1024
#: An interval with at most this many scores is narrow enough for the last pass.
ENOUGH = 1000

_LOW = np.iinfo(np.int64).min


def quantized(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as double precision; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * factor))
    return F.when((F.size(vector) > 0) & ~bad, whole)


def _tiles(q: pa.Table, c: pa.Table, dim: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(queries, their scores with all candidates) of a cell; a query's own row scores lowest."""
    x = q["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    y = c["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    own, other = q["row"].to_numpy(), c["row"].to_numpy()
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * dim < 2.0 ** 53
    right = y.T.astype(float) if exact else y.T
    for start in range(0, len(x), QUERY_TILE):
        tile = slice(start, start + QUERY_TILE)
        s = (x[tile].astype(float) @ right).astype(np.int64) if exact else x[tile] @ right
        s[own[tile, None] == other[None, :]] = _LOW
        yield tile, s


def _count(q: pa.Table, c: pa.Table, dim: int, span: int, width: int) -> pa.Table:
    """(query row, bin, scores in it) of a cell, from the top down to the bin that reaches the wanted count."""
    rows, lows, needs = (q[x].to_numpy() for x in ("row", "low", "need"))
    out = []
    for tile, s in _tiles(q, c, dim):
        low = lows[tile]
        i, j = np.nonzero((s >= low[:, None]) & (s < low[:, None] + span))
        counts = np.bincount(i * BINS + (s[i, j] - low[i]) // width, minlength=len(s) * BINS).reshape(len(s), BINS)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        i, b = np.nonzero((counts > 0) & (above < needs[tile, None]))
        out.append((rows[tile][i], b, counts[i, b]))
    return pa.table(dict(zip(("row", "bin", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def _pick(q: pa.Table, c: pa.Table, dim: int, k: int) -> pa.Table:
    """The k best of a cell for each query among the scores from its lower end on."""
    by_id = c.sort_by("vec_id")
    rows, ids, lows, others = q["row"].to_numpy(), q["vec_id"].to_numpy(), q["low"].to_numpy(), by_id["vec_id"].to_numpy()
    out = []
    for tile, s in _tiles(q, by_id, dim):
        i, j = np.nonzero((s >= lows[tile, None]) & (s != _LOW))
        order = np.lexsort((j, -s[i, j], i))  # of equal scores the smaller id
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[rank < k], j[rank < k]
        out.append((rows[tile][i], ids[tile][i], others[j], s[i, j]))
    return pa.table(dict(zip(_FOUND, map(np.concatenate, zip(*out, strict=True)), strict=True)))


_FOUND = ("row", "query_id", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", vector: Callable[[Column], Column] = quantized) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query with any other row.

    ``is_query`` marks query ids; ``vector`` turns a vector into integers (null: takes no part). Equal scores go to
    the smaller id.
    """
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector(F.col(vector_col)).alias("v"))
               .where("vec_id is not null and v is not null")
               .withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")
    n, n_queries, norm = rows.agg(
        F.count("*"), F.sum(is_query(F.col("vec_id")).cast("long")),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    most = min(int(norm or 0) + 1, 1 << 61)  # no inner product is larger than the square of the largest norm
    q_blocks, c_blocks = -(-(n_queries or 0) // QUERY_BLOCK) or 1, -(-(n or 0) // CANDIDATE_BLOCK) or 1

    def block(salt: int, blocks: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(blocks)).cast("int")

    def all_of(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    cell = ["dim", "qb", "cb"]
    candidates = rows.withColumn("cb", block(1, c_blocks)).withColumn("qb", all_of(q_blocks)).groupBy(*cell)
    queries = cut(rows.where(is_query(F.col("vec_id"))), "queries")
    state = queries.select("row", F.lit(-most).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))

    def against(state: DataFrame, work: Callable, names: tuple[str, ...]) -> DataFrame:
        q = queries.join(state, "row").withColumn("qb", block(2, q_blocks)).withColumn("cb", all_of(c_blocks))

        def of_cell(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
            if not q.num_rows or not c.num_rows:
                return pa.table({x: np.empty(0, np.int64) for x in names})
            return work(q, c, key[0].as_py())
        return q.groupBy(*cell).cogroup(candidates).applyInArrow(of_cell, ", ".join(f"{x} long" for x in names))

    def counter(span: int, width: int) -> Callable:
        return lambda q, c, dim: _count(q, c, dim, span, width)

    width, crowd = 2 * most + 1, ENOUGH + 1
    while width > 1 and crowd > ENOUGH:
        span, width = width, -(-width // BINS)
        falling = Window.partitionBy("row").orderBy(F.col("bin").desc())
        bins = (against(state, counter(span, width), ("row", "bin", "n")).groupBy("row", "bin").agg(F.sum("n").alias("n"))
                .join(state, "row").withColumn("above", F.sum("n").over(falling) - F.col("n")))
        hit = bins.where("above < need and above + n >= need").select("row", "bin", "above", "n")
        # without k scores in all the query keeps its lowest bound, and all its candidates are returned
        state = cut(state.join(hit, "row", "left").select(
            "row", (F.col("low") + F.coalesce("bin", F.lit(0)) * width).alias("low"),
            (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"), "n"), "state")
        crowd = state.agg(F.max("n")).first()[0] or 0
        state = state.drop("n")

    found = against(state, lambda q, c, dim: _pick(q, c, dim, k), _FOUND)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
