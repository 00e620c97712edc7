"""Ordered groups of any size: sorted over many partitions, walked as streams, never gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workboard.llm.store import cut


def in_order(df: DataFrame, order: list[Column], ties: list[Column] | None = None) -> DataFrame:
    """``df`` dealt in ranges of ``order`` and sorted by ``order`` and ``ties``, with ``part``, the number of the range.

    A group that leads the order and holds a third of all rows spreads over many ranges. Rows that tie in ``order``
    share a range; if only identical rows tie in all columns, a range that is computed again comes out the same.
    """
    return (df.repartitionByRange(*order).sortWithinPartitions(*order, *(ties or []))
            .withColumn("part", F.spark_partition_id()))


def streamed(df: DataFrame, keys: list[str], order: list[Column], walk: Callable[[Iterator[pa.RecordBatch]], Iterator],
             schema: str) -> DataFrame:
    """``walk`` over batches in which the rows of each key follow each other in ``order``.

    Spark sorts with spill and ``walk`` keeps what it carries from row to row, so memory does not grow with a group. Use
    it on rows that stand for many (chunks, pieces): the rows of one key are walked by one task.
    """
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)


def rows_of(it: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of ``columns``."""
    for b in it:
        at = [b.schema.get_field_index(c) for c in columns]
        yield from zip(*(b.column(i).to_pylist() for i in at), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, size_of: Callable[[tuple], int], limit: int = 4 << 20,
            most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of about ``limit`` bytes, as ``size_of`` tells them."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size_of(r)
        if total > limit or len(held) >= most:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)


def _folded(it: Iterator[pa.RecordBatch], key: str, xors: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    last, count, carry = None, 0, dict.fromkeys(xors, np.int64(0))
    for b in it:
        if not b.num_rows:
            continue
        ids = b.column(b.schema.get_field_index(key)).to_numpy()
        new = np.append(ids[0] != last or not count, ids[1:] != ids[:-1])
        run = np.cumsum(new)  # 0: the run of the batch before goes on
        starts = np.append(0, np.flatnonzero(new))[run]
        goes_on = run == 0
        n = np.arange(len(ids)) - starts + 1 + np.where(goes_on, count, 0)
        out = {"n": n}
        for x in xors:
            fold = np.bitwise_xor.accumulate(b.column(b.schema.get_field_index(x)).to_numpy())
            before = np.where(starts > 0, fold[starts - 1], np.int64(0))
            out[x] = fold ^ before ^ np.where(goes_on, carry[x], np.int64(0))
            carry[x] = out[x][-1]
        last, count = ids[-1], int(n[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[f.name], f.type) if f.name in out else b.column(b.schema.get_field_index(f.name)) for f in schema],
            schema=schema)


def running(ordered: DataFrame, key: str, xors: list[str], name: str) -> DataFrame:
    """Rows from :func:`in_order` with ``n``, their position in their group (from 1), and the columns ``xors`` replaced by
    their bitwise exclusive or over the group so far. ``key``, a long without nulls, leads the order.

    A range is folded as a stream. A group in several ranges is the first or last of each: the folds of those at most two
    groups for each range are added up in a table of that size.
    """
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema) + ", n long"
    schema = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in ordered.schema] + [("n", pa.int64())])
    rows = cut(ordered.mapInArrow(partial(_folded, key=key, xors=xors, schema=schema), ddl), name)
    edges = (rows.groupBy("part").agg(F.min(key).alias("a"), F.max(key).alias("b"))
             .select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias(key)))
    # two rows for each range, whatever the data
    ends = (rows.join(F.broadcast(edges), ["part", key]).groupBy("part", key)
            .agg(F.max("n").alias("__n"), *[F.max_by(x, "n").alias(f"__{x}") for x in xors]))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("part", key, F.sum("__n").over(earlier).alias("__n"),
                          *[F.bit_xor(f"__{x}").over(earlier).alias(f"__{x}") for x in xors]).where("__n is not null")
    found = rows.join(F.broadcast(offsets), ["part", key], "left")
    return found.withColumns({"n": F.col("n") + F.coalesce("__n", F.lit(0)),
                              **{x: F.col(x).bitwiseXOR(F.coalesce(f"__{x}", F.lit(0))) for x in xors}}).select(*rows.columns)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
