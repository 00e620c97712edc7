"""The state of a table whose changes arrive as a log of batches — a base snapshot and the log's tail.

Reading a state by folding the whole log costs more with every batch. A base holds the folded rows up to a batch; a read
then touches the newest base and only the batches after it (partition pruning on ``batch``). Bases are plain Parquet folders,
named in a small index that gets its row after a base is complete, so a reader never sees a half-written one.

A base row keeps, next to its values, the order of the change that set them, for the overwritten columns together and for each
keep-if-null column. A late change (an older ``seq`` in a later batch) is thus weighed as if the whole log were folded at
once: state = base + tail holds whatever the order of arrival.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard.functions.coerce import as_of_lit, now_utc
from workboard.operators.changes import KEEP_IF_NULL, order_of, split_changes
from workboard.session import fresh_path
from workboard.streaming.apply import read_log

INDEX = "upto BIGINT, path STRING, written TIMESTAMP_NTZ"


def _order_columns(policy: dict) -> list[str]:
    return ["_o"] + [f"_o_{c}" for c, p in policy.items() if p == KEEP_IF_NULL]


def fold(rows: DataFrame, changes: DataFrame, policy: dict, as_of=None, key: str = "Id", seq: str = "seq",
         stamp_col: str | None = "FechaActualizacion") -> DataFrame:
    """``rows`` with ``changes`` folded in, and the order columns ``_o…`` of the changes that set each value.

    ``rows`` is a plain table or the result of an earlier fold; folding two batches one after the other, in either order, equals
    folding their union (but for ``stamp_col``, which is the time of the fold that last touched the row).
    """
    usable, _ = split_changes(changes, [key], seq)
    order = order_of(usable, seq)
    kept = [c for c, p in policy.items() if p == KEEP_IF_NULL]
    written = [c for c, p in policy.items() if p != KEEP_IF_NULL]
    aggs = [F.max(order).alias("_n")]
    aggs += [F.max_by(F.struct(F.col(c).alias("v"), order.alias("o")), F.when(F.col(c).isNotNull(), order)).alias(f"_n_{c}") for c in kept]
    if written:
        aggs.append(F.max_by(F.struct(*written), order).alias("_w"))
    batch = usable.groupBy(F.col(key).alias("_key")).agg(*aggs)
    kind = batch.schema["_n"].dataType
    for c in _order_columns(policy):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    joined = rows.join(batch, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()

    def newer(new: Column, old: str) -> Column:
        return F.coalesce(new.isNotNull() & (F.col(old).isNull() | (new > F.col(old))), F.lit(False))

    out = {}
    for c in written:
        out[c] = F.when(newer(F.col("_n"), "_o"), F.col(f"_w.{c}")).otherwise(F.col(c))
    for c in kept:
        out[c] = F.when(newer(F.col(f"_n_{c}.o"), f"_o_{c}"), F.col(f"_n_{c}.v")).otherwise(F.col(c))
        out[f"_o_{c}"] = F.when(newer(F.col(f"_n_{c}.o"), f"_o_{c}"), F.col(f"_n_{c}.o")).otherwise(F.col(f"_o_{c}"))
    out["_o"] = F.when(newer(F.col("_n"), "_o"), F.col("_n")).otherwise(F.col("_o"))
    if stamp_col and stamp_col in rows.columns:
        out[stamp_col] = F.when(hit, as_of_lit(as_of) if as_of is not None else now_utc()).otherwise(F.col(stamp_col))
    return joined.select(*[out.get(c, F.col(c)).alias(c) for c in rows.columns])


def newest_base(spark: SparkSession, index_path: str) -> tuple[int, str] | None:
    """``(last batch folded in, folder)`` of the newest complete base."""
    row = read_log(spark, index_path, INDEX).agg(F.max_by(F.struct("upto", "path"), F.struct("upto", "written"))).first()[0]
    return (row.upto, row.path) if row else None


def _from_base(initial: DataFrame, log: DataFrame, index_path: str) -> tuple[DataFrame, DataFrame, int]:
    base = newest_base(initial.sparkSession, index_path)
    if base is None:
        return initial, log, -1
    upto, path = base
    return initial.sparkSession.read.parquet(path), log.where(F.col("batch") > upto), upto


def write_base(initial: DataFrame, log: DataFrame, root: str, index_path: str, policy: dict, as_of=None, key: str = "Id",
               seq: str = "seq", stamp_col: str | None = "FechaActualizacion") -> int:
    """Fold the log's tail into a new base under ``root`` and enter it in the index; returns the last batch it holds.

    Start from any job at any time: without new batches nothing is written, and a base written twice for the same batch
    only costs its space.
    """
    rows, tail, upto = _from_base(initial, log, index_path)
    last = tail.agg(F.max("batch")).first()[0]
    if last is None:
        return upto
    path = fresh_path(root, f"base-{last}")
    known = tail.where(F.col("batch") <= last).drop("batch")  # batches that arrive meanwhile stay in the tail
    fold(rows, known, policy, as_of, key, seq, stamp_col).write.parquet(path)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    spark = initial.sparkSession
    spark.createDataFrame([(last, path, now)], INDEX).coalesce(1).write.mode("append").parquet(index_path)
    return last


def read_state(initial: DataFrame, log: DataFrame, index_path: str, policy: dict, as_of=None, key: str = "Id", seq: str = "seq",
               stamp_col: str | None = "FechaActualizacion") -> DataFrame:
    """The table as of the log's end: the newest base (or ``initial``) and the batches after it."""
    rows, tail, _ = _from_base(initial, log, index_path)
    return fold(rows, tail.drop("batch"), policy, as_of, key, seq, stamp_col).select(*initial.columns)
