"""Shared helpers: cutting lineage in the cluster's shared folder, and joins against a side of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has at most this many rows of a few numbers each (a few MB).
BROADCAST_ROWS = 500_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    A private folder is made only where neither is set and the master is local (tests); a cluster without a shared
    folder is refused rather than served from a machine-local one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="workboard-llm-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later jobs start there, whatever executor is lost."""
    path = f"{shared_root(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast if a count shows that it is small; beyond that Spark shuffles both sides.

    ``df`` holds a few plain numbers a row and should be cheap to count (a cut).
    """
    return F.broadcast(df) if is_small(df) else df


def is_small(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def sifted(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts by its column ``key`` (long): rows whose key may be among the keys of ``ids`` (all that are, and a few
    others), and rows whose key is not.

    For joins with more ids than ``small`` broadcasts. A hash of each id sets one of 64 * BROADCAST_ROWS bits, and only
    these are broadcast, as words of 64 bits: with K ids a share of 1 - exp(-K / bits) of the other rows passes (6 % for two
    million ids), so what a join shuffles afterwards grows with its matches, not with ``df``.
    """
    def place(k: Column) -> tuple[Column, Column]:
        h = F.xxhash64(F.lit(23), k)
        return F.pmod(h, F.lit(BROADCAST_ROWS)), F.shiftrightunsigned(h, 58).cast("int")

    word, bit = place(F.col(key))
    bits = cut(ids.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__bits"))
               .groupBy("__word").agg(F.bit_or("__bits").alias("__bits")), "bits")
    held = F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(F.lit(1).cast("long"))
    marked = df.join(F.broadcast(bits), word == F.col("__word"), "left").withColumn("__may", F.coalesce(held == 1, F.lit(False)))
    return tuple(marked.where(x).drop("__word", "__bits", "__may") for x in ("__may", "not __may"))


def joined(df: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``df`` joined with the narrow ``side`` (a cut) on ``key``: ``side`` is broadcast if it is small, else ``df`` is sifted before both
    are shuffled. ``how``: inner, left or left_anti."""
    if is_small(side):
        return df.join(F.broadcast(side), key, how)
    may, other = sifted(df, key, side)
    out = may.join(side, key, how)
    return out if how == "inner" else out.unionByName(other, allowMissingColumns=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
