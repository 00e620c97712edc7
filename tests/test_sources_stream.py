import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from workboard import schemas
from workboard.operators import changes
from workboard.sources import tables
from workboard.streaming.apply import change_log_stream


def test_with_ids_contiguous_over_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("k"))
    out = tables.with_ids(df, [F.col("k")], base=41)
    rows = sorted((r["Id"], r["k"]) for r in out.collect())
    assert [i for i, _ in rows] == list(range(42, 1042))
    assert [k for _, k in rows] == sorted(k for _, k in rows)  # ids follow the sort order


def test_conform_adds_defaults(spark):
    old = spark.createDataFrame([(1, dt.datetime(2026, 1, 1), "t")],
                                "Id bigint, FechaRegistro timestamp_ntz, Titulo string")
    out = tables.conform(old, schemas.REQUESTS_GENERAL, {"Estado": "Nuevo"})
    assert out.columns == schemas.columns(schemas.REQUESTS_GENERAL)
    r = out.first()
    assert (r["Estado"], r["Titulo"], r["ProyectoId"]) == ("Nuevo", "t", None)
    assert tables.conform(out, schemas.REQUESTS_GENERAL).collect() == out.collect()  # idempotent


def test_link_children(spark):
    parents = tables.with_ids(spark.createDataFrame([("b",), ("a",)], "nk string"), [F.col("nk")])
    kids = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "nk string, x int")
    got = {r["x"]: r["pid"] for r in tables.link_children(kids, parents, "nk", "pid").collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_dir):
    now = dt.datetime(2026, 9, 1)
    target = spark.createDataFrame(
        [(i, dt.datetime(2026, 1, 1), "t", "s", "a", None, None, None, "No", None, None, "Nuevo", "ana", None, None,
          "{}", None) for i in range(1, 6)], schemas.REQUESTS_ERP)
    ddl = "Id bigint, seq bigint, Estado string, Responsable string, FechaEntrega date"
    src = os.path.join(tmp_dir, "changes")
    b1 = spark.createDataFrame([(1, 1, "A", None, None), (2, 2, None, "luis", None)], ddl)
    b2 = spark.createDataFrame([(1, 3, None, "eva", None), (9, 4, "Z", None, None)], ddl)
    b1.coalesce(1).write.parquet(os.path.join(src, "p1"))
    b2.coalesce(1).write.parquet(os.path.join(src, "p2"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    log = os.path.join(tmp_dir, "log")

    def state():
        changed = spark.read.parquet(log).drop("batch")
        return sorted(map(tuple, changes.apply_patch(target, changed, changes.TRACKING_POLICY, as_of=now).collect()))

    change_log_stream(stream, lambda b: b, log, os.path.join(tmp_dir, "ckpt")).awaitTermination()
    batch = changes.apply_patch(target, b1.unionByName(b2), changes.TRACKING_POLICY, as_of=now)
    assert state() == sorted(map(tuple, batch.collect()))
    # without its checkpoint the stream hands out the same batches again; they replace their partitions
    change_log_stream(stream, lambda b: b, log, os.path.join(tmp_dir, "ckpt2")).awaitTermination()
    assert spark.read.parquet(log).count() == 4 and state() == sorted(map(tuple, batch.collect()))
    with pytest.raises(ValueError):
        change_log_stream(stream, lambda b: b, log, "")


def test_append_and_replace_partitions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    base = spark.createDataFrame([(1, "infra"), (2, "erp")], "Id bigint, Tipo string")
    tables.append(base, path, ["Tipo"])
    tables.append(spark.createDataFrame([(3, "erp")], "Id bigint, Tipo string"), path, ["Tipo"])
    changed = spark.createDataFrame([(20, "erp")], "Id bigint, Tipo string")
    tables.replace_partitions(changed, path, ["Tipo"])
    got = sorted((r["Id"], r["Tipo"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, "infra"), (20, "erp")]


def test_write_table_layout_prunes_partitions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "notes")
    rows = [(i, ["infra", "erp", "gen"][i % 3], i // 3, f"n{i}", None, dt.datetime(2026, 1, 1)) for i in range(60)]
    tables.write_table(spark.createDataFrame(rows, schemas.NOTES), path, ["Tipo"], ["SolicitudId", "Id"])
    df = tables.read_table(spark, path, schemas.NOTES).where((F.col("Tipo") == "erp") & (F.col("SolicitudId") == 4))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Tipo" in plan and "EqualTo(SolicitudId,4)" in plan
    assert [r["Id"] for r in df.collect()] == [13]


def test_write_table_splits_one_kind(spark, tmp_dir):
    path = os.path.join(tmp_dir, "one-kind")
    df = spark.range(40_000, numPartitions=4).select(F.lit("erp").alias("Tipo"), F.col("id").alias("Id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_table(df, path, ["Tipo"], ["Id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(spark.read.parquet(path).inputFiles()) > 1


def test_with_ids_hot_key_spreads_and_stays_contiguous(spark):
    # a third of the rows share one sort key; the range sort splits them over partitions, ids stay contiguous
    df = spark.range(0, 3000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("tie"))
    out = tables.with_ids(df, [F.col("k"), F.col("tie")])
    rows = sorted((r["Id"], r["k"], r["tie"]) for r in out.collect())
    assert [i for i, _, _ in rows] == list(range(1, 3001))
    assert [(k, t) for _, k, t in rows] == sorted((k, t) for _, k, t in rows)
