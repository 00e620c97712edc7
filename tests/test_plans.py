"""Physical-plan properties the operators rely on: pushdown, pruning, bounded top-k, map-side reduction."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from workboard import schemas
from workboard.operators import changes, intake, search
from workboard.plans import catalog
from workboard.sources import tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_list_pushes_equality_filters_and_prunes(spark, tmp_dir):
    rows = [(i, dt.datetime(2026, 1, 1), f"T{i}", "app", None, None, None, None, None, None, None, None, None, None,
             None, None, None, None, None, None, None, None, None, None, None, None, None, "Nuevo", "{}", None, None,
             None, i % 3) for i in range(1, 50)]
    path = os.path.join(tmp_dir, "infra")
    spark.createDataFrame(rows, schemas.REQUESTS_INFRA).write.parquet(path)
    df = tables.read_table(spark, path, schemas.REQUESTS_INFRA)
    plan = _plan(search.list_requests(df, "infra", estado="Nuevo", q="ap", proyecto_id="2", limit=500))
    assert "TakeOrderedAndProject" in plan
    assert "EqualTo(Estado,Nuevo)" in plan and "EqualTo(ProyectoId,2)" in plan
    read_schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "PayloadJson" not in read_schema and "Funcionalidad" not in read_schema


def test_attachment_list_never_reads_bytes(spark, tmp_dir):
    rows = [(1, "infra", 5, "a.txt", None, 3, b"abc", None, dt.datetime(2026, 1, 1))]
    path = os.path.join(tmp_dir, "att")
    spark.createDataFrame(rows, schemas.ATTACHMENTS).write.parquet(path)
    att = tables.read_table(spark, path, schemas.ATTACHMENTS)
    keys = spark.createDataFrame([("infra", 5)], "Tipo string, SolicitudId bigint")
    plan = _plan(search.attachments_list(att, keys))
    read_schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "Contenido" not in read_schema


def test_upsert_collapse_is_one_partial_aggregate(spark):
    batch = spark.createDataFrame([("infra", 1, 1, "a"), ("infra", 1, 2, "b")],
                                  "Tipo string, SolicitudId bigint, seq bigint, Titulo string")
    last = changes.last_per_key(batch, ["Tipo", "SolicitudId"])
    plan = _plan(last)
    assert "partial_max_by" in plan and "Join" not in plan
    assert [r["Titulo"] for r in last.collect()] == ["b"]


def test_patch_collapse_is_partial_aggregate(spark):
    batch = spark.createDataFrame([(1, 1, "a", None, None)],
                                  "Id bigint, seq bigint, Estado string, Responsable string, FechaEntrega date")
    plan = _plan(changes.collapse(batch, ["Id"], changes.TRACKING_POLICY))
    assert "partial_max_by" in plan


def test_lowered_search_copy_is_pushed(spark, tmp_dir):
    path = os.path.join(tmp_dir, "lc")
    df = spark.createDataFrame([(1, "Caja Norte"), (2, "portal")], "Id bigint, Titulo string")
    df.withColumn("titulo_lc", F.lower("Titulo")).write.parquet(path)
    t = spark.read.parquet(path)
    q = t.where(search.text_search("CAJA", ["titulo_lc"], lowered=True))
    assert "StringContains(titulo_lc,caja)" in _plan(q)
    assert [r["Id"] for r in q.collect()] == [1]
    assert [r["Id"] for r in t.where(search.text_search("c_ja", ["titulo_lc"], lowered=True)).collect()] == [1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_seed_tasks_are_linked_before_their_texts_are_made(spark):
    """The join to the parents moves stored columns; the text id (built with ``lpad``) is made above the join."""
    for name in ("seed_load", "seed_load_rejects"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan.split("Join ", 1)
        assert "lpad" in above and "lpad" not in below, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_task_bodies_of_one_row_group_are_read_by_many_tasks(spark):
    parts = catalog.QUERIES["task_intake"](spark, SF).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_task_body_id_is_searched_once(spark):
    raw = spark.createDataFrame([("7x", "99999999999999999999", None, "3%", "a"), (" ", "5", "", None, "b")],
                                "proyectoId string, dependenciaId string, tareaPadreId string, progreso string, nombre string")
    typed = intake.tasks(raw)
    rows = [(r.ProyectoId, r.DependenciaId, r.TareaPadreId, r.Progreso, r.Motivo) for r in typed.collect()]
    assert rows == [(7, None, None, 3, "id_fuera_de_rango"), (None, 5, None, 0, "sin_proyecto")]
    plan = typed._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(ltrim(cast(proyectoId") + plan.count("regexp_extract(ltrim(proyectoId") <= 1
