"""Referential audit (R2, J7) and plan audit.

SQL Server enforced two foreign keys (task → project, task → parent task) and left the rest unchecked (request
``ProyectoId``, the ``(Tipo, SolicitudId)`` children). Spark enforces none, so the audit reports violations as rows:
each rule is one anti join, and the rules are unioned into one report (no shuffle for the union itself).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _finding(df: DataFrame, rule: str, table: str, id_col: str, ref_col: str, *more: str) -> DataFrame:
    return df.select(F.lit(rule).alias("Regla"), F.lit(table).alias("Tabla"), *more,
                     F.col(id_col).cast("string").alias("Id"), F.col(ref_col).cast("string").alias("Ref"))


def referential_audit(projects: DataFrame, tasks: DataFrame, feed: DataFrame, notes: DataFrame,
                      attachments: DataFrame, releases: DataFrame) -> DataFrame:
    """R2: orphan tasks, orphan parent links, dangling request ``ProyectoId``, and notes / attachments / releases
    whose ``(Tipo, SolicitudId)`` matches no request of the unified feed (R1).

    Rules with the same parent keys are one anti join over the union of their children, so each parent key set is
    built and shuffled once: projects for tasks and requests, the request feed for notes, attachments and releases,
    tasks for parent links. AQE broadcasts a parent key set when it is small, and otherwise splits skewed partitions
    of the sort-merge anti join. Ids come out as text (tasks of the test bindings have text keys).
    """
    of_project = (_finding(tasks, "tarea_sin_proyecto", "tareas", "Id", "ProyectoId")
                  .unionByName(_finding(feed.where(F.col("ProyectoId").isNotNull()), "solicitud_sin_proyecto",
                                        "solicitudes", "Id", "ProyectoId")))
    of_request = reduce(lambda a, b: a.unionByName(b), [
        _finding(notes, "nota_sin_solicitud", "notas", "Id", "SolicitudId", "Tipo"),
        _finding(attachments, "documento_sin_solicitud", "documentos", "Id", "SolicitudId", "Tipo"),
        _finding(releases, "pase_sin_solicitud", "pases", "Id", "SolicitudId", "Tipo")])
    of_parent = _finding(tasks.where(F.col("TareaPadreId").isNotNull()), "tarea_sin_padre", "tareas", "Id", "TareaPadreId")
    pids = projects.select(F.col("Id").cast("string").alias("Ref"))
    tids = tasks.select(F.col("Id").cast("string").alias("Ref"))
    req = feed.select("Tipo", F.col("Id").cast("string").alias("Ref"))
    return (of_project.join(pids, "Ref", "left_anti").unionByName(of_parent.join(tids, "Ref", "left_anti"))
            .unionByName(of_request.join(req, ["Tipo", "Ref"], "left_anti").drop("Tipo"))
            .select("Regla", "Tabla", "Id", "Ref"))


def _weekend(c) -> F.Column:
    return F.coalesce(F.dayofweek(c).isin(1, 7), F.lit(False))


def plan_audit(tasks: DataFrame) -> DataFrame:
    """A phase must span exactly its subtasks; a dependency must end before the dependent task starts;
    plan dates fall on working days.

    Children are aggregated per parent first (partial aggregation — a phase with a huge number of subtasks still
    reduces map-side), then joined to the phases one row per phase.
    """
    kids = tasks.where(F.col("TareaPadreId").isNotNull()).groupBy("TareaPadreId").agg(
        F.min("FechaInicio").alias("HijoMin"), F.max("FechaFin").alias("HijoMax"))
    ph = tasks.select("Id", "FechaInicio", "FechaFin").join(
        kids.withColumnRenamed("TareaPadreId", "Id"), "Id")
    span = ph.select(
        "Id",
        F.when(~F.col("FechaInicio").eqNullSafe(F.col("HijoMin")), "fase_inicio").alias("r1"),
        F.when(~F.col("FechaFin").eqNullSafe(F.col("HijoMax")), "fase_fin").alias("r2"),
    )
    span_rows = span.select("Id", F.explode(F.array_compact(F.array("r1", "r2"))).alias("Regla"))

    dep = tasks.select(F.col("Id").alias("DependenciaId"), F.col("FechaFin").alias("DepFin"))
    dep_rows = (tasks.where(F.col("DependenciaId").isNotNull()).join(dep, "DependenciaId")
                .where(F.col("DepFin") >= F.col("FechaInicio"))
                .select("Id", F.lit("dependencia").alias("Regla")))

    wk_rows = (tasks.where(_weekend(F.col("FechaInicio")) | _weekend(F.col("FechaFin")))
               .select("Id", F.lit("fin_de_semana").alias("Regla")))
    return span_rows.unionByName(dep_rows).unionByName(wk_rows).withColumnRenamed("Id", "TareaId")
