"""Project roll-up (A1 + J1) and portfolio KPIs (A2).

The reference groups a ``projects LEFT JOIN tasks`` by six project columns. Catalyst would aggregate *after* the join,
shuffling every task row together with the project columns. Because ``projects.Id`` is a key, the same result comes
from aggregating tasks by ``ProyectoId`` first (partial/final aggregation, map-side combine, so a project holding a
third of all tasks collapses to one row per map task) and joining one row per project afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workboard.functions.display import date_range_text, round_half_up

PROJECT_COLS = ["Id", "Nombre", "Responsable", "Estado", "FechaInicio", "FechaFin"]


def task_stats(tasks: DataFrame) -> DataFrame:
    """Per-project task aggregates: count, milestones, mean progress of non-milestones, date span."""
    return tasks.groupBy(F.col("ProyectoId")).agg(
        F.count(F.lit(1)).alias("Tareas"),
        F.sum(F.when(F.col("EsHito"), 1).otherwise(0)).cast("bigint").alias("Hitos"),
        F.avg(F.when(~F.col("EsHito"), F.col("Progreso").cast("double"))).alias("Avance"),
        F.min("FechaInicio").alias("TareaMin"),
        F.max("FechaFin").alias("TareaMax"),
    )


def project_rollup(projects: DataFrame, tasks: DataFrame, with_cards: bool = True) -> DataFrame:
    """A1: one row per project with its task roll-up; projects without tasks get 0 counts and null averages.

    ``with_cards`` adds the page's card expressions: H18 start/end fallback to the task span, H17 rounded percent,
    H20 range text.
    """
    stats = task_stats(tasks)
    p = projects.select(*PROJECT_COLS)
    out = p.join(stats, p["Id"] == stats["ProyectoId"], "left").select(
        *[p[c] for c in PROJECT_COLS],
        F.coalesce(stats["Tareas"], F.lit(0)).cast("bigint").alias("Tareas"),
        F.coalesce(stats["Hitos"], F.lit(0)).cast("bigint").alias("Hitos"),
        stats["Avance"], stats["TareaMin"], stats["TareaMax"],
    )
    if with_cards:
        ini = F.coalesce(F.col("FechaInicio"), F.col("TareaMin"))
        fin = F.coalesce(F.col("FechaFin"), F.col("TareaMax"))
        out = out.withColumns({
            "Inicio": ini,
            "Fin": fin,
            "AvancePct": round_half_up(F.coalesce(F.col("Avance"), F.lit(0.0))),
            "Rango": date_range_text(ini, fin),
        })
    return out


def portfolio_kpis(rollup: DataFrame) -> DataFrame:
    """A2: one row — project count, active count, rounded mean progress (null counts 0; 0 when empty),
    total tasks, total milestones. A global aggregate: partial sums per partition, one tiny final merge."""
    n = F.count(F.lit(1))
    return rollup.agg(
        n.alias("Proyectos"),
        F.count_if(F.col("Estado") == "Activo").alias("Activos"),
        F.coalesce(round_half_up(F.sum(F.coalesce(F.col("Avance"), F.lit(0.0))) / F.nullif(n, F.lit(0))),
                   F.lit(0)).cast("bigint").alias("AvancePromedio"),
        F.coalesce(F.sum("Tareas"), F.lit(0)).cast("bigint").alias("Tareas"),
        F.coalesce(F.sum("Hitos"), F.lit(0)).cast("bigint").alias("Hitos"),
    )


def project_list(projects: DataFrame) -> DataFrame:
    """P5/T5: the project list (8 columns) ordered by name, then id."""
    return projects.select("Id", "Nombre", "Descripcion", "Responsable", "FechaInicio", "FechaFin", "Estado",
                           "FechaRegistro").orderBy("Nombre", "Id")


def active(projects: DataFrame) -> DataFrame:
    """Projects whose state is ``Activo``."""
    return projects.filter(F.col("Estado") == "Activo")
