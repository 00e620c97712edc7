import datetime as dt

from pyspark.sql import functions as F

from seeds import seed_frames
from workboard import schemas
from workboard.operators import audit, portfolio

D = dt.date.fromisoformat


def test_seed_rollup_goldens(spark):
    projects, tasks = seed_frames(spark)
    r = {row["Id"]: row for row in portfolio.project_rollup(projects, tasks).collect()}
    a, b = r[1], r[2]
    assert (a["Tareas"], a["Hitos"], a["Avance"], a["TareaMin"], a["TareaMax"]) == \
        (5, 0, 0.0, D("2027-03-01"), D("2027-03-12"))
    assert (b["Tareas"], b["Hitos"], b["Avance"], b["TareaMin"], b["TareaMax"]) == \
        (18, 0, 0.0, D("2027-04-05"), D("2027-04-22"))


def test_seed_kpis_golden(spark):
    projects, tasks = seed_frames(spark)
    k = portfolio.portfolio_kpis(portfolio.project_rollup(projects, tasks)).first().asDict()
    assert k == {"Proyectos": 2, "Activos": 2, "AvancePromedio": 0, "Tareas": 23, "Hitos": 0}


def test_seed_plan_audit_has_no_findings(spark):
    _, tasks = seed_frames(spark)
    assert audit.plan_audit(tasks).where(F.col("Regla") != "fin_de_semana").count() == 0
    assert audit.plan_audit(tasks).count() == 0  # the seeds use working days only


def _project(i, estado="Activo", ini=None, fin=None):
    return (i, f"P{i}", None, None, ini, fin, estado, dt.datetime(2026, 1, 1))


def _task(i, pid, prog, hito=False, ini=None, fin=None):
    return (i, pid, f"T{i}", ini, fin, prog, None, None, hito, None, None, None)


def test_rollup_hand_rows(spark):
    projects = spark.createDataFrame([_project(1), _project(2), _project(3), _project(4, ini=D("2026-01-05"))],
                                     schemas.PROJECTS)
    tasks = spark.createDataFrame([
        _task(10, 2, 50, hito=True), _task(11, 2, None, hito=True),              # only milestones
        _task(20, 3, None), _task(21, 3, 40, ini=D("2026-02-01"), fin=D("2026-02-03")),  # null progress
        _task(30, 4, 10, ini=D("2026-03-01")),
    ], schemas.TASKS)
    r = {row["Id"]: row for row in portfolio.project_rollup(projects, tasks).collect()}
    assert (r[1]["Tareas"], r[1]["Hitos"], r[1]["Avance"], r[1]["AvancePct"]) == (0, 0, None, 0)
    assert (r[2]["Tareas"], r[2]["Hitos"], r[2]["Avance"]) == (2, 2, None)
    assert (r[3]["Tareas"], r[3]["Avance"], r[3]["Inicio"], r[3]["Fin"]) == (2, 40.0, D("2026-02-01"),
                                                                             D("2026-02-03"))
    assert r[4]["Inicio"] == D("2026-01-05") and r[4]["Fin"] is None and r[4]["Rango"] == "2026-01-05 → —"


def test_kpis_empty_and_half_rounding(spark):
    empty = portfolio.project_rollup(spark.createDataFrame([], schemas.PROJECTS),
                                     spark.createDataFrame([], schemas.TASKS))
    assert portfolio.portfolio_kpis(empty).first().asDict() == \
        {"Proyectos": 0, "Activos": 0, "AvancePromedio": 0, "Tareas": 0, "Hitos": 0}
    projects = spark.createDataFrame([_project(1), _project(2, estado="En pausa")], schemas.PROJECTS)
    tasks = spark.createDataFrame([_task(1, 1, 51)], schemas.TASKS)  # averages 51 and null(→0): 25.5 → 26
    k = portfolio.portfolio_kpis(portfolio.project_rollup(projects, tasks)).first()
    assert (k["AvancePromedio"], k["Activos"]) == (26, 1)


def test_rollup_aggregates_before_join(spark):
    projects, tasks = seed_frames(spark)
    plan = portfolio.project_rollup(projects, tasks)._jdf.queryExecution().optimizedPlan().toString()
    # the task aggregate sits below the join: the join sees one row per project
    assert plan.index("Join") < plan.index("Aggregate")
