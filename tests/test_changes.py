import datetime as dt

from pyspark.sql import functions as F

from seeds import seed_frames
from workboard import schemas
from workboard.operators import audit, changes

NOW = dt.datetime(2026, 9, 1, 12, 0)
D = dt.date


def _erp(i, estado="Nuevo", resp="ana", fecha=None):
    return (i, dt.datetime(2026, 1, 1), f"T{i}", "s", "a", None, None, None, "No", None, None, estado, resp, fecha,
            None, "{}", None)


def test_tracking_patch_policies(spark):
    target = spark.createDataFrame([_erp(1), _erp(2), _erp(3, fecha=D(2026, 1, 5))], schemas.REQUESTS_ERP)
    batch = spark.createDataFrame([
        (1, 1, None, None, None),                     # null estado keeps, null responsable clears
        (2, 2, "En curso", "luis", D(2026, 2, 1)),
        (2, 3, None, "eva", None),                    # two patches to one key: estado from the earlier one
        (9, 4, "Cerrado", "x", None),                 # unknown id
    ], "Id bigint, seq bigint, Estado string, Responsable string, FechaEntrega date")
    out = {r["Id"]: r for r in changes.apply_patch(target, batch, changes.TRACKING_POLICY, as_of=NOW).collect()}
    assert (out[1]["Estado"], out[1]["Responsable"], out[1]["FechaActualizacion"]) == ("Nuevo", None, NOW)
    assert (out[2]["Estado"], out[2]["Responsable"], out[2]["FechaEntrega"]) == ("En curso", "eva", None)
    assert (out[3]["Estado"], out[3]["Responsable"], out[3]["FechaEntrega"], out[3]["FechaActualizacion"]) == \
        ("Nuevo", "ana", D(2026, 1, 5), None)
    assert len(out) == 3
    oc = {r["outcome"]: r["Filas"] for r in changes.outcome_counts(changes.outcomes(target, batch)).collect()}
    assert oc == {"updated": 2, "not_found": 1}


def _rel(i, tipo, sid, titulo, estado):
    return (i, tipo, sid, titulo, None, None, None, None, None, estado, None, None, False, False, False, False,
            None, None, None, None, None, None, None)


def _chg(tipo, sid, seq, titulo, estado, gate=True):
    return (tipo, sid, seq, titulo, None, None, None, None, None, estado, None, gate, False, False, False, None, None,
            None, None, None, None, None)


CHG_DDL = ("Tipo string, SolicitudId bigint, seq bigint, Titulo string, FechaPlanificada date, "
           "VentanaInicio timestamp_ntz, VentanaFin timestamp_ntz, Responsable string, Aprobador string, "
           "Estado string, PlanRollback string, DocArquitectura boolean, DocFuncional boolean, DocSoporte boolean, "
           "Induccion boolean, DocArquitecturaFecha date, DocFuncionalFecha date, DocSoporteFecha date, "
           "InduccionFecha date, ReceptorDocumentacion string, ReceptorInduccion string, "
           "ContrapartePlanificacion string")


def test_upsert(spark):
    target = spark.createDataFrame([_rel(1, "infra", 10, "viejo", "Aprobado"), _rel(5, "erp", 10, "otro", "En curso")],
                                   schemas.RELEASES)
    batch = spark.createDataFrame([
        _chg("infra", 10, 1, "nuevo", "Planificado"),
        _chg("gen", 7, 2, "a", "Planificado"), _chg("gen", 7, 3, "b", "Rollback"),  # same key twice: last wins
        _chg("erp", 3, 4, "c", "Planificado"),
    ], CHG_DDL)
    out = {(r["Tipo"], r["SolicitudId"]): r for r in changes.upsert(target, batch, as_of=NOW).collect()}
    assert (out[("infra", 10)]["Id"], out[("infra", 10)]["Titulo"], out[("infra", 10)]["FechaActualizacion"]) == \
        (1, "nuevo", NOW)
    assert out[("erp", 10)]["Titulo"] == "otro" and out[("erp", 10)]["FechaActualizacion"] is None
    # inserts get contiguous ids after the largest id, in key order
    assert (out[("erp", 3)]["Id"], out[("gen", 7)]["Id"]) == (6, 7)
    assert (out[("gen", 7)]["Titulo"], out[("gen", 7)]["Estado"]) == ("b", "Rollback")
    # idempotent with a fixed as_of
    again = changes.upsert(changes.upsert(target, batch, as_of=NOW), batch, as_of=NOW)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, changes.upsert(target, batch, as_of=NOW).collect()))


def test_deletes(spark):
    projects, tasks = seed_frames(spark)
    p2, t2 = changes.cascade_delete(projects, tasks, spark.createDataFrame([(1,), (77,)], "Id bigint"))
    assert [r["Id"] for r in p2.collect()] == [2] and t2.count() == 18
    assert audit.referential_audit(p2, t2, spark.createDataFrame([], "Tipo string, " + schemas.REQUESTS_ERP),
                                   spark.createDataFrame([], schemas.NOTES),
                                   spark.createDataFrame([], schemas.ATTACHMENTS),
                                   spark.createDataFrame([], schemas.RELEASES)).count() == 0
    phase_b = tasks.where((F.col("ProyectoId") == 2) & F.col("TareaPadreId").isNull()).orderBy("Id").first()["Id"]
    leaf = tasks.where(F.col("TareaPadreId") == phase_b).orderBy("Id").first()["Id"]
    left, out = changes.delete_tasks_checked(tasks, spark.createDataFrame([(phase_b,), (leaf,), (-1,)], "Id bigint"))
    assert {r["Id"]: r["outcome"] for r in out.collect()} == {phase_b: "blocked", leaf: "deleted", -1: "missing"}
    assert left.count() == 22
    kept = changes.delete_keys(tasks, spark.createDataFrame([(leaf,), (999,)], "Id bigint"))
    assert kept.count() == 22


def test_changes_without_order_or_key_are_rejected_and_ties_have_one_winner(spark):
    ddl = "Id bigint, seq bigint, Estado string, Responsable string, FechaEntrega date"
    rows = [(1, 5, "A", "x", None), (1, 5, "B", "y", None), (1, None, "C", "z", None), (None, 9, "D", "w", None)]
    batch = spark.createDataFrame(rows, ddl)
    usable, rejects = changes.split_changes(batch, ["Id"])
    assert usable.count() == 2 and {r["Motivo"] for r in rejects.collect()} == {"sin_orden", "sin_clave"}
    target = spark.createDataFrame([_erp(1)], schemas.REQUESTS_ERP)
    one = changes.apply_patch(target, batch, changes.TRACKING_POLICY, as_of=NOW).collect()
    # all columns come from one change, whatever the order of the rows
    assert len(one) == 1 and (one[0]["Estado"], one[0]["Responsable"]) in {("A", "x"), ("B", "y")}
    again = changes.apply_patch(target, batch.orderBy(F.col("Estado").desc()), changes.TRACKING_POLICY, as_of=NOW).first()
    assert again["Estado"] == one[0]["Estado"]
    tied = spark.createDataFrame([_chg("gen", 7, 3, "a", "Rollback"), _chg("gen", 7, 3, "b", "Aprobado"),
                                  _chg("erp", 8, None, "c", "Aprobado")], CHG_DDL)
    assert [(r["Tipo"], r["SolicitudId"]) for r in changes.upsert(spark.createDataFrame([], schemas.RELEASES), tied,
                                                                  as_of=NOW).collect()] == [("gen", 7)]


def test_patch_hot_key_batch(spark):
    # a third of the batch hits one key: collapse keeps the last value per column
    target = spark.createDataFrame([_erp(i) for i in range(1, 4)], schemas.REQUESTS_ERP)
    rows = [(1, s, None if s % 2 else f"E{s}", f"R{s}", None) for s in range(300)] + \
           [(2 + s % 2, 300 + s, "X", None, None) for s in range(600)]
    batch = spark.createDataFrame(rows, "Id bigint, seq bigint, Estado string, Responsable string, FechaEntrega date")
    out = {r["Id"]: r for r in changes.apply_patch(target, batch, changes.TRACKING_POLICY, as_of=NOW).collect()}
    assert (out[1]["Estado"], out[1]["Responsable"]) == ("E298", "R299")
    assert (out[2]["Estado"], out[2]["Responsable"]) == ("X", None)
