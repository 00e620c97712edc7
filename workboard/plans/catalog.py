"""Registered queries over the driver's test tables and their DuckDB oracles.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs an operator over whole tables; ``ORACLES[name]`` is the same
result written as DuckDB SQL over the pre-registered views. Column names and types agree between the two.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from workboard.operators import portfolio, releases, search
from workboard.plans import roles

# Fixed "now" for operators that stamp or compare against the current time (keeps results reproducible).
AS_OF = dt.datetime(1998, 6, 1, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '1998-06-01 00:00:00'"

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ A1 J1 H17 H18 H20: project roll-up

_ROLLUP_SQL = f"""
WITH p AS ({roles.PROJECTS.sql}), t AS ({roles.TASKS.sql}),
r AS (
  SELECT p.Id, p.Nombre, p.Responsable, p.Estado, p.FechaInicio, p.FechaFin,
         COUNT(t.Id) AS Tareas, CAST(SUM(CASE WHEN t.EsHito THEN 1 ELSE 0 END) AS BIGINT) AS Hitos,
         AVG(CASE WHEN NOT t.EsHito THEN CAST(t.Progreso AS DOUBLE) END) AS Avance,
         MIN(t.FechaInicio) AS TareaMin, MAX(t.FechaFin) AS TareaMax
  FROM p LEFT JOIN t ON t.ProyectoId = p.Id
  GROUP BY p.Id, p.Nombre, p.Responsable, p.Estado, p.FechaInicio, p.FechaFin)
"""

ORACLE_PROJECT_ROLLUP = _ROLLUP_SQL + """
SELECT *, COALESCE(FechaInicio, TareaMin) AS Inicio, COALESCE(FechaFin, TareaMax) AS Fin,
       CAST(floor(COALESCE(Avance, 0) + 0.5) AS BIGINT) AS AvancePct,
       COALESCE(strftime(COALESCE(FechaInicio, TareaMin), '%Y-%m-%d'), '—') || ' → ' ||
       COALESCE(strftime(COALESCE(FechaFin, TareaMax), '%Y-%m-%d'), '—') AS Rango
FROM r
"""


@register("project_rollup", ORACLE_PROJECT_ROLLUP)
def q_project_rollup(spark, sf_dir):
    return portfolio.project_rollup(roles.PROJECTS.df(spark, sf_dir), roles.TASKS.df(spark, sf_dir))


ORACLE_PORTFOLIO_KPIS = _ROLLUP_SQL + """
SELECT COUNT(*) AS Proyectos, COUNT(*) FILTER (WHERE Estado = 'Activo') AS Activos,
       COALESCE(CAST(floor(SUM(COALESCE(Avance, 0)) / NULLIF(COUNT(*), 0) + 0.5) AS BIGINT), 0) AS AvancePromedio,
       COALESCE(CAST(SUM(Tareas) AS BIGINT), 0) AS Tareas, COALESCE(CAST(SUM(Hitos) AS BIGINT), 0) AS Hitos
FROM r
"""


@register("portfolio_kpis", ORACLE_PORTFOLIO_KPIS)
def q_portfolio_kpis(spark, sf_dir):
    rollup = portfolio.project_rollup(roles.PROJECTS.df(spark, sf_dir), roles.TASKS.df(spark, sf_dir), with_cards=False)
    return portfolio.portfolio_kpis(rollup)


# ------------------------------------------------------------------ P1 P9 P10 T1: request lists

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _search_sql(kind: str, estado=None, q=None, pid=None, limit=search.LIST_LIMIT) -> str:
    role = roles.REQUESTS[kind]
    where = ["TRUE"]
    if estado:
        where.append(f"Estado = {_q(estado)}")
    if pid is not None:
        where.append(f"ProyectoId = {pid}")
    if q:
        where.append("(" + " OR ".join(f"{c} ILIKE {_q('%' + q + '%')}" for c in search.SEARCH_COLS[kind]) + ")")
    cols = ", ".join(search.LIST_COLS[kind])
    return (f"WITH r AS ({role.sql}) SELECT {cols} FROM r WHERE {' AND '.join(where)} "
            f"ORDER BY Id DESC" + (f" LIMIT {limit}" if limit else ""))


@register("request_search", _search_sql("infra", estado="Nuevo", q="CLI"))
def q_request_search(spark, sf_dir):
    return search.list_requests(roles.REQUESTS_INFRA.df(spark, sf_dir), "infra", estado="Nuevo", q="CLI",
                                limit=search.LIST_LIMIT)


@register("request_search_all", _search_sql("infra", estado="Nuevo", q="CLI", limit=None))
def q_request_search_all(spark, sf_dir):
    return search.list_requests(roles.REQUESTS_INFRA.df(spark, sf_dir), "infra", estado="Nuevo", q="CLI", limit=None)


@register("request_search_project", _search_sql("erp", pid=7))
def q_request_search_project(spark, sf_dir):
    return search.list_requests(roles.REQUESTS_ERP.df(spark, sf_dir), "erp", proyecto_id="7",
                                limit=search.LIST_LIMIT)


@register("request_search_general", _search_sql("gen", estado="En curso", q="operac"))
def q_request_search_general(spark, sf_dir):
    return search.list_requests(roles.REQUESTS_GENERAL.df(spark, sf_dir), "gen", estado="En curso", q="operac",
                                limit=search.LIST_LIMIT)


PART_REQUESTS = roles.Role("part", (
    ("Id", "p_partkey"),
    ("FechaRegistro", "TIMESTAMP_NTZ '2024-03-01 00:00:00'"),
    ("Titulo", "p_name"),
    ("Solicitante", "p_brand"),
    ("Area", "p_type"),
    ("Ambito", "CASE WHEN p_size > 25 THEN 'Grande' END"),
    ("Prioridad", "CASE WHEN p_retailprice > 1500 THEN 'Alta' ELSE 'Media' END"),
    ("Estado", "'Nuevo'"),
    ("Responsable", "CAST(NULL AS STRING)"),
    ("FechaEntrega", "CAST(NULL AS DATE)"),
    ("FechaActualizacion", "CAST(NULL AS TIMESTAMP_NTZ)"),
))


@register("request_search_multi",
          f"WITH r AS ({PART_REQUESTS.sql}) SELECT {', '.join(search.GENERAL_LIST)} FROM r "
          "WHERE (Titulo ILIKE '%RED%' OR Solicitante ILIKE '%RED%' OR Area ILIKE '%RED%' OR Ambito ILIKE '%RED%') "
          "ORDER BY Id DESC LIMIT 20")
def q_request_search_multi(spark, sf_dir):
    return search.list_requests(PART_REQUESTS.df(spark, sf_dir), "gen", q="RED", limit=20)


# ------------------------------------------------------------------ P7: rows by id (bulk)

@register("request_by_keys",
          f"WITH r AS ({roles.REQUESTS_INFRA.sql}) SELECT * FROM r "
          "WHERE Id IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL AND c_custkey <> 0)")
def q_request_by_keys(spark, sf_dir):
    ids = roles.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Id"))
    return search.by_ids(roles.REQUESTS_INFRA.df(spark, sf_dir), ids)


# ------------------------------------------------------------------ R1: unified request feed

_FEED_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS Tipo, {', '.join(search.FEED_COLS)} FROM ({roles.REQUESTS[k].sql})"
    for k in ("infra", "erp", "gen"))


@register("request_feed", _FEED_SQL)
def q_request_feed(spark, sf_dir):
    return _feed(spark, sf_dir)


def _feed(spark, sf_dir):
    return search.request_feed(*(roles.REQUESTS[k].df(spark, sf_dir) for k in ("infra", "erp", "gen")))


# ------------------------------------------------------------------ P13 T3: task lists of active projects

@register("task_list",
          f"WITH t AS ({roles.TASKS.sql}), p AS ({roles.PROJECTS.sql}) "
          f"SELECT {', '.join(search.TASK_LIST)} FROM t WHERE ProyectoId IN (SELECT Id FROM p WHERE Estado = 'Activo')")
def q_task_list(spark, sf_dir):
    return search.tasks_of_projects(roles.TASKS.df(spark, sf_dir),
                                    portfolio.active(roles.PROJECTS.df(spark, sf_dir)))


# ------------------------------------------------------------------ P11 T4: notes of existing requests

@register("notes_for_request",
          f"WITH n AS ({roles.NOTES.sql}), f AS ({_FEED_SQL}) "
          f"SELECT {', '.join(search.NOTE_LIST)} FROM n "
          "WHERE EXISTS (SELECT 1 FROM f WHERE f.Tipo = n.Tipo AND f.Id = n.SolicitudId AND f.Id <> 0)")
def q_notes_for_request(spark, sf_dir):
    keys = _feed(spark, sf_dir).select("Tipo", F.col("Id").alias("SolicitudId"))
    return search.notes_list(roles.NOTES.df(spark, sf_dir), keys)


# ------------------------------------------------------------------ release board, counts, totals

_GATES_SQL = ("(CAST(COALESCE(DocArquitectura, FALSE) AS INT) + CAST(COALESCE(DocFuncional, FALSE) AS INT) + "
              "CAST(COALESCE(DocSoporte, FALSE) AS INT) + CAST(COALESCE(Induccion, FALSE) AS INT))")
_DAYS_SQL = "CAST(date_diff('day', CAST(DATE '1998-06-01' AS DATE), FechaPlanificada) AS INTEGER)"

ORACLE_RELEASE_BOARD = f"""
WITH r AS ({roles.RELEASES.sql})
SELECT {', '.join(search.RELEASE_LIST)},
  COALESCE(NULLIF(Titulo, ''), '#' || CAST(SolicitudId AS VARCHAR)) AS TituloTexto,
  COALESCE(CASE Tipo WHEN 'infra' THEN 'Infraestructura' WHEN 'erp' THEN 'ERP' WHEN 'gen' THEN 'General' END, Tipo)
    AS TipoTexto,
  COALESCE(strftime(FechaPlanificada, '%Y-%m-%d'), '—') AS FechaTexto,
  COALESCE(NULLIF((CASE WHEN VentanaInicio IS NOT NULL THEN strftime(VentanaInicio, '%Y-%m-%d %H:%M') ELSE '' END) ||
    (CASE WHEN VentanaFin IS NOT NULL THEN ' → ' || strftime(VentanaFin, '%Y-%m-%d %H:%M') ELSE '' END), ''), '—')
    AS VentanaTexto,
  COALESCE(NULLIF(Responsable, ''), '—') AS ResponsableTexto,
  {_GATES_SQL} AS Entregables,
  {_GATES_SQL} >= 4 AS EntregablesCompletos,
  {_DAYS_SQL} AS DiasRestantes,
  COALESCE({_DAYS_SQL} BETWEEN 0 AND 7, FALSE) AND NOT (Estado IS NOT DISTINCT FROM 'Completado') AS Pronto
FROM r
"""


def _position(name: str, order: list, order_sql: str):
    """Register ``<name>_order``: the rows of a listed query with their position, checked against a full sort."""
    fn = QUERIES[name]

    @register(f"{name}_order", f"SELECT *, row_number() OVER (ORDER BY {order_sql}) AS Posicion FROM ({ORACLES[name]}) q")
    def ordered(spark, sf_dir):
        return tables.with_position(fn(spark, sf_dir), order())


@register("release_board", ORACLE_RELEASE_BOARD)
def q_release_board(spark, sf_dir):
    return releases.board(roles.RELEASES.df(spark, sf_dir), AS_OF)


@register("release_status_counts", f"""
WITH r AS ({roles.RELEASES.sql}), c AS (SELECT Estado, COUNT(*) AS Cantidad FROM r GROUP BY Estado),
d AS (SELECT * FROM (VALUES ('Planificado', 0), ('Aprobado', 1), ('En curso', 2), ('Completado', 3),
                            ('Rollback', 4)) t(Estado, Orden))
SELECT COALESCE(d.Estado, c.Estado) AS Estado, CAST(COALESCE(c.Cantidad, 0) AS BIGINT) AS Cantidad,
       d.Estado IS NOT NULL AS Canonico, CAST(d.Orden AS INTEGER) AS Orden
FROM c FULL OUTER JOIN d ON c.Estado IS NOT DISTINCT FROM d.Estado
""")
def q_release_status_counts(spark, sf_dir):
    return releases.status_counts(roles.RELEASES.df(spark, sf_dir))


@register("release_totals", f"""
WITH r AS ({roles.RELEASES.sql})
SELECT COUNT(*) AS Total, COUNT(*) FILTER (WHERE {_GATES_SQL} >= 4) AS Listos,
  COUNT(*) FILTER (WHERE COALESCE(DocArquitectura, FALSE)) AS DocArquitectura,
  COUNT(*) FILTER (WHERE COALESCE(DocFuncional, FALSE)) AS DocFuncional,
  COUNT(*) FILTER (WHERE COALESCE(DocSoporte, FALSE)) AS DocSoporte,
  COUNT(*) FILTER (WHERE COALESCE(Induccion, FALSE)) AS Induccion
FROM r
""")
def q_release_totals(spark, sf_dir):
    return releases.totals(roles.RELEASES.df(spark, sf_dir))


# ------------------------------------------------------------------ U1 R3 A6: tracking patch batch

from dataclasses import replace  # noqa: E402

from workboard.functions import coerce  # noqa: E402
from workboard.operators import changes, intake  # noqa: E402

# Raw PATCH bodies derived from click events: several patches per key, unknown ids, null estado (keeps),
# null responsable (clears). Dates arrive as ISO text and go through the date coercion.
TRACKING_CHANGES = roles.Role("events", (
    ("id", "CAST(floor(value * 25) AS BIGINT)"),
    ("seq", "event_id"),
    ("estado", "CASE WHEN user_id % 3 = 0 THEN CAST(NULL AS STRING) WHEN user_id % 3 = 1 THEN ' En curso ' "
               "ELSE 'Cerrado' END"),
    ("responsable", "CASE WHEN value > 100 THEN 'agent' || CAST(user_id AS STRING) END"),
    ("fechaEntrega", "CASE WHEN value > 50 THEN CAST(CAST(ts AS DATE) + 10 AS STRING) END"),
), where="event_type = 'click'")


def normalise_tracking(raw):
    """Raw tracking PATCH bodies as JSON text through the library's normaliser; rejects stay out."""
    bodies = raw.select("id", "seq", F.to_json(F.struct("estado", "responsable", "fechaEntrega")).alias("body"))
    return intake.tracking_changes(bodies).where("Motivo IS NULL").drop("Motivo")


_TRACK_NORM_SQL = (f"SELECT id AS Id, seq, trim(estado) AS Estado, responsable AS Responsable, "
                   f"CAST(fechaEntrega AS DATE) AS FechaEntrega FROM ({TRACKING_CHANGES.sql}) WHERE id <> 0")


def _patch_sql(target_sql: str, changes_sql: str, policy: dict, cols: list[str], stamp: str | None) -> str:
    aggs = []
    for c, p in policy.items():
        if p == changes.KEEP_IF_NULL:
            aggs.append(f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}")
        else:
            aggs.append(f"arg_max_null({c}, seq) AS {c}")
    sel = []
    for c in cols:
        if c in policy:
            v = f"COALESCE(a.{c}, t.{c})" if policy[c] == changes.KEEP_IF_NULL else f"a.{c}"
            sel.append(f"CASE WHEN a.Id IS NOT NULL THEN {v} ELSE t.{c} END AS {c}")
        elif c == stamp:
            sel.append(f"CASE WHEN a.Id IS NOT NULL THEN {AS_OF_SQL} ELSE t.{c} END AS {c}")
        else:
            sel.append(f"t.{c}")
    return (f"WITH t AS ({target_sql}), c AS ({changes_sql}), "
            f"a AS (SELECT Id, {', '.join(aggs)} FROM c GROUP BY Id) "
            f"SELECT {', '.join(sel)} FROM t LEFT JOIN a ON a.Id = t.Id")


@register("tracking_patch", _patch_sql(roles.REQUESTS_ERP.sql, _TRACK_NORM_SQL, changes.TRACKING_POLICY,
                                       roles.REQUESTS_ERP.names(), "FechaActualizacion"))
def q_tracking_patch(spark, sf_dir):
    target = roles.REQUESTS_ERP.df(spark, sf_dir)
    batch = normalise_tracking(TRACKING_CHANGES.df(spark, sf_dir))
    return changes.apply_patch(target, batch, changes.TRACKING_POLICY, as_of=AS_OF)


def _register_tracking(kind: str):
    role = roles.REQUESTS[kind]

    @register(f"tracking_patch_{kind}", _patch_sql(role.sql, _TRACK_NORM_SQL, changes.TRACKING_POLICY, role.names(),
                                                   "FechaActualizacion"))
    def q_tracking_patch_of(spark, sf_dir):
        batch = normalise_tracking(TRACKING_CHANGES.df(spark, sf_dir))
        return changes.apply_patch(role.df(spark, sf_dir), batch, changes.TRACKING_POLICY, as_of=AS_OF)


for _kind in ("infra", "gen"):
    _register_tracking(_kind)


@register("tracking_patch_outcomes", f"""
WITH t AS ({roles.REQUESTS_ERP.sql}), c AS ({_TRACK_NORM_SQL}),
o AS (SELECT DISTINCT Id, CASE WHEN Id IN (SELECT Id FROM t) THEN 'updated' ELSE 'not_found' END AS outcome FROM c)
SELECT outcome, COUNT(*) AS Filas FROM o GROUP BY outcome
""")
def q_tracking_patch_outcomes(spark, sf_dir):
    target = roles.REQUESTS_ERP.df(spark, sf_dir)
    batch = normalise_tracking(TRACKING_CHANGES.df(spark, sf_dir))
    return changes.outcome_counts(changes.outcomes(target, batch))


# ------------------------------------------------------------------ U2: project patch batch

PROJECT_CHANGES = roles.Role("lineitem", (
    ("Id", "CASE WHEN l_linenumber = 7 THEN l_orderkey + 1000000 ELSE l_orderkey END"),
    ("seq", roles.TASK_KEY),
    ("Nombre", "CASE WHEN l_linenumber = 1 THEN 'Proyecto ' || CAST(l_orderkey AS STRING) END"),
    ("Descripcion", "'Lote ' || CAST(l_linenumber AS STRING)"),
    ("Responsable", "CASE WHEN l_linestatus = 'O' THEN 'Supplier#' || CAST(l_suppkey AS STRING) END"),
    ("FechaInicio", "CAST(l_shipdate AS DATE)"),
    ("FechaFin", "CASE WHEN l_linenumber > 2 THEN CAST(l_shipdate AS DATE) + 30 END"),
    ("Estado", "CASE WHEN l_returnflag = 'R' THEN 'En pausa' END"),
), where="l_returnflag <> 'N'")


@register("project_patch", _patch_sql(roles.PROJECTS.sql, PROJECT_CHANGES.sql, changes.PROJECT_POLICY,
                                      roles.PROJECTS.names(), None))
def q_project_patch(spark, sf_dir):
    return changes.apply_patch(roles.PROJECTS.df(spark, sf_dir), PROJECT_CHANGES.df(spark, sf_dir),
                               changes.PROJECT_POLICY, stamp_col=None)


# ------------------------------------------------------------------ U3: task patch batch (progress clamped)

_TASK_PATCH_COLS = (
    ("Nombre", "CASE WHEN l_linestatus = 'F' THEN 'Tarea ' || CAST(l_linenumber AS STRING) END"),
    ("FechaInicio", "CAST(l_shipdate AS DATE) + 1"),
    ("FechaFin", "CAST(l_shipdate AS DATE) + 5"),
    ("progreso_txt", "CAST(CAST(l_quantity * 3 - 20 AS BIGINT) AS STRING)"),
    ("Responsable", "CAST(NULL AS STRING)"),
    ("DependenciaId", "CAST(NULL AS STRING)"),
    ("TareaPadreId", "CAST(NULL AS STRING)"),
    ("EsHito", "l_quantity > 45"),
    ("Orden", "l_linenumber + 10"),
)
TASK_CHANGES_A = roles.Role("lineitem", (("Id", roles.TASK_KEY), ("seq", f"{roles.TASK_KEY} || '-0'"))
                            + _TASK_PATCH_COLS, where="l_returnflag = 'N'")
TASK_CHANGES_B = roles.Role("lineitem", (("Id", roles.TASK_KEY), ("seq", f"{roles.TASK_KEY} || '-1'"))
                            + tuple((n, "CAST(NULL AS STRING)" if n in ("Nombre", "progreso_txt") else e)
                                    for n, e in _TASK_PATCH_COLS), where="l_linestatus = 'O' AND l_quantity < 10")


def _task_batch(spark, sf_dir):
    raw = TASK_CHANGES_A.df(spark, sf_dir).unionByName(TASK_CHANGES_B.df(spark, sf_dir))
    return raw.withColumn("Progreso", coerce.clamp_progress("progreso_txt")).drop("progreso_txt")


_TASK_BATCH_SQL = (f"SELECT * EXCLUDE (progreso_txt), CASE WHEN progreso_txt IS NOT NULL THEN "
                   f"GREATEST(0, LEAST(100, CAST(progreso_txt AS INTEGER))) END AS Progreso FROM "
                   f"({TASK_CHANGES_A.sql} UNION ALL {TASK_CHANGES_B.sql})")


@register("task_patch", _patch_sql(roles.TASKS.sql, _TASK_BATCH_SQL, changes.TASK_POLICY, roles.TASKS.names(),
                                   "FechaActualizacion"))
def q_task_patch(spark, sf_dir):
    return changes.apply_patch(roles.TASKS.df(spark, sf_dir), _task_batch(spark, sf_dir), changes.TASK_POLICY,
                               as_of=AS_OF)


# ------------------------------------------------------------------ U4 J2 S4: release upsert

RELEASE_TARGET = roles.RELEASES

RELEASE_CHANGES = roles.Role("lineitem", (
    ("Tipo", "CASE WHEN l_linenumber = 7 THEN 'otro' WHEN l_linestatus = 'O' THEN 'infra' ELSE 'erp' END"),
    ("SolicitudId", "l_orderkey"),
    ("seq", roles.TASK_KEY),
    ("Titulo", "'Pase ' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING)"),
    ("FechaPlanificada", "CAST(l_shipdate AS DATE)"),
    ("VentanaInicio", "CAST(l_shipdate AS TIMESTAMP_NTZ) + INTERVAL 22 HOUR"),
    ("VentanaFin", "CASE WHEN l_tax > 0.04 THEN CAST(l_shipdate AS TIMESTAMP_NTZ) + INTERVAL 26 HOUR END"),
    ("Responsable", "'Supplier#' || CAST(l_suppkey AS STRING)"),
    ("Aprobador", "CASE WHEN l_discount > 0.05 THEN 'aprobador' END"),
    ("estado_txt", "CASE WHEN l_returnflag = 'R' THEN 'Rollback' WHEN l_returnflag = 'A' THEN 'Aprobado' ELSE ' ' END"),
    ("PlanRollback", "CAST(NULL AS STRING)"),
    ("DocArquitectura", "l_quantity > 25"),
    ("DocFuncional", "l_discount > 0.02"),
    ("DocSoporte", "l_tax > 0.02"),
    ("Induccion", "l_linenumber < 5"),
    ("DocArquitecturaFecha", "CASE WHEN l_quantity > 25 THEN CAST(l_shipdate AS DATE) END"),
    ("DocFuncionalFecha", "CAST(NULL AS DATE)"),
    ("DocSoporteFecha", "CAST(NULL AS DATE)"),
    ("InduccionFecha", "CAST(NULL AS DATE)"),
    ("ReceptorDocumentacion", "CAST(NULL AS STRING)"),
    ("ReceptorInduccion", "CAST(NULL AS STRING)"),
    ("ContrapartePlanificacion", "CAST(NULL AS STRING)"),
))


def _release_batch(spark, sf_dir):
    """Normalise release upsert bodies: kind must be known (P14), blank state defaults to ``Planificado`` (H7)."""
    raw = RELEASE_CHANGES.df(spark, sf_dir)
    return (raw.where(search.valid_kind() & (F.col("SolicitudId") != 0))  # the rest: release_rejects
            .withColumn("Estado", coerce.default_if_blank("estado_txt", "Planificado", 30)).drop("estado_txt"))


def _upsert_sql() -> str:
    cols = roles.RELEASES.names()
    fields = changes.RELEASE_FIELDS
    upd = []
    for c in cols:
        if c in ("Tipo", "SolicitudId"):
            upd.append(f"t.{c}")
        elif c in fields:
            upd.append(f"CASE WHEN c.Tipo IS NOT NULL THEN c.{c} ELSE t.{c} END AS {c}")
        elif c == "FechaActualizacion":
            upd.append(f"CASE WHEN c.Tipo IS NOT NULL THEN {AS_OF_SQL} ELSE t.{c} END AS {c}")
        else:
            upd.append(f"t.{c}")
    ins = []
    for c in cols:
        if c == "Id":
            ins.append("(SELECT COALESCE(MAX(Id), 0) FROM t) + row_number() OVER (ORDER BY c.Tipo, c.SolicitudId) "
                       "AS Id")
        elif c in ("Tipo", "SolicitudId") or c in fields:
            ins.append(f"c.{c}")
        elif c == "FechaActualizacion":
            ins.append(f"{AS_OF_SQL} AS {c}")
        else:
            ins.append(f"NULL AS {c}")
    return (f"WITH t AS ({RELEASE_TARGET.sql}), "
            f"c0 AS (SELECT * EXCLUDE (estado_txt), COALESCE(NULLIF(trim(estado_txt), ''), 'Planificado') AS Estado "
            f"FROM ({RELEASE_CHANGES.sql}) WHERE Tipo IN ('infra', 'erp', 'gen') AND SolicitudId <> 0), "
            f"c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Tipo, SolicitudId ORDER BY seq DESC) "
            f"AS rn FROM c0) WHERE rn = 1) "
            f"SELECT {', '.join(upd)} FROM t LEFT JOIN c ON c.Tipo = t.Tipo AND c.SolicitudId = t.SolicitudId "
            f"UNION ALL SELECT {', '.join(ins)} FROM c WHERE NOT EXISTS "
            f"(SELECT 1 FROM t WHERE t.Tipo = c.Tipo AND t.SolicitudId = c.SolicitudId)")


@register("release_upsert", _upsert_sql())
def q_release_upsert(spark, sf_dir):
    return changes.upsert(RELEASE_TARGET.df(spark, sf_dir), _release_batch(spark, sf_dir), as_of=AS_OF)


@register("release_rejects", f"""
SELECT Tipo, SolicitudId, seq, 'tipo_o_solicitud' AS Motivo FROM ({RELEASE_CHANGES.sql})
WHERE Tipo NOT IN ('infra', 'erp', 'gen') OR SolicitudId = 0
""")
def q_release_rejects(spark, sf_dir):
    raw = RELEASE_CHANGES.df(spark, sf_dir)
    return raw.where(~(search.valid_kind() & (F.col("SolicitudId") != 0))).select(
        "Tipo", "SolicitudId", "seq", F.lit("tipo_o_solicitud").alias("Motivo"))


# Release bodies as JSON: unknown kinds, a key beyond BIGINT, blank states, gates of every JSON type.
RELEASE_BODIES = roles.Role("orders", (
    ("seq", "o_orderkey"),
    ("estado_caso", "o_orderkey % 3"),
    ("gate_caso", "o_orderkey % 8"),
    ("tipo_caso", "o_orderkey % 5"),
    ("dia", "CAST(CAST(o_orderdate AS DATE) AS STRING)"),
    ("body", "'{\"tipo\":\"' || CASE o_orderkey % 5 WHEN 0 THEN 'infra' WHEN 1 THEN ' erp ' WHEN 2 THEN 'gen' WHEN 3 THEN "
             "'otro' ELSE 'infra' END || '\",\"solicitudId\":' || CASE WHEN o_orderkey % 5 = 4 THEN "
             "'\"99999999999999999999\"' ELSE '\"' || CAST(o_orderkey AS STRING) || 'x\"' END || "
             "',\"titulo\":\" Pase ' || CAST(o_orderkey AS STRING) || ' \",\"estado\":' || CASE o_orderkey % 3 WHEN 0 "
             "THEN '\" \"' WHEN 1 THEN '\"Aprobado\"' ELSE 'null' END || ',\"fechaPlanificada\":\"' || "
             "CAST(CAST(o_orderdate AS DATE) AS STRING) || '\",\"ventanaInicio\":\"' || "
             "CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T22:00:00Z\",\"docArquitectura\":' || "
             "CASE o_orderkey % 8 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN "
             "'\"0\"' WHEN 5 THEN '\"\"' WHEN 6 THEN '[]' ELSE 'null' END || "
             "',\"induccion\":{},\"aprobador\":\"  \",\"docSoporteFecha\":\"2024-02-30\"}'"),
))
_RELEASE_OUT = ["seq", "Tipo", "SolicitudId", *changes.RELEASE_FIELDS, "Motivo"]


def _release_intake_sql() -> str:
    known = {
        "Titulo": "'Pase ' || CAST(seq AS VARCHAR)", "FechaPlanificada": "CAST(dia AS DATE)",
        "VentanaInicio": "CAST(dia AS TIMESTAMP) + INTERVAL 22 HOUR", "VentanaFin": "CAST(NULL AS TIMESTAMP)",
        "Estado": "CASE WHEN estado_caso = 1 THEN 'Aprobado' ELSE 'Planificado' END",
        "DocArquitectura": "gate_caso IN (0, 2, 4, 6)", "DocFuncional": "FALSE", "DocSoporte": "FALSE", "Induccion": "TRUE",
        **{c: "CAST(NULL AS DATE)" for c in ("DocArquitecturaFecha", "DocFuncionalFecha", "DocSoporteFecha", "InduccionFecha")},
    }
    cols = ", ".join(f"{known.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in changes.RELEASE_FIELDS)
    return (f"SELECT seq, CASE tipo_caso WHEN 1 THEN 'erp' WHEN 2 THEN 'gen' WHEN 3 THEN 'otro' ELSE 'infra' END AS Tipo, "
            f"CASE WHEN tipo_caso <> 4 THEN seq END AS SolicitudId, {cols}, "
            f"CASE WHEN tipo_caso = 3 OR seq = 0 THEN 'tipo_o_solicitud' WHEN tipo_caso = 4 THEN 'id_fuera_de_rango' END "
            f"AS Motivo "
            f"FROM ({RELEASE_BODIES.sql})")


@register("release_intake", _release_intake_sql())
def q_release_intake(spark, sf_dir):
    """Every release body with its typed row or its reason: accepted and rejects are the whole input."""
    return intake.release_changes(RELEASE_BODIES.df(spark, sf_dir)).select(*_RELEASE_OUT)


# Project and task patch bodies as JSON, with ids of the path that are missing, zero, text and too large.
_PATH_ID = ("CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN 'abc' WHEN 3 THEN '92233720368547758080' "
            "ELSE CAST(o_orderkey + 3000000000 AS STRING) || 'z' END")
_PATH_REASON = ("CASE caso WHEN 0 THEN 'falta_id' WHEN 1 THEN 'falta_id' WHEN 2 THEN 'falta_id' "
                "WHEN 3 THEN 'id_fuera_de_rango' END")
_PATH_KNOWN = "CASE WHEN caso = 1 THEN 0 WHEN caso > 3 THEN seq + 3000000000 END"
PROJECT_PATCH_BODIES = roles.Role("orders", (
    ("seq", "o_orderkey"), ("caso", "o_orderkey % 9"), ("id", _PATH_ID),
    ("body", "'{\"nombre\":\"  \",\"descripcion\":\" ' || o_orderpriority || '\",\"fechaInicio\":\"2024-03-05T01:00:00+02:00\","
             "\"fechaFin\":\"05/03/2024\",\"estado\":\"En pausa\"}'"),
    ("prioridad", "o_orderpriority"),
))


@register("project_patch_intake", f"""
SELECT seq, CAST({_PATH_KNOWN} AS BIGINT) AS Id, CAST(NULL AS VARCHAR) AS Nombre, prioridad AS Descripcion,
       CAST(NULL AS VARCHAR) AS Responsable, DATE '2024-03-04' AS FechaInicio, CAST(NULL AS DATE) AS FechaFin,
       'En pausa' AS Estado, {_PATH_REASON} AS Motivo
FROM ({PROJECT_PATCH_BODIES.sql})
""")
def q_project_patch_intake(spark, sf_dir):
    return intake.project_changes(PROJECT_PATCH_BODIES.df(spark, sf_dir)).select(
        "seq", "Id", *changes.PROJECT_POLICY, "Motivo")


TASK_PATCH_BODIES = roles.Role("orders", (
    ("seq", "o_orderkey"), ("caso", "o_orderkey % 9"), ("id", _PATH_ID), ("hito", "o_orderkey % 4"),
    ("body", "'{\"nombre\":\" T \",\"progreso\":\"' || CAST(o_orderkey % 300 - 100 AS STRING) || '%\",\"dependenciaId\":' || "
             "CAST(o_orderkey + 5000000000 AS STRING) || ',\"esHito\":' || CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN "
             "'\"1\"' WHEN 2 THEN '\"true\"' ELSE '2' END || ',\"orden\":\"7.9\"}'"),
))


@register("task_patch_intake", f"""
SELECT seq, CAST({_PATH_KNOWN} AS BIGINT) AS Id, 'T' AS Nombre, CAST(NULL AS DATE) AS FechaInicio,
       CAST(NULL AS DATE) AS FechaFin, CAST(GREATEST(0, LEAST(100, seq % 300 - 100)) AS INTEGER) AS Progreso,
       CAST(NULL AS VARCHAR) AS Responsable, CAST(seq + 5000000000 AS BIGINT) AS DependenciaId,
       CAST(NULL AS BIGINT) AS TareaPadreId, hito < 2 AS EsHito, CAST(7 AS INTEGER) AS Orden, {_PATH_REASON} AS Motivo
FROM ({TASK_PATCH_BODIES.sql})
""")
def q_task_patch_intake(spark, sf_dir):
    return intake.task_changes(TASK_PATCH_BODIES.df(spark, sf_dir)).select("seq", "Id", *changes.TASK_POLICY, "Motivo")


# ------------------------------------------------------------------ X1–X5: deletes

@register("delete_attachments", f"""
WITH a AS ({roles.ATTACHMENTS.sql}) SELECT * FROM a WHERE Id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def q_delete_attachments(spark, sf_dir):
    keys = roles.read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("Id"))
    return changes.delete_keys(roles.ATTACHMENTS.df(spark, sf_dir), keys)


NOTE_DELETES = "SELECT doc_id * 1000000 + quality AS Id FROM labels WHERE toxic = 1"


@register("delete_rows", f"WITH n AS ({roles.NOTES.sql}) SELECT * FROM n WHERE Id NOT IN ({NOTE_DELETES})")
def q_delete_rows(spark, sf_dir):
    keys = roles.read(spark, sf_dir, "labels").where("toxic = 1").selectExpr("doc_id * 1000000 + quality AS Id")
    return changes.delete_keys(roles.NOTES.df(spark, sf_dir), keys)


PROJECT_DELETES = "SELECT o_orderkey AS Id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000"


def _cascade(spark, sf_dir):
    ids = roles.read(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice < 100000") \
        .selectExpr("o_orderkey AS Id")
    return changes.cascade_delete(roles.PROJECTS.df(spark, sf_dir), roles.TASKS.df(spark, sf_dir), ids)


@register("delete_project_cascade",
          f"WITH t AS ({roles.TASKS.sql}) SELECT * FROM t WHERE ProyectoId NOT IN ({PROJECT_DELETES})")
def q_delete_project_cascade(spark, sf_dir):
    return _cascade(spark, sf_dir)[1]


@register("delete_project_cascade_projects",
          f"WITH p AS ({roles.PROJECTS.sql}) SELECT * FROM p WHERE Id NOT IN ({PROJECT_DELETES})")
def q_delete_project_cascade_projects(spark, sf_dir):
    return _cascade(spark, sf_dir)[0]


# ------------------------------------------------------------------ tasks with plan links (phase = line 1)

from workboard.operators import activity, attachments, audit, directory  # noqa: E402
from workboard.sources import tables  # noqa: E402


def tasks_plan(spark, sf_dir):
    """Tasks with a parent link to their order's phase (its first line 1 task) and a dependency for line 2."""
    t = roles.TASKS.df(spark, sf_dir)
    ph = t.where(F.col("Nombre") == "Linea 1").groupBy("ProyectoId").agg(F.min("Id").alias("_pid"))
    return (t.drop("DependenciaId", "TareaPadreId").join(ph, "ProyectoId", "left")
            .withColumn("DependenciaId", F.when(F.col("Nombre") == "Linea 2", F.col("_pid")))
            .withColumn("TareaPadreId", F.when(F.col("Id") != F.col("_pid"), F.col("_pid")))
            .drop("_pid"))


TASKS_PLAN_SQL = (f"WITH t0 AS ({roles.TASKS.sql}), "
                  "ph AS (SELECT ProyectoId, MIN(Id) AS pid FROM t0 WHERE Nombre = 'Linea 1' GROUP BY ProyectoId) "
                  "SELECT t0.* EXCLUDE (DependenciaId, TareaPadreId), "
                  "CASE WHEN t0.Nombre = 'Linea 2' THEN ph.pid END AS DependenciaId, "
                  "CASE WHEN t0.Id <> ph.pid THEN ph.pid END AS TareaPadreId "
                  "FROM t0 LEFT JOIN ph ON ph.ProyectoId = t0.ProyectoId")

TASK_DELETES = roles.Role("lineitem", (
    ("Id", f"CASE WHEN l_linenumber = 3 THEN '-' || {roles.TASK_KEY} ELSE {roles.TASK_KEY} END"),
), where="l_returnflag = 'R' AND l_linenumber <= 3")


@register("delete_task_blocked", f"""
WITH tp AS ({TASKS_PLAN_SQL}), r AS (SELECT DISTINCT Id FROM ({TASK_DELETES.sql}))
SELECT r.Id, CASE WHEN NOT EXISTS (SELECT 1 FROM tp WHERE tp.Id = r.Id) THEN 'missing'
                  WHEN EXISTS (SELECT 1 FROM tp WHERE tp.TareaPadreId = r.Id) THEN 'blocked'
                  ELSE 'deleted' END AS outcome
FROM r
""")
def q_delete_task_blocked(spark, sf_dir):
    return changes.delete_tasks_checked(tasks_plan(spark, sf_dir), TASK_DELETES.df(spark, sf_dir))[1]


@register("delete_task_blocked_tasks", f"""
WITH tp AS ({TASKS_PLAN_SQL})
SELECT * FROM tp WHERE Id NOT IN (SELECT Id FROM ({TASK_DELETES.sql}))
  OR Id IN (SELECT TareaPadreId FROM tp WHERE TareaPadreId IS NOT NULL)
""")
def q_delete_task_blocked_tasks(spark, sf_dir):
    left = changes.delete_tasks_checked(tasks_plan(spark, sf_dir), TASK_DELETES.df(spark, sf_dir))[0]
    return left.select(*[c for c in roles.TASKS.names() if c not in ("DependenciaId", "TareaPadreId")],
                       "DependenciaId", "TareaPadreId")


# ------------------------------------------------------------------ R2 J7: referential audit

_AUDIT_PROJECTS_WHERE = "NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')"
_AUDIT_TASKS_WHERE = "NOT (Nombre = 'Linea 1' AND EsHito)"


@register("referential_audit", f"""
WITH p AS ({replace(roles.PROJECTS, where=_AUDIT_PROJECTS_WHERE).sql}),
tp AS (SELECT * FROM ({TASKS_PLAN_SQL}) WHERE {_AUDIT_TASKS_WHERE}),
f AS ({_FEED_SQL}), n AS ({roles.NOTES.sql}), a AS ({roles.ATTACHMENTS.sql}), r AS ({roles.RELEASES.sql})
SELECT 'tarea_sin_proyecto' AS Regla, 'tareas' AS Tabla, Id, CAST(ProyectoId AS VARCHAR) AS Ref FROM tp
  WHERE ProyectoId NOT IN (SELECT Id FROM p)
UNION ALL SELECT 'tarea_sin_padre', 'tareas', Id, TareaPadreId FROM tp
  WHERE TareaPadreId IS NOT NULL AND TareaPadreId NOT IN (SELECT Id FROM tp)
UNION ALL SELECT 'solicitud_sin_proyecto', 'solicitudes', CAST(Id AS VARCHAR), CAST(ProyectoId AS VARCHAR) FROM f
  WHERE ProyectoId IS NOT NULL AND ProyectoId NOT IN (SELECT Id FROM p)
UNION ALL SELECT 'nota_sin_solicitud', 'notas', CAST(Id AS VARCHAR), CAST(SolicitudId AS VARCHAR) FROM n
  WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.Tipo = n.Tipo AND f.Id = n.SolicitudId)
UNION ALL SELECT 'documento_sin_solicitud', 'documentos', CAST(Id AS VARCHAR), CAST(SolicitudId AS VARCHAR) FROM a
  WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.Tipo = a.Tipo AND f.Id = a.SolicitudId)
UNION ALL SELECT 'pase_sin_solicitud', 'pases', CAST(Id AS VARCHAR), CAST(SolicitudId AS VARCHAR) FROM r
  WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.Tipo = r.Tipo AND f.Id = r.SolicitudId)
""")
def q_referential_audit(spark, sf_dir):
    return audit.referential_audit(
        replace(roles.PROJECTS, where=_AUDIT_PROJECTS_WHERE).df(spark, sf_dir),
        tasks_plan(spark, sf_dir).where(_AUDIT_TASKS_WHERE),
        _feed(spark, sf_dir), roles.NOTES.df(spark, sf_dir), roles.ATTACHMENTS.df(spark, sf_dir),
        roles.RELEASES.df(spark, sf_dir))


# ------------------------------------------------------------------ R6: plan audit

@register("plan_audit", f"""
WITH tp AS ({TASKS_PLAN_SQL}),
k AS (SELECT TareaPadreId, MIN(FechaInicio) AS HijoMin, MAX(FechaFin) AS HijoMax FROM tp
      WHERE TareaPadreId IS NOT NULL GROUP BY TareaPadreId),
ph AS (SELECT tp.Id, tp.FechaInicio, tp.FechaFin, k.HijoMin, k.HijoMax FROM tp JOIN k ON k.TareaPadreId = tp.Id)
SELECT Id AS TareaId, 'fase_inicio' AS Regla FROM ph WHERE FechaInicio IS DISTINCT FROM HijoMin
UNION ALL SELECT Id, 'fase_fin' FROM ph WHERE FechaFin IS DISTINCT FROM HijoMax
UNION ALL SELECT t.Id, 'dependencia' FROM tp t JOIN tp d ON d.Id = t.DependenciaId WHERE d.FechaFin >= t.FechaInicio
UNION ALL SELECT Id, 'fin_de_semana' FROM tp
  WHERE COALESCE(dayofweek(FechaInicio) IN (0, 6), FALSE) OR COALESCE(dayofweek(FechaFin) IN (0, 6), FALSE)
""")
def q_plan_audit(spark, sf_dir):
    return audit.plan_audit(tasks_plan(spark, sf_dir))


# ------------------------------------------------------------------ R5: activity summary

@register("activity_summary", f"""
WITH n AS (SELECT Tipo, SolicitudId, COUNT(*) AS Notas, MAX(Fecha) AS UltimaNota FROM ({roles.NOTES.sql})
           GROUP BY ALL),
a AS (SELECT Tipo, SolicitudId, COUNT(*) AS Documentos, CAST(SUM(Tamano) AS BIGINT) AS Bytes
      FROM ({roles.ATTACHMENTS.sql}) GROUP BY ALL)
SELECT COALESCE(n.Tipo, a.Tipo) AS Tipo, COALESCE(n.SolicitudId, a.SolicitudId) AS SolicitudId,
       COALESCE(n.Notas, 0) AS Notas, n.UltimaNota, COALESCE(a.Documentos, 0) AS Documentos,
       COALESCE(a.Bytes, 0) AS Bytes
FROM n FULL OUTER JOIN a ON n.Tipo = a.Tipo AND n.SolicitudId = a.SolicitudId
""")
def q_activity_summary(spark, sf_dir):
    return activity.activity_summary(roles.NOTES.df(spark, sf_dir), roles.ATTACHMENTS.df(spark, sf_dir))


# ------------------------------------------------------------------ P6 P11: attachment metadata of requests

@register("attachment_metadata", f"""
WITH a AS ({roles.ATTACHMENTS.sql}), f AS ({_FEED_SQL})
SELECT {', '.join(search.ATTACHMENT_LIST)} FROM a
WHERE EXISTS (SELECT 1 FROM f WHERE f.Tipo = a.Tipo AND f.Id = a.SolicitudId AND f.Id <> 0)
""")
def q_attachment_metadata(spark, sf_dir):
    keys = _feed(spark, sf_dir).select("Tipo", F.col("Id").alias("SolicitudId"))
    return search.attachments_list(roles.ATTACHMENTS.df(spark, sf_dir), keys)


# ------------------------------------------------------------------ S7 H13 H14 P15: attachment uploads

UPLOADS = roles.Role("documents", (
    ("Ref", "doc_id"),
    ("tipo", "CASE lang WHEN 'en' THEN 'infra' WHEN 'es' THEN 'erp' WHEN 'fr' THEN 'gen' ELSE 'otro' END"),
    ("solicitudId", "substr(source, 4)"),
    ("nombre", "CASE WHEN doc_id % 17 = 0 THEN '  ' ELSE 'doc \"' || CAST(doc_id AS STRING) || '\"' || "
               "CHR(10) || '.txt' END"),
    ("contentType", "CASE WHEN lang = 'es' THEN CAST(NULL AS STRING) ELSE 'text/plain' END"),
    ("base64", ("CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 5 = 0 THEN ' ' || base64(CAST(text AS BINARY)) "
                "|| CHR(10) ELSE base64(CAST(text AS BINARY)) END",
                "CASE WHEN doc_id % 13 = 0 THEN '' ELSE to_base64(encode(text)) END")),
    ("autor", "source"),
    ("original", "text"),  # carried along so the decoded bytes can be compared without a second scan
))


@register("attachment_decode", f"""
WITH u AS ({UPLOADS.sql}),
d AS (SELECT *, CAST(octet_length(from_base64(base64)) AS INTEGER) AS sz FROM u)
SELECT Ref, NULLIF(trim(tipo), '') AS Tipo, TRY_CAST(solicitudId AS BIGINT) AS SolicitudId,
       NULLIF(trim(nombre), '') AS Nombre,
       regexp_replace(COALESCE(NULLIF(NULLIF(trim(nombre), ''), ''), 'documento'), '[\\r\\n"]', '_', 'g') AS Archivo,
       COALESCE(contentType, 'application/octet-stream') AS ContentType, sz AS Tamano,
       CASE WHEN tipo NOT IN ('infra', 'erp', 'gen') OR COALESCE(TRY_CAST(solicitudId AS BIGINT), 0) = 0
            THEN 'tipo_o_solicitud'
            WHEN NULLIF(trim(nombre), '') IS NULL THEN 'sin_nombre'
            WHEN base64 = '' THEN 'sin_contenido' WHEN sz = 0 THEN 'vacio'
            WHEN sz > {attachments.MAX_BYTES} THEN 'excede_limite' END AS Motivo,
       from_base64(base64) = encode(text) AS Igual
FROM d JOIN (SELECT doc_id, text FROM documents) x ON x.doc_id = d.Ref
""")
def q_attachment_decode(spark, sf_dir):
    up = attachments.intake(UPLOADS.df(spark, sf_dir))
    return up.select(
        "Ref", "Tipo", "SolicitudId", "Nombre", attachments.download_name("Nombre").alias("Archivo"),
        "ContentType", "Tamano", "Motivo", (F.col("Contenido") == F.col("original").cast("binary")).alias("Igual"))


# ------------------------------------------------------------------ J4: project name → id, create when missing

NAME_DIM_SQL = """
SELECT n_nationkey + 1 AS Id, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS Nombre
FROM nation
UNION ALL SELECT n_nationkey + 50, lower(n_name) FROM nation WHERE n_regionkey = 0
"""

NAME_ROWS = roles.Role("supplier", (
    ("s_suppkey", "s_suppkey"),
    ("nombre", "CASE WHEN s_suppkey % 5 = 0 THEN '  ' || lower(n_name) || ' ' WHEN s_suppkey % 5 = 1 THEN n_name "
               "WHEN s_suppkey % 5 = 2 THEN 'Nuevo ' || CAST(s_nationkey % 4 AS STRING) "
               "WHEN s_suppkey % 5 = 3 THEN upper(n_name) ELSE ' ' END"),
))


def _name_rows(spark, sf_dir):
    s = roles.read(spark, sf_dir, "supplier")
    n = roles.read(spark, sf_dir, "nation")
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left")
    return joined.selectExpr(*[f"{roles.spark_expr(e)} AS {c}" for c, e in NAME_ROWS.cols])


def _name_dim(spark, sf_dir):
    n = roles.read(spark, sf_dir, "nation")
    a = n.selectExpr("n_nationkey + 1 AS Id",
                     "CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS Nombre")
    b = n.where("n_regionkey = 0").selectExpr("n_nationkey + 50 AS Id", "lower(n_name) AS Nombre")
    return a.unionByName(b).withColumn("Id", F.col("Id").cast("bigint"))


@register("resolve_project_key", f"""
WITH d AS ({NAME_DIM_SQL}),
dk AS (SELECT lower(trim(Nombre)) AS k, MAX(Id) AS pid FROM d GROUP BY 1),
r AS (SELECT {', '.join(f'{roles.duck(e)} AS {c}' for c, e in NAME_ROWS.cols)}
      FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
rk AS (SELECT *, NULLIF(lower(trim(nombre)), '') AS k FROM r),
miss AS (SELECT k, (SELECT MAX(Id) FROM d) + row_number() OVER (ORDER BY k) AS nid
         FROM (SELECT DISTINCT rk.k FROM rk LEFT JOIN dk ON dk.k = rk.k WHERE rk.k IS NOT NULL AND dk.k IS NULL))
SELECT rk.s_suppkey, rk.nombre, CAST(COALESCE(dk.pid, miss.nid) AS BIGINT) AS ProyectoId,
       dk.pid IS NULL AND miss.nid IS NOT NULL AS Creado
FROM rk LEFT JOIN dk ON dk.k = rk.k LEFT JOIN miss ON miss.k = rk.k
""")
def q_resolve_project_key(spark, sf_dir):
    out, _ = intake.resolve_project_names(_name_rows(spark, sf_dir), "nombre", _name_dim(spark, sf_dir), AS_OF)
    return out


@register("resolve_project_new", f"""
WITH d AS ({NAME_DIM_SQL}), r AS (SELECT {', '.join(f'{roles.duck(e)} AS {c}' for c, e in NAME_ROWS.cols)}
      FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT lower(trim(nombre)) AS k, MIN(trim(nombre)) AS Nombre FROM r WHERE trim(nombre) <> ''
      AND lower(trim(nombre)) NOT IN (SELECT lower(trim(Nombre)) FROM d) GROUP BY 1)
SELECT CAST((SELECT MAX(Id) FROM d) + row_number() OVER (ORDER BY k) AS BIGINT) AS Id, Nombre, 'Activo' AS Estado,
       {AS_OF_SQL} AS FechaRegistro FROM m
""")
def q_resolve_project_new(spark, sf_dir):
    return intake.resolve_project_names(_name_rows(spark, sf_dir), "nombre", _name_dim(spark, sf_dir), AS_OF)[1]


# ------------------------------------------------------------------ P12 T6: directory members

DIRECTORY_DOMAIN = "example.com"

DIRECTORY_USERS = roles.Role("customer", (
    ("displayName", "CASE WHEN c_custkey % 17 = 0 THEN CAST(NULL AS STRING) "
                    "WHEN c_custkey % 19 = 0 THEN '' ELSE c_name END"),
    ("mail", "CASE WHEN c_custkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE "
             "lower(replace(c_name, '#', '.')) || '@' || CASE c_mktsegment WHEN 'BUILDING' THEN 'other.org' "
             "WHEN 'MACHINERY' THEN 'EXAMPLE.COM' ELSE 'example.com' END END"),
    ("userPrincipalName", "CASE WHEN c_custkey % 7 = 0 THEN lower(replace(c_name, '#', '_')) || '#EXT#@example.com' "
                          "ELSE lower(replace(c_name, '#', '_')) || '@example.com' END"),
    ("jobTitle", "CASE WHEN c_acctbal > 0 THEN c_mktsegment END"),
))


@register("directory_members", f"""
WITH u AS ({DIRECTORY_USERS.sql}),
e AS (SELECT *, COALESCE(NULLIF(mail, ''), NULLIF(userPrincipalName, ''), '') AS email FROM u)
SELECT displayName AS name, email, COALESCE(NULLIF(jobTitle, ''), '') AS jobTitle FROM e
WHERE COALESCE(displayName <> '', FALSE) AND NOT contains(lower(email), '#ext#')
  AND ends_with(lower(email), '@{DIRECTORY_DOMAIN}')
""")
def q_directory_members(spark, sf_dir):
    return directory.sorted_members(DIRECTORY_USERS.df(spark, sf_dir), DIRECTORY_DOMAIN)


# ------------------------------------------------------------------ S8: conform an old-shape table

_OLD_GENERAL_COLS = [c for c in roles.REQUESTS_GENERAL.names()
                     if c not in ("Responsable", "FechaEntrega", "FechaActualizacion", "ProyectoId")]


@register("conform_schema", f"""
WITH g AS ({roles.REQUESTS_GENERAL.sql})
SELECT {', '.join(_OLD_GENERAL_COLS)}, 'sin asignar' AS Responsable, CAST(NULL AS DATE) AS FechaEntrega,
       CAST(NULL AS TIMESTAMP) AS FechaActualizacion, CAST(NULL AS BIGINT) AS ProyectoId
FROM g
""")
def q_conform_schema(spark, sf_dir):
    from workboard import schemas
    old = roles.REQUESTS_GENERAL.df(spark, sf_dir).select(*_OLD_GENERAL_COLS)
    return tables.conform(old, schemas.REQUESTS_GENERAL, defaults={"Responsable": "sin asignar"})


# ------------------------------------------------------------------ S6 S4: seed load with parent links

@register("seed_load", f"""
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS Id FROM orders WHERE o_orderstatus = 'O'),
t AS ({roles.TASKS.sql})
SELECT t.* EXCLUDE (ProyectoId), CAST(p.Id AS BIGINT) AS ProyectoId
FROM t JOIN p ON p.o_orderkey = t.ProyectoId
""")
def q_seed_load(spark, sf_dir):
    parents = tables.with_ids(roles.read(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
                              .select("o_orderkey"), [F.col("o_orderkey")], base=0)
    # rows are linked as stored: the task's texts are made after the join, so they are not shuffled
    linked = tables.link_children(roles.read(spark, sf_dir, "lineitem"), parents, "l_orderkey", "ProyectoId", "o_orderkey")
    return linked.where(F.col("ProyectoId").isNotNull()).selectExpr(  # the rest: seed_load_rejects
        *[f"{roles.spark_expr(e)} AS {n}" for n, e in roles.TASKS.cols if n != "ProyectoId"], "ProyectoId")


@register("seed_load_rejects", f"""
WITH t AS ({roles.TASKS.sql})
SELECT Id, ProyectoId AS o_orderkey, 'sin_padre' AS Motivo FROM t
WHERE ProyectoId NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
""")
def q_seed_load_rejects(spark, sf_dir):
    parents = roles.read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").selectExpr("o_orderkey", "o_orderkey AS Id")
    linked = tables.link_children(roles.read(spark, sf_dir, "lineitem"), parents, "l_orderkey", "ProyectoId", "o_orderkey")
    return linked.where(F.col("ProyectoId").isNull()).selectExpr(f"{roles.TASK_KEY} AS Id", "l_orderkey AS o_orderkey",
                                                                 "'sin_padre' AS Motivo")


# ------------------------------------------------------------------ H1: clean text

NBSP, BOM, IDEO_SPACE, EMOJI = " ", "﻿", "　", "\U0001f600"

DIRTY_TEXT = roles.Role("part", (
    ("p_partkey", "p_partkey"),
    ("raw", f"CASE p_partkey % 7 WHEN 0 THEN '{NBSP}' || p_name || '{BOM}' WHEN 1 THEN '   ' WHEN 2 THEN '' "
            f"WHEN 3 THEN p_name || repeat('x', 300) WHEN 4 THEN CAST(NULL AS STRING) "
            f"WHEN 5 THEN '{IDEO_SPACE}' || p_name || ' {EMOJI}' "
            f"ELSE p_name || repeat('é', 199 - length(p_name)) || '{EMOJI}' || 'zz' END"),
))

# RE2 / Java class for the JavaScript whitespace set (same code points as coerce.JS_WS).
_WS_SQL = coerce.JS_WS


def _trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS_SQL}+|{_WS_SQL}+$', '', 'g')"


@register("clean_text", f"""
WITH d AS ({DIRTY_TEXT.sql})
SELECT p_partkey, raw, substring(NULLIF({_trim_sql('raw')}, ''), 1, 200) AS Limpio,
       NULLIF({_trim_sql('raw')}, '') AS LimpioSinLimite
FROM d
""")
def q_clean_text(spark, sf_dir):
    d = DIRTY_TEXT.df(spark, sf_dir)
    return d.select("p_partkey", "raw", coerce.clean_text("raw", 200).alias("Limpio"),
                    coerce.clean_text("raw").alias("LimpioSinLimite"))


# ------------------------------------------------------------------ H2 H3 H4 H6: numbers

DIRTY_NUMBERS = roles.Role("events", (
    ("event_id", "event_id"),
    ("raw", "CASE event_id % 12 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN CAST(user_id AS STRING) || '.7' "
            "WHEN 2 THEN CAST(user_id AS STRING) || 'abc' WHEN 3 THEN 'abc' WHEN 4 THEN '' WHEN 5 THEN '   ' "
            "WHEN 6 THEN '1e' || CAST(user_id % 5 AS STRING) WHEN 7 THEN '0x' || CAST(user_id AS STRING) "
            "WHEN 8 THEN CAST(user_id AS STRING) || 'd' WHEN 9 THEN '-' || CAST(user_id AS STRING) "
            "WHEN 10 THEN CAST(user_id AS STRING) || '0000000000' "
            "ELSE ' +' || CAST(user_id AS STRING) || '.25 ' END"),
))

_DEC_RE_SQL = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_NUM_SQL = (f"CASE WHEN raw IS NULL OR raw = '' THEN NULL WHEN {_trim_sql('raw')} = '' THEN 0.0 "
            f"WHEN regexp_matches({_trim_sql('raw')}, '{_DEC_RE_SQL}') THEN TRY_CAST({_trim_sql('raw')} AS DOUBLE) "
            f"WHEN regexp_matches({_trim_sql('raw')}, '^0[xX][0-9a-fA-F]+$') "
            f"THEN CAST(TRY_CAST({_trim_sql('raw')} AS BIGINT) AS DOUBLE) END")
_PREFIX_SQL = (f"CASE WHEN raw <> '' THEN TRY_CAST(regexp_extract(regexp_replace(raw, '^{_WS_SQL}+', ''), "
               f"'^([+-]?[0-9]+)', 1) AS INTEGER) END")


@register("clean_numbers", f"""
WITH d AS ({DIRTY_NUMBERS.sql}), n AS (SELECT *, {_NUM_SQL} AS Numero, {_PREFIX_SQL} AS EnteroPrefijo FROM d)
SELECT event_id, raw, Numero,
       CASE WHEN Numero > -2147483649 AND Numero < 2147483648 THEN CAST(trunc(Numero) AS INTEGER) END AS EnteroTrunc,
       EnteroPrefijo,
       CASE WHEN EnteroPrefijo IS NOT NULL THEN GREATEST(0, LEAST(100, EnteroPrefijo)) END AS Progreso,
       CASE WHEN Numero IS NOT NULL AND abs(Numero) < 10000000 THEN TRY_CAST(Numero AS DECIMAL(9,2)) END AS Decimal92
FROM n
""")
def q_clean_numbers(spark, sf_dir):
    d = DIRTY_NUMBERS.df(spark, sf_dir)
    return d.select("event_id", "raw", coerce.to_num("raw").alias("Numero"),
                    coerce.to_int_trunc("raw").alias("EnteroTrunc"), coerce.to_int_prefix("raw").alias("EnteroPrefijo"),
                    coerce.clamp_progress("raw").alias("Progreso"), coerce.to_decimal("raw", 9, 2).alias("Decimal92"))


# ------------------------------------------------------------------ H5 H25: dates

DIRTY_DATES = roles.Role("events", (
    ("event_id", "event_id"),
    ("raw", "CASE event_id % 7 WHEN 0 THEN CAST(CAST(ts AS DATE) AS STRING) "
            "WHEN 1 THEN CAST(CAST(ts AS DATE) AS STRING) || 'T10:30:00Z' "
            "WHEN 2 THEN CAST(CAST(ts AS DATE) AS STRING) || 'T23:30:15.5-05:00' "
            "WHEN 3 THEN '2024-02-31' "
            "WHEN 4 THEN substr(CAST(CAST(ts AS DATE) AS STRING), 9, 2) || '/' || "
            "substr(CAST(CAST(ts AS DATE) AS STRING), 6, 2) || '/' || substr(CAST(CAST(ts AS DATE) AS STRING), 1, 4) "
            "WHEN 5 THEN '' ELSE ' ' || CAST(CAST(ts AS DATE) AS STRING) || ' 08:15 ' END"),
))

_ISO_SQL = ("^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.]([0-9]{1,9}))?)?"
            "(Z|[+-][0-9]{2}:[0-9]{2})?)?$")


def _g(i):
    return f"regexp_extract(t, '{_ISO_SQL}', {i})"


_TS_SQL = (f"CASE WHEN regexp_matches(t, '{_ISO_SQL}') THEN "
           f"try_strptime({_g(1)} || '-' || {_g(2)} || '-' || {_g(3)} || ' ' || COALESCE(NULLIF({_g(4)}, ''), '00') "
           f"|| ':' || COALESCE(NULLIF({_g(5)}, ''), '00') || ':' || COALESCE(NULLIF({_g(6)}, ''), '00'), "
           f"'%Y-%m-%d %H:%M:%S') "
           f"+ CAST(substr(rpad(COALESCE(NULLIF({_g(7)}, ''), '0'), 3, '0'), 1, 3) AS INTEGER) "
           f"* INTERVAL 1 MILLISECOND "
           f"- (CASE WHEN {_g(8)} IN ('', 'Z') THEN 0 ELSE (CAST(substr({_g(8)}, 2, 2) AS INTEGER) * 60 + "
           f"CAST(substr({_g(8)}, 5, 2) AS INTEGER)) * (CASE WHEN substr({_g(8)}, 1, 1) = '-' THEN -1 ELSE 1 END) END)"
           f" * INTERVAL 1 MINUTE END")


@register("clean_dates", f"""
WITH d AS ({DIRTY_DATES.sql}), p AS (SELECT *, NULLIF({_trim_sql('raw')}, '') AS t FROM d),
s AS (SELECT event_id, raw, {_TS_SQL} AS Marca FROM p)
SELECT event_id, raw, Marca, CAST(Marca AS DATE) AS Fecha, COALESCE(Marca, {AS_OF_SQL}) AS FechaNota FROM s
""")
def q_clean_dates(spark, sf_dir):
    d = DIRTY_DATES.df(spark, sf_dir).withColumn("_t", coerce.clean_text("raw"))  # cleaned once, read thrice
    return d.select("event_id", "raw", coerce.to_timestamp_utc("_t", cleaned=True).alias("Marca"),
                    coerce.to_date_utc("_t", cleaned=True).alias("Fecha"),
                    coerce.date_or_now("_t", AS_OF, cleaned=True).alias("FechaNota"))


# ------------------------------------------------------------------ S2 I2: ERP JSON intake

_ERP_MODEL = ("'{\"solicitante\":' || (CASE WHEN c_acctbal < 0 THEN 'null' ELSE '\"' || c_name || '\"' END) || "
              "',\"area\":\"' || c_mktsegment || '\",\"descripcion\":\"  Cuenta ' || CAST(c_custkey AS STRING) || "
              "' de ' || c_mktsegment || '  \",\"modulos\":' || "
              "(CASE c_custkey % 3 WHEN 0 THEN '[\"Finanzas\",\"\",null,\"Compras\"]' WHEN 1 THEN '\"Ventas\"' "
              "ELSE '[]' END) || ',\"procesos\":[\"Cierre mensual\",\"Inventario\"],\"transformar_fabric\":' || "
              "(CASE c_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN '\"Sí\"' WHEN 2 THEN '\"true\"' "
              "ELSE 'false' END) || "
              "',\"prioridad\":\"Media\",\"estado\":\"\",\"proyecto_id\":\"' || CAST(c_nationkey AS STRING) || "
              "'abc\",\"extra\":{\"k\":1}}'")

ERP_BODIES = roles.Role("customer", (
    ("Ref", "c_custkey"),
    ("body", f"CASE WHEN c_custkey % 50 = 7 THEN '{{\"model\": {{\"solicitante\": \"x\"' "
             f"WHEN c_custkey % 2 = 0 THEN '{{\"model\":' || {_ERP_MODEL} || '}}' ELSE {_ERP_MODEL} END"),
))


def _jstr(path):
    return f"json_extract_string(m, '{path}')"


def _jlist(path, sep):
    return (f"CASE json_type(m, '{path}') WHEN 'ARRAY' THEN array_to_string(list_filter("
            f"CAST(json_extract_string(m, '{path}[*]') AS VARCHAR[]), lambda x: x IS NOT NULL AND x <> ''), '{sep}') "
            f"ELSE NULLIF(trim({_jstr(path)}), '') END")


_ENVELOPE_SQL = ("v AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS vb FROM b), "
                 "e AS (SELECT *, CASE WHEN json_type(vb, '$.model') = 'OBJECT' THEN json_extract(vb, '$.model') "
                 "ELSE json(vb) END AS m, CASE WHEN json_type(vb, '$.model') = 'OBJECT' "
                 "THEN json_extract(vb, '$.model')::VARCHAR ELSE json(vb)::VARCHAR END AS PayloadJson FROM v)")


@register("json_intake_erp", f"""
WITH b AS ({ERP_BODIES.sql}), {_ENVELOPE_SQL},
f AS (SELECT Ref, PayloadJson, vb, m, NULLIF(trim({_jstr('$.solicitante')}), '') AS Solicitante,
             NULLIF(trim({_jstr('$.area')}), '') AS Area, NULLIF(trim({_jstr('$.descripcion')}), '') AS Descripcion,
             {_jlist('$.modulos', ', ')} AS Modulos, {_jlist('$.procesos', ' | ')} AS Procesos FROM e)
SELECT Ref, substr(NULLIF(trim(Area || ' – ' || COALESCE(NULLIF(Modulos, ''), substr(Descripcion, 1, 60),
                                                       'Solicitud ERP')), ''), 1, 300) AS Titulo,
  Solicitante, Area, Descripcion, Modulos, Procesos,
  CASE WHEN (json_type(m, '$.transformar_fabric') = 'BOOLEAN' AND {_jstr('$.transformar_fabric')} = 'true')
         OR (json_type(m, '$.transformar_fabric') = 'VARCHAR' AND {_jstr('$.transformar_fabric')} IN ('Sí', 'si'))
       THEN 'Sí' ELSE 'No' END AS TransformarFabric,
  NULLIF(trim({_jstr('$.fabric_detalle')}), '') AS FabricDetalle,
  substr(NULLIF(trim({_jstr('$.prioridad')}), ''), 1, 20) AS Prioridad,
  COALESCE(NULLIF(trim({_jstr('$.estado')}), ''), 'Nuevo') AS Estado,
  TRY_CAST(regexp_extract({_jstr('$.proyecto_id')}, '^([+-]?[0-9]+)', 1) AS BIGINT) AS ProyectoId,
  PayloadJson,
  CASE WHEN vb IS NULL THEN 'json_invalido' WHEN json_type(m) NOT IN ('OBJECT', 'ARRAY') THEN 'cuerpo_invalido'
       WHEN Solicitante IS NULL OR Area IS NULL THEN 'faltan_obligatorios' END AS Motivo
FROM f
""")
def q_json_intake_erp(spark, sf_dir):
    return intake.erp_requests(ERP_BODIES.df(spark, sf_dir)).drop("body")


# ------------------------------------------------------------------ S2 I3: general JSON intake

_GEN_MODEL = ("'{\"solicitante\":\"' || c_name || '\",\"area\":' || (CASE WHEN c_custkey % 5 = 0 THEN 'null' "
              "ELSE '\" ' || c_mktsegment || ' \"' END) || ',\"asunto\":' || "
              "(CASE WHEN c_acctbal < 100 THEN '\"   \"' ELSE '\"Asunto ' || CAST(c_custkey AS STRING) || '\"' END) || "
              "',\"ambito\":' || (CASE c_custkey % 3 WHEN 0 THEN '[\"Reportes\",\"Accesos\"]' WHEN 1 THEN "
              "'\"Soporte\"' ELSE '[\"\"]' END) || ',\"descripcion\":\"Detalle ' || CAST(c_nationkey AS STRING) || "
              "'\",\"estado\":' || (CASE WHEN c_custkey % 4 = 0 THEN '\"Abierto\"' ELSE 'null' END) || "
              "',\"proyecto_id\":' || CAST(c_nationkey AS STRING) || '}'")

GEN_BODIES = roles.Role("customer", (
    ("Ref", "c_custkey"),
    ("body", f"CASE WHEN c_custkey % 45 = 11 THEN '[1, 2]' WHEN c_custkey % 2 = 1 "
             f"THEN '{{\"model\":' || {_GEN_MODEL} || '}}' ELSE {_GEN_MODEL} END"),
))


@register("json_intake_general", f"""
WITH b AS ({GEN_BODIES.sql}), {_ENVELOPE_SQL},
f AS (SELECT Ref, PayloadJson, vb, m, NULLIF(trim({_jstr('$.solicitante')}), '') AS Solicitante,
             NULLIF(trim({_jstr('$.asunto')}), '') AS Titulo, NULLIF(trim({_jstr('$.descripcion')}), '') AS Descripcion
      FROM e)
SELECT Ref, Titulo, Solicitante, NULLIF(trim({_jstr('$.area')}), '') AS Area, {_jlist('$.ambito', ', ')} AS Ambito,
  Descripcion, NULLIF(trim({_jstr('$.justificacion')}), '') AS Justificacion,
  substr(NULLIF(trim({_jstr('$.prioridad')}), ''), 1, 20) AS Prioridad,
  COALESCE(NULLIF(trim({_jstr('$.estado')}), ''), 'Nuevo') AS Estado,
  TRY_CAST(regexp_extract({_jstr('$.proyecto_id')}, '^([+-]?[0-9]+)', 1) AS BIGINT) AS ProyectoId,
  PayloadJson,
  CASE WHEN vb IS NULL THEN 'json_invalido' WHEN json_type(m) NOT IN ('OBJECT', 'ARRAY') THEN 'cuerpo_invalido'
       WHEN Solicitante IS NULL OR Titulo IS NULL OR Descripcion IS NULL THEN 'faltan_obligatorios' END AS Motivo
FROM f
""")
def q_json_intake_general(spark, sf_dir):
    return intake.general_requests(GEN_BODIES.df(spark, sf_dir)).drop("body")


# ------------------------------------------------------------------ I6 P14 P15: note intake and validation

NOTE_BODIES = roles.Role("events", (
    ("event_id", "event_id"),
    ("tipo", "CASE event_type WHEN 'view' THEN 'infra' WHEN 'click' THEN 'erp' WHEN 'signup' THEN 'gen' "
             "WHEN 'purchase' THEN 'toString' ELSE ' gen ' END"),
    ("solicitudId", "CASE WHEN value < 5 THEN '0' WHEN value < 10 THEN 'abc' "
                    "ELSE CAST(user_id + 1 AS STRING) || 'x' END"),
    ("nota", "CASE WHEN value < 50 THEN '  ' ELSE props END"),
    ("autor", "CASE WHEN value > 100 THEN 'user' || CAST(user_id AS STRING) END"),
    ("fecha", "CASE WHEN value > 200 THEN CAST(CAST(ts AS DATE) AS STRING) ELSE 'ayer' END"),
))

_NOTE_INTAKE_SQL = f"""
WITH d AS ({NOTE_BODIES.sql}),
x AS (SELECT event_id, NULLIF(trim(tipo), '') AS Tipo,
             TRY_CAST(regexp_extract(solicitudId, '^([+-]?[0-9]+)', 1) AS BIGINT) AS SolicitudId,
             NULLIF(trim(nota), '') AS Nota, NULLIF(trim(autor), '') AS Autor,
             COALESCE(CAST(TRY_CAST(fecha AS DATE) AS TIMESTAMP), {AS_OF_SQL}) AS Fecha FROM d)
SELECT *, CASE WHEN NOT COALESCE(Tipo IN ('infra', 'erp', 'gen'), FALSE) OR COALESCE(SolicitudId, 0) = 0
               THEN 'tipo_o_solicitud' WHEN Nota IS NULL THEN 'nota_vacia' END AS Motivo
FROM x
"""


@register("note_intake", _NOTE_INTAKE_SQL)
def q_note_intake(spark, sf_dir):
    return intake.notes(NOTE_BODIES.df(spark, sf_dir), AS_OF).select(
        "event_id", "Tipo", "SolicitudId", "Nota", "Autor", "Fecha", "Motivo")


@register("validation_split",
          f"SELECT COALESCE(Motivo, 'ok') AS Motivo, COUNT(*) AS Filas FROM ({_NOTE_INTAKE_SQL}) GROUP BY 1")
def q_validation_split(spark, sf_dir):
    return intake.reason_counts(intake.notes(NOTE_BODIES.df(spark, sf_dir), AS_OF))


# ------------------------------------------------------------------ R4: stream change application (final state)

from workboard.session import cut, fresh_path, shared_root  # noqa: E402
from workboard.streaming import apply as stream_apply  # noqa: E402


def _change_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A one-file glob: the file source treats a plain file path as its base directory and fails.
    src = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    if TRACKING_CHANGES.where:
        src = src.where(TRACKING_CHANGES.where)
    return src.selectExpr(*[f"{roles.spark_expr(e)} AS {n}" for n, e in TRACKING_CHANGES.cols])


@register("stream_apply", ORACLES["tracking_patch"])
def q_stream_apply(spark, sf_dir):
    root = fresh_path(shared_root(spark), "stream-apply")
    stream_apply.change_log_stream(_change_stream(spark, sf_dir), normalise_tracking, f"{root}/log",
                                   f"{root}/checkpoint").awaitTermination()
    log = spark.read.parquet(f"{root}/log").drop("batch")
    return changes.apply_patch(roles.REQUESTS_ERP.df(spark, sf_dir), log, changes.TRACKING_POLICY, as_of=AS_OF)


# ------------------------------------------------------------------ S2 I1: infrastructure JSON intake

_INFRA_MODEL = (
    "'{\"informacion_general\":{\"nombre_aplicacion\":' || (CASE WHEN p_size % 11 = 0 THEN 'null' "
    "ELSE '\" ' || p_name || '\"' END) || (CASE WHEN p_size % 3 = 0 THEN '' ELSE ',\"identificador\":\"APP-' || "
    "CAST(p_partkey AS STRING) || '\"' END) || ',\"proyecto\":\"' || p_brand || '\",\"lider_tecnico\":null,"
    "\"fecha_produccion\":' || (CASE p_partkey % 3 WHEN 0 THEN '\"2024-05-0' || CAST(p_partkey % 9 + 1 AS STRING) || "
    "'\"' WHEN 1 THEN '\"mañana\"' ELSE '\"2024-13-01\"' END) || ',\"descripcion\":\"' || p_type || '\"},"
    "\"computo_y_contenedores\":{\"arquitectura_despliegue\":\"Contenedores\",\"cpu_total_vcpu\":' || "
    "(CASE WHEN p_size % 4 = 0 THEN '\"12.5abc\"' ELSE CAST(p_size AS STRING) END) || ',\"ram_total_gb\":\"  16 \"},"
    "\"base_de_datos\":{\"motor_bd\":\"PostgreSQL\",\"almacenamiento_inicial_gb\":' || CAST(p_retailprice AS STRING) "
    "|| ',\"crecimiento_mensual_gb\":' || (CASE WHEN p_size % 5 = 0 THEN '\"1e12\"' ELSE '\"2.5\"' END) || '},"
    "\"clasificacion_registro\":{\"ambiente\":\"QA\",\"usuarios_concurrentes\":' || "
    "(CASE WHEN p_size % 2 = 0 THEN '\"12.7\"' ELSE CAST(p_size AS STRING) END) || ',\"criticidad\":\"Alta\","
    "\"requiere_ha\":\"Sí\",\"requiere_dr\":\"No\",\"estado\":null},\"proyecto_id\":\"' || CAST(p_size AS STRING) || "
    "'.9\"}'")

INFRA_BODIES = roles.Role("part", (
    ("Ref", "p_partkey"),
    ("body", f"'{{\"model\":' || {_INFRA_MODEL} || ',\"sharepoint_row\":{{' || (CASE WHEN p_partkey % 7 = 0 "
             f"THEN '\"Título\":\"  Lista ' || CAST(p_partkey AS STRING) || '\",' ELSE '' END) || "
             f"'\"FrontEnd\":\"React\"}}}}'"),
))

INFRA_OUT = ["Ref", "Titulo", "Aplicacion", "Identificador", "Proyecto", "LiderProyecto", "FechaProduccion",
             "Funcionalidad", "ArquitecturaDespliegue", "FrontEnd", "BackendAPI", "CPURequerida", "RAMRequeridaGB",
             "BaseDatos", "ModeloDespliegueBD", "StorageGB", "CrecimientoMensualGB", "DominioPublico", "TipoAcceso",
             "MetodoAutenticacion", "NivelSensibilidad", "Ambiente", "UsuariosConcurrentes", "Criticidad", "RequiereHA",
             "RequiereDR", "Estado", "ProyectoId", "PayloadJson", "Motivo"]


def _num_sql(x: str) -> str:
    t = _trim_sql(x)
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN {t} = '' THEN 0.0 "
            f"WHEN regexp_matches({t}, '{_DEC_RE_SQL}') THEN TRY_CAST({t} AS DOUBLE) END)")


def _dec_sql(x: str, p: int, s: int) -> str:
    n = _num_sql(x)
    return f"(CASE WHEN abs({n}) < {10 ** (p - s)} THEN TRY_CAST({n} AS DECIMAL({p},{s})) END)"


def _trunc_sql(x: str) -> str:
    n = _num_sql(x)
    return f"(CASE WHEN {n} > -2147483649 AND {n} < 2147483648 THEN CAST(trunc({n}) AS INTEGER) END)"


@register("json_intake_infra", f"""
WITH b AS ({INFRA_BODIES.sql}), v AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS vb FROM b),
e AS (SELECT Ref, vb, json_extract(vb, '$.model') AS m FROM v),
f AS (SELECT Ref, vb, m,
        json_extract_string(m, '$.informacion_general.nombre_aplicacion') AS nom,
        json_extract_string(m, '$.informacion_general.identificador') AS ident FROM e)
SELECT Ref,
  COALESCE(substr(NULLIF(trim(vb->'sharepoint_row'->>'Título'), ''), 1, 300),
           CASE WHEN COALESCE(ident, '') <> '' THEN ident || ' – ' || COALESCE(nom, '') END,
           substr(NULLIF(trim(nom), ''), 1, 300)) AS Titulo,
  substr(NULLIF(trim(nom), ''), 1, 200) AS Aplicacion, substr(NULLIF(trim(ident), ''), 1, 100) AS Identificador,
  NULLIF(trim(json_extract_string(m, '$.informacion_general.proyecto')), '') AS Proyecto,
  TRY_CAST(json_extract_string(m, '$.informacion_general.fecha_produccion') AS DATE) AS FechaProduccion,
  {_dec_sql("json_extract_string(m, '$.computo_y_contenedores.cpu_total_vcpu')", 9, 2)} AS CPURequerida,
  {_dec_sql("json_extract_string(m, '$.computo_y_contenedores.ram_total_gb')", 9, 2)} AS RAMRequeridaGB,
  {_dec_sql("json_extract_string(m, '$.base_de_datos.almacenamiento_inicial_gb')", 12, 2)} AS StorageGB,
  {_dec_sql("json_extract_string(m, '$.base_de_datos.crecimiento_mensual_gb')", 12, 2)} AS CrecimientoMensualGB,
  {_trunc_sql("json_extract_string(m, '$.clasificacion_registro.usuarios_concurrentes')")} AS UsuariosConcurrentes,
  NULLIF(trim(json_extract_string(m, '$.clasificacion_registro.requiere_ha')), '') AS RequiereHA,
  NULLIF(trim(vb->'sharepoint_row'->>'FrontEnd'), '') AS FrontEnd,
  NULLIF(trim(json_extract_string(m, '$.clasificacion_registro.estado')), '') AS Estado,
  CAST({_trunc_sql("json_extract_string(m, '$.proyecto_id')")} AS BIGINT) AS ProyectoId,
  CAST(NULL AS VARCHAR) AS LiderProyecto, NULLIF(trim(json_extract_string(m, '$.informacion_general.descripcion')), '')
    AS Funcionalidad, 'Contenedores' AS ArquitecturaDespliegue, CAST(NULL AS VARCHAR) AS BackendAPI,
  'PostgreSQL' AS BaseDatos, CAST(NULL AS VARCHAR) AS ModeloDespliegueBD, CAST(NULL AS VARCHAR) AS DominioPublico,
  CAST(NULL AS VARCHAR) AS TipoAcceso, CAST(NULL AS VARCHAR) AS MetodoAutenticacion,
  CAST(NULL AS VARCHAR) AS NivelSensibilidad, 'QA' AS Ambiente, 'Alta' AS Criticidad, 'No' AS RequiereDR,
  json_extract(vb, '$.model')::VARCHAR AS PayloadJson,
  CASE WHEN vb IS NULL THEN 'json_invalido' WHEN NULLIF(trim(nom), '') IS NULL THEN 'faltan_obligatorios'
       WHEN json_extract_string(m, '$.base_de_datos.crecimiento_mensual_gb') = '1e12' THEN 'numero_fuera_de_rango' END
    AS Motivo
FROM f
""")
def q_json_intake_infra(spark, sf_dir):
    return intake.infra_requests(INFRA_BODIES.df(spark, sf_dir)).select(*INFRA_OUT)


# ------------------------------------------------------------------ I4 I5: project and task form bodies

PROJECT_BODIES = roles.Role("orders", (
    ("o_orderkey", "o_orderkey"),
    ("nombre", "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN '  ' "
               "ELSE ' Proyecto ' || CAST(o_orderkey AS STRING) END"),
    ("descripcion", "o_orderpriority"),
    ("responsable", "CASE WHEN o_orderstatus = 'O' THEN 'Customer#' || CAST(o_custkey AS STRING) END"),
    ("fechaInicio", "CAST(CAST(o_orderdate AS DATE) AS STRING)"),
    ("fechaFin", "CASE WHEN o_totalprice > 200000 THEN CAST(CAST(o_orderdate AS DATE) + 60 AS STRING) "
                 "ELSE 'pronto' END"),
    ("estado", "CASE WHEN o_orderstatus = 'F' THEN 'Completado' ELSE ' ' END"),
))


@register("project_intake", f"""
WITH d AS ({PROJECT_BODIES.sql})
SELECT o_orderkey, NULLIF(trim(nombre), '') AS Nombre, NULLIF(trim(descripcion), '') AS Descripcion,
       NULLIF(trim(responsable), '') AS Responsable, TRY_CAST(fechaInicio AS DATE) AS FechaInicio,
       TRY_CAST(fechaFin AS DATE) AS FechaFin, COALESCE(NULLIF(trim(estado), ''), 'Activo') AS Estado,
       {AS_OF_SQL} AS FechaRegistro, CASE WHEN NULLIF(trim(nombre), '') IS NULL THEN 'sin_nombre' END AS Motivo
FROM d
""")
def q_project_intake(spark, sf_dir):
    return intake.projects(PROJECT_BODIES.df(spark, sf_dir), AS_OF).select(
        "o_orderkey", "Nombre", "Descripcion", "Responsable", "FechaInicio", "FechaFin", "Estado", "FechaRegistro",
        "Motivo")


TASK_BODIES = roles.Role("lineitem", (
    ("Ref", roles.TASK_KEY),
    ("proyectoId", "CAST(l_orderkey AS STRING)"),
    ("nombre", "CASE WHEN l_linenumber = 6 THEN '' ELSE 'Tarea ' || CAST(l_linenumber AS STRING) END"),
    ("fechaInicio", "CAST(CAST(l_shipdate AS DATE) AS STRING)"),
    ("fechaFin", "CAST(CAST(l_shipdate AS DATE) + 3 AS STRING)"),
    ("progreso", "CASE WHEN l_linenumber = 5 THEN CAST(NULL AS STRING) "
                 "ELSE CAST(CAST(l_quantity * 3 - 20 AS BIGINT) AS STRING) || '%' END"),
    ("responsable", "CAST(NULL AS STRING)"),
    ("dependenciaId", "CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber - 1 AS STRING) END"),
    ("tareaPadreId", "CAST(NULL AS STRING)"),
    ("esHito", "CASE l_returnflag WHEN 'R' THEN 'true' WHEN 'A' THEN '\"1\"' ELSE '\"true\"' END"),
    ("orden", "CAST(l_linenumber AS STRING)"),
))


@register("task_intake", f"""
WITH d AS ({TASK_BODIES.sql}),
x AS (SELECT Ref, TRY_CAST(regexp_extract(proyectoId, '^([+-]?[0-9]+)', 1) AS BIGINT) AS ProyectoId,
             NULLIF(trim(nombre), '') AS Nombre, TRY_CAST(fechaInicio AS DATE) AS FechaInicio,
             TRY_CAST(fechaFin AS DATE) AS FechaFin,
             COALESCE(CASE WHEN TRY_CAST(regexp_extract(progreso, '^([+-]?[0-9]+)', 1) AS INTEGER) IS NOT NULL
                      THEN GREATEST(0, LEAST(100, TRY_CAST(regexp_extract(progreso, '^([+-]?[0-9]+)', 1) AS INTEGER)))
                      END, 0) AS Progreso,
             CAST(NULL AS VARCHAR) AS Responsable,
             TRY_CAST(regexp_extract(dependenciaId, '^([+-]?[0-9]+)', 1) AS BIGINT) AS DependenciaId,
             CAST(NULL AS BIGINT) AS TareaPadreId, esHito IN ('true', '1', '"1"') AS EsHito,
             TRY_CAST(orden AS INTEGER) AS Orden FROM d)
SELECT *, CASE WHEN COALESCE(ProyectoId, 0) = 0 THEN 'sin_proyecto' WHEN Nombre IS NULL THEN 'sin_nombre' END
  AS Motivo
FROM x
""")
def q_task_intake(spark, sf_dir):
    return intake.tasks(TASK_BODIES.df(spark, sf_dir, spread=True)).select(
        "Ref", "ProyectoId", "Nombre", "FechaInicio", "FechaFin", "Progreso", "Responsable", "DependenciaId",
        "TareaPadreId", "EsHito", "Orden", "Motivo")


# ------------------------------------------------------------------ P8 H14: attachment content by id

ATTACHMENT_CONTENT = roles.Role("documents", roles.ATTACHMENT_META + (
    ("Contenido", ("CAST(text AS BINARY)", "encode(text)")),
))


@register("attachment_content", f"""
WITH a AS ({ATTACHMENT_CONTENT.sql})
SELECT Id, regexp_replace(COALESCE(NULLIF(Nombre, ''), 'documento'), '[\\r\\n"]', '_', 'g') AS Archivo,
       COALESCE(ContentType, 'application/octet-stream') AS ContentType, Contenido
FROM a WHERE Id IN (SELECT doc_id FROM labels WHERE quality = 1)
""")
def q_attachment_content(spark, sf_dir):
    ids = roles.read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("Id"))
    return attachments.content_by_ids(ATTACHMENT_CONTENT.df(spark, sf_dir), ids)


# ------------------------------------------------------------------ P5 T5: project list

@register("project_list", f"WITH p AS ({roles.PROJECTS.sql}) SELECT * FROM p")
def q_project_list(spark, sf_dir):
    return portfolio.project_list(roles.PROJECTS.df(spark, sf_dir))


# ------------------------------------------------------------------ E2 / I2 + S4: create ERP requests end to end

from workboard import schemas  # noqa: E402

_ERP_COLS = roles.REQUESTS_ERP.names()


@register("erp_create", f"""
WITH x AS ({ORACLES["json_intake_erp"]}),
t AS ({roles.REQUESTS_ERP.sql})
SELECT (SELECT MAX(Id) FROM t) + row_number() OVER (ORDER BY Ref) AS Id, {AS_OF_SQL} AS FechaRegistro,
       Titulo, Solicitante, Area, Descripcion, Modulos, Procesos, TransformarFabric, FabricDetalle, Prioridad, Estado,
       CAST(NULL AS VARCHAR) AS Responsable, CAST(NULL AS DATE) AS FechaEntrega,
       CAST(NULL AS TIMESTAMP) AS FechaActualizacion, PayloadJson, ProyectoId, Ref
FROM x WHERE Motivo IS NULL
""")
def q_erp_create(spark, sf_dir):
    typed = intake.erp_requests(ERP_BODIES.df(spark, sf_dir)).drop("body")
    new, _ = intake.create(roles.REQUESTS_ERP.df(spark, sf_dir), typed, schemas.REQUESTS_ERP, [F.col("Ref")],
                           as_of=AS_OF, keep=["Ref"])
    return new


@register("project_create", f"""
WITH x AS ({ORACLES["project_intake"]}), p AS ({roles.PROJECTS.sql})
SELECT (SELECT MAX(Id) FROM p) + row_number() OVER (ORDER BY o_orderkey) AS Id, Nombre, Descripcion, Responsable,
       FechaInicio, FechaFin, Estado, FechaRegistro, o_orderkey
FROM x WHERE Motivo IS NULL
""")
def q_project_create(spark, sf_dir):
    typed = intake.projects(PROJECT_BODIES.df(spark, sf_dir), AS_OF)
    new, _ = intake.create(roles.PROJECTS.df(spark, sf_dir), typed, schemas.PROJECTS, [F.col("o_orderkey")],
                           as_of=AS_OF, keep=["o_orderkey"])
    return new


# ------------------------------------------------------------------ R4: stream intake (accepted rows)

_ERP_OUT = ["Ref", "Titulo", "Solicitante", "Area", "Descripcion", "Modulos", "Procesos", "TransformarFabric",
            "FabricDetalle", "Prioridad", "Estado", "ProyectoId", "PayloadJson"]


@register("stream_intake", f"WITH x AS ({ORACLES['json_intake_erp']}) SELECT {', '.join(_ERP_OUT)} FROM x "
                           "WHERE Motivo IS NULL")
def q_stream_intake(spark, sf_dir):
    root = fresh_path(shared_root(spark), "stream-intake")
    # the bodies Spark derives from customer rows land as files, as the portal's POST bodies would
    ERP_BODIES.df(spark, sf_dir).write.parquet(f"{root}/in")
    src = spark.readStream.schema("Ref BIGINT, body STRING").parquet(f"{root}/in")
    q = stream_apply.intake_stream(src, lambda b: intake.erp_requests(b).drop("body"), f"{root}/accepted",
                                   f"{root}/rejects", f"{root}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/accepted").select(*_ERP_OUT)


# ------------------------------------------------------------------ T2–T5: positions in the ordered lists

_position("release_board", search.release_order, "FechaPlanificada ASC NULLS LAST, Id DESC")
_position("task_list", lambda: [F.col("ProyectoId"), *search.task_order()],
          "ProyectoId, COALESCE(Orden, 9999), FechaInicio ASC NULLS FIRST, Id")
_position("notes_for_request", lambda: [F.col("Fecha").desc(), F.col("Id").desc()], "Fecha DESC, Id DESC")
_position("attachment_metadata", lambda: [F.col("Fecha").desc(), F.col("Id").desc()], "Fecha DESC, Id DESC")
_position("project_list", lambda: [F.col("Nombre"), F.col("Id")], "Nombre, Id")


# ------------------------------------------------------------------ rejects of the creates

@register("erp_create_rejects", f"SELECT Ref, Motivo FROM ({ORACLES['json_intake_erp']}) x WHERE Motivo IS NOT NULL")
def q_erp_create_rejects(spark, sf_dir):
    typed = intake.erp_requests(ERP_BODIES.df(spark, sf_dir)).drop("body")
    return intake.create(roles.REQUESTS_ERP.df(spark, sf_dir), typed, schemas.REQUESTS_ERP, [F.col("Ref")],
                         as_of=AS_OF, keep=["Ref"])[1].select("Ref", "Motivo")


@register("project_create_rejects",
          f"SELECT o_orderkey, Motivo FROM ({ORACLES['project_intake']}) x WHERE Motivo IS NOT NULL")
def q_project_create_rejects(spark, sf_dir):
    typed = intake.projects(PROJECT_BODIES.df(spark, sf_dir), AS_OF)
    return intake.create(roles.PROJECTS.df(spark, sf_dir), typed, schemas.PROJECTS, [F.col("o_orderkey")],
                         as_of=AS_OF, keep=["o_orderkey"])[1].select("o_orderkey", "Motivo")


# ------------------------------------------------------------------ I1 I3 I5 I6 I7 + S4: the other creates end to end

def _created(name: str, intake_oracle: str, base_sql: str, order: str, cols: list, nulls: dict):
    """The create's oracle: accepted rows with ids after the largest one, in ``order``."""
    rest = ", ".join(f"{v} AS {k}" for k, v in nulls.items())
    return (f"SELECT (SELECT COALESCE(MAX(Id), 0) FROM ({base_sql})) + row_number() OVER (ORDER BY {order}) AS Id, "
            f"{', '.join(cols)}{', ' + rest if rest else ''}, {order} FROM ({intake_oracle}) x WHERE Motivo IS NULL")


_TRACK_NULLS = {"FechaRegistro": AS_OF_SQL, "Responsable": "CAST(NULL AS VARCHAR)", "FechaEntrega": "CAST(NULL AS DATE)",
                "FechaActualizacion": "CAST(NULL AS TIMESTAMP)"}
_GENERAL_CREATE = [c for c in roles.REQUESTS_GENERAL.names() if c != "Id" and c not in _TRACK_NULLS]


@register("infra_create", _created("infra_create", ORACLES["json_intake_infra"], roles.REQUESTS_INFRA.sql, "Ref",
                                   [c for c in INFRA_OUT if c not in ("Ref", "Motivo")], _TRACK_NULLS))
def q_infra_create(spark, sf_dir):
    typed = intake.infra_requests(INFRA_BODIES.df(spark, sf_dir)).drop("body")
    return intake.create(roles.REQUESTS_INFRA.df(spark, sf_dir), typed, schemas.REQUESTS_INFRA, [F.col("Ref")],
                         as_of=AS_OF, keep=["Ref"])[0]


@register("general_create", _created("general_create", ORACLES["json_intake_general"], roles.REQUESTS_GENERAL.sql, "Ref",
                                     _GENERAL_CREATE, _TRACK_NULLS))
def q_general_create(spark, sf_dir):
    typed = intake.general_requests(GEN_BODIES.df(spark, sf_dir)).drop("body")
    return intake.create(roles.REQUESTS_GENERAL.df(spark, sf_dir), typed, schemas.REQUESTS_GENERAL, [F.col("Ref")],
                         as_of=AS_OF, keep=["Ref"])[0]


@register("note_create", _created("note_create", ORACLES["note_intake"], roles.NOTES.sql, "event_id",
                                  ["Tipo", "SolicitudId", "Nota", "Autor", "Fecha"], {}))
def q_note_create(spark, sf_dir):
    typed = intake.notes(NOTE_BODIES.df(spark, sf_dir), AS_OF)
    return intake.create(roles.NOTES.df(spark, sf_dir), typed, schemas.NOTES, [F.col("event_id")], stamp_col=None,
                         keep=["event_id"])[0]


#: A table with numeric task ids, after which new ids continue.
_TASK_IDS = roles.Role("lineitem", (("Id", "l_orderkey"),))


@register("task_create", _created("task_create", ORACLES["task_intake"], _TASK_IDS.sql, "Ref",
                                  ["ProyectoId", "Nombre", "FechaInicio", "FechaFin", "Progreso", "Responsable",
                                   "DependenciaId", "TareaPadreId", "EsHito", "Orden"],
                                  {"FechaActualizacion": "CAST(NULL AS TIMESTAMP)"}))
def q_task_create(spark, sf_dir):
    typed = intake.tasks(TASK_BODIES.df(spark, sf_dir, spread=True))
    return intake.create(_TASK_IDS.df(spark, sf_dir), typed, schemas.TASKS, [F.col("Ref")], stamp_col=None,
                         keep=["Ref"])[0]


@register("attachment_create", f"""
SELECT (SELECT MAX(Id) FROM ({roles.ATTACHMENTS.sql})) + row_number() OVER (ORDER BY Ref) AS Id, Tipo, SolicitudId,
       x.Nombre, ContentType, Tamano, encode(d.text) AS Contenido, d.source AS Autor, {AS_OF_SQL} AS Fecha, Ref
FROM ({ORACLES["attachment_decode"]}) x JOIN documents d ON d.doc_id = x.Ref WHERE Motivo IS NULL
""")
def q_attachment_create(spark, sf_dir):
    typed = attachments.intake(UPLOADS.df(spark, sf_dir)).drop("original", "base64")
    return intake.create(roles.ATTACHMENTS.df(spark, sf_dir), typed, schemas.ATTACHMENTS, [F.col("Ref")], as_of=AS_OF,
                         stamp_col="Fecha", keep=["Ref"])[0]


# ------------------------------------------------------------------ X3 X5: deletes one after the other

from pyspark.sql import Window  # noqa: E402

from workboard.operators import ordered_deletes  # noqa: E402
from workboard.streaming import state as stream_state  # noqa: E402

# Plans of two shapes by project: chains of four (each task under the one before) and a phase with all others under it.
_DEEP_PLAN_SQL = f"""
SELECT Id, ProyectoId, pos, CASE WHEN ProyectoId % 2 = 0 THEN CASE WHEN pos % 4 <> 1 THEN antes END WHEN Id <> fase THEN fase END AS TareaPadreId
FROM (SELECT Id, ProyectoId, row_number() OVER (PARTITION BY ProyectoId ORDER BY Id) AS pos,
             lag(Id) OVER (PARTITION BY ProyectoId ORDER BY Id) AS antes, MIN(Id) OVER (PARTITION BY ProyectoId) AS fase
      FROM ({roles.TASKS.sql}) t0) t1
"""

# Per project: children first, parents first with a second try for the first task, or children first with a gap.
_DEEP_SEQ = "CASE WHEN ProyectoId % 3 = 1 THEN pos ELSE 100 - pos END"
_DEEP_REQUESTS = (
    ("Id", _DEEP_SEQ, "NOT (ProyectoId % 3 = 2 AND pos = 3)"),
    ("Id", "200", "ProyectoId % 3 = 1 AND pos = 1"),
    ("'-' || Id", "50", "pos = 2"),
)


def _deep_plan(spark, sf_dir):
    whole = Window.partitionBy("ProyectoId")
    keys = roles.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    ids = [f"{roles.spark_expr(e)} AS {n}" for n, e in roles.TASKS.cols if n in ("Id", "ProyectoId")]
    t = keys.repartition("l_orderkey").selectExpr(*ids).withColumns({  # the narrow key columns travel, not the id's text
        "pos": F.row_number().over(whole.orderBy("Id")), "antes": F.lag("Id").over(whole.orderBy("Id")), "fase": F.min("Id").over(whole)})
    up = (F.when(F.col("ProyectoId") % 2 == 0, F.when(F.col("pos") % 4 != 1, F.col("antes")))
          .when(F.col("Id") != F.col("fase"), F.col("fase")))
    return t.withColumn("TareaPadreId", up).drop("antes", "fase")


def _delete_in_order(spark, sf_dir):
    plan = cut(_deep_plan(spark, sf_dir), "deep-plan")
    asked = ", ".join(f"IF({w}, named_struct('Id', {i}, 'seq', CAST({q} AS BIGINT)), NULL)" for i, q, w in _DEEP_REQUESTS)
    requests = plan.selectExpr(f"explode(array_compact(array({asked}))) AS r").select("r.*")
    return ordered_deletes.delete_tasks_in_order(plan.drop("pos"), requests)


# One request at a time, as the portal does: what is left of each project after each of its requests.
_DELETE_STEPS_SQL = f"""
WITH RECURSIVE plan AS ({_DEEP_PLAN_SQL}),
asked AS ({' UNION ALL '.join(f"SELECT ProyectoId, {i} AS Id, CAST({q} AS BIGINT) AS seq FROM plan WHERE {w}" for i, q, w in _DEEP_REQUESTS)}),
turns AS (SELECT *, row_number() OVER (PARTITION BY ProyectoId ORDER BY seq) AS k FROM asked),
steps(ProyectoId, k, quedan, Id, seq, outcome) AS (
  SELECT ProyectoId, CAST(0 AS BIGINT), list({{'id': Id, 'up': TareaPadreId}}), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT),
         CAST(NULL AS VARCHAR) FROM plan GROUP BY ProyectoId
  UNION ALL
  SELECT ProyectoId, k, CASE WHEN outcome = 'deleted' THEN list_filter(quedan, lambda x: x.id <> Id) ELSE quedan END, Id, seq, outcome
  FROM (SELECT t.ProyectoId, t.k, s.quedan, t.Id, t.seq,
               CASE WHEN len(list_filter(s.quedan, lambda x: x.id = t.Id)) = 0 THEN 'missing'
                    WHEN len(list_filter(s.quedan, lambda x: x.up = t.Id)) > 0 THEN 'blocked' ELSE 'deleted' END AS outcome
        FROM steps s JOIN turns t ON t.ProyectoId = s.ProyectoId AND t.k = s.k + 1))
"""


@register("delete_task_ordered", f"{_DELETE_STEPS_SQL} SELECT Id, seq, outcome FROM steps WHERE k > 0")
def q_delete_task_ordered(spark, sf_dir):
    return _delete_in_order(spark, sf_dir)[1]


@register("delete_task_ordered_tasks", f"{_DELETE_STEPS_SQL} SELECT Id, ProyectoId, TareaPadreId FROM plan "
                                       "WHERE Id NOT IN (SELECT Id FROM steps WHERE outcome = 'deleted')")
def q_delete_task_ordered_tasks(spark, sf_dir):
    return _delete_in_order(spark, sf_dir)[0]


# ------------------------------------------------------------------ S4 in R4: ids assigned by a stream

@register("stream_create", ORACLES["erp_create"])
def q_stream_create(spark, sf_dir):
    """Bodies land in three parts; the stream is stopped and started between them and goes on with its ids."""
    root = fresh_path(shared_root(spark), "stream-create")
    bodies, target = ERP_BODIES.df(spark, sf_dir), roles.REQUESTS_ERP.df(spark, sf_dir)
    most = bodies.select(F.max("Ref")).scalar()
    for part in range(3):
        here = (F.col("Ref") > most * part / 3) & (F.col("Ref") <= most * (part + 1) / 3)
        bodies.where(here if part else here | (F.col("Ref") <= 0)).write.parquet(f"{root}/in/part={part}")
        src = spark.readStream.schema("Ref BIGINT, body STRING").parquet(f"{root}/in/*")
        stream_apply.create_stream(
            src, lambda b: intake.erp_requests(b).drop("body"), schemas.REQUESTS_ERP, [F.col("Ref")], f"{root}/accepted",
            f"{root}/rejects", f"{root}/marks", f"{root}/checkpoint", lambda: target.agg(F.max("Id")).first()[0], AS_OF,
            keep=["Ref"]).awaitTermination()
    return spark.read.schema(f"{schemas.REQUESTS_ERP}, Ref BIGINT").parquet(f"{root}/accepted").drop("batch")


# ------------------------------------------------------------------ R4: state by base and tail

_TRACKING_LOG = "Id BIGINT, seq BIGINT, Estado STRING, Responsable STRING, FechaEntrega DATE, batch BIGINT"


def _tracking_bodies(spark, sf_dir):
    raw = TRACKING_CHANGES.df(spark, sf_dir)
    return raw.select("id", "seq", F.to_json(F.struct("estado", "responsable", "fechaEntrega")).alias("body"))


def _tracking_log(spark, sf_dir, after_batch):
    """The tracking feed in three parts, newest changes first, so that later batches hold older changes."""
    root = fresh_path(shared_root(spark), "stream-state")
    bodies = _tracking_bodies(spark, sf_dir)
    most = bodies.select(F.max("seq")).scalar()
    for part in (2, 1, 0):
        here = (F.col("seq") > most * part / 3) & (F.col("seq") <= most * (part + 1) / 3)
        bodies.where(here if part else here | (F.col("seq") <= 0)).write.parquet(f"{root}/in/part={part}")
        src = spark.readStream.schema("id BIGINT, seq BIGINT, body STRING").parquet(f"{root}/in/*")
        stream_apply.change_log_stream(src, intake.tracking_changes, f"{root}/log", f"{root}/checkpoint",
                                       rejects_path=f"{root}/rejects").awaitTermination()
        after_batch(root, stream_apply.read_log(spark, f"{root}/log", _TRACKING_LOG))
    return root


@register("stream_state", ORACLES["tracking_patch"])
def q_stream_state(spark, sf_dir):
    """A base is written after every batch but the last, whose changes are read from the tail."""
    initial, bases = roles.REQUESTS_ERP.df(spark, sf_dir), []

    def base(root, log):
        if len(bases) < 2:
            bases.append(stream_state.write_base(initial, log, f"{root}/bases", f"{root}/index", changes.TRACKING_POLICY, AS_OF))

    root = _tracking_log(spark, sf_dir, base)
    log = stream_apply.read_log(spark, f"{root}/log", _TRACKING_LOG)
    return stream_state.read_state(initial, log, f"{root}/index", changes.TRACKING_POLICY, AS_OF)


@register("stream_change_rejects", f"SELECT id AS Id, seq, 'falta_id' AS Motivo FROM ({TRACKING_CHANGES.sql}) WHERE id = 0")
def q_stream_change_rejects(spark, sf_dir):
    root = _tracking_log(spark, sf_dir, lambda root, log: None)
    return stream_apply.read_log(spark, f"{root}/rejects", "Id BIGINT, seq BIGINT, Motivo STRING, batch BIGINT").select("Id", "seq", "Motivo")


# ------------------------------------------------------------------ H26: list members collected as the form does

_LISTS = ("CASE c_custkey % 5 WHEN 0 THEN '[\" Contabilidad \",\"\",\"   \",\"Compras\"]' WHEN 1 THEN '[\"  Ventas\"]' WHEN 2 THEN '[\"  \"]' "
          "WHEN 3 THEN '\" suelto \"' ELSE '[null, \" ' || c_mktsegment || '\"]' END")
LIST_BODIES = roles.Role("customer", (
    ("Ref", "c_custkey"),
    ("segmento", "c_mktsegment"),
    ("body", f"'{{\"solicitante\":\"x\",\"area\":\"TI\",\"asunto\":\"a\",\"descripcion\":\"d\",\"modulos\":' || {_LISTS} || "
             f"',\"procesos\":' || {_LISTS} || ',\"ambito\":' || {_LISTS} || '}}'"),
))


def _collected_sql(sep: str) -> str:
    return (f"CASE Ref % 5 WHEN 0 THEN 'Contabilidad{sep}Compras' WHEN 1 THEN 'Ventas' WHEN 2 THEN '' WHEN 3 THEN 'suelto' "
            "ELSE segmento END")


@register("list_collect", f"""
SELECT Ref, {_collected_sql(', ')} AS Modulos, {_collected_sql(' | ')} AS Procesos, {_collected_sql(', ')} AS Ambito
FROM ({LIST_BODIES.sql})
""")
def q_list_collect(spark, sf_dir):
    bodies = LIST_BODIES.df(spark, sf_dir)
    erp = intake.erp_requests(bodies, collect=True).select("Ref", "Modulos", "Procesos")
    return erp.join(intake.general_requests(bodies, collect=True).select("Ref", "Ambito"), "Ref")


# ------------------------------------------------------------------ S1: a table of older files by its declared schema

STORED_PROJECTS = roles.Role("orders", (
    ("Id", "CASE WHEN o_orderkey % 40 = 7 THEN 'x' ELSE '' END || CAST(o_orderkey AS STRING)"),
    ("Nombre", "CASE WHEN o_orderkey % 30 <> 3 THEN 'P-' || CAST(o_orderkey AS STRING) END"),
    ("FechaInicio", "CASE WHEN o_orderkey % 25 = 4 THEN 'pronto' WHEN o_orderkey % 25 <> 5 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END"),
    ("FechaFin", "CAST(o_orderdate AS DATE)"),
    ("FechaRegistro", "CAST(o_orderdate AS TIMESTAMP_NTZ)"),
    ("Sobrante", "o_orderpriority"),
))
_STORED_SQL = f"""
SELECT *, CASE WHEN Id LIKE 'x%' THEN 'tipo_invalido:Id' WHEN Nombre IS NULL THEN 'nulo:Nombre'
               WHEN FechaInicio = 'pronto' THEN 'tipo_invalido:FechaInicio' END AS Motivo FROM ({STORED_PROJECTS.sql})
"""


def _stored_projects(spark, sf_dir):
    path = fresh_path(shared_root(spark), "stored-projects")
    STORED_PROJECTS.df(spark, sf_dir).write.parquet(path)
    return tables.scan_table(spark, path, schemas.PROJECTS, {"Estado": "Activo"})


@register("table_scan", f"""
SELECT CAST(Id AS BIGINT) AS Id, Nombre, CAST(NULL AS VARCHAR) AS Descripcion, CAST(NULL AS VARCHAR) AS Responsable,
       CAST(FechaInicio AS DATE) AS FechaInicio, FechaFin, 'Activo' AS Estado, FechaRegistro
FROM ({_STORED_SQL}) WHERE Motivo IS NULL
""")
def q_table_scan(spark, sf_dir):
    return _stored_projects(spark, sf_dir)[0]


@register("table_scan_rejects", f"SELECT * FROM ({_STORED_SQL}) WHERE Motivo IS NOT NULL")
def q_table_scan_rejects(spark, sf_dir):
    return _stored_projects(spark, sf_dir)[1]


# ------------------------------------------------------------------ S3: landed directory pages

PAGE_USERS = replace(DIRECTORY_USERS, cols=DIRECTORY_USERS.cols + (("pagina", "CAST(floor(c_custkey / 50) AS BIGINT)"),))


def _landed_pages(spark, sf_dir):
    """Pages of 50 users as JSON lines; some are cut off, some are the directory's error answers."""
    path, page = fresh_path(shared_root(spark), "directory-pages"), F.col("pagina")
    user = F.struct("displayName", "mail", "userPrincipalName", "jobTitle")
    pages = (PAGE_USERS.df(spark, sf_dir).groupBy("pagina").agg(F.collect_list(user).alias("value"))
             .withColumn("texto", F.to_json(F.struct("pagina", "value"))))
    cut_off = F.substring("texto", 1, F.length("texto") - 20)
    answer = F.concat(F.lit('{"pagina":'), page.cast("string"), F.lit(',"error":{"code":"TooManyRequests"}}'))
    pages.select(F.when(page % 7 == 2, cut_off).when(page % 7 == 4, answer).otherwise(F.col("texto")).alias("value")).write.text(path)
    return directory.landed_pages(spark, path)


@register("directory_pages", ORACLES["directory_members"].replace(
    f"({DIRECTORY_USERS.sql})", f"(SELECT * FROM ({PAGE_USERS.sql}) WHERE pagina % 7 NOT IN (2, 4))"))
def q_directory_pages(spark, sf_dir):
    return directory.sorted_members(_landed_pages(spark, sf_dir)[0], DIRECTORY_DOMAIN)


@register("directory_page_rejects", f"""
SELECT DISTINCT CAST(pagina AS VARCHAR) AS Pagina, CASE WHEN pagina % 7 = 2 THEN 'pagina_invalida' ELSE 'error_del_directorio' END AS Motivo
FROM ({PAGE_USERS.sql}) WHERE pagina % 7 IN (2, 4)
""")
def q_directory_page_rejects(spark, sf_dir):
    rejects = _landed_pages(spark, sf_dir)[1]
    return rejects.select(F.regexp_extract("Texto", '"pagina":([0-9]+)', 1).alias("Pagina"), "Motivo")


# ------------------------------------------------------------------ T6: the Spanish order

_FIRST_NAMES = ("Ñandú", "ñora", "Nube", "nz", "Álvaro", "alba", "Azul", "Óscar", "oso", "Pérez", "perez", "Zoé", "Zacarías")
ACCENTED_USERS = roles.Role("customer", (
    ("displayName", f"CASE c_custkey % {len(_FIRST_NAMES)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_FIRST_NAMES))
     + " END || ' ' || CAST(c_custkey % 97 AS STRING)"),
    ("mail", "'u' || CAST(c_custkey AS STRING) || '@example.com'"),
    ("userPrincipalName", "CAST(NULL AS STRING)"),
    ("jobTitle", "c_mktsegment"),
))


@register("directory_order", f"""
SELECT displayName AS name, mail AS email, jobTitle, row_number() OVER (ORDER BY displayName COLLATE es, mail) AS Posicion
FROM ({ACCENTED_USERS.sql})
""")
def q_directory_order(spark, sf_dir):
    return directory.ranked_members(ACCENTED_USERS.df(spark, sf_dir), DIRECTORY_DOMAIN)
