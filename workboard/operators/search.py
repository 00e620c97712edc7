"""Lists, optional filters, text search, top-k, lookups by key, and the unified request feed.

Filters are plain Column predicates, so equality filters reach the parquet scan (``PushedFilters``); the
case-insensitive search (``ilike``) is evaluated after the scan, hence equality predicates are applied first. The
bounded lists become ``TakeOrderedAndProject`` (each task keeps its local top 500, one merge) — no global sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.schemas import KINDS

# List projections of the portal (column sets and their order).
INFRA_LIST = ["Id", "FechaRegistro", "Titulo", "Aplicacion", "Identificador", "Proyecto", "LiderProyecto",
              "Ambiente", "Criticidad", "CPURequerida", "RAMRequeridaGB", "StorageGB", "Estado", "Responsable",
              "FechaEntrega", "FechaActualizacion"]
ERP_LIST = ["Id", "FechaRegistro", "Titulo", "Solicitante", "Area", "Modulos", "TransformarFabric", "Prioridad",
            "Estado", "Responsable", "FechaEntrega", "FechaActualizacion"]
GENERAL_LIST = ["Id", "FechaRegistro", "Titulo", "Solicitante", "Area", "Ambito", "Prioridad", "Estado",
                "Responsable", "FechaEntrega", "FechaActualizacion"]
RELEASE_LIST = ["Id", "Tipo", "SolicitudId", "Titulo", "FechaPlanificada", "VentanaInicio", "VentanaFin",
                "Responsable", "Aprobador", "Estado", "DocArquitectura", "DocFuncional", "DocSoporte", "Induccion",
                "FechaActualizacion"]
TASK_LIST = ["Id", "ProyectoId", "Nombre", "FechaInicio", "FechaFin", "Progreso", "Responsable", "DependenciaId",
             "TareaPadreId", "EsHito", "Orden"]
NOTE_LIST = ["Id", "Tipo", "SolicitudId", "Nota", "Autor", "Fecha"]
ATTACHMENT_LIST = ["Id", "Nombre", "ContentType", "Tamano", "Autor", "Fecha"]

# The four columns searched by the text filter of each request list.
SEARCH_COLS = {
    "infra": ["Aplicacion", "Proyecto", "Titulo", "Identificador"],
    "erp": ["Titulo", "Solicitante", "Area", "Modulos"],
    "gen": ["Titulo", "Solicitante", "Area", "Ambito"],
}
LIST_COLS = {"infra": INFRA_LIST, "erp": ERP_LIST, "gen": GENERAL_LIST}

#: The portal's own bound of a request list, for callers that want it.
LIST_LIMIT = 500


def parse_int_param(value) -> int | None:
    """``parseInt(v, 10)`` for a filter parameter; blank → None; non-numeric raises ``ValueError``."""
    if value is None:
        return None
    s = str(value).strip()
    if s == "":
        return None
    sign = -1 if s[:1] == "-" else 1
    s = s[1:] if s[:1] in "+-" else s
    digits = ""
    for ch in s:
        if ch not in "0123456789":  # isdigit() would let other digits through
            break
        digits += ch
    if not digits:
        raise ValueError(f"not an integer: {value!r}")
    return sign * int(digits)


def optional_filters(**eq) -> Column:
    """AND of ``col == value`` for every supplied (non-empty) value; ``lit(True)`` when none are supplied."""
    preds = [F.col(c) == F.lit(v) for c, v in eq.items() if v is not None and v != ""]
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def text_search(q: str | None, cols: list[str], lowered: bool = False) -> Column:
    """P10: one ``%q%`` pattern OR-ed over ``cols``, case-insensitive. ``%``/``_`` in ``q`` stay wildcards; a
    backslash is literal (the source pattern language has no escape character; Spark's default escape is the
    backslash, so it is doubled here).

    ``lowered=True`` means ``cols`` are stored lower-case copies of hot search columns (write them with the table):
    the filter then becomes ``contains``, which parquet receives as a pushed ``StringContains``.
    """
    if not q:
        return F.lit(True)
    if lowered and "%" not in q and "_" not in q:
        # ``cols`` hold stored lower-case copies: a plain substring test reaches parquet as ``StringContains``
        needle = q.lower()
        # (no coalesce: inside a filter null already rejects the row, and a bare predicate can be pushed down)
        return reduce(lambda a, b: a | b, [F.col(c).contains(needle) for c in cols])
    pat = "%" + q.replace("\\", "\\\\") + "%"
    if lowered:
        return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).like(pat.lower()), F.lit(False)) for c in cols])
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(pat), F.lit(False)) for c in cols])


def list_requests(requests: DataFrame, kind: str, estado: str | None = None, q: str | None = None,
                  proyecto_id=None, *, limit: int | None) -> DataFrame:
    """P1–P3 + P9 + P10 + T1: the request list of one kind, newest id first.

    ``limit`` must be given: a number of rows (T1; the portal shows ``LIST_LIMIT``), or None for all matches.
    """
    pid = parse_int_param(proyecto_id)
    found = (requests
             .where(optional_filters(Estado=estado, ProyectoId=pid))
             .where(text_search(q, SEARCH_COLS[kind]))
             .select(*LIST_COLS[kind])
             .orderBy(F.col("Id").desc()))
    return found if limit is None else found.limit(limit)


def valid_ids(ids: DataFrame, col: str = "Id") -> DataFrame:
    """P7 id validity: null and 0 are invalid (falsy) and never looked up."""
    return ids.where(F.col(col).isNotNull() & (F.col(col) != 0))


def by_id(table: DataFrame, id_value) -> DataFrame:
    """The full row for one id (empty when missing)."""
    i = parse_int_param(id_value)
    if not i:
        raise ValueError(f"invalid id: {id_value!r}")
    return table.where(F.col("Id") == F.lit(i))


def by_ids(table: DataFrame, ids: DataFrame, col: str = "Id") -> DataFrame:
    """P7 bulk form: rows whose id is in ``ids`` (left semi join; AQE broadcasts the key side when it is small)."""
    keys = valid_ids(ids.select(F.col(col).alias("Id")))
    return table.join(keys, "Id", "left_semi")


def valid_kind(c: str = "Tipo") -> Column:
    """Request kind is one of the three known kinds."""
    return F.coalesce(F.col(c).isin(*KINDS), F.lit(False))


def by_request_key(table: DataFrame, tipo: str, solicitud_id) -> DataFrame:
    """Children of one request ``(Tipo, SolicitudId)``."""
    sid = parse_int_param(solicitud_id)
    if tipo not in KINDS or not sid:
        raise ValueError("missing or invalid tipo/solicitudId")
    return table.where((F.col("Tipo") == tipo) & (F.col("SolicitudId") == sid))


def by_request_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    """P11 bulk form: semi join on the composite key, invalid kinds and ids dropped from the key side."""
    k = keys.select("Tipo", "SolicitudId").where(valid_kind() & (F.col("SolicitudId") != 0))
    return table.join(k, ["Tipo", "SolicitudId"], "left_semi")


def newest_first(df: DataFrame) -> DataFrame:
    """T4: newest first with id tie-break (notes, attachments)."""
    return df.orderBy(F.col("Fecha").desc(), F.col("Id").desc())


def notes_list(notes: DataFrame, keys: DataFrame) -> DataFrame:
    """P5 + P11 + T4: notes of the given requests."""
    return newest_first(by_request_keys(notes, keys).select(*NOTE_LIST))


def attachments_list(attachments: DataFrame, keys: DataFrame) -> DataFrame:
    """P6 + P11 + T4: attachment metadata only — the bytes column is never read (parquet column pruning)."""
    return newest_first(by_request_keys(attachments, keys).select(*ATTACHMENT_LIST))


def task_order() -> list[Column]:
    """``ISNULL(Orden, 9999)``, start date (nulls first), id."""
    return [F.coalesce(F.col("Orden"), F.lit(9999)), F.col("FechaInicio").asc_nulls_first(), F.col("Id")]


def tasks_of(tasks: DataFrame, proyecto_id) -> DataFrame:
    """P13 + T3: tasks of one project in plan order."""
    pid = parse_int_param(proyecto_id)
    if not pid:
        raise ValueError("missing proyectoId")
    return tasks.where(F.col("ProyectoId") == pid).select(*TASK_LIST).orderBy(*task_order())


def tasks_of_projects(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """P13 bulk form: tasks of a set of projects, ordered by project then plan order.

    The global ``orderBy`` is range-partitioned, so a project holding a large share of the tasks is split over
    several ranges instead of landing in one task.
    """
    keys = projects.select(F.col("Id").alias("ProyectoId"))
    return (tasks.join(keys, "ProyectoId", "left_semi").select(*TASK_LIST)
            .orderBy(F.col("ProyectoId"), *task_order()))


def release_order() -> list[Column]:
    """Dated first, date ascending, then newest id."""
    return [F.col("FechaPlanificada").asc_nulls_last(), F.col("Id").desc()]


# Columns shared by the three request tables (the unified feed).
FEED_COLS = ["Id", "FechaRegistro", "Titulo", "Estado", "Responsable", "FechaEntrega", "FechaActualizacion",
             "ProyectoId"]


def request_feed(infra: DataFrame, erp: DataFrame, general: DataFrame) -> DataFrame:
    """The three request tables as one feed with an explicit ``Tipo`` (a union — no shuffle)."""
    parts = [df.select(F.lit(k).alias("Tipo"), *FEED_COLS) for k, df in (("infra", infra), ("erp", erp),
                                                                          ("gen", general))]
    return reduce(lambda a, b: a.unionByName(b), parts)
