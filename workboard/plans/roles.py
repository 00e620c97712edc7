"""Bindings of the driver's test tables to the portal's table roles.

A role is a projection (plus an optional slice predicate) of one test table into a reference-shaped table. Each
column is written once as an SQL expression that both Spark SQL and DuckDB accept; Spark runs it through
``selectExpr`` (so Catalyst prunes and pushes it into the parquet scan) and the oracles inline the same text as a
CTE. Only ``TIMESTAMP_NTZ`` needs translating (DuckDB's ``TIMESTAMP`` is already zone-less).

Roles: project = ``orders``; task = ``lineitem`` (progress = ``l_quantity*2``, milestone = return flag ``R``);
request = ``events`` (three kinds sliced by event type); release = ``orders``; note = ``conversations``;
attachment = ``documents``; directory member = ``customer``. Nulls are planted with ``CASE``/``NULLIF`` on data values
so every optional path of the operators is exercised.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duck(expr) -> str:
    if isinstance(expr, tuple):  # (Spark expression, DuckDB expression) where the dialects differ
        return expr[1]
    return expr.replace("TIMESTAMP_NTZ", "TIMESTAMP")


def spark_expr(expr) -> str:
    return expr[0] if isinstance(expr, tuple) else expr


@dataclass(frozen=True)
class Role:
    table: str
    cols: tuple  # ((name, shared SQL expression), ...)
    where: str | None = None
    extra: dict = field(default_factory=dict)

    def df(self, spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
        """``spread``: rows are dealt out over tasks as stored, for work that is much dearer than reading a row group."""
        d = read(spark, sf_dir, self.table)
        if self.where:
            d = d.where(self.where)
        if spread:
            d = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return d.selectExpr(*[f"{spark_expr(e)} AS {n}" for n, e in self.cols])

    @property
    def sql(self) -> str:
        body = ", ".join(f"{duck(e)} AS {n}" for n, e in self.cols)
        w = f" WHERE {duck(self.where)}" if self.where else ""
        return f"SELECT {body} FROM {self.table}{w}"

    def names(self) -> list[str]:
        return [n for n, _ in self.cols]


# ---------------------------------------------------------------- projects (orders)

PROJECTS = Role("orders", (
    ("Id", "o_orderkey"),
    ("Nombre", "'P-' || CAST(o_orderkey AS STRING)"),
    ("Descripcion", "o_orderpriority"),
    ("Responsable", "CASE WHEN o_orderpriority <> '5-LOW' THEN 'Customer#' || CAST(o_custkey AS STRING) END"),
    ("FechaInicio", "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(o_orderdate AS DATE) END"),
    ("FechaFin", "CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '3-MEDIUM') "
                 "THEN CAST(o_orderdate AS DATE) + 90 END"),
    ("Estado", "CASE o_orderstatus WHEN 'O' THEN 'Activo' WHEN 'F' THEN 'Completado' ELSE 'En pausa' END"),
    ("FechaRegistro", "o_orderdate"),
))

# ---------------------------------------------------------------- tasks (lineitem)

# The lineitem natural key (order, line, part, supplier, ship day) as text of fixed widths: it cannot collide or
# overflow at any scale, and its text order is the order of its parts.
TASK_KEY = ("(lpad(CAST(l_orderkey AS STRING), 19, '0') || '-' || lpad(CAST(l_linenumber AS STRING), 3, '0') || '-' || "
            "lpad(CAST(l_partkey AS STRING), 15, '0') || '-' || lpad(CAST(l_suppkey AS STRING), 15, '0') || '-' || "
            "CAST(CAST(l_shipdate AS DATE) AS STRING))")

TASKS = Role("lineitem", (
    ("Id", TASK_KEY),
    ("ProyectoId", "l_orderkey"),
    ("Nombre", "'Linea ' || CAST(l_linenumber AS STRING)"),
    ("FechaInicio", "CAST(l_shipdate AS DATE)"),
    ("FechaFin", "CASE WHEN NOT (l_returnflag = 'N' AND l_linenumber = 1) "
                 "THEN CAST(l_shipdate AS DATE) + l_linenumber END"),
    ("Progreso", "CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity * 2 AS INT) END"),
    ("Responsable", "CASE WHEN l_linestatus = 'O' THEN 'Supplier#' || CAST(l_suppkey AS STRING) END"),
    ("DependenciaId", "CAST(NULL AS STRING)"),
    ("EsHito", "l_returnflag = 'R'"),
    ("Orden", "NULLIF(l_linenumber, 3)"),
    ("FechaActualizacion", "CAST(NULL AS TIMESTAMP_NTZ)"),
    ("TareaPadreId", "CAST(NULL AS STRING)"),
))

# ---------------------------------------------------------------- requests (events, three kinds)

_REQ_COMMON = (
    ("Id", "event_id"),
    ("FechaRegistro", "ts"),
)
_TRACKING = (
    ("Estado", "CASE WHEN value < 100 THEN 'Nuevo' WHEN value < 300 THEN 'En curso' ELSE 'Completado' END"),
    ("Responsable", "CASE WHEN value > 200 THEN 'user' || CAST(user_id AS STRING) END"),
    ("FechaEntrega", "CASE WHEN value > 250 THEN CAST(ts AS DATE) + 30 END"),
    ("FechaActualizacion", "CAST(NULL AS TIMESTAMP_NTZ)"),
)

REQUESTS_INFRA = Role("events", _REQ_COMMON + (
    ("Titulo", "event_type || ' #' || CAST(event_id AS STRING)"),
    ("Aplicacion", "event_type"),
    ("Identificador", "props"),
    ("Proyecto", "'Cliente ' || CAST(user_id AS STRING)"),
    ("LiderProyecto", "CASE WHEN value > 50 THEN 'lead' || CAST(user_id AS STRING) END"),
    ("FechaProduccion", "CAST(ts AS DATE) + 60"),
    ("Funcionalidad", "props"),
    ("ArquitecturaDespliegue", "CAST(NULL AS STRING)"),
    ("FrontEnd", "CAST(NULL AS STRING)"),
    ("BackendAPI", "CAST(NULL AS STRING)"),
    ("CPURequerida", "CAST(value AS DECIMAL(9,2))"),
    ("RAMRequeridaGB", "CAST(value * 2 AS DECIMAL(9,2))"),
    ("BaseDatos", "CAST(NULL AS STRING)"),
    ("ModeloDespliegueBD", "CAST(NULL AS STRING)"),
    ("StorageGB", "CAST(value * 10 AS DECIMAL(12,2))"),
    ("CrecimientoMensualGB", "CAST(NULL AS DECIMAL(12,2))"),
    ("DominioPublico", "CAST(NULL AS STRING)"),
    ("TipoAcceso", "CAST(NULL AS STRING)"),
    ("MetodoAutenticacion", "CAST(NULL AS STRING)"),
    ("NivelSensibilidad", "CAST(NULL AS STRING)"),
    ("Ambiente", "CASE WHEN value < 250 THEN 'QA' ELSE 'Produccion' END"),
    ("UsuariosConcurrentes", "CAST(user_id AS INT)"),
    ("Criticidad", "CASE WHEN value > 400 THEN 'Alta' ELSE 'Media' END"),
    ("RequiereHA", "'No'"),
    ("RequiereDR", "'No'"),
) + _TRACKING[:1] + (
    ("PayloadJson", "props"),
) + _TRACKING[1:] + (
    ("ProyectoId", "user_id"),
), where="event_type IN ('view', 'click')")

REQUESTS_ERP = Role("events", _REQ_COMMON + (
    ("Titulo", "'ERP ' || event_type || ' #' || CAST(event_id AS STRING)"),
    ("Solicitante", "'user' || CAST(user_id AS STRING)"),
    ("Area", "CASE WHEN value < 150 THEN 'Finanzas' ELSE 'Logistica' END"),
    ("Descripcion", "props"),
    ("Modulos", "CASE WHEN value < 200 THEN 'Contabilidad, Compras' END"),
    ("Procesos", "CAST(NULL AS STRING)"),
    ("TransformarFabric", "CASE WHEN value > 300 THEN 'Sí' ELSE 'No' END"),
    ("FabricDetalle", "CAST(NULL AS STRING)"),
    ("Prioridad", "CASE WHEN value > 400 THEN 'Alta' ELSE 'Media' END"),
) + _TRACKING[:1] + (
    ("Responsable", _TRACKING[1][1]),
    ("FechaEntrega", _TRACKING[2][1]),
    ("FechaActualizacion", _TRACKING[3][1]),
    ("PayloadJson", "props"),
    ("ProyectoId", "user_id"),
), where="event_type IN ('signup', 'purchase')")

REQUESTS_GENERAL = Role("events", _REQ_COMMON + (
    ("Titulo", "'Consulta #' || CAST(event_id AS STRING)"),
    ("Solicitante", "'user' || CAST(user_id AS STRING)"),
    ("Area", "CASE WHEN value < 150 THEN 'Ventas' ELSE 'Operaciones' END"),
    ("Ambito", "CASE WHEN value < 300 THEN 'Reportes' END"),
    ("Descripcion", "props"),
    ("Justificacion", "CAST(NULL AS STRING)"),
    ("Prioridad", "CASE WHEN value > 400 THEN 'Alta' ELSE 'Media' END"),
) + _TRACKING[:1] + (
    ("Responsable", _TRACKING[1][1]),
    ("FechaEntrega", _TRACKING[2][1]),
    ("FechaActualizacion", _TRACKING[3][1]),
    ("PayloadJson", "props"),
    ("ProyectoId", "user_id"),
), where="event_type = 'error'")

REQUESTS = {"infra": REQUESTS_INFRA, "erp": REQUESTS_ERP, "gen": REQUESTS_GENERAL}

# ---------------------------------------------------------------- releases (orders)

RELEASES = Role("orders", (
    ("Id", "o_orderkey"),
    ("Tipo", "CASE o_orderstatus WHEN 'O' THEN 'infra' WHEN 'F' THEN 'erp' ELSE 'gen' END"),
    ("SolicitudId", "o_orderkey"),
    ("Titulo", "CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 'Pase ' || CAST(o_orderkey AS STRING) END"),
    ("FechaPlanificada", "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(o_orderdate AS DATE) END"),
    ("VentanaInicio", "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') "
                      "THEN CAST(o_orderdate AS TIMESTAMP_NTZ) + INTERVAL 20 HOUR END"),
    ("VentanaFin", "CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') "
                   "THEN CAST(o_orderdate AS TIMESTAMP_NTZ) + INTERVAL 23 HOUR END"),
    ("Responsable", "CASE WHEN o_orderpriority <> '5-LOW' THEN 'Customer#' || CAST(o_custkey AS STRING) END"),
    ("Aprobador", "CAST(NULL AS STRING)"),
    ("Estado", "CASE WHEN o_orderstatus = 'F' THEN 'Completado' "
               "WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN 'Aprobado' "
               "WHEN o_orderstatus = 'O' THEN 'Planificado' "
               "WHEN o_orderpriority = '5-LOW' THEN NULL "
               "WHEN o_orderpriority = '1-URGENT' THEN 'Cancelado' ELSE 'En curso' END"),
    ("PlanRollback", "CAST(NULL AS STRING)"),
    ("FechaActualizacion", "CAST(NULL AS TIMESTAMP_NTZ)"),
    ("DocArquitectura", "o_totalprice > 100000"),
    ("DocFuncional", "o_orderstatus <> 'P'"),
    ("DocSoporte", "o_orderpriority < '3'"),
    ("Induccion", "o_totalprice > 50000"),
    ("DocArquitecturaFecha", "CAST(NULL AS DATE)"),
    ("DocFuncionalFecha", "CAST(NULL AS DATE)"),
    ("DocSoporteFecha", "CAST(NULL AS DATE)"),
    ("InduccionFecha", "CAST(NULL AS DATE)"),
    ("ReceptorDocumentacion", "CAST(NULL AS STRING)"),
    ("ReceptorInduccion", "CAST(NULL AS STRING)"),
    ("ContrapartePlanificacion", "CAST(NULL AS STRING)"),
))

# ---------------------------------------------------------------- notes (conversations)

KIND_OF_CONV = "CASE WHEN conv_id % 3 = 0 THEN 'infra' WHEN conv_id % 3 = 1 THEN 'erp' ELSE 'gen' END"

NOTES = Role("conversations", (
    ("Id", "conv_id * 1000000 + turn"),
    ("Tipo", KIND_OF_CONV),
    ("SolicitudId", "conv_id"),
    ("Nota", "text"),
    ("Autor", "CASE WHEN role = 'user' THEN CAST(NULL AS STRING) ELSE role END"),
    ("Fecha", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + (conv_id % 7) * INTERVAL 1 DAY"),
))

# ---------------------------------------------------------------- attachments (documents)

ATTACHMENT_META = (
    ("Id", "doc_id"),
    ("Tipo", "CASE lang WHEN 'en' THEN 'infra' WHEN 'es' THEN 'erp' ELSE 'gen' END"),
    ("SolicitudId", "CAST(substr(source, 4) AS BIGINT)"),
    ("Nombre", "'doc \"' || CAST(doc_id AS STRING) || '\".txt'"),
    ("ContentType", "CASE WHEN lang = 'de' THEN CAST(NULL AS STRING) ELSE 'text/plain' END"),
    ("Autor", "source"),
    ("Fecha", "TIMESTAMP_NTZ '2024-02-01 00:00:00' + (doc_id % 11) * INTERVAL 1 DAY"),
)

ATTACHMENTS = Role("documents", ATTACHMENT_META + (
    ("Tamano", ("octet_length(text)", "CAST(strlen(text) AS INTEGER)")),
))
