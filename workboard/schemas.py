"""Table schemas of the work-request portal, as Spark DDL strings.

Column names follow the reference tables so results stay traceable. Identity keys are BIGINT; SQL Server
DATETIME2 (zone-less UTC wall clock) maps to TIMESTAMP_NTZ.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

# The column names and types of the portal's tables, which are its public interface.

REQUESTS_INFRA = (
    "Id BIGINT NOT NULL, FechaRegistro TIMESTAMP_NTZ NOT NULL, Titulo STRING, Aplicacion STRING, "
    "Identificador STRING, Proyecto STRING, LiderProyecto STRING, FechaProduccion DATE, Funcionalidad STRING, "
    "ArquitecturaDespliegue STRING, FrontEnd STRING, BackendAPI STRING, CPURequerida DECIMAL(9,2), "
    "RAMRequeridaGB DECIMAL(9,2), BaseDatos STRING, ModeloDespliegueBD STRING, StorageGB DECIMAL(12,2), "
    "CrecimientoMensualGB DECIMAL(12,2), DominioPublico STRING, TipoAcceso STRING, MetodoAutenticacion STRING, "
    "NivelSensibilidad STRING, Ambiente STRING, UsuariosConcurrentes INT, Criticidad STRING, RequiereHA STRING, "
    "RequiereDR STRING, Estado STRING, PayloadJson STRING, Responsable STRING, FechaEntrega DATE, "
    "FechaActualizacion TIMESTAMP_NTZ, ProyectoId BIGINT"
)

REQUESTS_ERP = (
    "Id BIGINT NOT NULL, FechaRegistro TIMESTAMP_NTZ NOT NULL, Titulo STRING, Solicitante STRING, Area STRING, "
    "Descripcion STRING, Modulos STRING, Procesos STRING, TransformarFabric STRING, FabricDetalle STRING, "
    "Prioridad STRING, Estado STRING, Responsable STRING, FechaEntrega DATE, FechaActualizacion TIMESTAMP_NTZ, "
    "PayloadJson STRING, ProyectoId BIGINT"
)

REQUESTS_GENERAL = (
    "Id BIGINT NOT NULL, FechaRegistro TIMESTAMP_NTZ NOT NULL, Titulo STRING, Solicitante STRING, Area STRING, "
    "Ambito STRING, Descripcion STRING, Justificacion STRING, Prioridad STRING, Estado STRING, Responsable STRING, "
    "FechaEntrega DATE, FechaActualizacion TIMESTAMP_NTZ, PayloadJson STRING, ProyectoId BIGINT"
)

PROJECTS = (
    "Id BIGINT NOT NULL, Nombre STRING NOT NULL, Descripcion STRING, Responsable STRING, FechaInicio DATE, "
    "FechaFin DATE, Estado STRING, FechaRegistro TIMESTAMP_NTZ NOT NULL"
)

TASKS = (
    "Id BIGINT NOT NULL, ProyectoId BIGINT NOT NULL, Nombre STRING NOT NULL, FechaInicio DATE, FechaFin DATE, "
    "Progreso INT, Responsable STRING, DependenciaId BIGINT, EsHito BOOLEAN NOT NULL, Orden INT, "
    "FechaActualizacion TIMESTAMP_NTZ, TareaPadreId BIGINT"
)

NOTES = (
    "Id BIGINT NOT NULL, Tipo STRING NOT NULL, SolicitudId BIGINT NOT NULL, Nota STRING NOT NULL, Autor STRING, "
    "Fecha TIMESTAMP_NTZ NOT NULL"
)

ATTACHMENTS = (
    "Id BIGINT NOT NULL, Tipo STRING NOT NULL, SolicitudId BIGINT NOT NULL, Nombre STRING NOT NULL, "
    "ContentType STRING, Tamano INT, Contenido BINARY NOT NULL, Autor STRING, Fecha TIMESTAMP_NTZ NOT NULL"
)

RELEASES = (
    "Id BIGINT NOT NULL, Tipo STRING NOT NULL, SolicitudId BIGINT NOT NULL, Titulo STRING, FechaPlanificada DATE, "
    "VentanaInicio TIMESTAMP_NTZ, VentanaFin TIMESTAMP_NTZ, Responsable STRING, Aprobador STRING, Estado STRING, "
    "PlanRollback STRING, FechaActualizacion TIMESTAMP_NTZ, DocArquitectura BOOLEAN NOT NULL, "
    "DocFuncional BOOLEAN NOT NULL, DocSoporte BOOLEAN NOT NULL, Induccion BOOLEAN NOT NULL, "
    "DocArquitecturaFecha DATE, DocFuncionalFecha DATE, DocSoporteFecha DATE, InduccionFecha DATE, "
    "ReceptorDocumentacion STRING, ReceptorInduccion STRING, ContrapartePlanificacion STRING"
)

DIRECTORY_PAGE = (
    "value ARRAY<STRUCT<displayName: STRING, mail: STRING, userPrincipalName: STRING, jobTitle: STRING>>"
)

TABLES = {
    "requests_infra": REQUESTS_INFRA,
    "requests_erp": REQUESTS_ERP,
    "requests_general": REQUESTS_GENERAL,
    "projects": PROJECTS,
    "tasks": TASKS,
    "notes": NOTES,
    "attachments": ATTACHMENTS,
    "releases": RELEASES,
}

# Request kinds and the request table each one addresses (the polymorphic (Tipo, SolicitudId) key).
KINDS = ("infra", "erp", "gen")
KIND_TABLE = {"infra": "requests_infra", "erp": "requests_erp", "gen": "requests_general"}


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def columns(ddl: str) -> list[str]:
    return [f.name for f in struct(ddl).fields]
