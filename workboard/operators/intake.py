"""Intake of JSON requests and form bodies (S2 P14 P15 H7–H12 H15 H16 I1–I7) and project name lookup.

Each intake is ``raw text rows → typed rows + Motivo``: ``Motivo`` is null for accepted rows and otherwise names
the first failing rule, so ``valid ∪ rejects`` is always the whole input (nothing is dropped silently). The body
is parsed once into a VARIANT (``try_parse_json``; malformed text → null → rejected), which keeps the JSON value
types that the flag rules depend on. Everything is row-local; the only shuffle deals JSON bodies out over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.functions.coerce import (as_of_lit, clamp, clamp_progress, clean_text, date_or_now, default_if_blank,
                                        id_text_too_large, id_too_large, join_list, jstr, jtype, leading_int, now_utc,
                                        number_out_of_range, strict_bit, strict_bit_text, to_date_utc, to_decimal, to_id, to_id_trunc, to_int_prefix,
                                        to_int_trunc, to_timestamp_utc, truthy, yes_no)
from workboard.operators.attachments import passthrough, with_fields
from workboard.schemas import KINDS
from workboard.sources.tables import conform, hold, max_id, with_ids

# ---------------------------------------------------------------------------------------------- JSON envelope


def field(v: Column, *path: str) -> Column:
    """Nested JSON member as VARIANT (missing groups propagate null, like ``model.group || {}``)."""
    p = "$" + "".join(f"['{k}']" for k in path)
    return F.try_variant_get(v, p, "variant")


def spread(raw: DataFrame) -> DataFrame:
    """Bodies dealt out evenly over ``spark.sql.shuffle.partitions`` tasks before work that costs far more than their bytes: a
    small file of many rows (one row group) would be parsed by one task. A stream is left as its source cuts it."""
    return raw if raw.isStreaming else raw.repartition(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def staged_body(raw: DataFrame, text_col: str, fields: dict, typed: tuple = ()) -> DataFrame:
    """S2 + H15 + H16: parse ``body.model || body`` and extract members, one projection per stage.

    Adds ``_b`` (parsed body, null when malformed), ``_m`` (the model), ``_is_obj``, ``_payload`` (the model's JSON
    text, unknown members kept) and, for every ``name: (root, path…)`` in ``fields`` (root ``'m'`` = model,
    ``'b'`` = body), ``_v_<name>`` (VARIANT) and ``_t_<name>`` (JavaScript ``String(v)``), plus ``_y_<name>`` (JSON
    type) for the members listed in ``typed``. Each stage is its own
    projection, so the parsed VARIANT is computed once per row instead of being inlined into every field.
    """
    d = raw.withColumn("_b", F.try_parse_json(F.col(text_col)))
    d = d.withColumn("_m0", field(F.col("_b"), "model"))
    d = d.withColumn("_m0_t", jtype(F.col("_m0")))
    d = d.withColumn("_use_m", truthy(F.col("_m0"), F.col("_m0_t")))
    d = d.withColumns({"_m": F.when(F.col("_use_m"), F.col("_m0")).otherwise(F.col("_b")),
                       "_m_t": F.when(F.col("_use_m"), F.col("_m0_t")).otherwise(jtype(F.col("_b")))})
    roots = {"m": F.col("_m"), "b": F.col("_b")}
    d = d.withColumns({
        # an array passes the portal's object test and then fails for its missing members
        "_is_obj": F.coalesce(F.col("_m_t").isin("OBJECT", "ARRAY"), F.lit(False)),
        "_payload": F.when(F.col("_use_m"), F.get_json_object(F.col(text_col), "$.model"))
                     .otherwise(F.get_json_object(F.col(text_col), "$")),
        **{f"_v_{k}": field(roots[spec[0]], *spec[1:]) for k, spec in fields.items()},
    })
    if typed:  # JSON value types, only for the members whose rules depend on them (flags, lists, truthiness)
        d = d.withColumns({f"_y_{k}": jtype(F.col(f"_v_{k}")) for k in typed})
    return d.withColumns({f"_t_{k}": jstr(F.col(f"_v_{k}")) for k in fields})


def _v(k: str) -> Column:
    return F.col(f"_v_{k}")


def _y(k: str) -> Column:
    return F.col(f"_y_{k}")


def _t(k: str) -> Column:
    return F.col(f"_t_{k}")


def _envelope_reason() -> Column:
    return F.when(F.col("_b").isNull(), "json_invalido").when(~F.col("_is_obj"), "cuerpo_invalido")


def _finish(d: DataFrame, stage1: dict, stage2: dict) -> DataFrame:
    """Two final projections (cleaned fields, then derived ones), dropping the staging columns."""
    d = d.withColumns(stage1).withColumns(stage2)
    return d.drop(*[c for c in d.columns if c.startswith("_")])


# ---------------------------------------------------------------------------------------------- I2 ERP requests

# Member names of the portal's JSON bodies (ERP here; general and infrastructure bodies below).
_ERP_FIELDS = {k: ("m", k) for k in ("solicitante", "area", "descripcion", "modulos", "procesos",
                                      "transformar_fabric", "fabric_detalle", "prioridad", "estado", "proyecto_id")}


def erp_requests(raw: DataFrame, text_col: str = "body", collect: bool = False) -> DataFrame:
    """ERP request bodies → ``requests_erp`` columns (without Id/registration time) + ``Motivo``.

    ``collect`` trims the entries of the list members first, as the portal's form does before it sends them (H26).
    """
    d = staged_body(spread(raw), text_col, _ERP_FIELDS, typed=("modulos", "procesos", "transformar_fabric"))
    clean = {
        "Solicitante": clean_text(_t("solicitante"), 200), "Area": clean_text(_t("area"), 200),
        "Descripcion": clean_text(_t("descripcion")), "Modulos": join_list(_v("modulos"), ", ", t=_y("modulos"), collect=collect),
        "Procesos": join_list(_v("procesos"), " | ", t=_y("procesos"), collect=collect),
        "TransformarFabric": yes_no(_v("transformar_fabric"), _y("transformar_fabric")),
        "FabricDetalle": clean_text(_t("fabric_detalle")), "Prioridad": clean_text(_t("prioridad"), 20),
        "Estado": default_if_blank(_t("estado"), "Nuevo", 50),
        "ProyectoId": to_id(_t("proyecto_id")), "PayloadJson": F.col("_payload"),
    }
    derived = {
        "Titulo": clean_text(F.concat(F.col("Area"), F.lit(" – "), F.coalesce(
            F.nullif(F.col("Modulos"), F.lit("")), F.substring(F.col("Descripcion"), 1, 60),
            F.lit("Solicitud ERP"))), 300),
        "Motivo": _envelope_reason().when(F.col("Solicitante").isNull() | F.col("Area").isNull(),
                                          "faltan_obligatorios").when(id_too_large(_t("proyecto_id")),
                                                                      "id_fuera_de_rango"),
    }
    return _finish(d, clean, derived)


# ---------------------------------------------------------------------------------------------- I3 general

# Member names of general request bodies.
_GENERAL_FIELDS = {k: ("m", k) for k in ("solicitante", "area", "asunto", "ambito", "descripcion", "justificacion",
                                          "prioridad", "estado", "proyecto_id")}


def general_requests(raw: DataFrame, text_col: str = "body", collect: bool = False) -> DataFrame:
    """General request bodies → ``requests_general`` columns + ``Motivo`` (``collect``: see :func:`erp_requests`)."""
    d = staged_body(spread(raw), text_col, _GENERAL_FIELDS, typed=("ambito",))
    clean = {
        "Titulo": clean_text(_t("asunto"), 300), "Solicitante": clean_text(_t("solicitante"), 200),
        "Area": clean_text(_t("area"), 200), "Ambito": join_list(_v("ambito"), ", ", t=_y("ambito"), collect=collect),
        "Descripcion": clean_text(_t("descripcion")), "Justificacion": clean_text(_t("justificacion")),
        "Prioridad": clean_text(_t("prioridad"), 20), "Estado": default_if_blank(_t("estado"), "Nuevo", 50),
        "ProyectoId": to_id(_t("proyecto_id")), "PayloadJson": F.col("_payload"),
    }
    derived = {"Motivo": _envelope_reason().when(
        F.col("Solicitante").isNull() | F.col("Titulo").isNull() | F.col("Descripcion").isNull(),
        "faltan_obligatorios").when(id_too_large(_t("proyecto_id")), "id_fuera_de_rango")}
    return _finish(d, clean, derived)


# ---------------------------------------------------------------------------------------------- I1 infrastructure

# Groups and member names of infrastructure bodies.
_IG, _CC, _BD, _RA, _SM, _CR = ("informacion_general", "computo_y_contenedores", "base_de_datos", "redes_y_apis",
                                "seguridad_y_monitoreo", "clasificacion_registro")
_INFRA_FIELDS = {
    "nombre": ("m", _IG, "nombre_aplicacion"), "ident": ("m", _IG, "identificador"),
    "proyecto": ("m", _IG, "proyecto"), "lider": ("m", _IG, "lider_tecnico"),
    "fprod": ("m", _IG, "fecha_produccion"), "desc": ("m", _IG, "descripcion"),
    "arq": ("m", _CC, "arquitectura_despliegue"), "cpu": ("m", _CC, "cpu_total_vcpu"),
    "ram": ("m", _CC, "ram_total_gb"),
    "motor": ("m", _BD, "motor_bd"), "modelo_bd": ("m", _BD, "modelo_despliegue"),
    "storage": ("m", _BD, "almacenamiento_inicial_gb"), "crec": ("m", _BD, "crecimiento_mensual_gb"),
    "dominio": ("m", _RA, "dominio_publico"), "acceso": ("m", _RA, "tipo_acceso"),
    "auth": ("m", _SM, "metodo_autenticacion_usuarios"), "sens": ("m", _SM, "nivel_sensibilidad_datos"),
    "amb": ("m", _CR, "ambiente"), "usuarios": ("m", _CR, "usuarios_concurrentes"), "crit": ("m", _CR, "criticidad"),
    "ha": ("m", _CR, "requiere_ha"), "dr": ("m", _CR, "requiere_dr"), "estado": ("m", _CR, "estado"),
    "pid": ("m", "proyecto_id"),
    "row_titulo": ("b", "sharepoint_row", "Título"), "row_front": ("b", "sharepoint_row", "FrontEnd"),
    "row_back": ("b", "sharepoint_row", "BackendAPI"),
}


def infra_requests(raw: DataFrame, text_col: str = "body") -> DataFrame:
    """Infrastructure bodies ``{model: {six groups}, sharepoint_row}`` → ``requests_infra`` columns + ``Motivo``.

    Numbers use ``Number()`` (decimals; out of range → null and rejected) and the truncating integer rule (H3); the title is the
    supplied list title, else ``identificador – nombre`` (raw text, not cut), else the name (H12a). No default state.
    """
    d = staged_body(spread(raw), text_col, _INFRA_FIELDS, typed=("ident", "nombre"))
    clean = {
        "Aplicacion": clean_text(_t("nombre"), 200), "Identificador": clean_text(_t("ident"), 100),
        "Proyecto": clean_text(_t("proyecto"), 200), "LiderProyecto": clean_text(_t("lider"), 200),
        "FechaProduccion": to_date_utc(_t("fprod")), "Funcionalidad": clean_text(_t("desc")),
        "ArquitecturaDespliegue": clean_text(_t("arq"), 100), "FrontEnd": clean_text(_t("row_front"), 500),
        "BackendAPI": clean_text(_t("row_back"), 500), "CPURequerida": to_decimal(_t("cpu"), 9, 2),
        "RAMRequeridaGB": to_decimal(_t("ram"), 9, 2), "BaseDatos": clean_text(_t("motor"), 100),
        "ModeloDespliegueBD": clean_text(_t("modelo_bd"), 100), "StorageGB": to_decimal(_t("storage"), 12, 2),
        "CrecimientoMensualGB": to_decimal(_t("crec"), 12, 2), "DominioPublico": clean_text(_t("dominio"), 200),
        "TipoAcceso": clean_text(_t("acceso"), 100), "MetodoAutenticacion": clean_text(_t("auth"), 100),
        "NivelSensibilidad": clean_text(_t("sens"), 100), "Ambiente": clean_text(_t("amb"), 50),
        "UsuariosConcurrentes": to_int_trunc(_t("usuarios")), "Criticidad": clean_text(_t("crit"), 20),
        "RequiereHA": clean_text(_t("ha"), 5), "RequiereDR": clean_text(_t("dr"), 5),
        "Estado": clean_text(_t("estado"), 50), "ProyectoId": to_id_trunc(_t("pid")),
        "PayloadJson": F.col("_payload"),
    }
    derived = {
        "Titulo": F.coalesce(
            clean_text(_t("row_titulo"), 300),
            F.when(truthy(_v("ident"), _y("ident")), F.concat(_t("ident"), F.lit(" – "), F.when(
                truthy(_v("nombre"), _y("nombre")), _t("nombre")).otherwise(F.lit("")))),
            clean_text(_t("nombre"), 300)),
        "Motivo": _envelope_reason().when(F.col("Aplicacion").isNull(), "faltan_obligatorios")
        .when(id_too_large(_t("pid")), "id_fuera_de_rango")
        .when(number_out_of_range(_t("cpu"), 9, 2) | number_out_of_range(_t("ram"), 9, 2)
              | number_out_of_range(_t("storage"), 12, 2) | number_out_of_range(_t("crec"), 12, 2)
              | number_out_of_range(_t("usuarios"), 10, 0), "numero_fuera_de_rango"),
    }
    return _finish(d, clean, derived)


# ---------------------------------------------------------------------------------------------- I4–I6 form bodies

def _stage_clean(raw: DataFrame, cols: list[str]) -> DataFrame:
    """Clean text fields once, in their own projection (``_c_<name>``), before rules that read them repeatedly."""
    return raw.withColumns({f"_c_{c}": clean_text(c) for c in cols})


def _drop_staged(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_c_")])


def _kind_ok(tipo: Column, sid: Column) -> Column:
    return F.coalesce(tipo.isin(*KINDS), F.lit(False)) & F.coalesce(sid != 0, F.lit(False))


def notes(raw: DataFrame, as_of) -> DataFrame:
    """Note bodies ``tipo, solicitudId, nota, autor, fecha`` → typed note rows + ``Motivo``.

    A supplied, parseable ``fecha`` back-dates the note; otherwise it is stamped ``as_of`` (H25).
    """
    raw = _stage_clean(with_fields(raw, ["tipo", "solicitudId", "nota", "autor", "fecha"]), ["fecha"])
    tipo, sid, nota = clean_text("tipo", 10), to_id("solicitudId"), clean_text("nota")
    motivo = F.when(id_too_large("solicitudId"), "id_fuera_de_rango").when(~_kind_ok(tipo, sid), "tipo_o_solicitud").when(nota.isNull(), "nota_vacia")
    return _drop_staged(raw.select(
        *passthrough(raw, ["Tipo", "SolicitudId", "Nota", "Autor", "Fecha", "Motivo"]),
        tipo.alias("Tipo"), sid.alias("SolicitudId"), nota.alias("Nota"),
        clean_text("autor", 200).alias("Autor"), date_or_now("_c_fecha", as_of, cleaned=True).alias("Fecha"),
        motivo.alias("Motivo")))


def projects(raw: DataFrame, as_of) -> DataFrame:
    """I4: project bodies → typed project rows (state defaults to ``Activo``) + ``Motivo``."""
    raw = _stage_clean(with_fields(raw, ["nombre", "descripcion", "responsable", "fechaInicio", "fechaFin", "estado"]),
                       ["fechaInicio", "fechaFin"])
    nombre = clean_text("nombre", 200)
    return _drop_staged(raw.select(*passthrough(raw, ["Nombre", "Descripcion", "Responsable", "FechaInicio",
                                                      "FechaFin", "Estado", "FechaRegistro", "Motivo"]),
                      nombre.alias("Nombre"), clean_text("descripcion").alias("Descripcion"),
                      clean_text("responsable", 200).alias("Responsable"),
                      to_date_utc("_c_fechaInicio", cleaned=True).alias("FechaInicio"),
                      to_date_utc("_c_fechaFin", cleaned=True).alias("FechaFin"),
                      default_if_blank("estado", "Activo", 50).alias("Estado"),
                      as_of_lit(as_of).alias("FechaRegistro"),
                      F.when(nombre.isNull(), "sin_nombre").alias("Motivo")))


def tasks(raw: DataFrame) -> DataFrame:
    """Task bodies → typed task rows (progress clamped, null → 0; milestone strict bit) + ``Motivo``.

    ``esHito`` arrives as JSON text, so ``true``/``1``/``"1"`` are told apart from other values (H11).
    """
    raw = _stage_clean(with_fields(raw, ["proyectoId", "nombre", "fechaInicio", "fechaFin", "progreso", "responsable",
                                         "dependenciaId", "tareaPadreId", "esHito", "orden"]),
                       ["fechaInicio", "fechaFin"])
    ids = ("proyectoId", "dependenciaId", "tareaPadreId")  # read by several rules: their integers are found once
    raw = raw.withColumns({**{f"_c_{c}": leading_int(c) for c in ids}, "_c_progreso": to_int_prefix("progreso")})
    raw = raw.withColumn("_c_id", F.col("_c_proyectoId").try_cast("bigint"))
    pid, nombre = F.col("_c_id"), clean_text("nombre", 300)
    hito = strict_bit_text("esHito")
    motivo = F.when(id_text_too_large(*[f"_c_{c}" for c in ids]), "id_fuera_de_rango").when(F.coalesce(pid == 0, F.lit(True)), "sin_proyecto").when(nombre.isNull(), "sin_nombre")
    return _drop_staged(raw.select(
                      *passthrough(raw, ["ProyectoId", "Nombre", "FechaInicio", "FechaFin", "Progreso",
                                         "Responsable", "DependenciaId", "TareaPadreId", "EsHito", "Orden", "Motivo"]),
                      pid.alias("ProyectoId"), nombre.alias("Nombre"),
                      to_date_utc("_c_fechaInicio", cleaned=True).alias("FechaInicio"),
                      to_date_utc("_c_fechaFin", cleaned=True).alias("FechaFin"),
                      F.coalesce(clamp("_c_progreso"), F.lit(0)).alias("Progreso"),
                      clean_text("responsable", 200).alias("Responsable"),
                      F.col("_c_dependenciaId").try_cast("bigint").alias("DependenciaId"),
                      F.col("_c_tareaPadreId").try_cast("bigint").alias("TareaPadreId"),
                      hito.alias("EsHito"), to_int_prefix("orden").alias("Orden"),
                      motivo.alias("Motivo")))


def split_valid(df: DataFrame, reason_col: str = "Motivo") -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejects)``; together they are the whole input.

    The typed rows are persisted, so one intake computation feeds both outputs (blocks of a lost executor are computed
    again), and the filter cannot be pushed back through the parsing stages, where Catalyst would otherwise inline the
    JSON parse into the predicate once per reference.
    """
    typed = hold(df)
    return typed.where(F.col(reason_col).isNull()), typed.where(F.col(reason_col).isNotNull())


def reason_counts(df: DataFrame, reason_col: str = "Motivo") -> DataFrame:
    """Accepted/rejected counts per reason (``ok`` for accepted rows)."""
    return df.groupBy(F.coalesce(F.col(reason_col), F.lit("ok")).alias(reason_col)).agg(
        F.count(F.lit(1)).alias("Filas"))


# ---------------------------------------------------------------------------------------------- U1–U4 change bodies


def _change_reason(id_col: str) -> Column:
    return (F.when(F.col("_b").isNull(), "json_invalido").when(id_too_large(id_col), "id_fuera_de_rango")
            .when(F.coalesce(to_id(id_col) == 0, F.lit(True)), "falta_id"))


def _members(*names: str) -> dict:
    return {n: ("b", n) for n in names}


def tracking_changes(raw: DataFrame, text_col: str = "body", id_col: str = "id") -> DataFrame:
    """Tracking PATCH bodies (``id`` of the path, JSON text) → ``Id, Estado, Responsable, FechaEntrega, Motivo``;
    other input columns (the batch order) stay."""
    d = staged_body(raw, text_col, _members("estado", "responsable", "fechaEntrega"))  # in the order they came
    d = d.withColumns({"_reason": _change_reason(id_col), "_id": to_id(id_col)}).drop(id_col)
    return _finish(d, {"Id": F.col("_id"), "Estado": clean_text(_t("estado"), 50),
                       "Responsable": clean_text(_t("responsable"), 200),
                       "FechaEntrega": to_date_utc(_t("fechaEntrega"))}, {"Motivo": F.col("_reason")}).drop(text_col)


def project_changes(raw: DataFrame, text_col: str = "body", id_col: str = "id") -> DataFrame:
    """Project PATCH bodies → typed change rows + ``Motivo``."""
    d = staged_body(spread(raw), text_col, _members("nombre", "descripcion", "responsable", "fechaInicio", "fechaFin", "estado"))
    d = d.withColumns({"_reason": _change_reason(id_col), "_id": to_id(id_col)}).drop(id_col)
    return _finish(d, {"Id": F.col("_id"), "Nombre": clean_text(_t("nombre"), 200),
                       "Descripcion": clean_text(_t("descripcion")), "Responsable": clean_text(_t("responsable"), 200),
                       "FechaInicio": to_date_utc(_t("fechaInicio")), "FechaFin": to_date_utc(_t("fechaFin")),
                       "Estado": clean_text(_t("estado"), 50)}, {"Motivo": F.col("_reason")}).drop(text_col)


def task_changes(raw: DataFrame, text_col: str = "body", id_col: str = "id") -> DataFrame:
    """Task PATCH bodies → typed change rows + ``Motivo`` (progress clamped, milestone strict bit)."""
    d = staged_body(spread(raw), text_col, _members("nombre", "fechaInicio", "fechaFin", "progreso", "responsable", "dependenciaId",
                                            "tareaPadreId", "esHito", "orden"), typed=("esHito",))
    reason = _change_reason(id_col).when(id_too_large(_t("dependenciaId"), _t("tareaPadreId")), "id_fuera_de_rango")
    d = d.withColumns({"_reason": reason, "_id": to_id(id_col)}).drop(id_col)
    return _finish(d, {"Id": F.col("_id"), "Nombre": clean_text(_t("nombre"), 300),
                       "FechaInicio": to_date_utc(_t("fechaInicio")), "FechaFin": to_date_utc(_t("fechaFin")),
                       "Progreso": clamp_progress(_t("progreso")), "Responsable": clean_text(_t("responsable"), 200),
                       "DependenciaId": to_id(_t("dependenciaId")), "TareaPadreId": to_id(_t("tareaPadreId")),
                       "EsHito": strict_bit(_v("esHito"), _y("esHito")), "Orden": to_int_prefix(_t("orden"))},
                   {"Motivo": F.col("_reason")}).drop(text_col)


# JSON members of a release body, by the column they fill.
_RELEASE_TEXT = {"Titulo": ("titulo", 300), "Responsable": ("responsable", 200), "Aprobador": ("aprobador", 200),
                 "PlanRollback": ("planRollback", None), "ReceptorDocumentacion": ("receptorDocumentacion", 200),
                 "ReceptorInduccion": ("receptorInduccion", 200),
                 "ContrapartePlanificacion": ("contrapartePlanificacion", 200)}
_RELEASE_DATES = {"FechaPlanificada": "fechaPlanificada", "DocArquitecturaFecha": "docArquitecturaFecha",
                  "DocFuncionalFecha": "docFuncionalFecha", "DocSoporteFecha": "docSoporteFecha",
                  "InduccionFecha": "induccionFecha"}
_RELEASE_TIMES = {"VentanaInicio": "ventanaInicio", "VentanaFin": "ventanaFin"}
_RELEASE_GATES = {"DocArquitectura": "docArquitectura", "DocFuncional": "docFuncional", "DocSoporte": "docSoporte",
                  "Induccion": "induccion"}


def release_changes(raw: DataFrame, text_col: str = "body") -> DataFrame:
    """U4: release bodies → key, the nineteen written columns and ``Motivo``.

    The key must be a known kind and a non-zero request id; a blank state becomes ``Planificado``; the four gates follow
    JavaScript truthiness (H10). Other input columns (the batch order) stay.
    """
    d = staged_body(spread(raw), text_col, _members(
        "tipo", "solicitudId", "estado", *[m for m, _ in _RELEASE_TEXT.values()], *_RELEASE_DATES.values(),
        *_RELEASE_TIMES.values(), *_RELEASE_GATES.values()), typed=tuple(_RELEASE_GATES.values()))
    clean = {"Tipo": clean_text(_t("tipo"), 10), "SolicitudId": to_id(_t("solicitudId")),
             "Estado": default_if_blank(_t("estado"), "Planificado", 30),
             **{c: clean_text(_t(m), n) for c, (m, n) in _RELEASE_TEXT.items()},
             **{c: to_date_utc(_t(m)) for c, m in _RELEASE_DATES.items()},
             **{c: to_timestamp_utc(_t(m)) for c, m in _RELEASE_TIMES.items()},
             **{c: truthy(_v(m), _y(m)) for c, m in _RELEASE_GATES.items()}}
    reason = (F.when(F.col("_b").isNull(), "json_invalido").when(id_too_large(_t("solicitudId")), "id_fuera_de_rango")
              .when(~_kind_ok(F.col("Tipo"), F.col("SolicitudId")), "tipo_o_solicitud"))
    return _finish(d, clean, {"Motivo": reason}).drop(text_col)


# ---------------------------------------------------------------------------------------------- J4 name lookup

def name_key(c) -> Column:
    return F.lower(clean_text(c))


def resolve_project_names(rows: DataFrame, name_col: str, projects_df: DataFrame, as_of=None):
    """Project name → id, case- and blank-insensitive, creating projects for names not found.

    Existing names equal ignoring case resolve to the highest id (D13). Each distinct missing name is created once
    (named by its first spelling in sort order) with ids continuing after the largest project id. Returns
    ``(rows + ProyectoId + Creado, new project rows)``. The dimension is reduced to one row per name key before the
    join; AQE broadcasts it when it is small.
    """
    dim = (projects_df.select(name_key("Nombre").alias("_k"), F.col("Id"))
           .where(F.col("_k").isNotNull()).groupBy("_k").agg(F.max("Id").alias("_pid")))
    r = rows.withColumn("_k", name_key(name_col)).join(dim, "_k", "left")
    missing = (r.where(F.col("_k").isNotNull() & F.col("_pid").isNull())
               .groupBy("_k").agg(F.min(clean_text(name_col, 200)).alias("Nombre")))
    created = with_ids(missing, [F.col("_k")], base=max_id(projects_df))
    new_ids = created.select("_k", F.col("Id").alias("_new"))
    out = (r.join(new_ids, "_k", "left")
           .withColumn("ProyectoId", F.coalesce(F.col("_pid"), F.col("_new")).cast("bigint"))
           .withColumn("Creado", F.col("_pid").isNull() & F.col("_new").isNotNull())
           .drop("_k", "_pid", "_new"))
    new_projects = created.select("Id", "Nombre", F.lit("Activo").alias("Estado"),
                                  (as_of_lit(as_of) if as_of is not None else now_utc()).alias("FechaRegistro"))
    return out, new_projects


def create(target: DataFrame, typed: DataFrame, ddl: str, order_by: list, as_of=None,
           stamp_col: str | None = "FechaRegistro", keep: list[str] | None = None):
    """I1–I7 + S4 end to end (``INSERT … OUTPUT INSERTED.Id``): accepted rows get ids continuing after the target's
    largest id (in ``order_by`` order), the registration stamp, and the target's schema; rejects keep their reason.

    Returns ``(new_rows, rejects)``; append ``new_rows`` with ``write.mode('append')``. ``keep`` lists extra input
    columns (e.g. a source reference) to carry next to the schema columns.
    """
    valid, rejects = split_valid(typed)
    return number_rows(valid, ddl, order_by, max_id(target), as_of, stamp_col, keep), rejects


def number_rows(valid: DataFrame, ddl: str, order_by: list, base, as_of=None, stamp_col: str | None = "FechaRegistro",
                keep: list[str] | None = None) -> DataFrame:
    """Accepted rows with ids after ``base`` in ``order_by`` order, their stamp and the declared columns (defaults null)."""
    if stamp_col:
        valid = valid.withColumn(stamp_col, as_of_lit(as_of) if as_of is not None else now_utc())
    with_id = with_ids(valid.drop("Motivo"), order_by, base=base)
    extra = "".join(f", {k} {with_id.schema[k].dataType.simpleString()}" for k in (keep or []))
    return conform(with_id, ddl + extra)
