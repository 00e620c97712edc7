"""Attachments: base64 intake with size limits (S7 H13 P15), content by id (P8), download name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.functions.coerce import clean_text, id_too_large, to_id


def passthrough(raw: DataFrame, outputs: list[str]) -> list[str]:
    """Input columns kept next to the typed outputs (names equal ignoring case would be ambiguous in Spark)."""
    taken = {o.lower() for o in outputs}
    return [c for c in raw.columns if c.lower() not in taken]



def with_fields(raw: DataFrame, names: list[str]) -> DataFrame:
    """Body fields that were not sent are null (JavaScript ``undefined``)."""
    missing = [n for n in names if n.lower() not in {c.lower() for c in raw.columns}]
    return raw.withColumns({n: F.lit(None).cast("string") for n in missing}) if missing else raw


# Attachment size limit (10 MiB, checked after decoding) and the default content type.
MAX_BYTES = 10 * 1024 * 1024
DEFAULT_CONTENT_TYPE = "application/octet-stream"


def lenient_base64(c) -> Column:
    """H13 decode like Node's ``Buffer.from(s, 'base64')``: characters outside the (standard or URL-safe)
    alphabet are skipped, decoding stops at the first ``=``, and a dangling single character is ignored."""
    raw = F.col(c) if isinstance(c, str) else c
    s = F.translate(F.regexp_replace(raw, "[^A-Za-z0-9+/=_-]", ""), "-_", "+/")
    s = F.regexp_extract(s, "^([^=]*)", 1)
    n = F.length(s)
    rem = n % 4
    body = F.when(rem == 1, F.substring(s, 1, n - 1)).otherwise(s)
    padded = F.when(rem == 2, F.concat(body, F.lit("=="))).when(rem == 3, F.concat(body, F.lit("="))) \
        .otherwise(body)
    # Well-formed input decodes strictly (same bytes as the lenient rules); the cleanup runs only when that fails.
    return F.coalesce(F.try_to_binary(raw, F.lit("base64")), F.try_to_binary(padded, F.lit("base64")))


def download_name(c) -> Column:
    """``(Nombre || 'documento')`` with CR, LF and ``"`` replaced by ``_``."""
    s = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.coalesce(F.nullif(s, F.lit("")), F.lit("documento")), '[\\r\\n"]', "_")


def intake(raw: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Validate and decode attachment uploads (``tipo, solicitudId, nombre, contentType, base64, autor``).

    Adds ``Motivo`` (null when accepted; else the first failing rule, in the reference's order) next to the typed
    row: ``Tipo``, ``SolicitudId``, ``Nombre``, ``ContentType``, ``Tamano``, ``Contenido``, ``Autor``.
    """
    raw = with_fields(raw, ["tipo", "solicitudId", "nombre", "contentType", "base64", "autor"])
    tipo = clean_text("tipo", 10)
    sid = to_id("solicitudId")
    nombre = clean_text("nombre", 300)
    content = lenient_base64("base64")
    size = F.octet_length(content)
    motivo = (F.when(id_too_large("solicitudId"), "id_fuera_de_rango").when(~valid_kind_expr(tipo) | F.coalesce(sid == 0, F.lit(True)), "tipo_o_solicitud")
              .when(nombre.isNull(), "sin_nombre")
              .when(F.col("base64").isNull() | (F.col("base64") == ""), "sin_contenido")
              .when(F.coalesce(size, F.lit(0)) == 0, "vacio")
              .when(size > max_bytes, "excede_limite"))
    outs = ["Tipo", "SolicitudId", "Nombre", "ContentType", "Tamano", "Contenido", "Autor", "Motivo"]
    return raw.select(
        *passthrough(raw, outs),
        tipo.alias("Tipo"), sid.alias("SolicitudId"), nombre.alias("Nombre"),
        F.coalesce(clean_text("contentType", 150), F.lit(DEFAULT_CONTENT_TYPE)).alias("ContentType"),
        size.alias("Tamano"), content.alias("Contenido"), clean_text("autor", 200).alias("Autor"),
        motivo.alias("Motivo"),
    )


def valid_kind_expr(c: Column) -> Column:
    return F.coalesce(c.isin("infra", "erp", "gen"), F.lit(False))


def content_by_ids(attachments: DataFrame, ids: DataFrame) -> DataFrame:
    """P8 bulk form: download name, content type and bytes for the requested ids."""
    return attachments.join(ids.select("Id"), "Id", "left_semi").select(
        "Id", download_name("Nombre").alias("Archivo"),
        F.coalesce(F.col("ContentType"), F.lit(DEFAULT_CONTENT_TYPE)).alias("ContentType"), "Contenido")


__all__ = ["intake", "lenient_base64", "download_name", "content_by_ids", "passthrough", "with_fields"]
