"""Activity summary per request (R5): notes and attachments, each aggregated by request key, then joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["Tipo", "SolicitudId"]


def activity_summary(notes: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row per request that has notes or attachments: note count, latest note time, attachment count, bytes.

    Each side is reduced to one row per key before the join (partial aggregation absorbs hot requests), so the
    full outer join only moves one row per key from each side. Attachment bytes are never read (``Tamano`` is
    stored), so parquet prunes the binary column.
    """
    n = notes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("Notas"), F.max("Fecha").alias("UltimaNota"))
    a = attachments.groupBy(*KEY).agg(F.count(F.lit(1)).alias("Documentos"),
                                      F.sum("Tamano").cast("bigint").alias("Bytes"))
    return n.join(a, KEY, "full_outer").select(
        *KEY,
        F.coalesce("Notas", F.lit(0)).cast("bigint").alias("Notas"),
        "UltimaNota",
        F.coalesce("Documentos", F.lit(0)).cast("bigint").alias("Documentos"),
        F.coalesce("Bytes", F.lit(0)).cast("bigint").alias("Bytes"),
    )
