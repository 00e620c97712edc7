"""Release board (P4 T2 H19–H22 J5 A5 P17 P18), status counts (A3) and totals (A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard.functions.display import (RELEASE_STATES, days_until, dash_if_blank, fmt_date, kind_label,
                                         title_or_ref, window_text)
from workboard.operators.search import RELEASE_LIST, release_order

GATES = ["DocArquitectura", "DocFuncional", "DocSoporte", "Induccion"]


def gate_count() -> Column:
    """A5: number of the four delivery gates that are set (null counts as unset)."""
    return sum(F.coalesce(F.col(g), F.lit(False)).cast("int") for g in GATES)


def gates_complete() -> Column:
    """All four gates set."""
    return gate_count() >= 4


def due_soon(as_of) -> Column:
    """Planned 0..7 days from ``as_of`` and not completed (a null state counts as not completed)."""
    d = days_until("FechaPlanificada", as_of)
    return F.coalesce(d.between(0, 7), F.lit(False)) & ~F.col("Estado").eqNullSafe("Completado")


def board(releases: DataFrame, as_of) -> DataFrame:
    """The release board: P4 columns plus the page's row expressions, ordered by T2."""
    return (releases.select(*RELEASE_LIST)
            .withColumns({
                "TituloTexto": title_or_ref("Titulo", "SolicitudId"),
                "TipoTexto": kind_label("Tipo"),
                "FechaTexto": fmt_date("FechaPlanificada"),
                "VentanaTexto": window_text("VentanaInicio", "VentanaFin"),
                "ResponsableTexto": dash_if_blank("Responsable"),
                "Entregables": gate_count(),
                "EntregablesCompletos": gates_complete(),
                "DiasRestantes": days_until("FechaPlanificada", as_of),
                "Pronto": due_soon(as_of),
            })
            .orderBy(*release_order()))


def canonical_states(spark: SparkSession) -> DataFrame:
    """The five canonical states with their display order (a fixed 5-row dimension)."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(RELEASE_STATES)], "Estado string, Orden int")


def status_counts(releases: DataFrame) -> DataFrame:
    """A3: count per state, zero-filled for the five canonical states; other states (and null) keep their count.

    No join: the fixed 5-row canonical dimension is unioned in with count 0 and the union is re-aggregated. The
    group-by has a handful of keys, so partial aggregation leaves a few rows per map task whatever the skew.
    """
    spark = releases.sparkSession
    counts = releases.groupBy("Estado").agg(F.count(F.lit(1)).alias("Cantidad"),
                                            F.lit(None).cast("int").alias("Orden"))
    dim = canonical_states(spark).select("Estado", F.lit(0).cast("bigint").alias("Cantidad"), "Orden")
    return counts.unionByName(dim).groupBy("Estado").agg(
        F.sum("Cantidad").cast("bigint").alias("Cantidad"),
        F.max(F.col("Orden").isNotNull()).alias("Canonico"),
        F.max("Orden").alias("Orden"),
    )


def totals(releases: DataFrame) -> DataFrame:
    """A4: total releases and fully-gated releases (plus each gate's count) in one row."""
    return releases.agg(
        F.count(F.lit(1)).alias("Total"),
        F.count_if(gates_complete()).alias("Listos"),
        *[F.count_if(F.coalesce(F.col(g), F.lit(False))).alias(g) for g in GATES],
    )
