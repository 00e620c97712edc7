"""Directory members (S3 P12 T6): landed directory pages → domain members sorted by name (Spanish collation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard import schemas
from workboard.sources.tables import with_position


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """S3: directory pages landed as JSON files (``{"value": [...], "@odata.nextLink": ...}``), one member per row.

    Pages are read in parallel (one file per page); ``explode`` keeps every member, with no page or size cap.
    """
    pages = spark.read.schema(schemas.DIRECTORY_PAGE).json(path)
    return pages.select(F.explode("value").alias("u")).select("u.*")


def landed_pages(spark: SparkSession, path: str, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3: landed directory pages → ``(users, rejects)``, one user per row.

    A page is one line, or one file (``whole_files``, for pretty-printed pages). A page that is no JSON object is rejected as
    ``pagina_invalida``, an error answer of the directory (``{"error": ...}``) as ``error_del_directorio``; both keep
    the file and the text, so a page is never lost in silence. A page without ``value`` has no users.
    """
    text = spark.read.text(path, wholetext=whole_files).select(F.col("_metadata.file_path").alias("Archivo"), F.col("value").alias("Texto"))
    ddl = schemas.DIRECTORY_PAGE + ", error STRING, _bad STRING"
    page = F.from_json("Texto", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    pages = text.where(F.trim("Texto") != "").withColumn("_p", page)
    reason = (F.when(F.col("_p").isNull() | F.col("_p._bad").isNotNull(), "pagina_invalida")
              .when(F.col("_p.error").isNotNull(), "error_del_directorio"))
    pages = pages.withColumn("Motivo", reason)
    users = pages.where("Motivo is null").select(F.explode("_p.value").alias("u")).select("u.*")
    return users, pages.where("Motivo is not null").select("Archivo", "Texto", "Motivo")


def members(users: DataFrame, domain: str) -> DataFrame:
    """Keep users with a name whose e-mail (mail, else UPN) is in ``domain`` and is not a guest (``#ext#``)."""
    dom = "@" + domain.lstrip("@").lower()
    email = F.coalesce(F.nullif(F.col("mail"), F.lit("")), F.nullif(F.col("userPrincipalName"), F.lit("")),
                       F.lit(""))
    el = F.lower(email)
    keep = (F.coalesce(F.col("displayName") != "", F.lit(False))
            & ~el.contains("#ext#") & el.endswith(dom))
    return users.where(keep).select(F.col("displayName").alias("name"), email.alias("email"),
                                    F.coalesce(F.nullif(F.col("jobTitle"), F.lit("")), F.lit("")).alias("jobTitle"))


def ranked_members(users: DataFrame, domain: str) -> DataFrame:
    """P12 + T6: members with their position (from 1) in the Spanish order, for pages of the sorted list."""
    return with_position(members(users, domain), [F.collate(F.col("name"), "es"), F.col("email")])


def sorted_members(users: DataFrame, domain: str) -> DataFrame:
    """P12 + T6: members ordered by name under the Spanish locale collation (ICU ``es``), then by e-mail."""
    return members(users, domain).orderBy(F.collate(F.col("name"), "es"), "email")
