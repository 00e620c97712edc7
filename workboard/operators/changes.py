"""Change operators as table → table transforms.

Stock Spark does not run ``UPDATE``/``MERGE``/``DELETE`` on parquet tables, so each statement becomes a pure function
``(target, changes, as_of) → new target`` plus an outcomes frame. Writing the new snapshot is the caller's job (a new
version directory, then switch — never overwrite a path that is being read).

Change batches are collapsed to one row per key first (R3) with ``max_by`` aggregates, which aggregate partially
on the map side, so a key receiving a third of all changes is reduced before the shuffle. The collapsed batch is
then joined to the target on its unique key; AQE turns that into a broadcast join at run time when the batch is
small and a sort-merge join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.functions.coerce import as_of_lit, now_utc
from workboard.sources.tables import hold, max_id, with_ids

KEEP_IF_NULL = "keep_if_null"
OVERWRITE = "overwrite"

# Per-column update policies of the three PATCH statements.
TRACKING_POLICY = {"Estado": KEEP_IF_NULL, "Responsable": OVERWRITE, "FechaEntrega": OVERWRITE}
PROJECT_POLICY = {"Nombre": KEEP_IF_NULL, "Descripcion": OVERWRITE, "Responsable": OVERWRITE,
                  "FechaInicio": OVERWRITE, "FechaFin": OVERWRITE, "Estado": KEEP_IF_NULL}
TASK_POLICY = {"Nombre": KEEP_IF_NULL, "FechaInicio": OVERWRITE, "FechaFin": OVERWRITE, "Progreso": KEEP_IF_NULL,
               "Responsable": OVERWRITE, "DependenciaId": OVERWRITE, "TareaPadreId": OVERWRITE,
               "EsHito": OVERWRITE, "Orden": OVERWRITE}

# Columns a release upsert writes (all overwritten on match).
RELEASE_FIELDS = ["Titulo", "FechaPlanificada", "VentanaInicio", "VentanaFin", "Responsable", "Aprobador", "Estado",
                  "PlanRollback", "DocArquitectura", "DocFuncional", "DocSoporte", "Induccion",
                  "DocArquitecturaFecha", "DocFuncionalFecha", "DocSoporteFecha", "InduccionFecha",
                  "ReceptorDocumentacion", "ReceptorInduccion", "ContrapartePlanificacion"]


def order_of(changes: DataFrame, seq: str) -> Column:
    """Batch order: ``seq``, then a hash of the whole change, so changes with equal ``seq`` have one winner."""
    return F.struct(F.col(seq), F.xxhash64(*[F.col(c) for c in changes.columns]))


def split_changes(changes: DataFrame, keys: list[str], seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """``(usable, rejects)``: a change without a key or without an order cannot be applied and keeps its ``Motivo``."""
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    reason = F.when(no_key, "sin_clave").when(F.col(seq).isNull(), "sin_orden")
    return (changes.where(reason.isNull()),
            changes.where(reason.isNotNull()).withColumn("Motivo", reason))


def collapse(changes: DataFrame, keys: list[str], policy: dict, seq: str = "seq") -> DataFrame:
    """Fold a batch of sequential patches into one row per key.

    Overwrite columns all come from the last patch; keep-if-null columns take the last non-null value (null when
    every patch left them null) — the result of applying the patches one by one. Changes without key or order are no
    part of it (see :func:`split_changes`).
    """
    usable, _ = split_changes(changes, keys, seq)
    order = order_of(usable, seq)
    last = [c for c, p in policy.items() if p != KEEP_IF_NULL]
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
            for c, p in policy.items() if p == KEEP_IF_NULL]
    if last:
        aggs.append(F.max_by(F.struct(*last), order).alias("_last"))
    out = usable.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("_patches"))
    return out.select(*keys, *[F.col(f"_last.{c}").alias(c) if c in last else F.col(c) for c in policy], "_patches")


def apply_patch(target: DataFrame, changes: DataFrame, policy: dict, as_of=None, key: str = "Id",
                seq: str = "seq", stamp_col: str | None = "FechaActualizacion") -> DataFrame:
    """Apply a batch of partial updates by key. Unmatched change keys change nothing (see :func:`outcomes`).

    ``as_of`` stamps ``stamp_col`` on matched rows (the statement's ``SYSUTCDATETIME()``).
    """
    c = collapse(changes, [key], policy, seq).withColumn("_hit", F.lit(True))
    t = target.alias("t")
    j = t.join(c.alias("c"), F.col(f"t.{key}") == F.col(f"c.{key}"), "left")
    hit = F.col("c._hit").isNotNull()
    cols = []
    for name in target.columns:
        old = F.col(f"t.{name}")
        if name in policy:
            new = F.col(f"c.{name}")
            val = F.coalesce(new, old) if policy[name] == KEEP_IF_NULL else new
            cols.append(F.when(hit, val).otherwise(old).alias(name))
        elif stamp_col and name == stamp_col and as_of is not None:
            cols.append(F.when(hit, as_of_lit(as_of)).otherwise(old).alias(name))
        else:
            cols.append(old.alias(name))
    return j.select(*cols)


def outcomes(target: DataFrame, changes: DataFrame, key: str = "Id") -> DataFrame:
    """A6 + J3: per change key, ``updated`` (matched) or ``not_found``; counts via ``groupBy('outcome')``."""
    keys = changes.select(key).distinct()
    found = target.select(key).withColumn("_f", F.lit(True))
    return (keys.join(found, key, "left")
            .select(key, F.when(F.col("_f"), "updated").otherwise("not_found").alias("outcome")))


def outcome_counts(outcomes_df: DataFrame) -> DataFrame:
    """Affected-row counts per outcome."""
    return outcomes_df.groupBy("outcome").agg(F.count(F.lit(1)).alias("Filas"))


def last_per_key(changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """R3 for whole-row changes: the last change per key, exactly one (equal ``seq``: see :func:`collapse`).

    One aggregate that combines before its shuffle, so a key holding a third of the batch is one row per task.
    """
    usable, _ = split_changes(changes, keys, seq)
    rest = [c for c in changes.columns if c not in keys]
    best = usable.groupBy(*keys).agg(F.max_by(F.struct(*rest), order_of(usable, seq)).alias("_last"))
    return best.select(*keys, "_last.*")


def upsert(target: DataFrame, changes: DataFrame, as_of=None, keys=("Tipo", "SolicitudId"), seq: str = "seq",
           fields: list[str] = RELEASE_FIELDS, stamp_col: str = "FechaActualizacion") -> DataFrame:
    """U4 ``MERGE`` on a composite key: the last change per key (R3) overwrites every field of a matched row and is
    inserted otherwise, with ids continuing after the target's largest id in key order (S4).

    ``changes`` are normalised rows (see ``intake.release_changes``); those without key or order are not applied
    (:func:`split_changes` gives them with their reason).
    """
    keys = list(keys)
    c = last_per_key(changes, keys, seq).select(*keys, *fields, F.lit(True).alias("_hit"))
    stamp = as_of_lit(as_of) if as_of is not None else now_utc()
    t = target.withColumn("_old", F.lit(True)).alias("t")
    hit = F.col("c._hit").isNotNull()

    def value(name: str) -> Column:
        if name in keys:
            return F.coalesce(f"t.{name}", f"c.{name}")
        if name in fields:
            return F.when(hit, F.col(f"c.{name}")).otherwise(F.col(f"t.{name}"))
        return F.when(hit, stamp).otherwise(F.col(f"t.{name}")) if name == stamp_col else F.col(f"t.{name}")

    # one full outer join gives both sides; it is held, because the inserted rows are numbered apart
    on = [F.col(f"t.{k}") == F.col(f"c.{k}") for k in keys]
    merged = hold(t.join(c.alias("c"), on, "full_outer").select(
        *[value(n).alias(n) for n in target.columns], F.col("t._old").isNull().alias("_new")))
    updated = merged.where(~F.col("_new")).drop("_new")
    inserted = with_ids(merged.where("_new").drop("_new", "Id"), [F.col(k) for k in keys], base=max_id(target))
    return updated.unionByName(inserted.select(*target.columns))


def delete_keys(target: DataFrame, keys: DataFrame, key: str = "Id") -> DataFrame:
    """Rows minus the deleted keys (a missing key is still success)."""
    return target.join(keys.select(key), key, "left_anti")


def cascade_delete(projects: DataFrame, tasks: DataFrame, project_ids: DataFrame):
    """Delete the projects' tasks, then the projects; requests keep their dangling ``ProyectoId``.

    Returns ``(projects', tasks')``. Both anti joins use the same key set.
    """
    ids = project_ids.select(F.col("Id"))
    tasks_left = tasks.join(ids.withColumnRenamed("Id", "ProyectoId"), "ProyectoId", "left_anti")
    projects_left = projects.join(ids, "Id", "left_anti")
    return projects_left, tasks_left


def delete_tasks_checked(tasks: DataFrame, task_ids: DataFrame):
    """X3 + X5: delete tasks by id, refusing those that still have child tasks (the parent foreign key).

    Returns ``(tasks', outcomes)`` with outcome ``deleted``, ``blocked`` (has children) or ``missing`` (no such task,
    still a success). Children are judged against the table before the batch.
    """
    req = task_ids.select("Id").distinct()
    parents = tasks.where(F.col("TareaPadreId").isNotNull()).select(F.col("TareaPadreId").alias("Id")).distinct()
    exists = tasks.select("Id").withColumn("_e", F.lit(True))
    # one row per requested id, used twice below: computed once
    out = (req.join(exists, "Id", "left").join(parents.withColumn("_p", F.lit(True)), "Id", "left")
           .select("Id", F.when(F.col("_e").isNull(), "missing").when(F.col("_p"), "blocked")
                   .otherwise("deleted").alias("outcome")))
    out = hold(out)
    deletable = out.where(F.col("outcome") == "deleted").select("Id")
    return tasks.join(deletable, "Id", "left_anti"), out
