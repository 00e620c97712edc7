"""Typed table scans (S1), id-assigning appends (S4), seed loads with parent links (S6), schema conform."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from workboard import schemas

_LOW33 = (1 << 33) - 1

_held: ContextVar[list | None] = ContextVar("held", default=None)


def hold(df: DataFrame) -> DataFrame:
    """Persist a frame that a plan reads twice; a surrounding :func:`released` block lets go of it."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if (frames := _held.get()) is not None:
        frames.append(df)
    return df


@contextmanager
def released() -> Iterator[None]:
    """Frames that operators persist inside the block are unpersisted at its end: build *and write* results in it, so that a
    long-lived job does not fill its executors' disks."""
    token = _held.set([])
    try:
        yield
    finally:
        for df in _held.get():
            df.unpersist()
        _held.reset(token)


def read_table(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet") -> DataFrame:
    """Read one portal table with its declared schema (never inferred)."""
    return spark.read.schema(ddl).format(fmt).load(path)


def _cast(raw: DataFrame, name: str, kind: str) -> Column:
    """The column as ``kind``, null where it cannot be; a type that has no cast at all is null throughout."""
    if raw.schema[name].dataType.simpleString() == kind:
        return F.col(name)  # as stored: filters on it still reach the files
    try:
        raw.select(F.col(name).try_cast(kind))
    except AnalysisException:
        return F.lit(None).cast(kind)
    return F.col(name).try_cast(kind)


def scan_table(spark: SparkSession, path: str, ddl: str, defaults: dict | None = None, fmt: str = "parquet",
               options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """A portal table from files that may be older or looser than its declaration → ``(rows, rejects)``.

    Rows come out with the declared columns and types: missing columns get their default (or null), columns of another
    type are cast. A row is rejected, with the first reason in column order, where a value does not fit the declared type
    (``tipo_invalido:Columna``) or a column declared NOT NULL has none (``nulo:Columna``); rejects keep the stored columns.
    Both sides are plain scans of the files: nothing is cached or shuffled.
    """
    raw = spark.read.format(fmt).options(**(options or {})).load(path)
    defaults, present = defaults or {}, set(raw.columns)
    out, reason = [], F.lit(None).cast("string")
    for f in schemas.struct(ddl).fields:
        kind = f.dataType.simpleString()
        value = _cast(raw, f.name, kind) if f.name in present else F.lit(defaults.get(f.name)).try_cast(kind)
        if f.name in present and f.name in defaults:
            value = F.when(F.col(f.name).isNull(), F.lit(defaults[f.name]).try_cast(kind)).otherwise(value)
        bad = F.lit(None).cast("string")
        if f.name in present and raw.schema[f.name].dataType.simpleString() != kind:
            bad = F.when(F.col(f.name).isNotNull() & value.isNull(), f"tipo_invalido:{f.name}")
        if not f.nullable:
            bad = F.coalesce(bad, F.when(value.isNull(), f"nulo:{f.name}"))
        reason = F.coalesce(reason, bad)
        out.append(value.alias(f.name))
    return raw.where(reason.isNull()).select(*out), raw.withColumn("Motivo", reason).where("Motivo is not null")


def read_jdbc(spark: SparkSession, url: str, table: str, ddl: str, partition_column: str, lower_bound, upper_bound,
              num_partitions: int, props: dict | None = None) -> DataFrame:
    """S1 against the live database: a JDBC scan in ``num_partitions`` ranges of ``partition_column``, projected to the
    declared schema (driver jar supplied by the deployment). The four options are required: without them one task
    would read the whole table."""
    df = (spark.read.format("jdbc").options(**(props or {}))
          .options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=lower_bound,
                   upperBound=upper_bound, numPartitions=num_partitions).load())
    return conform(df, ddl)


def max_id(df: DataFrame, col: str = "Id") -> Column:
    """Largest id in use (0 for an empty table), as a scalar subquery of the plan that uses it."""
    return F.coalesce(df.select(F.max(col).cast("bigint")).scalar(), F.lit(0).cast("bigint"))


def with_ids(df: DataFrame, order_by: list, base: int | Column = 0, id_col: str = "Id") -> DataFrame:
    """Assign contiguous ids ``base+1 … base+n`` in ``order_by`` order, without a one-partition window.

    The rows are range-sorted (so a hot key spreads over several ranges), with a hash of the whole row as the last
    sort key: only identical rows tie, so a partition that is computed again after an executor loss comes out the same. They
    are tagged with partition and position and persisted, because the counts per partition (one row each, a
    bounded table) and the rows must come from the same sort. Nothing is written to a folder.
    """
    whole = F.xxhash64(*[F.col(c) for c in df.columns])
    tagged = hold(df.orderBy(*order_by, whole).withColumn("_pid", F.spark_partition_id())
                  .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: this unpartitioned running sum sees #partitions rows, never data rows
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    start = base if isinstance(base, Column) else F.lit(base)
    out = tagged.join(F.broadcast(offsets), "_pid").withColumn(
        id_col, (start + F.col("_off") + F.col("_pos") + 1).cast("bigint"))
    return out.drop("_pid", "_pos", "_off")


def with_position(df: DataFrame, order_by: list, col: str = "Posicion") -> DataFrame:
    """The position (from 1) of each row in a fully ordered list, as a column."""
    return with_ids(df, order_by, id_col=col)


def link_children(children: DataFrame, parents: DataFrame, natural_key: str, parent_id_col: str,
                  parent_key: str | None = None) -> DataFrame:
    """Give child rows the id just assigned to their parent, matched on the parent's natural key."""
    pk = parent_key or natural_key
    p = parents.select(F.col(pk).alias(natural_key), F.col("Id").alias(parent_id_col))
    return children.join(p, natural_key, "left")


def conform(df: DataFrame, ddl: str, defaults: dict | None = None) -> DataFrame:
    """Bring a frame to a declared schema — missing columns are added with their default (or null), present
    ones are cast (``try_cast``), columns come out in schema order. Idempotent."""
    defaults = defaults or {}
    out: list[Column] = []
    present = set(df.columns)
    for f in schemas.struct(ddl).fields:
        t = f.dataType.simpleString()
        if f.name in present:
            out.append(F.col(f.name).try_cast(t).alias(f.name))
        else:
            out.append(F.lit(defaults.get(f.name)).try_cast(t).alias(f.name))
    return df.select(*out)


def append(df: DataFrame, path: str, partition_cols: list[str] | None = None) -> None:
    """S4 append sink: add new rows (e.g. the output of :func:`with_ids`) to a parquet table."""
    w = df.write.mode("append")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    """Write changed rows back, replacing only the partitions present in ``df`` (dynamic partition overwrite).

    Use for change operators whose output covers whole partitions (e.g. a table partitioned by ``Tipo`` or by
    registration month): untouched partitions are left as they are. Never target the path being read by ``df``
    itself — write a new version first.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                sort_within: list[str] | None = None, mode: str = "overwrite") -> None:
    """Lay a portal table out for its lookups: the re-aimed form of the reference's secondary indexes.

    ``partition_by`` (low-cardinality: request kind, registration month) gives partition pruning; ``sort_within``
    (the indexed columns: ``Id``, ``(Tipo, SolicitudId)``, ``(ProyectoId, Orden)``) orders rows inside each file, so
    parquet row-group min/max statistics let pushed-down filters skip most of the file.
    """
    out = df
    if partition_by:  # ranges over the sort columns too, so one kind with most rows spreads over many tasks
        out = out.repartitionByRange(*partition_by, *(sort_within or []))
    if sort_within:
        out = out.sortWithinPartitions(*sort_within)
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
