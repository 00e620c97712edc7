"""Session construction and cluster-safe scratch locations.

Everything the library needs from the session is set here once: UTC session time zone (the reference stores UTC
wall-clock values), ANSI mode (so intake uses ``try_*`` functions explicitly), AQE with partition coalescing and
skew-join splitting, and the Spark UI off.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Fixed session settings the operators rely on.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "workboard",
                extra: dict | None = None, max_partition_bytes: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    ``master`` is only set when given (a cluster submit supplies its own). ``shuffle_partitions`` should follow the
    data size: ~cores for local tests, and roughly shuffled bytes / 128 MiB on a cluster (AQE coalesces the rest).
    ``max_partition_bytes`` (e.g. ``"256m"``) sizes scan splits so a task's input fits executor memory.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(SESSION_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if max_partition_bytes:
        conf["spark.sql.files.maxPartitionBytes"] = str(max_partition_bytes)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in conf.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)
        elif k in SESSION_CONF and not k.startswith("spark.ui") and spark.conf.get(k, None) != v:
            raise ValueError(f"this session was started with another {k} than the operators rely on ({v})")
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # sessions without a local SparkContext (e.g. Spark Connect)
        pass
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder for stream state: ``spark.checkpoint.dir``, the context's checkpoint folder, or the warehouse.

    All of them are shared by driver and executors on a cluster; nothing is made in a machine-local temp folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (root or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def fresh_path(root: str, name: str) -> str:
    """A unique path under a shared root."""
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as plain Parquet under the shared root and read it back, so that rounds do not grow one plan."""
    path = fresh_path(shared_root(df.sparkSession), name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, key: str, name: str, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows shuffled once by ``key``, worked on by ``then`` (joins and groups by that key) and written as a bucketed table under
    the shared root: later joins and groups by the key read them in place, without another shuffle."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(shared_root(spark), name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    (then(df.repartition(n, key)).write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key)
     .saveAsTable(table, format="parquet"))
    return spark.table(table)
