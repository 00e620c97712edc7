"""Stream forms of intake, creation and change application.

The portal receives one event per HTTP call; here those events arrive as files (JSON bodies or parquet change rows)
and a Structured Streaming query handles each micro-batch with ``foreachBatch``: normalise, then write the rows to a
plain parquet log partitioned by batch id. A replayed batch (``foreachBatch`` is at-least-once) replaces its own
partition, so nothing is applied twice. The state of a table is the fold of that log (``streaming.state``).

All paths are given by the caller and must be shared by driver and executors.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard.operators.changes import split_changes
from workboard.operators.intake import number_rows, split_valid
from workboard.sources.tables import released

MARKS = "batch BIGINT, first BIGINT, last BIGINT, stamp TIMESTAMP_NTZ"


def _start(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool):
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint folder that all machines share")
    w = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_log(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A log of batches with its declared schema; a log that no batch has written yet has no rows."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def _log(df: DataFrame, path: str, batch_id: int) -> None:
    """Write ``df`` as the partition of its batch (none, if it has no rows), in files of Spark's advisory size: intake deals
    bodies out over many tasks."""
    _write(df.hint("rebalance").withColumn("batch", F.lit(batch_id).cast("bigint")), path)


def change_log_stream(changes: DataFrame, normalise: Callable[[DataFrame], DataFrame], log_path: str, checkpoint: str,
                      available_now: bool = True, rejects_path: str | None = None, keys: tuple = ("Id",), seq: str = "seq"):
    """Append a change feed to the log at ``log_path``, one ``batch`` partition per micro-batch.

    Changes that cannot be applied (``Motivo`` of ``normalise``, or no key or order) go to ``rejects_path`` with their
    reason and never to the log; without that path they are left out.
    """
    def on_batch(batch: DataFrame, batch_id: int):
        with released():
            typed = normalise(batch)
            if "Motivo" not in typed.columns:
                typed = typed.withColumn("Motivo", F.lit(None).cast("string"))
            good, bad = split_valid(typed)
            usable, unordered = split_changes(good.drop("Motivo"), list(keys), seq)
            _log(usable, log_path, batch_id)
            if rejects_path:
                _log(bad.unionByName(unordered), rejects_path, batch_id)

    return _start(changes, on_batch, checkpoint, available_now)


def intake_stream(bodies: DataFrame, normalise: Callable[[DataFrame], DataFrame], accepted_path: str,
                  rejects_path: str, checkpoint: str, available_now: bool = True):
    """R4 intake: a stream of raw request bodies → typed rows in ``accepted_path`` and rejects (with their reason) in
    ``rejects_path``."""
    def on_batch(batch: DataFrame, batch_id: int):
        with released():  # both outputs read the typed rows; recomputed from the batch if an executor is lost
            good, bad = split_valid(normalise(batch))
            _log(good.drop("Motivo"), accepted_path, batch_id)
            _log(bad, rejects_path, batch_id)

    return _start(bodies, on_batch, checkpoint, available_now)


def _mark_before(spark: SparkSession, marks_path: str, batch_id: int) -> tuple[int | None, dt.datetime | None]:
    """``(largest id in use before the batch, stamp the batch had when it ran before)``: one row of a small table."""
    marks = read_log(spark, marks_path, MARKS)
    row = marks.agg(F.max_by(F.when(F.col("batch") < batch_id, F.col("last")), F.when(F.col("batch") < batch_id, F.col("batch"))),
                    F.max(F.when(F.col("batch") == batch_id, F.col("stamp")))).first()
    return row[0], row[1]


def create_stream(bodies: DataFrame, normalise: Callable[[DataFrame], DataFrame], ddl: str, order_by: list, accepted_path: str,
                  rejects_path: str, marks_path: str, checkpoint: str, base_id: Callable[[], int] = lambda: 0, as_of=None,
                  stamp_col: str | None = "FechaRegistro", keep: list[str] | None = None, available_now: bool = True):
    """R4 + S4: a stream of POST bodies → finished rows with ids, stamp and the declared columns (``INSERT … OUTPUT Id``).

    Ids continue from a high-water mark kept next to the batch log: one row for each batch, the ids it took. A batch starts
    after the mark of the batch before it and writes its own mark last. A replayed batch therefore finds the
    same mark, takes the same ids in the same order, keeps its first stamp, and replaces its own partitions; a batch that failed
    half-way has no mark and is done again. Ids have no gaps, because a mark counts the accepted rows.

    ``base_id()`` (the largest id of the table) is asked once, before the first batch ever, and kept as the mark of batch -1.
    """
    def on_batch(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        last, stamp = _mark_before(spark, marks_path, batch_id)
        if last is None:
            last = int(base_id() or 0)
            _mark(spark, marks_path, -1, last, last, None)
        stamp = as_of or stamp or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        with released():
            good, bad = split_valid(normalise(batch))
            new = number_rows(good, ddl, order_by, last, stamp, stamp_col, keep)
            _log(new, accepted_path, batch_id)
            _log(bad, rejects_path, batch_id)
            _mark(spark, marks_path, batch_id, last + 1, last + good.count(), stamp)

    return _start(bodies, on_batch, checkpoint, available_now)


def _mark(spark: SparkSession, path: str, batch_id: int, first: int, last: int, stamp) -> None:
    _write(spark.createDataFrame([(batch_id, first, last, stamp)], MARKS).coalesce(1), path)
