"""X3 + X5 as a sequence: deletes applied one after the other, as the portal receives them.

A task row cannot go while another row names it as its parent. Whether a request succeeds therefore depends on the requests
before it: child first, then parent, removes both; parent first is refused, and a later request for it may still succeed.

The batch is not replayed row by row. A task goes at its first request after all of its children went, so the time at which
it goes follows from the times of its children: a fixpoint over the forest of requested tasks, climbed from the leaves, one
aggregate per parent and round. There are as many rounds as that forest is high (a plan of phases and subtasks: two); a phase
with any number of children is combined before the shuffle.

Ids may be long texts, so rows travel by id once: requests, and rows with what was asked of them, are written hashed by id
(:func:`placed`) and every later join by id reads them in place. A row without children is settled by its first request. A
round moves only what its rows report to their parents; it looks at later requests only where the first came too early.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workboard.operators.changes import split_changes
from workboard.session import cut, placed


def _climb(known: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, ``at``) of the requested rows with children that go. ``known``: id, up, n (children), first and last request."""
    known = known.where("first is not null")
    holding = known.where("n > 0")
    again = cut(asked.join(holding.where("first < final").select("id"), "id", "left_semi"), "deletes-again")
    newly, partly, rounds = known.where("n = 0").select("up", F.col("first").alias("at")), None, []
    while True:
        sums = (newly.where(F.col("up").isNotNull()).groupBy("up").agg(F.count(F.lit(1)).alias("gone"), F.max("at").alias("last"))
                .withColumnRenamed("up", "id"))
        if partly is not None:
            sums = partly.unionByName(sums).groupBy("id").agg(F.sum("gone").alias("gone"), F.max("last").alias("last"))
        reached = holding.join(sums, "id").withColumn("free", F.col("gone") == F.col("n"))
        later = again.withColumnRenamed("id", "_id")
        tried = reached.join(later, F.col("free") & (F.col("first") <= F.col("last")) & (F.col("id") == F.col("_id"))
                             & (F.col("seq") > F.col("last")), "left")
        state = cut(tried.groupBy("id", "up", "free", "gone", "last", "first")
                    .agg(F.min("seq").alias("retry")).withColumn("at", F.when(
                        F.col("free"), F.when(F.col("first") > F.col("last"), F.col("first")).otherwise(F.col("retry"))))
                    .drop("first", "retry"), "deletes-round")
        partly = state.where("not free").select("id", "gone", "last")
        newly = state.where("at is not null").select("id", "up", "at")
        rounds.append(newly.select("id", "at"))
        if newly.isEmpty():
            return reduce(DataFrame.unionByName, rounds)


def delete_tasks_in_order(tasks: DataFrame, requests: DataFrame, key: str = "Id", parent: str = "TareaPadreId",
                          seq: str = "seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """X3 + X5: apply the delete requests ``(key, seq)`` in the order of ``seq``.

    Returns ``(tasks', outcomes, rejects)``. Each distinct request has one outcome: ``deleted`` (it removed the row),
    ``blocked`` (rows that name it as parent were still there) or ``missing`` (no such row then, still a success).
    Requests of equal ``seq`` do not see each other: a child must go at an *earlier* ``seq`` than its parent. A cycle of
    parents is never removed; a row that names itself is. Requests without key or order are ``rejects`` with their reason.
    """
    usable, rejects = split_changes(requests.select(key, seq), [key], seq)
    asked = placed(usable.select(F.col(key).alias("id"), F.col(seq).alias("seq")), "id", "deletes-asked",
                   lambda d: d.distinct())
    spans = asked.groupBy("id").agg(F.min("seq").alias("first"), F.max("seq").alias("final"))
    above = F.when(F.col(parent) != F.col(key), F.col(parent))  # a row that names itself does not hold itself
    children = (tasks.select(above.alias("id")).where(F.col("id").isNotNull()).groupBy("id")
                .agg(F.count(F.lit(1)).alias("n")))
    rows = placed(tasks, key, "deletes-rows", lambda d: (
        d.join(spans.toDF(key, "_first", "_final"), key, "left").join(children.toDF(key, "_n"), key, "left")
        .withColumn("_n", F.coalesce("_n", F.lit(0)))))
    known = rows.select(F.col(key).alias("id"), above.alias("up"), F.col("_n").alias("n"), F.col("_first").alias("first"),
                        F.col("_final").alias("final"))
    gone = rows.join(_climb(known, asked).toDF(key, "_climbed"), key, "left").withColumn(
        "_at", F.when(F.col("_n") == 0, F.col("_first")).otherwise(F.col("_climbed")))
    found = (asked.join(gone.select(F.col(key).alias("id"), F.lit(True).alias("_e"), F.col("_at").alias("at")), "id", "left")
             .select(F.col("id").alias(key), F.col("seq").alias(seq),
                     F.when(F.col("_e").isNull(), "missing")
                     .when(F.col("at").isNull() | (F.col("seq") < F.col("at")), "blocked")
                     .when(F.col("seq") == F.col("at"), "deleted").otherwise("missing").alias("outcome")))
    return gone.where(F.col("_at").isNull()).select(*tasks.columns), found, rejects
