"""Ordered deletes, id-assigning streams, base-and-tail state, declared scans, landed pages and collected lists."""

import datetime as dt
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from workboard import schemas
from workboard.functions import coerce
from workboard.operators import changes, directory, intake, ordered_deletes
from workboard.sources import tables
from workboard.streaming import apply as streams
from workboard.streaming import state

NOW = dt.datetime(2026, 9, 1)
TREE = "Id bigint, TareaPadreId bigint, Nombre string"


# ------------------------------------------------------------------ X3 X5 one after the other

def _one_by_one(tree, requests):
    """The portal's way: each request against what is left. Equal ``seq``: all judged against the rows before them."""
    left, out = dict(tree), []
    for _, same in itertools.groupby(sorted(set(requests), key=lambda r: (r[1], r[0])), key=lambda r: r[1]):
        gone = []
        for i, q in same:
            held = any(p == i and c != i for c, p in left.items())
            out.append((i, q, "missing" if i not in left else "blocked" if held else "deleted"))
            if out[-1][2] == "deleted":
                gone.append(i)
        for i in gone:
            del left[i]
    return sorted(left), sorted(out)


def _in_order(spark, tree, requests):
    tasks = spark.createDataFrame([(i, p, f"t{i}") for i, p in tree], TREE)
    left, out, rejects = ordered_deletes.delete_tasks_in_order(tasks, spark.createDataFrame(requests, "Id bigint, seq bigint, quien string"))
    assert rejects.count() == 0
    return sorted(r.Id for r in left.collect()), sorted(map(tuple, out.collect()))


def _asked(pairs):
    return [(i, q, "x") for i, q in pairs]


def test_ordered_deletes_of_small_plans(spark):
    tree = [(1, None), (2, 1), (3, 1), (4, 3), (5, 5), (6, 7), (7, 6)]  # 5 names itself, 6 and 7 each other
    cases = [[(4, 1), (3, 2), (2, 3), (1, 4)], [(1, 1), (3, 2), (4, 3), (2, 4), (3, 5), (1, 6), (1, 7)], [(5, 1), (6, 2), (7, 3)],
             [(2, 1), (9, 1), (2, 2)], [(3, 5), (4, 5), (3, 6)]]
    for pairs in cases:
        assert _in_order(spark, tree, _asked(pairs)) == _one_by_one(tree, pairs)


def test_ordered_deletes_of_a_chain_and_a_hot_parent(spark):
    chain = [(i, i - 1 if i else None) for i in range(12)]
    down = [(i, 100 - i) for i in range(12)]
    assert _in_order(spark, chain, _asked(down)) == ([], sorted((i, q, "deleted") for i, q in down))
    hot = [(0, None)] + [(i, 0) for i in range(1, 3000)]
    pairs = [(0, 1)] + [(i, 10 + i % 7) for i in range(1, 3000)] + [(0, 16), (0, 17), (0, 18)]
    left, out = _in_order(spark, hot, _asked(pairs))
    assert left == [] and [o for o in out if o[0] == 0] == [(0, 1, "blocked"), (0, 16, "blocked"), (0, 17, "deleted"), (0, 18, "missing")]


def test_ordered_deletes_match_single_steps(spark):
    rng = random.Random(1)
    tree = [(i, rng.choice([None, *range(max(0, i - 6), i)]) if i else None) for i in range(120)]
    pairs = [(rng.randrange(125), rng.randrange(400)) for _ in range(900)]
    assert _in_order(spark, tree, _asked(pairs)) == _one_by_one(tree, pairs)


def test_ordered_deletes_reject_and_take_nothing(spark):
    tasks = spark.createDataFrame([(1, None, "a")], TREE)
    bad = spark.createDataFrame([(None, 1), (1, None)], "Id bigint, seq bigint")
    left, out, rejects = ordered_deletes.delete_tasks_in_order(tasks, bad)
    assert (left.count(), out.count()) == (1, 0)
    assert sorted(r.Motivo for r in rejects.collect()) == ["sin_clave", "sin_orden"]
    left, out, _ = ordered_deletes.delete_tasks_in_order(tasks.limit(0), spark.createDataFrame([(1, 1)], "Id bigint, seq bigint"))
    assert left.count() == 0 and [r.outcome for r in out.collect()] == ["missing"]


def test_ordered_deletes_move_requests_and_rows_by_id_once(spark):
    """What is left and the outcomes read requests and rows where they were placed: only what the rounds found is shuffled."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    tasks = spark.createDataFrame([(i, i - i % 4 if i % 4 else None, "t") for i in range(40)], TREE)
    requests = spark.createDataFrame([(i, 50 - i) for i in range(45)] + [(8, 60), (8, 60)], "Id bigint, seq bigint")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        left, out, _ = ordered_deletes.delete_tasks_in_order(tasks, requests)
        for df, n in ((left, 0), (out, 46)):
            assert df.count() == n
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") <= 2, plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# ------------------------------------------------------------------ S4 in R4

BODY = '{"solicitante":"%s","area":"TI"}'


def _land(spark, path, names):
    rows = [(i, BODY % n if n else "{}") for i, n in names]
    spark.createDataFrame(rows, "Ref bigint, body string").coalesce(1).write.mode("append").parquet(path)


def _create(spark, root, checkpoint, base, as_of=NOW):
    src = spark.readStream.schema("Ref bigint, body string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    streams.create_stream(src, lambda b: intake.erp_requests(b).drop("body"), schemas.REQUESTS_ERP, [F.col("Ref")], f"{root}/rows",
                          f"{root}/rejects", f"{root}/marks", f"{root}/{checkpoint}", base, as_of, keep=["Ref"]).awaitTermination()
    rows = spark.read.parquet(f"{root}/rows")
    return sorted((r.Id, r.Ref, r.Estado, r.FechaRegistro) for r in rows.collect())


def test_stream_assigns_ids_and_a_replay_repeats_them(spark, tmp_dir):
    _land(spark, f"{tmp_dir}/in/a", [(1, "ana"), (2, None), (3, "eva")])
    _land(spark, f"{tmp_dir}/in/b", [(4, "luis")])
    first = _create(spark, tmp_dir, "ckpt", lambda: 40)
    assert [(i, r) for i, r, _, _ in first] == [(41, 1), (42, 3), (43, 4)] and {(e, t) for _, _, e, t in first} == {("Nuevo", NOW)}
    # a later start goes on from the marks, whatever the table holds by then
    _land(spark, f"{tmp_dir}/in/c", [(6, "mar"), (5, "sol")])
    later = _create(spark, tmp_dir, "ckpt", lambda: 9999)
    assert [(i, r) for i, r, _, _ in later[3:]] == [(44, 5), (45, 6)] and later[:3] == first
    # without its checkpoint the stream hands out every batch again: same ids, nothing twice
    assert _create(spark, tmp_dir, "ckpt2", lambda: 9999) == later
    assert [r.Ref for r in spark.read.parquet(f"{tmp_dir}/rejects").collect()] == [2]
    marks = sorted((r.batch, r.first, r.last) for r in spark.read.parquet(f"{tmp_dir}/marks").collect())
    assert marks == [(-1, 40, 40), (0, 41, 42), (1, 43, 43), (2, 44, 45)]


def test_a_batch_that_failed_half_way_takes_the_same_ids(spark, tmp_dir, monkeypatch):
    _land(spark, f"{tmp_dir}/in/a", [(1, "ana"), (2, "eva")])
    _land(spark, f"{tmp_dir}/in/b", [(3, "luis")])
    real, calls = streams._mark, []

    def broken(spark_, path, batch_id, *rest):
        calls.append(batch_id)
        if calls.count(1) == 1 and batch_id == 1:
            raise RuntimeError("lost before the mark")
        return real(spark_, path, batch_id, *rest)

    monkeypatch.setattr(streams, "_mark", broken)
    with pytest.raises(Exception):  # noqa: B017  the stream wraps the error
        _create(spark, tmp_dir, "ckpt", lambda: 0)
    assert [(i, r) for i, r, _, _ in _create(spark, tmp_dir, "ckpt", lambda: 7)] == [(1, 1), (2, 2), (3, 3)]


def test_replayed_batches_keep_their_stamp(spark, tmp_dir):
    _land(spark, f"{tmp_dir}/in/a", [(1, "ana")])
    first = _create(spark, tmp_dir, "ckpt", lambda: 0, as_of=None)
    assert first[0][3] is not None and _create(spark, tmp_dir, "ckpt2", lambda: 0, as_of=None) == first


# ------------------------------------------------------------------ R4 base and tail

CHG = "Id bigint, seq bigint, Estado string, Responsable string, FechaEntrega date"


def _target(spark, n):
    rows = [(i, NOW, "t", "s", "a", None, None, None, "No", None, None, "Nuevo", "ana", None, None, "{}", None) for i in range(n)]
    return spark.createDataFrame(rows, schemas.REQUESTS_ERP)


def test_base_and_tail_equal_the_whole_fold_in_any_order(spark, tmp_dir):
    rng = random.Random(2)
    rows = [(rng.randrange(14), rng.randrange(1000), rng.choice([None, "A", "B", "C"]), rng.choice([None, "x", "y"]), None) for _ in range(300)]
    target, log = _target(spark, 12), f"{tmp_dir}/log"
    whole = sorted(map(tuple, changes.apply_patch(target, spark.createDataFrame(rows, CHG), changes.TRACKING_POLICY, as_of=NOW).collect()))
    folded = []
    for b in range(5):
        part = spark.createDataFrame(rows[b * 60:(b + 1) * 60], CHG).withColumn("batch", F.lit(b).cast("bigint"))
        part.write.mode("append").partitionBy("batch").parquet(log)
        seen = streams.read_log(spark, log, CHG + ", batch bigint")
        if b in (0, 2):
            folded.append(state.write_base(target, seen, f"{tmp_dir}/bases", f"{tmp_dir}/index", changes.TRACKING_POLICY, NOW))
        now = state.read_state(target, seen, f"{tmp_dir}/index", changes.TRACKING_POLICY, NOW)
        batch = changes.apply_patch(target, seen.drop("batch"), changes.TRACKING_POLICY, as_of=NOW)
        assert sorted(map(tuple, now.collect())) == sorted(map(tuple, batch.collect()))
    assert folded == [0, 2] and sorted(map(tuple, now.collect())) == whole
    # only the tail's partitions are read
    plan = state._from_base(target, seen, f"{tmp_dir}/index")[1]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "(batch" in plan and "> 2)" in plan
    # with nothing new no base is written; a base that was half written is not in the index
    assert state.write_base(target, seen.where("batch <= 2"), f"{tmp_dir}/bases", f"{tmp_dir}/index", changes.TRACKING_POLICY) == 2
    os.makedirs(f"{tmp_dir}/bases/base-4-broken")
    assert state.newest_base(spark, f"{tmp_dir}/index")[0] == 2


def test_empty_logs_leave_the_initial_rows(spark, tmp_dir):
    log = streams.read_log(spark, f"{tmp_dir}/none", CHG + ", batch bigint")
    assert state.newest_base(spark, f"{tmp_dir}/index") is None
    assert state.write_base(_target(spark, 2), log, f"{tmp_dir}/b", f"{tmp_dir}/index", changes.TRACKING_POLICY) == -1
    got = state.read_state(_target(spark, 2), log, f"{tmp_dir}/index", changes.TRACKING_POLICY).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, _target(spark, 2).collect()))


def test_change_log_keeps_rejects_out(spark, tmp_dir):
    rows = [("1", 1, '{"estado":"A"}'), ("", 2, "{}"), ("2", None, "{}"), ("3", 3, "{")]
    spark.createDataFrame(rows, "id string, seq bigint, body string").write.parquet(f"{tmp_dir}/in/a")
    src = spark.readStream.schema("id string, seq bigint, body string").parquet(f"{tmp_dir}/in/*")
    streams.change_log_stream(src, intake.tracking_changes, f"{tmp_dir}/log", f"{tmp_dir}/c", rejects_path=f"{tmp_dir}/bad").awaitTermination()
    assert [r.Id for r in spark.read.parquet(f"{tmp_dir}/log").collect()] == [1]
    assert sorted(r.Motivo for r in spark.read.parquet(f"{tmp_dir}/bad").collect()) == ["falta_id", "json_invalido", "sin_orden"]


def test_frames_are_released(spark):
    ids = spark.range(5).withColumnRenamed("id", "k")
    with tables.released():
        frame = tables.hold(ids)
        assert frame.is_cached and tables.with_ids(ids, [F.col("k")]).count() == 5
    assert not frame.is_cached


def test_upsert_reads_its_target_once(spark, tmp_dir):
    from tests.test_changes import CHG_DDL, _chg
    spark.createDataFrame([], schemas.RELEASES).write.parquet(f"{tmp_dir}/releases")
    target = spark.read.parquet(f"{tmp_dir}/releases")
    out = changes.upsert(target, spark.createDataFrame([_chg("gen", 7, 3, "a", "Rollback")], CHG_DDL), as_of=NOW)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" in plan and "LeftAnti" not in plan and out.count() == 1


# ------------------------------------------------------------------ S1 S3 T6 H26

def test_declared_scan(spark, tmp_dir):
    ddl = "Id BIGINT NOT NULL, Nombre STRING NOT NULL, Orden INT, Estado STRING, Hito BOOLEAN NOT NULL"
    rows = [("1", "a", [1], "s", None), ("x", "b", None, None, None), ("3", None, None, None, None), ("4", "d", None, None, "z"), (None, "e", [2], None, None)]
    spark.createDataFrame(rows, "Id string, Nombre string, Orden array<int>, Estado string, Otra string").write.parquet(f"{tmp_dir}/t")
    good, bad = tables.scan_table(spark, f"{tmp_dir}/t", ddl, {"Hito": False})
    assert [tuple(r) for r in good.collect()] == [(4, "d", None, None, False)]
    assert good.schema.simpleString() == schemas.struct(ddl).simpleString()
    assert sorted((r.Id or "", r.Motivo) for r in bad.collect()) == [
        ("", "nulo:Id"), ("1", "tipo_invalido:Orden"), ("3", "nulo:Nombre"), ("x", "tipo_invalido:Id")]
    spark.createDataFrame([(1, "a")], "Id bigint, Nombre string").write.parquet(f"{tmp_dir}/typed")
    found, _ = tables.scan_table(spark, f"{tmp_dir}/typed", "Id BIGINT, Nombre STRING")
    assert "EqualTo(Id,1)" in found.where("Id = 1")._jdf.queryExecution().executedPlan().toString()


def test_landed_pages(spark, tmp_dir):
    user = '{"displayName":"Ana","mail":"ana@x.org"}'
    os.makedirs(f"{tmp_dir}/lines")
    with open(f"{tmp_dir}/lines/p.json", "w") as f:
        f.write(f'{{"value":[{user},{user}],"@odata.nextLink":"u"}}\n{{"value":[{user}\n\n{{"error":{{"code":"x"}}}}\n{{"value":[]}}\n{{}}\nnull\n')
    users, bad = directory.landed_pages(spark, f"{tmp_dir}/lines")
    assert users.count() == 2 and sorted(r.Motivo for r in bad.collect()) == ["error_del_directorio", "pagina_invalida", "pagina_invalida"]
    os.makedirs(f"{tmp_dir}/files")
    with open(f"{tmp_dir}/files/p.json", "w") as f:
        f.write(f'{{\n "value": [\n  {user}\n ]\n}}\n')
    users, bad = directory.landed_pages(spark, f"{tmp_dir}/files", whole_files=True)
    assert [r.displayName for r in users.collect()] == ["Ana"] and bad.count() == 0


def test_spanish_positions(spark):
    names = ["oso", "Ñandú", "nz", "Nube", "alba", "Álvaro", "Azul", "ñora"]
    users = spark.createDataFrame([(n, f"{n}@x.org", None, None) for n in names], "displayName string, mail string, userPrincipalName string, jobTitle string")
    got = directory.ranked_members(users, "x.org").orderBy("Posicion").collect()
    assert [r.name for r in got] == ["alba", "Álvaro", "Azul", "Nube", "nz", "Ñandú", "ñora", "oso"]


def test_lists_are_collected_as_by_the_form(spark):
    v = F.parse_json(F.lit('[" a ", "", "  ", null, 0, false, 7, "b"]'))
    row = spark.range(1).select(coerce.join_list(v, "|").alias("plain"), coerce.join_list(v, "|", collect=True).alias("form"),
                                coerce.trim_list(F.array(F.lit(" x"), F.lit(None).cast("string"), F.lit(" "))).alias("l")).first()
    assert (row.plain, row.form, row.l) == (" a |  |7|b", "a|7|b", ["x"])
