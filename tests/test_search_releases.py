import datetime as dt

import pytest
from pyspark.sql import functions as F

from workboard import schemas
from workboard.operators import releases, search


def _requests(spark, n=600):
    rows = []
    for i in range(1, n + 1):
        rows.append((i, dt.datetime(2026, 1, 1), f"Titulo {i}", "Aplicación Caja" if i % 2 else "portal_web",
                     f"ID-{i}", "Proyecto X" if i % 3 else "100% nube", None, None, None, None, None, None, None,
                     None, None, None, None, None, None, None, None, None, None, None, None, None, None,
                     "Nuevo" if i % 4 else "Cerrado", None, None, None, None, i % 5))
    return spark.createDataFrame(rows, schemas.REQUESTS_INFRA)


def test_list_top500_and_filters(spark):
    df = _requests(spark)
    top = search.list_requests(df, "infra", limit=500).collect()
    assert search.list_requests(df, "infra", limit=None).count() == 600  # all of them, when asked for
    assert len(top) == 500 and top[0]["Id"] == 600 and top[-1]["Id"] == 101
    assert len(top[0]) == len(search.INFRA_LIST)
    caja = search.list_requests(df, "infra", q="caja", limit=500).collect()  # mixed case
    assert len(caja) == 300 and all(r["Aplicacion"] == "Aplicación Caja" for r in caja)
    assert search.list_requests(df, "infra", q="aplicacion", limit=500).count() == 0  # accent-sensitive
    assert search.list_requests(df, "infra", q="portal_web", limit=500).count() == 300
    # % stays a wildcard: 200 "100% nube" projects plus "Titulo 100"
    assert search.list_requests(df, "infra", q="100%", limit=500).count() == 201
    both = search.list_requests(df, "infra", estado="Cerrado", proyecto_id="2", limit=500).collect()
    assert {(r["Estado"]) for r in both} == {"Cerrado"} and len(both) == 30
    assert search.list_requests(df, "infra", estado="", q="", limit=500).count() == 500  # empty filters add nothing
    with pytest.raises(ValueError):
        search.list_requests(df, "infra", proyecto_id="abc", limit=500)


def test_by_id_and_keys(spark):
    df = _requests(spark, 10)
    assert search.by_id(df, "7").first()["Id"] == 7
    with pytest.raises(ValueError):
        search.by_id(df, "0")
    ids = spark.createDataFrame([(0,), (3,), (99,), (None,)], "Id bigint")
    assert [r["Id"] for r in search.by_ids(df, ids).collect()] == [3]


def _release(i, tipo, sid, fecha, estado, gates, titulo=None, vi=None, vf=None):
    return (i, tipo, sid, titulo, fecha, vi, vf, None, None, estado, None, None, *gates, None, None, None, None,
            None, None, None)


def test_board_rows(spark):
    as_of = dt.datetime(2026, 8, 1)
    d = dt.date
    rows = [
        _release(1, "infra", 10, None, "Planificado", (True, True, True, True)),
        _release(2, "erp", 11, d(2026, 8, 1), None, (True, False, False, False), titulo="Pase"),
        _release(3, "gen", 12, d(2026, 8, 8), "Completado", (False,) * 4),
        _release(4, "otro", 13, d(2026, 8, 9), "Aprobado", (False,) * 4, vi=dt.datetime(2026, 8, 9, 22)),
        _release(5, "erp", 14, d(2026, 7, 31), "Rollback", (False,) * 4, vf=dt.datetime(2026, 8, 1, 1)),
        _release(6, "erp", 15, d(2026, 8, 1), "En curso", (True, True, False, False)),
    ]
    df = spark.createDataFrame(rows, schemas.RELEASES)
    b = releases.board(df, as_of).collect()
    assert [r["Id"] for r in b] == [5, 6, 2, 3, 4, 1]  # dated first, date asc, id desc, nulls last
    by = {r["Id"]: r for r in b}
    assert (by[2]["DiasRestantes"], by[2]["Pronto"], by[2]["TituloTexto"]) == (0, True, "Pase")
    assert (by[3]["DiasRestantes"], by[3]["Pronto"]) == (7, False)  # completed
    assert (by[4]["DiasRestantes"], by[4]["Pronto"], by[4]["TipoTexto"]) == (8, False, "otro")
    assert (by[5]["DiasRestantes"], by[5]["Pronto"], by[5]["VentanaTexto"]) == (-1, False, " → 2026-08-01 01:00")
    assert (by[1]["TituloTexto"], by[1]["Entregables"], by[1]["EntregablesCompletos"], by[1]["FechaTexto"]) == \
        ("#10", 4, True, "—")
    assert by[4]["VentanaTexto"] == "2026-08-09 22:00"
    counts = {r["Estado"]: (r["Cantidad"], r["Canonico"]) for r in releases.status_counts(df).collect()}
    assert counts == {"Planificado": (1, True), "Aprobado": (1, True), "En curso": (1, True),
                      "Completado": (1, True), "Rollback": (1, True), None: (1, False)}
    t = releases.totals(df).first()
    assert (t["Total"], t["Listos"]) == (6, 1)
    assert sum(r["Cantidad"] for r in releases.status_counts(df).collect()) == df.count()


def test_feed_union(spark):
    df = _requests(spark, 5)
    feed = search.request_feed(df, df.limit(2), df.limit(1))
    assert feed.groupBy("Tipo").count().orderBy("Tipo").collect() == \
        [("erp", 2), ("gen", 1), ("infra", 5)]
    assert feed.count() == 8 and set(feed.columns) == {"Tipo", *search.FEED_COLS}
    assert feed.where(F.col("Tipo") == "infra").count() == 5


def test_search_backslash_and_bracket_are_literal(spark):
    rows = [(1, "C:\\temp\\x", "a[1]"), (2, "other", "b")]
    df = spark.createDataFrame(rows, "Id bigint, Titulo string, Solicitante string")
    hits = lambda q: sorted(r["Id"] for r in df.where(search.text_search(q, ["Titulo", "Solicitante"])).collect())
    assert hits("\\temp") == [1]
    assert hits("[1]") == [1]
    assert hits("x\\") == []
