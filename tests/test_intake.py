import datetime as dt
import json
import os

from pyspark.sql import functions as F

from workboard.operators import attachments, directory, intake

NOW = dt.datetime(2026, 9, 1)


def _bodies(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "Ref int, body string")


def test_erp_envelope_and_rules(spark):
    model = {"solicitante": " Ana ", "area": "Finanzas", "descripcion": "x" * 80, "modulos": ["Compras", "", None],
             "procesos": "Cierre", "transformar_fabric": "si", "estado": "", "proyecto_id": "12abc", "extra": {"k": 1}}
    texts = [json.dumps({"model": model}, separators=(",", ":"), ensure_ascii=False),
             json.dumps(dict(model, modulos=[]), separators=(",", ":"), ensure_ascii=False),
             "{not json", json.dumps({"model": {"area": "x"}}), '"texto"']
    r = {x["Ref"]: x for x in intake.erp_requests(_bodies(spark, texts)).collect()}
    a = r[0]
    assert (a["Solicitante"], a["Modulos"], a["Procesos"], a["TransformarFabric"], a["Estado"], a["ProyectoId"]) == \
        ("Ana", "Compras", "Cierre", "Sí", "Nuevo", 12)
    assert a["Titulo"] == "Finanzas – Compras" and a["Motivo"] is None
    assert json.loads(a["PayloadJson"])["extra"] == {"k": 1}  # unknown member kept
    assert r[1]["Modulos"] == "" and r[1]["Titulo"] == "Finanzas – " + "x" * 60  # '' falls back to description
    assert json.loads(r[1]["PayloadJson"])["solicitante"] == " Ana "
    assert r[2]["Motivo"] == "json_invalido"
    assert r[3]["Motivo"] == "faltan_obligatorios"
    assert r[4]["Motivo"] == "cuerpo_invalido"


def test_bodies_of_one_partition_are_parsed_by_many_tasks(spark):
    """A small file of many rows is one partition; its bodies are dealt out before they are parsed, none lost or doubled."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = json.dumps({"model": {"solicitante": "Ana", "area": "TI", "informacion_general": {"nombre_aplicacion": "Caja"}}})
    raw = _bodies(spark, [body] * 400 + ["{no"] * 40).coalesce(1)
    for read in (intake.erp_requests, intake.infra_requests):
        typed = read(raw).select("Ref", "Motivo")
        sizes = typed.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) == n and max(r["count"] for r in sizes) < 2 * 440 / n
        rows = typed.collect()
        assert sorted(r.Ref for r in rows) == list(range(440))
        assert sum(r.Motivo == "json_invalido" for r in rows) == 40


def test_infra_title_and_numbers(spark):
    body = {"model": {"informacion_general": {"nombre_aplicacion": "Caja", "identificador": "APP-1"},
                      "computo_y_contenedores": {"cpu_total_vcpu": "2.5", "ram_total_gb": 99999999999},
                      "clasificacion_registro": {"usuarios_concurrentes": "12.7", "estado": "  "},
                      "proyecto_id": 7.9},
            "sharepoint_row": {"FrontEnd": " React "}}
    r = intake.infra_requests(_bodies(spark, [json.dumps(body)])).first()
    assert r["Titulo"] == "APP-1 – Caja" and r["FrontEnd"] == "React" and r["Estado"] is None
    assert (float(r["CPURequerida"]), r["RAMRequeridaGB"], r["UsuariosConcurrentes"], r["ProyectoId"]) == \
        (2.5, None, 12, 7)


def test_notes_projects_tasks(spark):
    raw = spark.createDataFrame([("infra", "5", " hola ", None, "2026-01-02"), ("toString", "5", "x", None, None),
                                 ("erp", "0", "x", None, None), ("gen", "3", "  ", "yo", "mañana")],
                                "tipo string, solicitudId string, nota string, autor string, fecha string")
    n = intake.notes(raw, NOW).collect()
    assert [x["Motivo"] for x in n] == [None, "tipo_o_solicitud", "tipo_o_solicitud", "nota_vacia"]
    assert n[0]["Fecha"] == dt.datetime(2026, 1, 2) and n[3]["Fecha"] == NOW and n[0]["Nota"] == "hola"
    valid, rejects = intake.split_valid(intake.notes(raw, NOW))
    assert valid.count() + rejects.count() == raw.count()
    p = intake.projects(spark.createDataFrame([(" P ", None), ("", "x")], "nombre string, estado string"), NOW)
    assert [(x["Nombre"], x["Estado"], x["Motivo"]) for x in p.collect()] == [("P", "Activo", None),
                                                                             (None, "x", "sin_nombre")]
    t = intake.tasks(spark.createDataFrame([("3", "a", "150", "1"), ("0", "b", None, "true"), ("4", "c", "-5", '"1"')],
                                           "proyectoId string, nombre string, progreso string, esHito string"))
    assert [(x["Progreso"], x["EsHito"], x["Motivo"]) for x in t.collect()] == \
        [(100, True, None), (0, True, "sin_proyecto"), (0, True, None)]


def test_resolve_names(spark):
    projects = spark.createDataFrame([(1, "Alfa"), (2, "beta"), (3, "BETA")], "Id bigint, Nombre string")
    rows = spark.createDataFrame([(1, "alfa"), (2, "  Beta "), (3, "Gamma"), (4, "gamma "), (5, ""), (6, None)],
                                 "k int, nombre string")
    out, new = intake.resolve_project_names(rows, "nombre", projects, NOW)
    r = {x["k"]: (x["ProyectoId"], x["Creado"]) for x in out.collect()}
    assert r == {1: (1, False), 2: (3, False), 3: (4, True), 4: (4, True), 5: (None, False), 6: (None, False)}
    assert [(x["Id"], x["Nombre"]) for x in new.collect()] == [(4, "Gamma")]


def test_attachments(spark):
    import base64
    good = base64.b64encode(b"hola mundo").decode()
    raw = spark.createDataFrame([
        ("infra", "1", 'a"b\nc.txt', None, good),
        ("infra", "1", "x", "text/plain", " " + good[:4] + "\n" + good[4:] + "!"),  # stray characters skipped
        ("erp", "2", "x", None, ""), ("gen", "3", "x", None, "===="), ("gen", "3", "x", None, good),
        ("otro", "3", "x", None, good),
    ], "tipo string, solicitudId string, nombre string, contentType string, base64 string")
    r = attachments.intake(raw, max_bytes=5).collect()
    assert [x["Motivo"] for x in r] == ["excede_limite", "excede_limite", "sin_contenido", "vacio", "excede_limite",
                                        "tipo_o_solicitud"]
    r = attachments.intake(raw).collect()
    assert bytes(r[0]["Contenido"]) == b"hola mundo" and bytes(r[1]["Contenido"]) == b"hola mundo"
    assert (r[0]["Tamano"], r[0]["ContentType"]) == (10, "application/octet-stream")
    names = spark.createDataFrame([('a"b\nc', ), (None,)], "n string")
    assert [x[0] for x in names.select(attachments.download_name("n")).collect()] == ["a_b_c", "documento"]


def test_directory_pages(spark, tmp_dir):
    pages = [{"value": [{"displayName": "Ñu", "mail": "nu@Example.com", "userPrincipalName": None, "jobTitle": None},
                        {"displayName": "azul", "mail": None, "userPrincipalName": "azul@example.com",
                         "jobTitle": "TI"},
                        {"displayName": "Guest", "mail": "g#EXT#@example.com", "userPrincipalName": None,
                         "jobTitle": None}],
              "@odata.nextLink": "next"},
             {"value": [{"displayName": "álamo", "mail": "alamo@EXAMPLE.COM"},
                        {"displayName": "Otro", "mail": "o@other.org"}, {"displayName": "", "mail": "x@example.com"},
                        {"displayName": "nz", "mail": "nz@example.com"},
                        {"displayName": "Ob", "mail": "ob@example.com"}]}]
    for i, p in enumerate(pages):
        with open(os.path.join(tmp_dir, f"page{i}.json"), "w") as f:
            f.write(json.dumps(p, ensure_ascii=False))
    users = directory.read_pages(spark, tmp_dir)
    names = [r["name"] for r in directory.sorted_members(users, "example.com").collect()]
    assert names == ["álamo", "azul", "nz", "Ñu", "Ob"]
    jt = {r["name"]: r["jobTitle"] for r in directory.members(users, "@example.com").collect()}
    assert jt["azul"] == "TI" and jt["Ñu"] == ""


def test_ids_beyond_32_and_64_bits(spark):
    big, huge = "3000000000", "99999999999999999999"
    t = spark.createDataFrame([(big, "a", big, big), (big, "a", None, huge), (huge, "a", None, None), ("0", "a", None, None)],
                              "proyectoId string, nombre string, dependenciaId string, tareaPadreId string")
    got = [(r["ProyectoId"], r["DependenciaId"], r["TareaPadreId"], r["Motivo"]) for r in intake.tasks(t).collect()]
    assert got == [(3000000000, 3000000000, 3000000000, None), (3000000000, None, None, "id_fuera_de_rango"),
                   (None, None, None, "id_fuera_de_rango"), (0, None, None, "sin_proyecto")]
    n = spark.createDataFrame([("erp", big, "x"), ("erp", huge, "x")], "tipo string, solicitudId string, nota string")
    assert [(r["SolicitudId"], r["Motivo"]) for r in intake.notes(n, NOW).collect()] == [
        (3000000000, None), (None, "id_fuera_de_rango")]


def test_infra_number_out_of_range_is_rejected(spark):
    body = '{"model":{"informacion_general":{"nombre_aplicacion":"x"},"computo_y_contenedores":{"cpu_total_vcpu":"%s"}}}'
    raw = spark.createDataFrame([(body % "1e9",), (body % "12.345",)], "body string")
    got = [(None if r["CPURequerida"] is None else float(r["CPURequerida"]), r["Motivo"])
           for r in intake.infra_requests(raw).collect()]
    assert got == [(None, "numero_fuera_de_rango"), (12.35, None)] or got == [(None, "numero_fuera_de_rango"), (12.34, None)]


def test_change_bodies(spark):
    raw = spark.createDataFrame([("7", 1, '{"estado":" Cerrado ","fechaEntrega":"2026-02-31"}'), ("0", 2, "{}"), ("5", 3, "{bad")],
                                "id string, seq int, body string")
    got = [(r["Id"], r["seq"], r["Estado"], r["FechaEntrega"], r["Motivo"]) for r in intake.tracking_changes(raw).collect()]
    assert got == [(7, 1, "Cerrado", None, None), (0, 2, None, None, "falta_id"), (5, 3, None, None, "json_invalido")]
    rel = spark.createDataFrame([('{"tipo":"erp","solicitudId":"4","docFuncional":"0","induccion":[]}', 1)], "body string, seq int")
    r = intake.release_changes(rel).first()
    assert (r["Tipo"], r["SolicitudId"], r["Estado"], r["DocArquitectura"], r["DocFuncional"], r["Induccion"], r["Motivo"]) == (
        "erp", 4, "Planificado", False, True, True, None)
