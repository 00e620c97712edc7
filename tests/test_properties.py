"""Property tests: the Column coercions against small pure-Python models of the JavaScript rules."""

import json
import math
import os
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from workboard.functions import coerce
from workboard.operators import intake
from workboard.streaming.apply import intake_stream

WS = coerce.JS_WS_CHARS
ALPHABET = list("0123456789+-.eExX abc") + [" ", "﻿", "　", "\t", "\n"]


def js_trim(s):
    return s.strip(WS)


def js_parse_int(s):
    m = re.match(r"^([+-]?[0-9]+)", s.lstrip(WS))
    if s == "" or not m:
        return None
    v = int(m.group(1))
    return v if -2**31 <= v < 2**31 else None


def js_number(s):
    if s == "":
        return None
    t = js_trim(s)
    if t == "":
        return 0.0
    if re.fullmatch(r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?", t):
        return float(t)
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", t):
        return float(int(t[2:], 16))
    return None


strings = st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=300)


@settings(max_examples=6, deadline=None)
@given(strings)
def test_coercions_match_js_models(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select(coerce.js_trim("v"), coerce.to_int_prefix("v"), coerce.to_num("v")).collect()
    for v, (t, i, n) in zip(values, rows):
        assert t == js_trim(v), v
        assert i == js_parse_int(v), v
        expected = js_number(v)
        if expected is None or n is None:
            assert n == expected, v
        elif math.isinf(expected):
            assert n == expected, v
        else:
            assert math.isclose(n, expected, rel_tol=1e-12), v


def test_intake_stream_splits_accepted_and_rejects(spark, tmp_dir):
    src = os.path.join(tmp_dir, "bodies")
    os.makedirs(src)
    bodies = [{"model": {"solicitante": "Ana", "area": "TI"}}, {"model": {"area": "TI"}}, "{broken"]
    for i, b in enumerate(bodies):
        with open(os.path.join(src, f"b{i}.txt"), "w") as f:
            f.write(b if isinstance(b, str) else json.dumps(b))
    stream = spark.readStream.text(src).withColumnRenamed("value", "body")
    q = intake_stream(stream, intake.erp_requests, os.path.join(tmp_dir, "ok"), os.path.join(tmp_dir, "bad"),
                      os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination()
    ok = spark.read.parquet(os.path.join(tmp_dir, "ok"))
    bad = spark.read.parquet(os.path.join(tmp_dir, "bad"))
    assert [r["Solicitante"] for r in ok.collect()] == ["Ana"]
    assert sorted(r["Motivo"] for r in bad.collect()) == ["faltan_obligatorios", "json_invalido"]
    assert ok.count() + bad.count() == len(bodies)


def test_intake_stream_replay_replaces_its_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "bodies")
    os.makedirs(src)
    with open(os.path.join(src, "b0.txt"), "w") as f:
        f.write(json.dumps({"model": {"solicitante": "Ana", "area": "TI"}}))
    ok, bad = os.path.join(tmp_dir, "ok"), os.path.join(tmp_dir, "bad")
    for run in range(2):  # second run: fresh checkpoint, same batch id 0 → replaces, no duplicate
        stream = spark.readStream.text(src).withColumnRenamed("value", "body")
        intake_stream(stream, intake.erp_requests, ok, bad, os.path.join(tmp_dir, f"ckpt{run}")).awaitTermination()
    assert spark.read.parquet(ok).count() == 1
