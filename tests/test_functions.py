import datetime as dt
import decimal

from pyspark.sql import functions as F

from workboard.functions import coerce, display

EMOJI = "\U0001f600"


def _one(spark, values, fn, ddl="v string"):
    df = spark.createDataFrame([(v,) for v in values], ddl)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_clean_text(spark):
    vals = [None, "", "   ", " a ", " x ", "﻿y﻿", "　z　", "ab" + EMOJI + "cd"]
    assert _one(spark, vals, lambda c: coerce.clean_text(c)) == [None, None, None, "a", "x", "y", "z",
                                                                  "ab" + EMOJI + "cd"]
    # bound counts characters; an emoji at the bound stays whole
    assert _one(spark, ["ab" + EMOJI + "cd", "abcdef"], lambda c: coerce.clean_text(c, 3)) == ["ab" + EMOJI, "abc"]


def test_numbers(spark):
    vals = ["12", "12.7", "12abc", "abc", "", " ", "1e3", "0x10", "1d", "Infinity", "-5", "150", None, " -12.7 "]
    assert _one(spark, vals, coerce.to_num) == [12.0, 12.7, None, None, None, 0.0, 1000.0, 16.0, None,
                                                float("inf"), -5.0, 150.0, None, -12.7]
    assert _one(spark, vals, coerce.to_int_trunc) == [12, 12, None, None, None, 0, 1000, 16, None, None, -5, 150,
                                                      None, -12]
    assert _one(spark, vals, coerce.to_int_prefix) == [12, 12, 12, None, None, None, 1, 0, 1, None, -5, 150, None,
                                                       -12]
    assert _one(spark, vals, coerce.clamp_progress) == [12, 12, 12, None, None, None, 1, 0, 1, None, 0, 100, None,
                                                        0]
    assert _one(spark, ["99999999999", "3000000000"], coerce.to_int_trunc) == [None, None]
    dec = _one(spark, ["12.345", "10000000", "9999999.99", "Infinity"], lambda c: coerce.to_decimal(c, 9, 2))
    assert dec == [decimal.Decimal("12.35"), None, decimal.Decimal("9999999.99"), None]


def test_dates(spark):
    vals = ["2026-08-13", "2026-08-13T10:30:00Z", "2026-08-13T23:30:00-05:00", "2026-02-31", "13/08/2026", "",
            "2026-08-13 08:15", None]
    ts = _one(spark, vals, coerce.to_timestamp_utc)
    assert ts == [dt.datetime(2026, 8, 13), dt.datetime(2026, 8, 13, 10, 30), dt.datetime(2026, 8, 14, 4, 30), None,
                  None, None, dt.datetime(2026, 8, 13, 8, 15), None]
    assert _one(spark, vals[:3], coerce.to_date_utc) == [dt.date(2026, 8, 13), dt.date(2026, 8, 13),
                                                         dt.date(2026, 8, 14)]
    now = dt.datetime(2026, 1, 1)
    assert _one(spark, ["2026-08-13", "mañana"], lambda c: coerce.date_or_now(c, now)) == [dt.datetime(2026, 8, 13),
                                                                                          now]


def _json(spark, texts, fn):
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    return [r[0] for r in df.select(fn(F.try_variant_get(F.try_parse_json("j"), "$.x", "variant"))).collect()]


def test_flags(spark):
    texts = ['{"x": true}', '{"x": "Sí"}', '{"x": "si"}', '{"x": "no"}', '{}', '{"x": "true"}', '{"x": 1}']
    assert _json(spark, texts, coerce.yes_no) == ["Sí", "Sí", "Sí", "No", "No", "No", "No"]
    assert _json(spark, texts, coerce.strict_bit) == [True, False, False, False, False, False, True]
    t2 = ['{"x": "0"}', '{"x": "false"}', '{"x": 0}', '{"x": ""}', '{"x": null}', '{}', '{"x": []}', '{"x": false}']
    assert _json(spark, t2, coerce.truthy) == [True, True, False, False, False, False, True, False]
    assert _json(spark, ['{"x": "1"}'], coerce.strict_bit) == [True]


def test_lists(spark):
    texts = ['{"x": ["a", null, "", "b"]}', '{"x": []}', '{"x": "  solo "}', '{}', '{"x": [" c "]}']
    assert _json(spark, texts, lambda v: coerce.join_list(v, ", ")) == ["a, b", "", "solo", None, " c "]


def test_display(spark):
    df = spark.createDataFrame([(0.5, None), (2.49, dt.date(2026, 1, 2))], "x double, d date")
    r = df.select(display.round_half_up("x").alias("r"), display.fmt_date("d").alias("f"),
                  display.kind_label(F.lit("erp")).alias("k"), display.kind_label(F.lit("otro")).alias("o")).collect()
    assert [(x.r, x.f, x.k, x.o) for x in r] == [(1, "—", "ERP", "otro"), (2, "2026-01-02", "ERP", "otro")]
    w = spark.createDataFrame([(dt.datetime(2026, 1, 1, 22), None), (None, dt.datetime(2026, 1, 2, 2)), (None, None)],
                              "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in w.select(display.window_text("a", "b")).collect()] == \
        ["2026-01-01 22:00", " → 2026-01-02 02:00", "—"]


def test_strict_bit_text_matches_variant_rule(spark):
    texts = ["true", "1", '"1"', "1.0", "0", '"true"', "false", "", None, " true "]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    a = [r[0] for r in df.select(coerce.strict_bit_text("v")).collect()]
    b = [r[0] for r in df.select(coerce.strict_bit(F.try_parse_json(coerce.js_trim("v")))).collect()]
    assert a == b == [True, True, True, True, False, False, False, False, False, True]


def test_trim_list(spark):
    df = spark.createDataFrame([([" a ", "", "  ", "b"],)], "v array<string>")
    assert df.select(coerce.trim_list(F.col("v"))).first()[0] == ["a", "b"]


def test_dates_do_not_depend_on_session_zone(spark):
    vals = ["2026-08-13", "2026-08-13T10:30:00Z", "2026-08-13T23:30:00-05:00", "2026-08-13 08:15"]
    expected = [dt.datetime(2026, 8, 13), dt.datetime(2026, 8, 13, 10, 30), dt.datetime(2026, 8, 14, 4, 30),
                dt.datetime(2026, 8, 13, 8, 15)]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("America/Bogota", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert _one(spark, vals, coerce.to_timestamp_utc) == expected
            assert _one(spark, ["x"], lambda c: coerce.date_or_now(c, dt.datetime(2026, 1, 1, 5))) == \
                [dt.datetime(2026, 1, 1, 5)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_minute_precision_with_zone(spark):
    assert _one(spark, ["2026-08-13T10:30+01:00", "2026-08-13T10:30Z"], coerce.to_timestamp_utc) == \
        [dt.datetime(2026, 8, 13, 9, 30), dt.datetime(2026, 8, 13, 10, 30)]
