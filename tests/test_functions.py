"""Golden rows for the scalar rules (times and text)."""
from pyspark.sql import functions as F

from pliego.functions import text as T
from pliego.functions import times as D


def one(spark, col, data, schema="s string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_floor_days_negative(spark):
    df = spark.createDataFrame([("2022-01-02T00:00:00-05:00", "2022-01-03T01:00:00-05:00")], "e string, s string")
    assert df.select(D.floor_days(D.instant("e"), D.instant("s"))).first()[0] == -2


def test_floor_days_positive_and_null(spark):
    df = spark.createDataFrame([("2022-01-03T01:00:00-05:00", "2022-01-02T00:00:00-05:00"), ("bad", None)],
                               "e string, s string")
    assert [r[0] for r in df.select(D.floor_days(D.instant("e"), D.instant("s"))).collect()] == [1, None]


def test_local_year_ignores_session_zone(spark):
    assert one(spark, D.local_year("s"), [("2022-12-31T23:30:00-05:00",)]) == [2022]
    assert one(spark, D.date_year("s"), [("2023-01-01T02:00:00+00:00",)]) == [2023]
    assert one(spark, D.local_year("s"), [("bad",), (None,)]) == [None, None]


def test_hours_and_minutes(spark):
    df = spark.createDataFrame([("2022-01-01T10:30:00-05:00", "2022-01-01T08:00:00-05:00")], "a string, b string")
    r = df.select(D.hours_between(D.instant("a"), D.instant("b")),
                  D.minutes_between(D.instant("a"), D.instant("b"))).first()
    assert (r[0], r[1]) == (2.5, 150.0)


def test_process_code(spark):
    got = one(spark, T.process_code("s"), [
        ("ocds-5wno2w-SIE-15BAE-045-2022-54082",), ("ocds-5wno2w-SIEB-GADMSC-014-2022-15065",),
        ("xocds-5wno2w-A-B",), ("ocds-5wno2w--x",), ("ocds-5wno2w-SIE",), (None,)])
    assert got == ["SIE-15BAE-045-2022", "SIEB-GADMSC-014-2022", None, None, None, None]


def test_url_tail(spark):
    got = one(spark, T.url_tail("s"), [
        ("https://host/PLATAFORMA/ocds/ocds-5wno2w-SIE-15BAE-045-2022-54082",), ("https://a/b/",), ("noslash",)])
    assert got == ["ocds-5wno2w-SIE-15BAE-045-2022-54082", None, None]


def test_patterns(spark):
    data = [("Convalidación",), ("convalidar",), ("Convalidación de ofertas",), ("NO se presentaron preguntas",)]
    wide = one(spark, T.matches("s", T.RE_WIDE), data)
    narrow = one(spark, T.matches("s", T.RE_NARROW), data)
    assert wide == [False, True, True, True]
    assert narrow == [True, False, True, False]
    assert one(spark, T.match_count("s", T.RE_WIDE), [("CONVALIDA convalidar",)]) == [2]


def test_strip_tags_and_lines(spark):
    got = spark.createDataFrame([("<td>\n<b>a</b>\nb&nbsp;\n",)], "s string").select(
        T.text_lines(T.strip_tags("s"))).first()[0]
    assert got == ["", "a", "b&nbsp;"]
    assert one(spark, F.size(T.text_lines("s")), [("",)]) == [0]


def test_first_link(spark):
    got = one(spark, T.first_link("s"), [('<a href="info.cpe?id=7,">x</a>',), ("<a>none</a>",)])
    assert got == [T.HARVEST_BASE_URL + "info.cpe?id=7", None]
