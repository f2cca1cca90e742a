import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import text


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


CLEAN = {
    "the rain in spain": "the rain in spain",
    "the (rain) in. spain": "the ( rain ) in . spain",
    "新建总结": "新 建 总 结",
    "(": "(",
    "((": "( (",
    "É é": "É é",
    " a": " a",
    "a ": "a ",
    "😀a😀": "😀 a 😀",
    "x\x0cy": "x \x0c y",
    "": "",
}


def clean(s):
    """The cleaner, character by character."""
    out, blank = "", False
    for i, c in enumerate(s):
        if c in " \t\n\x0b\r\0":
            out += "" if blank else " "
            blank = True
        elif c in string.ascii_letters + string.digits + "',&#;":
            out += c.lower()
            blank = False
        else:
            out += ("" if blank or not out else " ") + c
            blank = False
            if i + 1 < len(s):
                out += " "
                blank = True
    return out


def test_clean_golden(spark):
    rows = spark.createDataFrame([(k,) for k in CLEAN], "s string").select("s", text.clean_tokens(F.col("s")).alias("c")).collect()
    assert {r.s: r.c for r in rows} == CLEAN
    assert {s: clean(s) for s in CLEAN} == CLEAN


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("aZé (.)\t\n,&😀0", max_size=12), min_size=20, max_size=20))
def test_clean_property(spark, xs):
    rows = spark.createDataFrame([(x,) for x in xs], "s string").select("s", text.clean_tokens(F.col("s")).alias("c")).collect()
    assert all(r.c == clean(r.s) for r in rows)


@pytest.mark.parametrize(
    ("given_", "want"),
    [("a\tB.c", "a\tb . c"), ("\tFoo", "\tfoo"), ("no tab", "no tab")],
)
def test_clean_last(spark, given_, want):
    assert one(spark, text.clean_last(F.lit(given_), 1)) == want


def test_tab_split_point(spark):
    assert [one(spark, text.tab_split_point(F.lit("ab\tc\td"), n)) for n in (1, 2, 3)] == [2, 4, 6]


def test_predicates(spark):
    assert one(spark, text.bad_key(F.lit("my_abc_title"))) and not one(spark, text.bad_key(F.lit("title")))
    assert one(spark, text.latin_only(F.lit("naïve 12"))) and not one(spark, text.latin_only(F.lit("да")))
    assert one(spark, text.ascii_only(F.lit("abc"))) and not one(spark, text.ascii_only(F.lit("é")))
    assert [one(spark, text.english_locale(F.lit(x))) for x in ("", " ", "-en-rGB", "-de")] == [True, True, True, False]


def test_fix_rows(spark):
    assert one(spark, text.fix_rows(F.lit("a\tb\nb\tc\td\ne\tf\tg\th\n"))) == ["a\tb\\nb\tc\td", "e\tf\tg\th"]


def test_values(spark):
    assert one(spark, text.sanitize(F.lit("a\tb\nc"))) == "a&#09;b&#10;c"
    assert one(spark, text.xml_value(F.lit("it's"))) == '"it\'s"'
    assert one(spark, text.xml_value(F.lit("@x"))) == "\\@x"
    assert one(spark, text.xml_value(F.lit('a"b\\c'))) == 'a\\"b\\\\c'
    assert one(spark, text.xml_value(F.lit("a\x01b"))) == "a\\u0001b"
    assert one(spark, text.size_bytes(F.lit("11.5 MB"))) == round(11.5 * 1024 * 1024)
    assert one(spark, text.size_bytes(F.lit("big"))) is None
    assert one(spark, text.xor_fold(F.lit("5^3^1"))) == 7
    assert str(one(spark, text.first_date(F.lit("on March 3, 2016 or so")))) == "2016-03-03 00:00:00"
    assert one(spark, text.host_port(F.lit("1.2.3.4:80")))["port"] == 80
    assert one(spark, text.host_port(F.lit("1.2.3.4:x"))) is None
    assert one(spark, text.flag_names(F.lit(9), text.ACCESS)) == ["public", "static"]


def test_locales(spark):
    n = F.lit(None).cast("string")
    assert one(spark, text.locale_string(F.lit("de"), F.lit("AT"), n, n)) == "-de-rAT"
    assert one(spark, text.locale_string(F.lit("sr"), F.lit("RS"), F.lit("Latn"), n)) == "-b+sr+Latn+RS"
    p = one(spark, text.locale_parts(F.lit("-b+sr+Latn+RS")))
    assert (p.language, p.script, p.region, p.variant) == ("sr", "Latn", "RS", None)


def test_cleaner_works_in_strips_and_without_lookarounds(spark, monkeypatch):
    rows = ["", " ", "a", ".", " .a", "Ab\u00e9\u8a9e!!", "\t\n x", "x \x00", "\u00e9", None, "\U0001f600\U0001f600 ok?"]
    want = ["", " ", "a", ".", " . a", "ab \u00e9 \u8a9e ! !", " x", "x ", "\u00e9", None, "\U0001f600 \U0001f600 ok ?"]
    assert text._clean(pa.array(rows)).to_pylist() == want
    monkeypatch.setattr(text.strips, "__defaults__", (3,))
    assert text._clean(pa.array(["x", *rows])[1:]).to_pylist() == want
    plan = spark.createDataFrame([("a",)], "s string").select(text.words(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_constants_are_found_once(spark):
    d = spark.createDataFrame([("a=5;b=a^3;", "+(a^b)+(b)+(7^a)")], "s string, e string")
    out = d.select(text.xor_digits(F.col("e"), text.xor_constants(F.col("s"))).alias("n"))
    assert out.first().n == 362
    assert out._jdf.queryExecution().optimizedPlan().toString().count("map_concat") <= 1
