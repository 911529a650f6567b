import math

import pytest
from pyspark.sql import functions as F

from marketframe.functions import semantics as sem


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("12.50", 12.5), ("12.5abc", 12.5), ("1,234", 1.0), ("", None), (None, None), ("abc", None),
    ("  7", 7.0), (".5", 0.5), ("-3.2e2x", -320.0), ("1e", 1.0), ("+4.", 4.0),
])
def test_parse_float(spark, text, expected):
    assert _one(spark, sem.parse_float("x"), text) == expected


@pytest.mark.parametrize("text,expected", [
    ("12.50", "12.50"), ("", "0.00"), (None, "0.00"), ("abc", "0.00"), ("12.5abc", "12.50"),
    ("1,234", "1.00"), ("99999999999999", None),
])
def test_parse_float_or_zero_is_money(spark, text, expected):
    v = _one(spark, sem.parse_float_or_zero("x"), text)
    assert (None if v is None else str(v)) == expected


@pytest.mark.parametrize("text,expected", [
    ("20", 20), ("12.5", 12), ("1e3", 1), (" -4x", -4), ("sin limite", None), (None, None), ("", None),
])
def test_parse_int(spark, text, expected):
    assert _one(spark, sem.parse_int("x"), text) == expected
    assert sem.parse_int_param(text) == expected


def test_parse_params():
    assert sem.parse_float_param("50000.5abc") == 50000.5
    assert math.isnan(sem.parse_float_param("abc"))


def test_falsy_rules(spark):
    df = spark.createDataFrame([("", 0), (None, None), ("a", 3)], "s string, n int")
    rows = df.select(sem.falsy_to_null("s").alias("s"), sem.falsy_default("n", 1, "number").alias("n"),
                     sem.falsy_default("s", "Near Mint").alias("d")).collect()
    assert [tuple(r) for r in rows] == [(None, 1, "Near Mint"), (None, 1, "Near Mint"), ("a", 3, "a")]


def test_blank(spark):
    df = spark.createDataFrame([("",), ("  \t",), (None,), (" x ",)], "x string")
    assert [r[0] for r in df.select(sem.is_blank("x")).collect()] == [True, True, True, False]
    with pytest.raises(ValueError):
        sem.require_text("   ")
    assert sem.require_text(" ring ") == " ring "


def test_ilike_contains_wildcards_and_escapes(spark):
    names = ["Red Dragon", "rod", "100% Pure", "a_b", "axb", "back\\slash", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")

    def hits(text, literal=False):
        return sorted(r[0] for r in df.where(sem.ilike_contains("name", text, literal)).collect())

    assert hits("r_d") == ["Red Dragon", "rod"]          # '_' stays a wildcard
    assert hits("RED") == ["Red Dragon"]                 # case-insensitive
    assert hits("a_b", literal=True) == ["a_b"]
    assert hits("100%", literal=True) == ["100% Pure"]
    assert hits("\\d") == ["Red Dragon", "rod"]          # backslash before other chars: literal char
    assert hits("k\\\\s") == ["back\\slash"]


def test_pg_order_null_placement(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "p int")
    assert [r[0] for r in df.orderBy(sem.pg_asc("p")).collect()] == [1, 3, None]
    assert [r[0] for r in df.orderBy(sem.pg_desc("p")).collect()] == [None, 3, 1]
