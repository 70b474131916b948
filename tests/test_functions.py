import math

import pytest
from pyspark.sql import functions as F

from cellforge.functions import ieee
from cellforge.functions.expr import ExpressionError, parse

NAN, INF = math.nan, math.inf


def rows(spark, *columns):
    return spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (NAN, 1.0), (6.0, 3.0), (1.0, -0.0)], "a double, b double").select(*columns).collect()


def test_division_follows_ieee(spark):
    got = [r[0] for r in rows(spark, ieee.div(F.col("a"), F.col("b")))]
    assert got[:2] == [INF, -INF] and math.isnan(got[2]) and math.isnan(got[3]) and got[4] == 2.0 and got[5] == -INF


def test_nan_compares_as_in_c(spark):
    cols = [f(F.col("a"), F.lit(NAN)).alias(n) for n, f in ieee.COMPARE.items()]
    for r in rows(spark, *cols):
        assert r.asDict() == {"lt": False, "le": False, "gt": False, "ge": False, "eq": False, "ne": True}


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 0.5, 1.0, 1.1, NAN, INF)], "x double")
    assert [r[0] for r in df.select(ieee.uniform_bin(F.col("x"), 0, 1, 2)).collect()] == [None, 0, 1, 1, None, None, None]
    assert [r[0] for r in df.select(ieee.edge_bin(F.col("x"), [0.0, 0.4, 0.6, 1.0])).collect()] == [None, 0, 1, 2, None, None, None]


@pytest.mark.parametrize(
    ("text", "value"),
    [("1+2*3", 7), ("(1+2)*3", 9), ("2**3**2", 512), ("-2**2", -4), ("2^-1", 0.5), ("7-2-1", 4), ("a/b", 2), ("a>b", 1), ("a==6 and b==2", 0), ("if(a>b, 10, 20)", 10), ("fmod(-a, 4)", -2), ("max(a, b)", 6), ("heaviside(0, 0.5)", 0.5), ("floor(-0.5)", -1), ("pow(a, 2) - sqrt(36)", 30), ("1e2 + .5", 100.5), ("pi > 3", 1)],
)
def test_expressions(spark, text, value):
    got = spark.createDataFrame([(6.0, 3.0)], "a double, b double").select(parse(text, {"a": F.col("a"), "b": F.col("b")})).first()[0]
    assert got == pytest.approx(value)


@pytest.mark.parametrize("text", ["", "a +", "(a", "a b", "nope(a)", "c", "max(a)", "a $ b", "a; drop table x"])
def test_bad_expressions(spark, text):
    with pytest.raises(ExpressionError):
        parse(text, {"a": F.lit(1.0), "b": F.lit(2.0)})


def test_logs_of_zero_and_below(spark):
    got = spark.range(1).select(parse("log(0)", {}), parse("log10(-1)", {})).first()
    assert got[0] == -INF and math.isnan(got[1])
