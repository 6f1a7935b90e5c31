"""Scalar kernels, validity, and the two SQL grammars."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparklith.functions import expressions as X
from sparklith.functions.registry import Signature, default_registry, kernel_from_udf
from sparklith.functions.types import PAIRS, SPARK_TYPE
from sparklith.functions.validity import both_valid, either_valid, same_validity, with_validity
from sparklith.plans.sql import expression_type, parse, project


def column(df, c):
    return [r[0] for r in df.orderBy("pos").select(c).collect()]


def test_three_columns_with_null(spark):
    df = spark.createDataFrame([(0, 4, 4, 4), (1, 4, 5, 5), (2, 4, None, 6)], "pos int, col1 bigint, col2 int, col3 int")
    out = project(df, "(col1+col2)+col3", strict=True)
    assert out.schema["out"].dataType.simpleString() == "bigint"
    assert [r[0] for r in out.collect()] == [12, 14, None]


@pytest.mark.parametrize(
    ("c1", "c2", "c3", "c4", "expected"),
    [
        ([1, None, 3], [1, 3, 3], [0, 0, 0], [4, 5, 6], [6, None, 12]),
        ([1, 2, 3], [1, 3, 3], [0, 0, 0], [4, 5, 6], [6, 10, 12]),
        ([1, 1, 1], [1, 3, 3], [0, 0, 0], [4, 5, 6], [6, 9, 10]),
    ],
)
def test_three_level_tree(spark, c1, c2, c3, c4, expected):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(zip(c1, c2, c3, c4))], "pos int, c1 int, c2 int, c3 bigint, c4 bigint")
    inner = X.add(df, "c1", "c2")
    assert column(df, X.add(df, X.add(df, "c3", inner), "c4")) == expected


def test_comparisons(spark):
    df = spark.createDataFrame([(0, 1, 1, 3, 2), (1, None, 2, 1, 2), (2, 3, 2, 2, 9)], "pos int, a bigint, b bigint, c bigint, d bigint")
    assert column(df, X.eq(df, "a", "b")) == [True, None, False]
    assert column(df, X.gt(df, "c", "d")) == [True, False, False]
    assert column(df, X.ge(df, "d", "c")) == [False, True, True]


def test_strings_and_booleans(spark):
    df = spark.createDataFrame([(0, "aa", "aa", 5, True), (1, "b", "bb", 5, False), (2, None, "c", 1, True), (3, "", "", 1, None)], "pos int, s string, t string, n bigint, b boolean")
    assert column(df, X.eq(df, "s", "t")) == [True, False, None, True]
    assert column(df, X.add(df, "n", "b")) == [6, 5, 2, None]
    assert column(df, X.eq(df, "n", "b")) == [False, False, True, None]


def test_overflow(spark):
    df = spark.createDataFrame([(0, 2**63 - 1, 1)], "pos int, a bigint, b bigint")
    with pytest.raises(PySparkException, match="ARITHMETIC_OVERFLOW"):
        column(df, X.add(df, "a", "b"))
    assert column(df, X.add(df, "a", "b", overflow="null")) == [None]
    with pytest.raises(ValueError):
        X.add(df, "a", "b", overflow="wrap")


def test_unsigned_64_bit(spark):
    df = spark.sql("select 0 as pos, cast('18446744073709551614' as decimal(20,0)) as a, cast(1 as decimal(20,0)) as b, cast(2 as decimal(20,0)) as c")
    assert int(column(df, X.add(df, "a", "b"))[0]) == 2**64 - 1
    with pytest.raises(PySparkException, match="overflow"):
        column(df, X.add(df, "a", "c"))


def test_validity(spark):
    df = spark.createDataFrame([(0, 7, 1), (1, 8, 0), (2, 9, 2), (3, None, 1), (4, 5, None)], "pos int, v bigint, f int")
    assert column(df, with_validity(F.col("v"), F.col("f"))) == [7, None, 9, None, None]
    assert column(df, both_valid(F.col("v"), F.col("f"))) == [True, True, True, False, False]
    assert column(df, either_valid(F.col("v"), F.col("f"))) == [True] * 5
    a = spark.createDataFrame([(1,), (1,), (0,)], "f int")
    assert same_validity(a, a)
    assert not same_validity(a, a.distinct())


def test_signatures_and_pairs(spark):
    assert Signature.of("+", "u64", "u32") == Signature.of("+", "u64", "u32")
    assert Signature.of("+", "u64", "u32") != Signature.of("+", "u32", "u64")
    assert Signature.of("+", "u64", "u32") != Signature.of("=", "u64", "u32")
    registry = default_registry()
    for name in ("+", "=", ">", ">="):
        assert all(registry.find(name, a, b) for a, b in PAIRS)
        with pytest.raises(ValueError):
            registry.find(name, "u32", "u64")
    for role in SPARK_TYPE:
        assert registry.find("hash=", role).result == "u64"
        assert registry.find("hash+=", "u64", role).result == "u64"


def test_user_kernels(spark):
    df = spark.createDataFrame([(0, 5, 3), (1, None, 1)], "pos int, a bigint, b bigint")
    with pytest.raises(ValueError, match="no kernel"):
        project(df, "a - b", strict=True)
    registry = default_registry()
    registry.register(Signature.of("-", "u64", "u64"), lambda x, y: x - y, "u64")
    assert [r[0] for r in project(df, "a - b", strict=True, registry=registry).collect()] == [2, None]

    @F.pandas_udf("bigint")
    def times(x, y):
        return x * y

    registry.register(Signature.of("-", "u64", "u64"), kernel_from_udf(times), "u64")
    assert [r[0] for r in project(df.where("pos = 0"), "a - b", strict=True, registry=registry).collect()] == [15]
    with pytest.raises(ValueError, match="unknown role"):
        registry.register(Signature.of("-", "u64", "u64"), times, "f64")


GOOD = ["a=b", "a>=b", "a>b", "a+b", "(a+b)+c", "a>=(b+c)", "a+(b=c)", "SELECT a+b", "a+n"]
BAD = ["a", "1", "a+1", "a<b", "a<=b", "a*b", "a/b", "a-b", "(a+b)=c", "(a+b)>=c", "(a+b)+(b+c)", "hash(a)", "t.a", "a and b", "a+", "(a+b", "a b", "missing+a", "A+b", "n+a", "", "a+b)"]


@pytest.mark.parametrize("text", GOOD)
def test_strict_accepts(spark, text):
    df = spark.createDataFrame([(3, 2, 1, 4)], "a bigint, b bigint, c bigint, n int")
    assert project(df, text, strict=True).count() == 1


@pytest.mark.parametrize("text", BAD)
def test_strict_rejects(spark, text):
    df = spark.createDataFrame([(3, 2, 1, 4)], "a bigint, b bigint, c bigint, n int")
    with pytest.raises(ValueError):
        project(df, text, strict=True)


def test_free_grammar(spark):
    df = spark.createDataFrame([(3, 2, 1)], "a bigint, b bigint, c bigint")
    for text, value in (("(a+b)=c", False), ("a+1", 4), ("SELECT (a+b)+(b+c)", 8), ("a*b", 6), ("case when a < b then 0 else c end", 1)):
        assert project(df, text).first()[0] == value


def test_types_of_expressions(spark):
    df = spark.createDataFrame([(3, 2, 1)], "a bigint, n int, m int")
    assert expression_type(df, "a+n") == "u64"
    assert expression_type(df, "n+m") == "u32"
    assert expression_type(df, "a>n") == "bool"
    assert parse("a+(b)") == parse("SELECT a + ( b )")


def test_a_name_that_begins_with_select(spark):
    df = spark.createDataFrame([(1, 5), (2, 5)], "selected bigint, b bigint")
    for text in ("selected + b", " SELECT  selected + b", "select\nselected + b"):
        assert [r[0] for r in project(df, text).collect()] == [6, 7]
