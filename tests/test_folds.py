"""Bindings that copy nothing, and folds that keep what is found."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions.exprs import fold_found, let
from lexmill.functions.lexing import lex_cpp


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_binding_is_no_transform(spark):
    df = spark.createDataFrame([("a b",)], "c string").select(let(F.split("c", " "), lambda w: F.concat(w, w)).alias("x"))
    assert df.first().x == ["a", "b", "a", "b"]
    assert "transform(" not in plan(df)


def test_plain_tokens_are_told_by_one_lookup(spark):
    df = spark.createDataFrame([("if (a->b >= .5) { x.y = 'c'; }",)], "c string").select(lex_cpp(F.col("c")).alias("x"))
    assert "INSET" in plan(df)
    told = [p.tag for p in df.first().x]
    assert told == [
        "if", "(", "identifier", "->", "field_identifier", ">=", "number_literal", ")", "{", "identifier", ".", "field_identifier", "=",
        "char_literal", ";", "}",
    ]


@pytest.mark.parametrize("size", [0, 1, 1_023, 1_024, 1_025, 2_048, 2_049, 5_000])
def test_fold_found(spark, size):
    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("span"))

    def step(s, x):
        return F.struct((s["n"] + 1).alias("n"), F.when(x % 7 == 3, s["n"]).alias("span"))

    def both(a):
        return fold_found(a, zero, step, lambda s: s["span"], lambda found, last: F.struct(found.alias("found"), last["n"].alias("n")))

    df = spark.createDataFrame([(list(range(size)),)], "a array<int>")
    out = df.select(let(F.col("a"), both).alias("x")).first().x
    assert (out.found, out.n) == ([x for x in range(size) if x % 7 == 3], size)
