"""Long single texts: four times the input may take at most about four times the time."""

import time

import pytest
from pyspark.sql import functions as F

from lexmill.functions.exprs import let, scan
from lexmill.functions.extraction import cpp_functions
from lexmill.functions.lexing import lex_cpp, lex_java
from lexmill.functions.python_lexing import lex_python
from lexmill.functions.spans import cpp_spans, java_spans, python_spans

BODY = "(int a, char *b) { if (a > 1) { log(a); } return a; }\n"
CASES = {
    "cpp spans": (lambda c: let(lex_cpp(c), cpp_spans), "int f" + BODY),
    "cpp functions": (lambda c: cpp_functions(c, False), "int f" + BODY),
    "java spans": (lambda c: let(F.transform(lex_java(c), lambda p: p["token"]), java_spans), "public int f" + BODY),
    "python spans": (lambda c: let(lex_python(c), python_spans), "def f(x):\n    if x > 1:\n        return 1\n    return x\n"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_many_functions_in_one_text(spark, name):
    step, unit = CASES[name]
    seconds = []
    for count in (100, 4_000, 16_000):
        df = spark.createDataFrame([(unit * count,)], "c string").select(F.size(step(F.col("c"))).alias("n"))
        began = time.perf_counter()
        assert df.first()["n"] == count
        seconds.append(time.perf_counter() - began)
    # The first, small text shows what planning takes.
    assert seconds[2] - seconds[0] < 8 * max(seconds[1] - seconds[0], 1.0), seconds


@pytest.mark.parametrize("size", [0, 1, 15, 16, 17, 255, 256, 257, 511, 512, 513, 2_000])
def test_scan(spark, size):
    df = spark.createDataFrame([(list(range(size)),)], "a array<int>")
    (found,) = df.select(let(F.col("a"), lambda a: scan(a, F.lit(7), lambda s, x: s + x)).alias("s")).first()
    assert found == [7 + k * (k + 1) // 2 for k in range(size)]
