"""Folds against plain search on random token streams, and properties of the lexers."""

import random
import re

from pyspark.sql import functions as F

from lexmill.functions.exprs import scan
from lexmill.functions.lexing import lex_cpp, lex_java
from lexmill.functions.normalize import _SEGMENT
from lexmill.functions.spans import cpp_spans, java_spans, python_spans

CPP_WORDS = [
    "f (", ") {", "}", "int", ";", "f ( ) { x", "if ( x ) {", ") throw ( ) { y", "{ }", "(", ")", "{", "class A {",
    "::", "static", "throw", ",", "\n",
]
JAVA_WORDS = ["{", "}", "(", ")", ";", "f", "throws", "E", "NEW_LINE", "/*", "*/", "//", "ENDCOM", "static"]
PYTHON_WORDS = ["def", "INDENT", "DEDENT", "x", "NEW_LINE"]
PAIRS = "array<struct<token:string,tag:string>>"


def streams(words, seed, count=400, longest=60):
    source = random.Random(seed)
    weights = [3] * 4 + [1] * (len(words) - 4)
    drawn = [source.choices(words, weights, k=source.randint(0, longest)) for _ in range(count)]
    return [[t for piece in row for t in piece.split(" ")] for row in drawn]




def closing(tokens, body):
    depth = 0
    for at in range(body, len(tokens)):
        depth += {"{": 1, "}": -1}.get(tokens[at], 0)
        if depth == 0:
            return at
    return len(tokens) - 1


def cpp_by_search(tokens):
    def at(i):
        return tokens[i] if i < len(tokens) else None

    found, after = [], 0
    for p, token in enumerate(tokens):
        direct = at(p + 1) == "{" and at(p + 2) not in (None, "}")
        throwing = at(p + 1) == "throw" and at(p + 4) == "{" and at(p + 5) not in (None, "}")
        if token != ")" or p < after or not (direct or throwing):
            continue
        bounds = [i for i in range(after, p) if tokens[i] in (";", "{", "}", "\n")]
        start = bounds[-1] + 1 if bounds else after
        body = tokens.index("{", p)
        name = tokens.index("(", start) - 1 if "(" in tokens[start:body] else -1
        if name >= start and tokens[name] in ("f", "E"):
            end = closing(tokens, body)
            found.append((start, end))
            after = end + 1
    return found


def java_by_search(tokens):
    found, after = [], 0
    for p, token in enumerate(tokens):
        ahead = [t for t in tokens[p + 1 :] if t != "NEW_LINE"][:3]
        is_header = ahead[:1] == ["{"] or (ahead[:1] == ["throws"] and ahead[2:] == ["{"])
        if token != ")" or p < after or not is_header:
            continue
        start = 0
        for i in range(p - 1, -1, -1):
            if tokens[i] in (";", "{", "}", "*/", "ENDCOM", "NEW_LINE"):
                opener = {"*/": "/*", "ENDCOM": "//"}.get(tokens[i])
                before = [k for k in range(i) if tokens[k] == opener]
                start = before[-1] if before else i + 1
                break
        end = closing(tokens, tokens.index("{", p))
        found.append((start, end))
        after = end + 1
    return found


def python_by_search(tokens):
    found, at, depth = [], 0, 0
    while "def" in tokens[at:]:
        start = tokens.index("def", at)
        for end in range(start, len(tokens)):
            depth += {"INDENT": 1, "DEDENT": -1}.get(tokens[end], 0)
            if tokens[end] == "DEDENT" and depth == 0:
                found.append((start, end))
                break
        else:
            break
        at = end + 1
    return found


def spans_of(spark, step, rows, schema):
    df = spark.createDataFrame([(i, row) for i, row in enumerate(rows)], schema).repartition(4)
    out = df.select("id", step(F.col("t")).alias("s")).orderBy("id").collect()
    return [[(s.start, s.end) for s in row.s] for row in out]


def test_cpp_spans(spark):
    rows = streams(CPP_WORDS, 1)
    tagged = [[(t, "identifier" if t in ("f", "E") else t) for t in row] for row in rows]
    wanted = [cpp_by_search(r) for r in rows]
    assert sum(map(len, wanted)) > 300
    assert spans_of(spark, cpp_spans, tagged, f"id int, t {PAIRS}") == wanted


def test_java_spans(spark):
    rows = streams(JAVA_WORDS, 2)
    assert spans_of(spark, java_spans, rows, "id int, t array<string>") == [java_by_search(r) for r in rows]


def test_python_spans(spark):
    rows = streams(PYTHON_WORDS, 3)
    assert spans_of(spark, python_spans, rows, "id int, t array<string>") == [python_by_search(r) for r in rows]


def test_scan_over_chunk_borders(spark):
    rows = [[1] * n for n in (0, 1, 127, 128, 129, 256, 1000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, v array<int>")
    out = df.select("id", scan(F.col("v"), F.lit(0), lambda a, x: a + x).alias("s")).orderBy("id").collect()
    assert [row.s for row in out] == [list(range(1, len(r) + 1)) for r in rows]


CODE = ["int", " ", "a", "->", "b", "(", ")", "{", "}", '"s; // x"', "'c'", "/* k */", "// l\n", "\n", "1.5e3", "#define N 1\n", "'", '"', "\\", "é", "\t"]


def test_segments_cover_the_text(spark):
    source = random.Random(4)
    texts = ["".join(source.choices(CODE, k=source.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, c string")
    joined = F.array_join(F.regexp_extract_all("c", F.lit(_SEGMENT), F.lit(0)), "")
    assert df.where(joined != F.col("c")).count() == 0


def test_tokens_cover_all_but_blanks(spark):
    source = random.Random(5)
    texts = ["".join(source.choices(CODE, k=source.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, c string")
    rows = df.select("c", lex_cpp(F.col("c"))["token"].alias("cpp"), lex_java(F.col("c"))["token"].alias("java"))
    for row in rows.collect():
        for tokens in (row.cpp, row.java):
            assert re.sub(r"\s", "", "".join(tokens)) == re.sub(r"\s", "", row.c)


JAVA_SHAPES = {
    "class A { @B({1, 2}) /* k */ public int f(int a /* { */) throws E, x.F { return a; } }": ["/* k */ public int f ( int a /* { */ ) throws E , x . F { return a ; }"],
    "class A { // c\n@x.y.Z(a = {\"}\"}) static void f() { g(() -> { h(); }); } }": [],
    "class A { abstract void f() throws E; int[] a = {1}; void g() { } }": ["void g ( ) { }"],
    "class A { @ B ( ( 1 ) ) A() { } int x; @C int y() { return x; }": ["@ B ( ( 1 ) ) A ( ) { }", "@ C int y ( ) { return x ; }"],
    "class A { R r = new R(1) { public void run() { x(); } }; void f() { open(": ["R r = new R ( 1 ) { public void run ( ) { x ( ) ; } }", "void f ( ) { open ("],
    "": [], "int x;": [], "void f(": [], "@A(": [], ")": [], "void f() throws X": [],
}


def test_java_functions_of_lexed_text(apply):
    from lexmill.functions.extraction import java_pair_functions
    from lexmill.functions.lexing import lex_java

    texts = list(JAVA_SHAPES)
    found = apply(lambda c: F.transform(java_pair_functions(lex_java(c), False, False), lambda f: f["text"]), *texts)
    for text, functions in zip(texts, found):
        if JAVA_SHAPES[text] or "static" not in text:
            assert functions == JAVA_SHAPES[text], text
    # A line comment in front belongs to the function; braces in its own body are counted.
    (shape,) = [f for t, f in zip(texts, found) if "static" in t]
    assert [s.split("static")[1] for s in shape] == [" void f ( ) { g ( ( ) -> { h ( ) ; } ) ; }"]
