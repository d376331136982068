from pyspark.sql import functions as F

from lexmill.functions.exprs import words
from lexmill.functions.lexing import lex_cpp
from lexmill.functions.literals import text_pairs, text_tokens
from lexmill.functions.python_lexing import lex_python
from lexmill.functions.rendering import (
    indent_lines,
    join_macro_parameters,
    render_cfamily,
    render_pairs,
    render_python,
)
from lexmill.operators.tokens import rendered, tokenize


def test_indent_lines(apply):
    lines = "f OB_\n a OB_\n b\n CB_\nCB_\nCB_\nx OB_\nCB_ else OB_\ny"
    (text,) = apply(lambda c: indent_lines(F.split(c, "\n")), lines)
    assert text == "f OB_\n  a OB_\n    b\n  CB_\nCB_\nCB_\nx OB_\nCB_ else OB_\ny"


def test_render_cpp(apply):
    code = 'int f(int a) { if (a) { log("x {y};"); } return vec<vec<int> >(a); } // end'
    (text,) = apply(lambda c: render_cfamily(text_tokens(lex_cpp(c), "cpp", True)), code)
    assert text.split("\n") == [
        "int f ( int a ) {",
        "  if ( a ) {",
        '    log ( "x {y};" ) ;',
        "  }",
        "  return vec < vec < int >> ( a ) ;",
        "}",
        "// end",
        "",
    ]


def test_tags_save_the_second_lexing(apply):
    code = 'int f() { g("a"); }'
    assert apply(lambda c: render_pairs(lex_cpp(c)), code) == apply(
        lambda c: render_cfamily(lex_cpp(c)["token"]), code
    )


def test_rendered_text_lexes_to_the_same_tokens(apply):
    code = 'class A { int x; void m(int a) { for (;;) { s += "q; {r}"; } } };'
    tokens = apply(lambda c: text_tokens(lex_cpp(c), "cpp"), code)
    again = apply(lambda c: text_tokens(lex_cpp(render_cfamily(text_tokens(lex_cpp(c), "cpp"))), "cpp"), code)
    assert again == tokens


CODE = """#include <a.h>
#define MAX 1
// one { comment ; }
class A { /* two
 lines */ int x; void m(int a) { char c = '\\n'; s += "q; {r}\\t"; if (a >> 2) { g(); } else { h(); } } };
"""


def test_render_from_tags(apply):
    """Tags that went through literal processing say the same as lexing the joined tokens again."""
    pairs = lambda c: text_pairs(lex_cpp(c), "cpp", True)
    by_tags = apply(lambda c: render_pairs(pairs(c)), CODE)
    assert by_tags == apply(lambda c: render_cfamily(F.transform(pairs(c), lambda p: p["token"])), CODE)
    again = apply(lambda c: text_tokens(lex_cpp(render_pairs(pairs(c))), "cpp"), CODE)
    assert again == apply(lambda c: text_tokens(lex_cpp(c), "cpp"), CODE)


def test_lexer_stands_once_in_the_plan(spark):
    df = spark.createDataFrame([(1, CODE)], "id int, code string")
    for lang in ("cpp", "java"):
        plan = rendered(df, "code", lang)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == tokenize(df, "code", lang)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")


def test_lex_render_lex_needs_few_rounds(spark):
    before = spark.conf.get("spark.sql.analyzer.maxIterations")
    spark.conf.set("spark.sql.analyzer.maxIterations", "75")
    try:
        df = spark.createDataFrame([(1, CODE)], "id int, c string")
        (row,) = df.select(lex_cpp(render_pairs(text_pairs(lex_cpp(F.col("c")), "cpp"))).alias("x")).collect()
        assert len(row.x) > 40
    finally:
        spark.conf.set("spark.sql.analyzer.maxIterations", before)


def test_macro_parameters(apply):
    assert apply(join_macro_parameters, "#define A ( x )\n#define B (y) + (z)") == [
        "#define A( x )\n#define B (y) +(z)"
    ]


def test_render_python(apply):
    code = "import os . path\nclass A:\n    def f(self):\n        s = rb'x y'  # c\n        return s >> 2\n    z = 1\n"
    (text,) = apply(lambda c: render_python(lex_python(c)), code)
    assert text == (
        "import os.path\nclass A :\n    def f ( self ) :\n        s = rb'x y'\n        return s >> 2\n    z = 1\n"
    )


def test_render_python_closes_blocks(apply):
    (text,) = apply(lambda c: render_python(words(c)), "if a : NEW_LINE INDENT b NEW_LINE DEDENT c NEW_LINE")
    assert text == "if a :\n    b\nc\n"
