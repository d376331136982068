import pytest
from pyspark.sql import functions as F

from lexmill.functions.exprs import let, words
from lexmill.functions.extraction import cpp_functions, java_functions, python_functions
from lexmill.functions.lexing import lex_cpp
from lexmill.functions.python_lexing import lex_python
from lexmill.functions.signatures import (
    cfamily_function_name,
    clean_preprocessor,
    drop_heredoc_marks,
    extract_arguments,
    is_python2,
    python_function_name,
    remove_annotation,
)
from lexmill.functions.spans import cpp_spans, java_spans, python_spans
from lexmill.operators import functions_table, tokens
from lexmill.plans import queries  # noqa: F401  registers the language of words


def spans(rows):
    return [(r.start, r.end) for r in rows]


def of_code(c):
    return let(lex_cpp(c), cpp_spans)


CPP = {
    "int f ( int a ) { if ( a ) { g ( a ) ; } return a ; } void h ( ) { } int k ( ) { x ;": [(0, 21), (28, 34)],
    "if ( a ) { int q ( int b ) { y ; } } ; static int z ( ) throw ( ) { w ; }": [(5, 14), (17, 28)],
    "no functions here ;": [],
    "; ) { i ; } void v ( int a ) { for ( ; ; i ++ ) { u ; } }": [(6, 24)],
    "": [],
    "int f ( ) {": [],
    "( ) { x ; } int g ( ) { y ; }": [(6, 13)],
}


@pytest.mark.parametrize("code", CPP)
def test_cpp_spans(apply, code):
    assert spans(apply(of_code, code)[0]) == CPP[code]


def test_cpp_kind_text_and_arguments(apply):
    code = """#include <x.h>
/* doc */
static int f(int a, char *b[]) { // c
  return a; }
class P { int get(void) { return 1; } static int s() { return 2; } };
void Box::put() { n--; }
"""
    (found,) = apply(cpp_functions, code)
    assert [(f.name, f.kind) for f in found] == [
        ("f", "standalone"), ("get", "class"), ("s", "standalone"), ("put", "class"),
    ]
    assert found[0].text == (
        "/* doc */ ENDCOM static int f ( int a , char * b [ ] ) { // c ENDCOM return a ; }"
    )
    assert (found[0].arg_types, found[0].arg_names) == (["int ", "char * [ ]"], ["a", "b"])
    assert (found[2].arg_types, found[2].arg_names) == (["None"], ["None"])


def test_cpp_tokenised_input(apply):
    code = '# include <a.h> NEW_LINE int f ( ) { // ▁ x ENDCOM s = " a ▁ b " ; }'
    (found,) = apply(cpp_functions, code)
    assert [f.text for f in found] == ['int f ( ) { // ▁ x ENDCOM s = " a ▁ b " ; }']


def test_cpp_drops_functions_led_by_a_directive(apply):
    assert apply(cpp_functions, "#endif int f() { x; }") == [[]]


def test_many_functions_in_one_row(apply):
    code = "".join(f"int f{i}(int a) {{ return {i}; }}\n" for i in range(3000))
    (found,) = apply(lambda c: F.size(cpp_functions(c)), code)
    assert found == 3000


def test_java_spans_and_comments(apply):
    code = (
        "class A { /* ▁ k ▁ */ public int f ( int [ ] a ) throws E { if ( a ) { x ; } } // ▁ y ENDCOM "
        "static void g ( ) NEW_LINE { } abstract int m ( ) ; int z ( ) { q ;"
    )
    (found,) = apply(lambda c: java_functions(words(c)), code)
    assert [(f.name, f.kind) for f in found] == [("f", "class"), ("g", "standalone"), ("z", "class")]
    assert found[0].text.startswith("/* ▁ k ▁ */ public int f (")
    assert found[1].text == "// ▁ y ENDCOM static void g ( ) NEW_LINE { }"
    assert found[2].text == "int z ( ) { q ;"
    assert spans(apply(lambda c: java_spans(words(c)), "if ( a ) {", "", "void f ( ) { }")[2]) == [(0, 5)]


PYTHON = (
    "class A : NEW_LINE INDENT def f ( self ) : NEW_LINE INDENT return 1 NEW_LINE DEDENT "
    "def g ( x ) : NEW_LINE INDENT pass NEW_LINE DEDENT DEDENT"
)


def test_python_spans(apply):
    found = apply(lambda c: python_spans(words(c)), PYTHON, "def f ( ) : NEW_LINE INDENT x", "")
    assert [spans(f) for f in found] == [[(5, 16), (17, 27)], [], []]


def test_python_functions(apply):
    code = "class A:\n    def f(self):\n        def inner(): return 1\n        return 2\ndef g(x):\n    print x\ndef h():\n    pass\n"
    (found,) = apply(lambda c: python_functions(lex_python(c)), code)
    assert [(f.name, f.kind) for f in found] == [("f", "class"), ("h", "standalone")]
    assert "def inner" in found[0].text


def test_python_kind_without_parenthesis(apply):
    (found,) = apply(lambda c: python_functions(words(c)), "def f INDENT x DEDENT")
    assert [(f.name, f.kind) for f in found] == [("f", None)]


def test_python2_marks(apply):
    texts = ["print x", "print ( x )", "raise E , x", "n = 10 L", "d . iteritems ( )", "xrange ( 3 )", "x"]
    assert apply(is_python2, *texts) == [True, False, True, True, True, True, False]


def test_preprocessor_cleaning(apply):
    cases = {
        "# include <a.h> int f ( ) { # if defined ( Q ) x # else y # endif }": "int f ( ) {  x  y  }",
        '# include "a.h" x': "x",
        "# define N 10 x": "x",
        "# ifdef A # ifndef B # if C x": "x",
    }
    assert apply(clean_preprocessor, *cases) == list(cases.values())


def test_bindings_pass_the_value_alone(apply):
    def joined(items, sep="-"):
        return F.array_join(items, sep)

    assert apply(lambda c: let(words(c), joined), "a b  c", "", None) == ["a-b-c", "", None]


def test_functions_of_a_plugged_language(spark):
    rows = [(1, "A b. c d. open"), (1, "x."), (2, ""), (3, None), (4, "no end")]
    read = tokens.text_tokens_table(spark.createDataFrame(rows, "id int, text string"), "text", "words")
    found = functions_table.function_table(read, "id", lang="words").orderBy("id", "text").collect()
    assert [(f.id, f.start_pos, f.end_pos, f.kind, f.text, f.name) for f in found] == [
        (1, 0, 1, "standalone", "A b.", "A"), (1, 2, 3, "standalone", "c d.", "c"), (1, 0, 0, "standalone", "x.", "x."),
    ]


def test_heredoc_and_annotation(apply):
    assert apply(drop_heredoc_marks, "a < DOCUMENT_1> b") == ["a b"]
    assert apply(remove_annotation, "@ Override ( x ) int f", "int @ Override ( x ) f") == [
        "int f", "int @ Override ( x ) f",
    ]


def test_names(apply):
    assert apply(lambda c: cfamily_function_name(words(c)), "int f ( )", "( x", "x") == ["f", None, None]
    assert apply(lambda c: python_function_name(words(c)), "def f ( )", "x") == ["f", None]


def test_arguments(apply):
    def pairs(text):
        (found,) = apply(extract_arguments, text)
        return None if found is None else [(a.type, a.name) for a in found]

    assert pairs("int f ( int a , char * b [ ] ) { }") == [("int ", "a"), ("char * [ ]", "b")]
    assert pairs("void f ( ) { }") == [("None", "None")]
    assert pairs("f ( void ) ;") == [("", "void")]
    assert pairs("f ( map < int , int > m )") == [("map < ", "int"), ("int > ", "m")]
    assert pairs("no parenthesis") is None
    assert pairs("f ( g ( x ) y ) z") == [("g ( x ) ", "y")]
