import time

import pytest
from pyspark.sql import functions as F

from lexmill.functions import lexing
from lexmill.functions.lexing import lex_cpp, lex_java
from lexmill.functions.literals import text_tokens
from lexmill.functions.python_lexing import lex_python


def tokens(rows):
    return [r.token for r in rows]


def pairs(rows):
    return [(r.token, r.tag) for r in rows]


def test_cpp_tokens_and_tags(apply):
    (found,) = apply(lex_cpp, "static int f(A a) { return a->next + b.c[0x1F]; /* k */ }")
    assert pairs(found) == [
        ("static", "static"), ("int", "int"), ("f", "identifier"), ("(", "("), ("A", "identifier"),
        ("a", "identifier"), (")", ")"), ("{", "{"), ("return", "return"), ("a", "identifier"),
        ("->", "->"), ("next", "field_identifier"), ("+", "+"), ("b", "identifier"), (".", "."),
        ("c", "field_identifier"), ("[", "["), ("0x1F", "number_literal"), ("]", "]"), (";", ";"),
        ("/* k */", "comment"), ("}", "}"),
    ]


def test_cpp_literals(apply):
    (found,) = apply(lex_cpp, r'''L"a // b" 'c' '\'' R"x(raw " text)x" "open''')
    assert pairs(found) == [
        ('L"a // b"', "string_literal"), ("'c'", "char_literal"), (r"'\''", "char_literal"),
        ('R"x(raw " text)x"', "raw_string_literal"), ('"', '"'), ("open", "identifier"),
    ]


def test_cpp_numbers_and_operators(apply):
    (found,) = apply(lex_cpp, "1.5e-3f 10UL 1'000 .5 0b11 a<<=2 x<=>y p->*q ... ::")
    assert tokens(found) == [
        "1.5e-3f", "10UL", "1'000", ".5", "0b11", "a", "<<=", "2", "x", "<=>", "y", "p", "->*", "q", "...", "::",
    ]


def test_cpp_directives_end_with_a_line_token(apply):
    code = "#include <a.h>\n # define M(x, y) (x + \\\n y) // c\n#if A > 1\n#endif\n#pragma once\nint a;"
    (found,) = apply(lex_cpp, code)
    assert pairs(found) == [
        ("#include", "#include"), ("<a.h>", "system_lib_string"), ("\n", "\n"),
        ("# define", "#define"), ("M", "identifier"), ("(", "("), ("x", "identifier"), (",", ","),
        ("y", "identifier"), (")", ")"), ("(x + \\\n y)", "preproc_arg"), ("// c", "comment"),
        ("#if", "#if"), ("A", "identifier"), (">", ">"), ("1", "number_literal"), ("\n", "\n"),
        ("#endif", "#endif"), ("#pragma", "preproc_directive"), ("once", "preproc_arg"), ("\n", "\n"),
        ("int", "int"), ("a", "identifier"), (";", ";"),
    ]


def test_carriage_returns_and_empty_text(apply):
    found = apply(lex_cpp, "a\r\n;", "", "  ")
    assert [tokens(f) for f in found] == [["a", ";"], [], []]


def test_java_tokens(apply):
    (found,) = apply(lex_java, "int x = a >>> 2; char c = 'q'; @A String s = \"\"\"\nt \"x\" \"\"\";")
    assert [p for p in pairs(found) if p[1] not in (";", "=")] == [
        ("int", "int"), ("x", "identifier"), ("a", "identifier"), (">>>", ">>>"), ("2", "number_literal"),
        ("char", "char"), ("c", "identifier"), ("'q'", "character_literal"), ("@", "@"), ("A", "identifier"),
        ("String", "identifier"), ("s", "identifier"), ('"""\nt "x" """', "string_literal"),
    ]


def test_long_literal(apply):
    (found,) = apply(lex_cpp, 'f("' + "a" * 1_000_000 + '");')
    assert [len(t) for t in tokens(found)] == [1, 1, 1_000_002, 1, 1]


def test_text_tokens(apply):
    code = "#define N 1\nint a; // note it\nlog(\"a b\"); /* - */"

    def words(keep, whole):
        return lambda c: text_tokens(lex_cpp(c), "cpp", keep, whole)

    assert apply(words(False, True), code) == [
        ["#define", "N", "1", "NEW_LINE", "int", "a", ";", "log", "(", '" a ▁ b "', ")", ";"]
    ]
    assert apply(words(True, True), code)[0][7] == "// ▁ note ▁ it ENDCOM"
    assert apply(words(True, False), code)[0][7] == "// note it ENDCOM"
    assert apply(words(True, False), code)[0][-3:] == ['"a b"', ")", ";"]


PY = '''import os
def f(x,
      # inner
      y=[1, 2]):
    """doc
    two"""
    if x > 1:
\t"""only"""
    # c
    return f"a {x}", 'z' ** 2  # end
class A:
    def g(self): pass
    def h(self):
        return \\
            b'q'
print("done")'''


def test_python_layout(apply):
    (found,) = apply(lex_python, PY)
    assert " ".join(found) == (
        "import os NEW_LINE def f ( x , y = [ 1 , 2 ] ) : NEW_LINE INDENT if x > 1 : NEW_LINE "
        "return f\" a ▁ { x } \" , ' z ' ** 2 NEW_LINE DEDENT class A : NEW_LINE INDENT "
        "def g ( self ) : pass NEW_LINE def h ( self ) : NEW_LINE INDENT return b' q ' NEW_LINE "
        'DEDENT DEDENT print ( " done " ) NEW_LINE'
    )


def test_python_comments_and_docstrings_kept(apply):
    (found,) = apply(lambda c: lex_python(c, True), PY)
    text = " ".join(found)
    assert ', # ▁ inner ENDCOM y =' in text
    assert 'INDENT """ doc STRNEWLINE' in text
    # "# c" has too little content to be kept.
    assert 'INDENT """ only """ NEW_LINE DEDENT return' in text


def test_python_bad_source_is_null(apply):
    bad = ["if x:\n        a\n    b\n", "f(\n", 'x = """abc\n', "a)\n"]
    assert apply(lex_python, *bad) == [None] * 4


def test_python_small_texts(apply):
    assert apply(lex_python, "", "x", 'a "b\n', "'''only'''\n", "\n\n# c\n") == [
        [], ["x", "NEW_LINE"], ["a", '"', "b", "NEW_LINE"], [], [],
    ]


def test_python_tabs_count_to_eight(apply):
    (found,) = apply(lex_python, "if a:\n\tif b:\n\t    c\n        d\n")
    assert " ".join(found) == (
        "if a : NEW_LINE INDENT if b : NEW_LINE INDENT c NEW_LINE DEDENT d NEW_LINE DEDENT"
    )


def test_python_empty_block_vanishes(apply):
    (found,) = apply(lex_python, "class A:\n  def f():\n    '''d'''\nx\n")
    assert " ".join(found) == "class A : NEW_LINE INDENT def f ( ) : NEW_LINE DEDENT x NEW_LINE"


def test_python_many_lines(apply):
    code = "".join(f"if a{i}:\n    b\n" for i in range(1500))
    (found,) = apply(lex_python, code)
    assert len(found) == 1500 * 8
    assert found.count("INDENT") == found.count("DEDENT") == 1500


def test_lexed_once(spark):
    """The lexer stands once in the optimized plan of a tokenised table."""
    from lexmill.operators.tokens import tag_counts, tokenize

    df = spark.createDataFrame([(1, "int a;")], "id int, code string")
    for result in (tokenize(df, "code"), tag_counts(tokenize(df, "code"))):
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("(?smd)") == 1  # how the pattern of the lexer begins
    assert tokenize(df, "code").select(F.size("tokens").alias("n")).first().n == 3


OPEN_STRINGS = [
    ('R"( a R"( b', ["R", '"( a R"', "(", "b"]),
    ('x = R"w(1)w" + R"w(2', ["x", "=", 'R"w(1)w"', "+", "R", '"', "w", "(", "2"]),
    ('R"a(1 R"b(2)b" R"a(3', ["R", '"a(1 R"', "b", "(", "2", ")", "b", '" R"', "a", "(", "3"]),
    ('R"(x)" R"(y', ['R"(x)"', "R", '"', "(", "y"]),
    ('/* R"( */ R"(a)" /* b', ["/* R\"( */", 'R"(a)"', "/", "*", "b"]),
    ('R")R"R(1', None), ('R"(﷐', None), ('u8R"x(a)x" LR"y(', None),
]


def test_open_raw_strings(apply):
    """Marks change no token: the same as the pattern alone gives."""
    texts = [text for text, _ in OPEN_STRINGS]
    found = apply(lambda c: F.transform(lex_cpp(c), lambda p: p["token"]), *texts)
    plain = apply(lambda c: F.regexp_extract_all(c, F.lit(lexing._CPP), F.lit(0)), *texts)
    assert found == plain
    assert all(tokens == expected for tokens, (_, expected) in zip(found, OPEN_STRINGS) if expected)


def test_open_text_blocks(apply):
    texts = ['"""\\""" a \\""" b', 'x = """a\\""" """; y = """\\"""', '"""a\\\\""" + """b \\"""" + 1 \\"""', '\\"""\\"""\\\\"""\\"""x', '"""']
    found = apply(lambda c: F.transform(lex_java(c), lambda p: p["token"]), *texts)
    assert found == apply(lambda c: F.regexp_extract_all(c, F.lit(lexing._JAVA), F.lit(0)), *texts)


@pytest.mark.parametrize(
    ("lex", "unit"), [(lex_cpp, 'R"( a '), (lex_cpp, 'R"ab(x)" '), (lex_cpp, 'R"(a)" R"b( '), (lex_java, '"""\\"""x'), (lex_java, '\\""" a '), (lex_cpp, "/* "), (lex_java, '"a" ')]
)
def test_open_strings_take_linear_time(apply, lex, unit):
    text = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    (count,) = apply(lambda c: F.size(lex(c)), text)
    assert count > 1000 and time.perf_counter() - began < 25
