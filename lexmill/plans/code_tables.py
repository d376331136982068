"""Code corpora as SQL over the part table.

The given tables hold no source code, so each part row is written out as one file by an expression
that Spark and other SQL engines read alike.  Rows and characters grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.operators.columns import spread

_NL = "chr(10)"
_KEY = "cast(p_partkey as varchar(20))"
_SIZE = "cast(p_size as varchar(20))"


def _concat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _lines(*lines: str) -> str:
    """Text lines given as SQL operands, each one closed by a line end."""
    return _concat(*(part for line in lines for part in (line, _NL)))


_STATIC = "case when p_partkey % 3 = 0 then 'static ' else '' end"

CPP_FUNCTION = _concat(
    "'/* '", "p_name", "' */'", _NL, _NL,
    _STATIC, "'int f'", _KEY, "'(int a, char *b) {  '", _NL,
    "'  // '", "p_type", _NL,
    "'  if (a > '", _SIZE, """') { log("'""", "p_brand", """' // kept"); }'""", _NL, _NL,
    "'  return a;'", _NL, "'}'", _NL,
)

CPP_FILE = _lines(
    "'#include <stdio.h>'",
    _concat("'#define LIMIT_'", _KEY, "' '", _SIZE),
    _concat("'/* '", "p_name", "' */'"),
    _concat(_STATIC, "'int f'", _KEY, "'(int a, char *b[]) {'"),
    _concat("'  if (a > '", _SIZE, """') { log("'""", "p_brand", """' // kept; {x}"); }'"""),
    _concat("'  // '", "p_type"),
    "'  return a->next;'",
    "'}'",
    _concat(
        "'void Box'", _SIZE, "'::put(unsigned long n) throw () { while (n > 0x1F) { n -= 1.5e3; s[n] = '",
        "chr(39)", "chr(92)", "'n'", "chr(39)", "'; } }'",
    ),
    _concat("'int none'", _KEY, "'() { }'"),
    "case when p_partkey % 5 = 0 then 'class P { public: int get(void) { return x >> 2; } };' else ';' end",
    "'for (;;i++) { g(); }'",
    # Blocks up to six deep, classes in classes, and braces that open no function or stand in a literal.
    _concat(
        "'static long deep'", _KEY, "'(long v) { '", "repeat('if (v) { ', cast(p_partkey % 7 as int))", "'v--; '",
        "repeat('} ', cast(p_partkey % 7 as int))", "'return v; }'",
    ),
    _concat("'struct S'", _KEY, "' { int a; struct T { char c; int m(int q) { return q + a; } }; int *n() { return &a; } };'"),
    "'int odd(int a) /* why */ { return a; }'",
    _concat("'const char *s = \"} { '", "chr(92)", "'\" ;\"; auto l = [](int a) { return a; };'"),
    "case when p_partkey % 2 = 0 then 'bool operator==(const A &o) { return true; }' else 'enum E { X, Y };' end",
    _concat("'template <typename T> T id'", _SIZE, "'(T t, map<T, vector<T> > m) { do { t++; } while (t < '", _SIZE, "'); return t; }'"),
    _concat(
        "'double last'", _KEY, "'(double x, map<int, int> y) { return x * 2;'",
        "case when p_partkey % 4 = 0 then '' else ' }' end",
    ),
)

JAVA_FILE = _lines(
    _concat("'/** '", "p_name", "' ; */'"),
    _concat("'public class C'", _SIZE, "' extends B {'"),
    "'  @Override'",
    _concat(
        "'  public int f'", _KEY, """'(int[] a, String s) throws IOException { return a[0] >>> '""",
        _SIZE, """' + s.length(); } // '""", "p_type",
    ),
    _concat("""'  String g() { return "'""", "p_brand", """'" + '""", "chr(39)", "'x'", "chr(39)", "'; }'"),
    # Annotations with lists, and of two names; one that names a method's error list; methods without a body.
    "case when p_partkey % 2 = 0 then '  @SuppressWarnings({\"a\", \"b\"})' else '  @Override()' end",
    _concat("'  static void m'", _KEY, "'(Map<K, List<V>> x) throws E, java.io.IOException { if (x) { for (;;) { m(); } } }'"),
    "'  abstract void k(int z) throws E;'",
    _concat("'  @java.lang.Deprecated(since = \"'", "p_brand", "'\") /* '", "p_type", "' */'"),
    _concat("'  public C'", _SIZE, "'() { this(new int[] {1, 2}); }'"),
    "case when p_partkey % 3 = 0 then '  // next' else '  int[] v = {1, 2};' end",
    "'  long last(long y) { return y; '",
    "case when p_partkey % 4 = 0 then '' else '} }' end",
)

JAVA_TOKENS = _concat(
    "'class C'", _KEY, "' { /* ▁ '", "p_name", "' ▁ */ '",
    "case when p_partkey % 2 = 0 then '' else '@ Override ( x ) ' end",
    "'public int f'", _KEY, "' ( int [ ] a , String s ) throws IOException { if ( a ) { return '",
    _SIZE, "' ; } return 1 ; } // ▁ '", "p_type", "' ENDCOM '", _STATIC,
    "'void g ( ) NEW_LINE { } NEW_LINE int h ( int z ) { y ; } abstract void k ( ) ; '",
    "case when p_partkey % 4 = 0 then 'int open ( ) { z ;' else '}' end",
)

PYTHON_FUNCTION = _lines(
    _concat("'def f'", _KEY, "'(x):'"),
    _concat("'    if x > '", _SIZE, "':'"),
    _concat("""'        return "'""", "p_brand", """'"'"""),
    _concat("'    return x  # '", "p_type"),
)

# A tab reaches the same column as eight blanks.
_EIGHT = "case when p_partkey % 3 = 0 then chr(9) else '        ' end"

PYTHON_FILE = _lines(
    "'import os.path'",
    "''",
    _concat("'class C'", _KEY, "'(object):'"),
    _concat("""'    \"\"\"'""", "p_name", """'\"\"\"'"""),
    _concat("'    def f'", _KEY, "'(self, a):'"),
    _concat("'        # '", "p_type"),
    _concat("'        if a > '", _SIZE, "':'"),
    _concat("""'            return "'""", "p_brand", """'"'"""),
    "''",
    "'        return [a,'",
    _concat("'            '", _SIZE, "']'"),
    "'    def g(x):'",
    "case when p_partkey % 5 = 0 then '        print x' else '        return x.iteritems() ** 2' end",
    # Blocks up to eight deep, all closed at once.
    _concat("'def n'", _KEY, "'(k):'"),
    *(f"case when p_partkey % 8 >= {k} then '{'    ' * k}if k > {k}:' else '' end" for k in range(1, 8)),
    _concat("repeat('    ', cast(p_partkey % 8 as int) + 1)", "'k += 1'"),
    "'# comment in the first column'",
    # Tabs, a continued line, brackets over several lines and an inner function.
    _concat("'def t'", _KEY, "'(a):'"),
    _concat(_EIGHT, "'if a:'"),
    _concat(_EIGHT, "'    return a + '", "chr(92)", _NL, "' 1'"),
    _concat(_EIGHT, "'b = (a,'"),
    "'# in brackets'",
    "'  2)'",
    _concat(_EIGHT, "'def inner(z):'"),
    _concat(_EIGHT, _EIGHT, "'return z'"),
    _concat(_EIGHT, "'return inner'"),
    _concat("'def h'", _KEY, "'(y, z):'"),
    "'    return y  # tail'",
)

PREPROCESSED = _concat(
    "'# include <'", "p_type", "'.h> # ifdef '", "p_type", "' # define MAX ( a ) ( '", "p_name",
    "' ) '", _NL, "'# define N'", _KEY, "' ( '", _SIZE, "' ) # ifndef Q int f ( ) { # if defined ( Q ) return '",
    _SIZE, "' ; # else < DOCUMENT_'", _KEY, "'> return 2 ; # endif } '",
)

_DASHES = "repeat('-', 25)"
# Headers that begin with dashes, and delimiter lines of all widths with and without further text.
BLOCKS = _concat(
    "case when p_partkey % 3 = 0 then '-head ' when p_partkey % 3 = 1 then '------------------------ ' else '' end",
    _KEY, "' API_'", "p_type", "' head'", _NL, "'  '", "p_name", "'  '", _NL, _NL,
    """'log("'""", "p_brand", """'");'""", _NL, "cast(p_size % 3 as varchar(20))", _NL,
    "repeat('-', 25 + p_size)", _NL,
    "'short block'", _NL, "'1'", _NL, "repeat('-', 33)", "case when p_partkey % 2 = 0 then ' end' else '' end", _NL,
    "'-second head'", _NL, "'  x = '", _SIZE, "';'", _NL, "'--y;'", _NL,
    "case when p_partkey % 4 = 0 then 'not a label' else '1' end", _NL, _DASHES, "' end'", _NL,
    "'h2'", _NL, "'code2 '", "p_type", _NL, "'1'", _NL, "'// '", _DASHES, "case when p_partkey % 5 = 0 then '-' else ' //' end", _NL,
    "'third head'", _NL, "p_name", _NL, "'0'", _NL,
)

LITERAL = _concat(
    """'L"'""", "p_name", "' // '", "p_brand", "'; {'", "p_type", "'}'", "chr(92)", "'n'", "chr(9)",
    """'1,5 $x-L  y."'""",
)
BLOCK_COMMENT = _concat(
    "'/** '", "p_name", "'   ========='", _NL, "' *  '", "p_type", "chr(9)", "' a.b; */'",
)
LINE_COMMENT = _concat(
    "'//  '", "case when p_partkey % 3 = 0 then '-- !' else p_brand end",
    "case when p_partkey % 2 = 0 then '' else concat(chr(10), ' more -------- text') end",
)

TABLES = {
    "code_cpp": ("p_partkey as id, cast(p_size % 2 as int) as label", CPP_FUNCTION),
    "cpp_file": ("p_partkey as id, cast(p_size % 2 as int) as label", CPP_FILE),
    "java_file": ("p_partkey as id", JAVA_FILE),
    "java_tokens": ("p_partkey as id", JAVA_TOKENS),
    "code_py": ("p_partkey as id", PYTHON_FUNCTION),
    "py_file": ("p_partkey as id", PYTHON_FILE),
    "preprocessed": ("p_partkey as id", PREPROCESSED),
    "block_file": ("p_partkey as id", BLOCKS),
    "literal": ("p_partkey as id", LITERAL),
    "block_comment": ("p_partkey as id", BLOCK_COMMENT),
    "line_comment": ("p_partkey as id", LINE_COMMENT),
}


def cte(name: str) -> str:
    """``name as (select ...)`` for a WITH clause."""
    keys, code = TABLES[name]
    return f"{name} as (select {keys}, {code} as code from part)"


def code_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    keys, code = TABLES[name]
    # Each narrow row becomes a file.  Splits of a table are cut at its row groups, so a few of them may hold all rows.
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), per_core=4)
    return part.selectExpr(*keys.split(", "), f"{code} as code")
