"""Lexing of C, C++ and Java text into aligned tokens and tags.

The lexer is one regular expression per language, run inside the JVM.  A preprocessor line is
matched whole first and then cut by rules of its own, because its end is a token there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import fixed
from lexmill.functions.exprs import (
    NOT_WS,
    OPEN_MARK,
    let,
    mark_open_comments,
    mark_open_raw_strings,
    mark_open_text_blocks,
    one_of,
    unmark,
)

_COMMENT = r"//[^\n\\]*+(?:\\.[^\n\\]*+)*+|/\*.*?\*/"
_CHAR = r"(?:u8|[LuU])?'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_STRING = r'(?:u8|[LuU])?"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_RAW_STRING = rf'(?:u8|[LuU])?R"([^()\\\s{OPEN_MARK}]{{0,16}})\(.*?\)\1"'
_TEXT_BLOCK = r'"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"""'
_WORD = r"[\p{L}_$][\p{L}\p{N}_$]*+"
_NUMBER = (
    r"0[xX][0-9a-fA-F'_]++(?:\.[0-9a-fA-F]*+)?(?:[pP][+-]?[0-9]++)?[uUlLfF]*+"
    r"|0[bB][01'_]++[uUlL]*+"
    r"|(?:[0-9][0-9'_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9]++)?[uUlLfFdD]*+"
)
# Most tokens, told before all other patterns: marks that begin nothing longer, and words that are no prefix of a quote.
_QUICK = rf"[;,(){{}}\[\]~?]|{_WORD}(?!['\"])"
_CPP_OPERATORS = (
    r"->\*|->|\+\+|--|<<=|>>=|<=>|\.\.\.|\.\*|<<|>>|::|[-+*/%&|^=!<>]=|&&|\|\|"
)
_JAVA_OPERATORS = r"->|\+\+|--|>>>=|<<=|>>=|>>>|\.\.\.|<<|>>|::|[-+*/%&|^=!<>]=|&&|\|\|"

# A directive line runs to its line end, over escaped line ends, and stops before a comment.
_DIRECTIVE = rf"(?:^[ \t]*+#[ \t]*+[A-Za-z](?:[^\n\\/]|\\.|/(?![/*{OPEN_MARK}]))*+\n?+)"

_CPP_BODY = "|".join(
    (_COMMENT, _CHAR, _RAW_STRING, _STRING, _WORD, _NUMBER, _CPP_OPERATORS, NOT_WS)
)
# No token but a directive begins with a blank, so blanks are passed without trying the other patterns.
_CPP = rf"(?smd){_QUICK}|{_DIRECTIVE}|(?={NOT_WS})(?:{_CPP_BODY})"
_JAVA_BODY = "|".join(
    (_COMMENT, _CHAR, _TEXT_BLOCK, _STRING, _WORD, _NUMBER, _JAVA_OPERATORS, NOT_WS)
)
_JAVA = rf"(?sd){_QUICK}|(?={NOT_WS})(?:{_JAVA_BODY})"

_DIRECTIVE_WORD = r"#[ \t]*+[A-Za-z][A-Za-z0-9_]*+"
_INCLUDE_LINE = rf'(?sd){_DIRECTIVE_WORD}|<[^>\n]++>|"[^"\n]*+"|[A-Za-z_][A-Za-z0-9_]*+|\n'
_CONDITION_LINE = rf"(?sd){_DIRECTIVE_WORD}|\n|{_CPP_BODY}"
_DEFINE_LINE = r"(?sd)^(#[ \t]*+define)[ \t]*+([A-Za-z_][A-Za-z0-9_]*+)?(\([^)\n]*+\))?[ \t]*+(.*?)[ \t]*+(\n?)\z"
_OTHER_LINE = rf"(?sd)^({_DIRECTIVE_WORD})[ \t]*+(.*?)[ \t]*+(\n?)\z"
_PARAMETER = r"\(|\)|,|\.\.\.|[A-Za-z_][A-Za-z0-9_]*+"

# Tokens that are their own tags: no class of the lexers begins with them.
_PLAIN_TOKENS = (
    *"!#%&()*+,-./:;<=>?@[]^{|}~\n",
    "->", "++", "--", "<<", ">>", "::", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "==", "!=", "<=", ">=", "&&", "||", "...",
)

_KNOWN_DIRECTIVES = (
    "#include", "#define", "#if", "#ifdef", "#ifndef", "#else", "#elif", "#endif",
)


def _pair(token: Column, tag: Column) -> Column:
    return F.struct(token.alias("token"), tag.alias("tag"))


def _member_tag(before: Column) -> Column:
    return F.when(one_of(before, ".", "->"), F.lit("field_identifier")).otherwise(F.lit("identifier"))


def _tag(token: Column, before: Column, keywords: tuple[str, ...], char_tag: str) -> Column:
    """Tag of a token that is not part of a directive; the token itself when no class fits."""
    quoted = F.length(token) > 1
    return (
        # Most tokens are told by one look-up.
        F.when(token.isin(*_PLAIN_TOKENS, *keywords), token)
        .when(token.rlike(rf"^{_WORD}$"), _member_tag(before))
        .when(token.rlike(r"^\.?[0-9]"), F.lit("number_literal"))
        .when(token.startswith("//") | token.startswith("/*"), F.lit("comment"))
        .when(quoted & token.rlike(r'^(?:u8|[LuU])?R"'), F.lit("raw_string_literal"))
        .when(quoted & token.rlike(r'^(?:u8|[LuU])?"'), F.lit("string_literal"))
        .when(quoted & token.rlike(r"^(?:u8|[LuU])?'"), F.lit(char_tag))
        .otherwise(token)
    )


def _is_directive(match: Column) -> Column:
    return (match.startswith("#") | match.startswith(" ") | match.startswith("\t")) & match.rlike(
        r"^[ \t]*+#[ \t]*+[A-Za-z]"
    )


def _directive_pairs(line: Column) -> Column:
    """Pairs of one directive line without blanks in front; a NULL tag is left to the main rules."""
    word = F.regexp_extract(line, rf"^{_DIRECTIVE_WORD}", 0)
    return let(F.regexp_replace(word, r"[ \t]+", ""), lambda plain: _by_directive(line, word, plain))


def _by_directive(line: Column, word: Column, plain_word: Column) -> Column:
    open_tag = F.lit(None).cast("string")

    def lexed(pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all(line, F.lit(pattern), F.lit(0)),
            lambda t: _pair(t, F.when(t.rlike("^<.+>$"), F.lit("system_lib_string"))),
        )

    def argument(pattern: str, at: int) -> Column:
        return F.array(
            _pair(F.regexp_extract(line, pattern, at), F.lit("preproc_arg")),
            _pair(F.regexp_extract(line, pattern, at + 1), F.lit("\n")),
        )

    define = F.concat(
        F.array(_pair(F.regexp_extract(line, _DEFINE_LINE, 2), open_tag)),
        F.transform(
            F.regexp_extract_all(
                F.regexp_extract(line, _DEFINE_LINE, 3), F.lit(_PARAMETER), F.lit(0)
            ),
            lambda t: _pair(t, open_tag),
        ),
        argument(_DEFINE_LINE, 4),
    )
    condition = lexed(_CONDITION_LINE)
    rest = (
        F.when(plain_word == "#include", lexed(_INCLUDE_LINE))
        .when(plain_word == "#define", define)
        .when(one_of(plain_word, "#if", "#elif"), condition)
        .when(
            one_of(plain_word, "#ifdef", "#ifndef", "#else", "#endif"),
            F.filter(condition, lambda p: p["token"] != "\n"),
        )
        .otherwise(argument(_OTHER_LINE, 2))
    )
    word_tag = F.when(plain_word.isin(*_KNOWN_DIRECTIVES), plain_word).otherwise(
        F.lit("preproc_directive")
    )
    # The lexed lines repeat the directive word; it is written once, with its own tag.
    return F.concat(
        F.array(_pair(word, word_tag)),
        F.filter(rest, lambda p: (p["token"] != "") & ~p["token"].rlike(f"^{_DIRECTIVE_WORD}$")),
    )


def _matches(code: Column, pattern: str, mark_strings: Callable[[Column], Column]) -> Column:
    """Matches of a lexer's pattern, in time linear in the text also where comments or strings stay open."""

    def found(plain: Column) -> Column:
        def cut(text: Column) -> Column:
            parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
            return let(parts, lambda parts: F.when(text == plain, parts).otherwise(unmark(parts)))

        marked = let(mark_open_comments(plain), mark_strings)
        return let(F.when(plain.contains(OPEN_MARK), plain).otherwise(marked), cut)

    return let(F.replace(code, F.lit("\r"), F.lit("")), found)


def lex_cpp(code: Column) -> Column:
    """C or C++ text -> array of (token, tag), in text order."""

    def raw(matches: Column) -> Column:
        plain = F.transform(matches, lambda m: _pair(m, F.lit(None).cast("string")))
        mixed = F.transform(
            matches,
            lambda m: F.when(
                _is_directive(m), let(F.regexp_replace(m, r"^[ \t]++", ""), _directive_pairs)
            ).otherwise(F.array(_pair(m, F.lit(None).cast("string")))),
        )
        return F.when(F.exists(matches, _is_directive), F.flatten(mixed)).otherwise(plain)

    def tagged(raw: Column) -> Column:
        return F.transform(
            raw,
            lambda p, i: _pair(
                p["token"],
                F.coalesce(
                    p["tag"],
                    _tag(p["token"], F.get(raw, i - 1)["token"], fixed.CPP_KEYWORDS, "char_literal"),
                ),
            ),
        )

    return let(let(_matches(code, _CPP, mark_open_raw_strings), raw), tagged)


def lex_java(code: Column) -> Column:
    """Java text -> array of (token, tag), in text order."""

    def pairs(matches: Column) -> Column:
        return F.transform(
            matches,
            lambda m, i: _pair(
                m, _tag(m, F.get(matches, i - 1), fixed.JAVA_KEYWORDS, "character_literal")
            ),
        )

    return let(_matches(code, _JAVA, mark_open_text_blocks), pairs)
