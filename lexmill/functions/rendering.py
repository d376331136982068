"""Tokens back to readable source text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import fixed
from lexmill.functions.exprs import let, one_of, replace_held, replace_in_order, scan, strip
from lexmill.functions.lexing import lex_cpp, lex_java
from lexmill.functions.literals import mark_specials

_OPEN, _CLOSE = fixed.OPEN_BRACE, fixed.CLOSE_BRACE


def indent_lines(lines: Column) -> Column:
    """Lines joined with two blanks per open brace mark.

    A line that begins with a closing mark steps back first; a line that ends with an opening
    mark steps in afterwards, unless it also began with a closing one.
    """

    def step(depth: Column, line: Column) -> Column:
        return (
            F.when(line.startswith(_CLOSE), F.greatest(depth - 1, F.lit(0)))
            .when(line.endswith(_OPEN), depth + 1)
            .otherwise(depth)
        )

    def lay_out(lines: Column) -> Column:
        def write(depths: Column) -> Column:
            return F.transform(
                lines,
                lambda line, i: F.concat(
                    F.repeat(
                        F.lit("  "),
                        F.when(line.startswith(_CLOSE), F.get(depths, i)).otherwise(
                            F.coalesce(F.get(depths, i - 1), F.lit(0))
                        ),
                    ),
                    line,
                ),
            )

        return let(scan(lines, F.lit(0), step), write)

    return F.array_join(let(F.transform(lines, lambda t: strip(t)), lay_out), "\n")


def _decode_literal(token: Column, specials) -> Column:
    shown = replace_in_order(token, ((fixed.STR_NEWLINE, "\n"), (fixed.TAB_SYMBOL, "\t")))
    return replace_in_order(mark_specials(shown, specials), ((" ", ""), (fixed.SPACE_MARK, " ")))


def _comment_text(token: Column) -> Column:
    """A comment whose end mark is gone; marks inside it are line ends."""
    return F.replace(F.regexp_replace(token, rf" *{fixed.ENDCOM} *\z", ""), F.lit(fixed.ENDCOM), F.lit("\n"))


def render_pairs(pairs: Column, lang: str = "cpp") -> Column:
    """Laid-out source text from (token, tag) pairs of a C-family language, lexed or made for text modelling.

    The tags say what each token is, so no text is lexed again.
    """
    specials = fixed.SPECIALS[lang]

    def piece(p: Column) -> Column:
        return (
            F.when(
                p["tag"] == fixed.COMMENT,
                F.concat(_decode_literal(_comment_text(p["token"]), specials), F.lit("\n")),
            )
            .when(one_of(p["tag"], *fixed.LITERAL_TAGS[lang][1:]), _decode_literal(p["token"], specials))
            .when(one_of(p["token"], ";", "{", "}"), F.concat(p["token"], F.lit(" \n")))
            .otherwise(p["token"])
        )

    # Braces to marks, then special sequences restored, in one fold.
    marked = replace_held(F.array_join(F.transform(pairs, piece), " "), (*fixed.BRACES_TO_MARKS, *specials))
    lines = F.split(marked, fixed.NEW_LINE)
    text = replace_held(indent_lines(lines), fixed.MARKS_TO_BRACES)
    return join_macro_parameters(text) if lang == "cpp" else text


def render_cfamily(tokens: Column, lang: str = "cpp") -> Column:
    """Laid-out source text from a token array without tags, which is lexed for them; with tags use :func:`render_pairs`."""
    lex = {"cpp": lex_cpp, "java": lex_java}[lang]
    text = replace_in_order(
        F.array_join(tokens, " "), ((fixed.ENDCOM, "\n"), (fixed.NEW_LINE, "\n"))
    )
    return render_pairs(lex(text), lang)


def join_macro_parameters(text: Column) -> Column:
    """Close the gap between a macro name and its parameter list."""
    return F.regexp_replace(text, r"(?d)#define (.*) \(", r"#define $1(")


def render_python(tokens: Column) -> Column:
    """Source text with four blanks per block from a Python token array."""
    joined = replace_in_order(
        F.array_join(tokens, " "),
        ((fixed.ENDCOM, fixed.NEW_LINE), (fixed.SPACE_MARK, fixed.SPACE_TOKEN)),
    )
    lines = F.transform(F.split(joined, fixed.NEW_LINE), lambda t: strip(t))

    def dedents(line: Column) -> Column:
        return F.size(F.regexp_extract_all(line, F.lit(fixed.DEDENT), F.lit(0)))

    def step(depth: Column, line: Column) -> Column:
        return (
            F.when(line.startswith(f"{fixed.INDENT} "), depth + 1)
            .when(line.startswith(fixed.DEDENT), F.greatest(depth - dedents(line), F.lit(0)))
            .otherwise(depth)
        )

    def lay_out(lines: Column) -> Column:
        def blanks(depth: Column) -> Column:
            return F.repeat(F.lit("    "), depth)

        def write(depths: Column) -> Column:
            return F.transform(
                lines,
                lambda line, i: F.when(
                    line.startswith(f"{fixed.INDENT} "),
                    F.replace(line, F.lit(f"{fixed.INDENT} "), blanks(F.get(depths, i))),
                )
                .when(
                    line.startswith(fixed.DEDENT),
                    F.concat(
                        blanks(F.get(depths, i)),
                        strip(F.replace(line, F.lit(fixed.DEDENT), F.lit(""))),
                    ),
                )
                .otherwise(F.concat(blanks(F.get(depths, i)), line)),
            )

        return let(scan(lines, F.lit(0), step), write)

    text = F.array_join(let(lines, lay_out), "\n")
    return _close_up_python(_decode_python_literals(text))


_PY_LITERAL = (
    r"""(?sd)#[^\n]*+|\"\"\"[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+\"\"\"|'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+'''"""
    r"""|"[^\n"\\]*+(?:\\.[^\n"\\]*+)*+"|'[^\n'\\]*+(?:\\.[^\n'\\]*+)*+'|[^#"']++|."""
)


def _decode_python_literals(text: Column) -> Column:
    return F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(_PY_LITERAL), F.lit(0)),
            lambda t: F.when(
                t.rlike("^[#\"']"),
                replace_in_order(
                    t,
                    (
                        (fixed.STR_NEWLINE, "\n"),
                        (fixed.TAB_SYMBOL, "\t"),
                        (" ", ""),
                        (fixed.SPACE_TOKEN, " "),
                    ),
                ),
            ).otherwise(t),
        ),
        "",
    )


def _close_up_python(text: Column) -> Column:
    dotted = replace_in_order(text, fixed.PYTHON_DOTS)
    prefixes = fixed.PYTHON_STRING_PREFIXES + tuple(p.upper() for p in fixed.PYTHON_STRING_PREFIXES)
    joined = reduce(
        lambda t, p: replace_in_order(t, ((f" {p} '", f" {p}'"), (f' {p} "', f' {p}"'))),
        prefixes,
        dotted,
    )
    return replace_in_order(joined, (("> >", ">>"), ("< <", "<<")))
