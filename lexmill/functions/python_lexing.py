"""Lexing of Python text with layout tokens.

One regular expression cuts the text into lexemes (strings over several lines stay whole), the
lexemes are grouped into physical lines, and a scan over the lines keeps the bracket depth and
the indentation stack.  Source that has no valid layout gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import fixed
from lexmill.functions.exprs import NOT_WS, fold_found, let, one_of, replace_in_order, section
from lexmill.functions.literals import process_comment, process_literal

_PREFIX = r"(?:[bB][rR]|[rR][bB]|[fF][rR]|[rR][fF]|[bBrRuUfF])?+"
_TRIPLE = (
    rf'{_PREFIX}"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"""'
    rf"|{_PREFIX}'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+'''"
)
_OPEN_TRIPLE = rf"""{_PREFIX}(?:\"\"\"|''')"""
_SINGLE = (
    rf'{_PREFIX}"[^\n"\\]*+(?:\\.[^\n"\\]*+)*+"'
    rf"|{_PREFIX}'[^\n'\\]*+(?:\\.[^\n'\\]*+)*+'"
)
_DIGITS = r"[0-9](?:_?[0-9])*+"
_EXPONENT = rf"(?:[eE][-+]?{_DIGITS})?"
_NUMBER = (
    r"0[xX](?:_?[0-9a-fA-F])++|0[bB](?:_?[01])++|0[oO](?:_?[0-7])++"
    rf"|(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS}|{_DIGITS}){_EXPONENT}[jJ]?"
)
_NAME = r"[\p{L}\p{N}\p{Mn}_]++"
_OPERATOR = r"\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|[-+*/%&|^@]="
# Most lexemes, told before all other patterns: marks that begin nothing longer, and names that are no prefix of a quote.
_QUICK = r"""[(),;\[\]{}~]|[\p{L}_][\p{L}\p{N}\p{Mn}_]*+(?!["'])"""
_BODY = "|".join(
    (
        r"\n[ \t\f]*+", r"\\\n[ \t\f]*+", r"#[^\n]*+", _TRIPLE, _OPEN_TRIPLE, _SINGLE,
        _NUMBER, _NAME, _OPERATOR, NOT_WS,
    )
)
# No lexeme begins with a blank, so blanks are passed without trying the other patterns.
_LEXEME = rf"(?sd){_QUICK}|(?=\n|{NOT_WS})(?:{_BODY})"
_IS_STRING = rf"(?s)^{_PREFIX}[\"'].++"
_IS_OPEN_TRIPLE = rf"^{_OPEN_TRIPLE}$"


def _width(blanks: Column) -> Column:
    """Column reached by leading blanks: tab stops at eight, a form feed starts over."""
    stepped = F.aggregate(
        F.split(blanks, ""),
        F.lit(0),
        lambda w, c: F.when(c == " ", w + 1)
        .when(c == "\t", (F.floor(w / 8) * 8 + 8).cast("int"))
        .when(c == "\f", F.lit(0))
        .otherwise(w),
    )
    return F.when(blanks.rlike(r"[\t\f]"), stepped).otherwise(F.length(blanks))


def _bracket_change(lexemes: Column) -> Column:
    opened = F.size(F.filter(lexemes, lambda t: one_of(t, "(", "[", "{")))
    return opened - F.size(F.filter(lexemes, lambda t: one_of(t, ")", "]", "}")))


def _is_comment(lexeme: Column) -> Column:
    return lexeme.startswith("#")


def _is_string(lexeme: Column) -> Column:
    """Most lexemes hold no quote, so the pattern does not meet them."""
    return (lexeme.contains('"') | lexeme.contains("'")) & lexeme.rlike(_IS_STRING)


def _is_open_triple(lexeme: Column) -> Column:
    return (lexeme.endswith('"""') | lexeme.endswith("'''")) & lexeme.rlike(_IS_OPEN_TRIPLE)


def _physical_lines(code: Column, keep_comments: bool, process_strings: bool) -> Column:
    """Array of lines: width, bracket change, output tokens and the facts the layout needs."""
    specials = fixed.PYTHON_SPECIALS

    def line(blanks: Column, lexemes: Column) -> Column:
        docstring = (F.size(lexemes) == 1) & _is_string(F.get(lexemes, F.lit(0)))
        comment = (
            F.transform(lexemes, lambda t: process_comment(t, specials, process_strings))
            if keep_comments
            else F.array().cast("array<string>")
        )
        kept = lexemes if keep_comments else F.filter(lexemes, lambda t: ~_is_comment(t))
        plain = F.transform(
            kept,
            lambda t: F.when(
                _is_comment(t),
                process_comment(t, specials, process_strings) if keep_comments else F.lit(""),
            )
            .when(_is_string(t), process_literal(t, specials, process_strings))
            .otherwise(t),
        )
        out = F.filter(F.when(docstring, comment).otherwise(plain), lambda t: t != "")
        return let(
            out,
            lambda o: F.struct(
                _width(blanks).alias("width"),
                _bracket_change(lexemes).alias("change"),
                F.exists(lexemes, lambda t: ~_is_comment(t)).alias("code"),
                F.exists(lexemes, _is_open_triple).alias("broken"),
                (docstring & (F.size(o) == 0)).alias("removed"),
                o.alias("out"),
            ),
        )

    def lines(lexemes: Column) -> Column:
        ends = F.filter(
            F.transform(lexemes, lambda t, i: F.when(t.startswith("\n"), i)),
            lambda i: i.isNotNull(),
        )

        def cut(at: Column) -> Column:
            return F.transform(
                at,
                lambda a, k: let(
                    F.filter(
                        section(lexemes, a + 1, F.coalesce(F.get(at, k + 1), F.size(lexemes))),
                        lambda t: ~t.startswith("\\\n"),
                    ),
                    lambda own: line(F.substr(F.get(lexemes, a), F.lit(2)), own),
                ),
            )

        return let(ends, cut)

    text = replace_in_order(code, (("\\r", ""), ("\r", "")))
    marked = F.concat(F.lit("\n"), text)
    return let(F.regexp_extract_all(marked, F.lit(_LEXEME), F.lit(0)), lines)


def _layout(lines: Column, finish: Callable[[Column, Column], Column]) -> Column:
    """``finish`` of the layout tokens to write per line, as one number each (:func:`_laid_out`), and of the last state."""
    start = F.struct(
        F.lit(0).alias("depth"),
        F.array(F.lit(0)).alias("stack"),
        F.lit(0).alias("waiting"),
        F.lit(False).alias("removed"),
        F.lit(True).alias("ok"),
        F.lit(0).cast("long").alias("marks"),
    )

    def step(state: Column, line: Column) -> Column:
        opens_statement = line["code"] & (state["depth"] == 0)
        top = F.element_at(state["stack"], -1)
        deeper = opens_statement & (line["width"] > top)
        kept = F.filter(state["stack"], lambda w: w <= line["width"])
        stack = (
            F.when(deeper, F.array_append(state["stack"], line["width"]))
            .when(opens_statement, kept)
            .otherwise(state["stack"])
        )
        closed = F.when(opens_statement, F.size(state["stack"]) - F.size(kept)).otherwise(F.lit(0))
        # An indentation without any token in it vanishes together with its closing mark.
        cancelled = F.least(closed, state["waiting"])
        waiting = state["waiting"] - cancelled + deeper.cast("int")
        depth = state["depth"] + line["change"]
        removed = state["removed"] | line["removed"]
        ends = line["code"] & (depth <= 0)
        newline = ends & ~removed
        visible = newline | (F.size(line["out"]) > 0)
        return F.struct(
            depth.alias("depth"),
            stack.alias("stack"),
            F.when(visible, F.lit(0)).otherwise(waiting).alias("waiting"),
            (removed & ~ends).alias("removed"),
            (
                state["ok"]
                & ~line["broken"]
                & (~opens_statement | deeper | (F.element_at(kept, -1) == line["width"]))
            ).alias("ok"),
            (
                F.shiftleft((closed - cancelled).cast("long"), 32)
                + F.when(visible, waiting).otherwise(F.lit(0)) * 2
                + newline.cast("int")
            ).alias("marks"),
        )

    return fold_found(lines, start, step, lambda s: s["marks"], finish)


def _repeat(mark: str, times: Column) -> Column:
    return F.array_repeat(F.lit(mark), times)


def _laid_out(marks: Column, out: Column) -> Column:
    """Tokens of a line with its layout tokens; ``marks`` holds dedents, indents (31 bits) and a line end (one bit)."""
    ended = F.concat(out, F.array(F.lit(fixed.NEW_LINE)))
    deeper = F.concat(
        _repeat(fixed.DEDENT, F.shiftright(marks, 32).cast("int")),
        _repeat(fixed.INDENT, F.shiftright(marks, 1).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")),
        F.when(marks % 2 == 1, ended).otherwise(out),
    )
    return F.when(marks == 0, out).when(marks == 1, ended).otherwise(deeper)


def lex_python(code: Column, keep_comments: bool = False, process_strings: bool = True) -> Column:
    """Python text -> array of tokens with NEW_LINE, INDENT and DEDENT; NULL for bad source."""

    def build(lines: Column) -> Column:
        def write(marks: Column, last: Column) -> Column:
            body = F.flatten(F.transform(lines, lambda line, i: _laid_out(F.get(marks, i), line["out"])))
            tail = _repeat(fixed.DEDENT, F.size(last["stack"]) - 1 - last["waiting"])
            return F.when(last["ok"] & (last["depth"] == 0), F.concat(body, tail))

        return _layout(lines, lambda marks, last: let(F.struct(marks.alias("marks"), last.alias("last")), lambda b: write(b["marks"], b["last"])))

    return let(_physical_lines(code, keep_comments, process_strings), build)
