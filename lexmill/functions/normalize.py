"""Cleaning of raw code: comments, trailing blanks, empty lines, carriage returns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.exprs import OPEN_MARK, WS, let, mark_open_comments

# One match per comment, literal, or stretch without either.  Every loop around a group is
# possessive: a plain loop recurses per character in Java and overflows on long literals.
_SEGMENT = (
    r"(?sd)//[^\n]*+|/\*.*?\*/"
    r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"
    r'|"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    r"""|[^/'"]++|."""
)


def remove_comments(code: Column) -> Column:
    """Turn each comment into one space; literals that hold comment marks stay."""
    cleaned = F.array_join(
        F.transform(
            F.regexp_extract_all(mark_open_comments(code), F.lit(_SEGMENT), F.lit(0)),
            lambda s: F.when(s.startswith("//") | s.startswith("/*"), " ").otherwise(s),
        ),
        "",
    )
    unmarked = lambda c: F.when(code.contains(OPEN_MARK), c).otherwise(F.replace(c, F.lit(OPEN_MARK), F.lit("")))
    return let(cleaned, unmarked)


def remove_trailing_space(code: Column) -> Column:
    """Drop blanks before each line end; runs of blank lines shrink, the last line end goes."""
    return F.regexp_replace(code, rf"(?md)(?<!{WS}){WS}+$", "")


def remove_empty_lines(code: Column) -> Column:
    return F.regexp_replace(code, r"(?md)^$\n", "")


def remove_carriage_returns(code: Column) -> Column:
    return F.replace(code, F.lit("\r"), F.lit(""))


def normalize(code: Column) -> Column:
    """The three cleaning steps in their fixed order."""
    return remove_empty_lines(remove_trailing_space(remove_comments(code)))
