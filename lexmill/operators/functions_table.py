"""Function tables: one row per function found in a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.extraction import cpp_functions
from lexmill.operators.languages import by_language, language


def _table(df: DataFrame, found: Column, keep: tuple[str, ...]) -> DataFrame:
    # The functions are complete before the array is opened, so the file's tokens are not copied
    # to every function row.
    return df.select(*keep, F.inline(found))


def function_table(
    df: DataFrame, *keep: str, tokens: str = "tokens", lang: str = "cpp", arguments: bool = True
) -> DataFrame:
    """Functions of tokenised files: span, kind, text, name and, if asked for, arguments."""
    return _table(df, language(lang).functions(F.col(tokens), arguments), keep)


def cpp_function_table(
    df: DataFrame, *keep: str, code: str = "code", arguments: bool = True
) -> DataFrame:
    """Functions of C or C++ files given as text."""
    return _table(df, cpp_functions(F.col(code), arguments), keep)


def mixed_function_table(
    df: DataFrame, *keep: str, code: str = "code", lang_column: str = "lang", arguments: bool = True
) -> DataFrame:
    """Functions of files given as text, found by the language of each row."""
    return _table(df, by_language(F.col(lang_column), "code_functions", F.col(code), arguments), keep)
