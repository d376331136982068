"""Code or tokens of one file -> array of its functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import fixed
from lexmill.functions.exprs import NOT_WS, WS, let, section, words
from lexmill.functions.lexing import lex_cpp
from lexmill.functions.signatures import (
    cfamily_function_name,
    clean_preprocessor,
    close_comment,
    drop_heredoc_marks,
    extract_arguments,
    is_python2,
    marks_to_text,
    python_function_name,
    remove_annotation,
    text_to_marks,
)
from lexmill.functions.spans import cpp_spans, java_pair_spans, java_spans, python_spans

STANDALONE, IN_CLASS = "standalone", "class"


def _cut(items: Column, span: Column) -> Column:
    return section(items, span["start"], span["end"] + 1)


def _before(tokens: Column, mark: str) -> Column:
    """Tokens in front of the first ``mark``."""
    return F.slice(
        tokens, F.lit(1), F.greatest(F.array_position(tokens, F.lit(mark)).cast("int") - 1, F.lit(0))
    )


# The words that give a Python function its name: the first ``def`` and what follows it.
_DEF_NAME = rf"(?<!{NOT_WS})def(?!{NOT_WS})(?:{WS}++{NOT_WS}++)?+"


def _row(
    span: Column, kind: Column, text: Column, name: Callable[[Column], Column], arguments: bool, head: str | None = None
) -> Column:
    """A function; with ``head``, only the words of the first match of that pattern are read for its name."""

    def fields(text: Column) -> Column:
        none = F.lit(None).cast("array<struct<type:string,name:string>>")
        args = extract_arguments(text) if arguments else none
        return let(
            args,
            lambda a: F.struct(
                span["start"].alias("start_pos"),
                span["end"].alias("end_pos"),
                kind.alias("kind"),
                text.alias("text"),
                name(words(F.regexp_extract(text, head, 0) if head else text)).alias("name"),
                F.transform(a, lambda x: x["type"]).alias("arg_types"),
                F.transform(a, lambda x: x["name"]).alias("arg_names"),
            ),
        )

    return let(text, fields)


def cpp_kind(pairs: Column, in_class: Column) -> Column:
    """Kind of a C++ function from its own pairs and whether a class body surrounds it."""
    tokens = F.transform(pairs, lambda p: p["token"])

    def decide(tokens: Column) -> Column:
        open_at = F.array_position(tokens, F.lit("(")).cast("int")
        member = F.coalesce(F.get(pairs, open_at - 2)["tag"] == "field_identifier", F.lit(False))
        static = F.array_contains(_before(tokens, "{"), F.lit("static"))
        scoped = F.array_contains(_before(tokens, "("), F.lit("::"))
        return F.when(static | ~(scoped | member | in_class), STANDALONE).otherwise(IN_CLASS)

    return let(tokens, decide)


def cpp_functions(code: Column, arguments: bool = True) -> Column:
    """Functions of C or C++ text, raw or space-joined tokens; NULL arguments when not asked for."""

    def text_of(own: Column) -> Column:
        joined = F.array_join(
            F.transform(
                own,
                lambda p: F.when(p["tag"] == fixed.COMMENT, close_comment(p["token"])).otherwise(p["token"]),
            ),
            " ",
        )
        return text_to_marks(clean_preprocessor(drop_heredoc_marks(joined)))

    def rows(pairs: Column) -> Column:
        return F.transform(
            cpp_spans(pairs),
            lambda s: let(
                _cut(pairs, s),
                lambda own: _row(
                    s, cpp_kind(own, s["in_class"]), text_of(own), cfamily_function_name, arguments
                ),
            ),
        )

    found = let(lex_cpp(marks_to_text(clean_preprocessor(code))), rows)
    return F.filter(found, lambda f: ~f["text"].startswith("#"))


def java_functions(tokens: Column, arguments: bool = True) -> Column:
    """Functions of tokenised Java text; NULL arguments when not asked for."""

    def rows(tokens: Column) -> Column:
        return F.transform(
            java_spans(tokens),
            lambda s: let(
                _cut(tokens, s),
                lambda own: _row(
                    s,
                    F.when(F.array_contains(_before(own, "{"), F.lit("static")), STANDALONE).otherwise(
                        IN_CLASS
                    ),
                    remove_annotation(F.array_join(own, " ")),
                    cfamily_function_name,
                    arguments,
                ),
            ),
        )

    return let(tokens, rows)


def java_pair_functions(pairs: Column, arguments: bool = True, without_annotation: bool = True) -> Column:
    """Functions of Java text tokens with their tags (comments kept); NULL arguments when not asked for."""

    def rows(pairs: Column) -> Column:
        def row(s: Column) -> Column:
            def of(own: Column) -> Column:
                text = F.array_join(own, " ")
                static = F.array_contains(_before(own, "{"), F.lit("static"))
                return _row(
                    s,
                    F.when(static, STANDALONE).otherwise(IN_CLASS),
                    remove_annotation(text) if without_annotation else text,
                    cfamily_function_name,
                    arguments,
                )

            return let(F.transform(_cut(pairs, s), lambda p: p["token"]), of)

        return F.transform(java_pair_spans(pairs), row)

    return let(pairs, rows)


def python_functions(tokens: Column) -> Column:
    """Functions of tokenised Python text, without those of the old language version."""

    def kind(own: Column) -> Column:
        return let(
            F.array_position(own, F.lit("(")).cast("int"),
            lambda at: F.when(
                at > 0, F.when(F.get(own, at) == "self", IN_CLASS).otherwise(STANDALONE)
            ),
        )

    def rows(tokens: Column) -> Column:
        return F.transform(
            python_spans(tokens),
            lambda s: let(
                _cut(tokens, s),
                lambda own: _row(s, kind(own), F.array_join(own, " "), python_function_name, False, _DEF_NAME),
            ),
        )

    return F.filter(let(tokens, rows), lambda f: ~is_python2(f["text"]))


def functions_of(lang: str, tokens: Column, arguments: bool = True) -> Column:
    """Functions of a tokenised file by language key."""
    if lang == "cpp":
        return cpp_functions(F.array_join(tokens, " "), arguments)
    if lang == "java":
        return java_functions(tokens, arguments)
    return python_functions(tokens)
