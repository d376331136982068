"""Cleaning of function texts, and their names and arguments."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import fixed
from lexmill.functions.exprs import let, replace_in_order, strip


def clean_preprocessor(text: Column) -> Column:
    """Remove tokenised preprocessor lines from a function or file text."""
    cleaned = reduce(
        lambda t, pattern: F.regexp_replace(t, f"(?d){pattern}", ""),
        fixed.PREPROCESSOR_PATTERNS,
        text,
    )
    return strip(replace_in_order(cleaned, ((word, "") for word in fixed.PREPROCESSOR_WORDS)))


def drop_heredoc_marks(text: Column) -> Column:
    return F.regexp_replace(text, f"(?d){fixed.HEREDOC_PATTERN}", "")


def marks_to_text(code: Column) -> Column:
    """Layout marks to characters, and the blank mark to a word, before a text is lexed."""
    return replace_in_order(
        code,
        (
            (fixed.ENDCOM, "\n"),
            (fixed.SPACE_MARK, fixed.SPACE_TOKEN),
            (fixed.NEW_LINE, "\n"),
        ),
    )


def text_to_marks(text: Column) -> Column:
    """Line ends and blank words of a function text back to marks."""
    return replace_in_order(
        text, (("\n", fixed.ENDCOM), (fixed.SPACE_TOKEN, fixed.SPACE_MARK))
    )


def close_comment(token: Column) -> Column:
    """Comment token as it stands in a function text."""
    return F.concat(strip(token), F.lit(f" {fixed.ENDCOM}"))


def remove_annotation(text: Column) -> Column:
    """Drop one leading built-in annotation that has an argument list."""
    return F.regexp_replace(text, f"(?d){fixed.ANNOTATION_PATTERN}", "")


#: What every match of the pattern at the same place in ``fixed.PYTHON2_PATTERNS`` holds.
_PYTHON2_PARTS = ("print ", "raise ", "except ", " = ")


def is_python2(text: Column) -> Column:
    """True for a function text with syntax or calls of the old language version."""
    # A literal part is looked for first; only texts that hold it meet the pattern.
    tests = [text.contains(part) & text.rlike(pattern) for part, pattern in zip(_PYTHON2_PARTS, fixed.PYTHON2_PATTERNS, strict=True)]
    tests += [F.contains(text, F.lit(word)) for word in fixed.PYTHON2_WORDS]
    return reduce(or_, tests)


def cfamily_function_name(tokens: Column) -> Column:
    """Token before the first parenthesis; NULL when there is none."""
    return let(
        F.array_position(tokens, F.lit("(")).cast("int"),
        lambda at: F.when(at > 1, F.get(tokens, at - 2)),
    )


def python_function_name(tokens: Column) -> Column:
    """Token after ``def``; NULL when there is none."""
    return let(
        F.array_position(tokens, F.lit("def")).cast("int"),
        lambda at: F.when(at > 0, F.get(tokens, at)),
    )


def _first_parenthesis(tokens: Column) -> Column:
    """Tokens inside the first balanced pair, NULL without one."""

    def inside(tail: Column) -> Column:
        # Positions of the parentheses only, closing ones negative.
        marks = F.filter(
            F.transform(tail, lambda t, i: F.when(t == "(", i + 1).when(t == ")", -i - 1)),
            lambda m: m.isNotNull(),
        )
        state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("end"))
        folded = F.aggregate(
            marks,
            state,
            lambda s, m: F.struct(
                (s["depth"] + F.signum(m).cast("int")).alias("depth"),
                F.when((s["end"] == 0) & (m < 0) & (s["depth"] == 1), -m).otherwise(s["end"]).alias("end"),
            ),
            lambda s: F.when(s["end"] > 0, s["end"]).otherwise(F.size(tail)),
        )
        return F.slice(tail, F.lit(2), F.greatest(folded - 2, F.lit(0)))

    return let(
        F.array_position(tokens, F.lit("(")).cast("int"),
        lambda at: F.when(
            at > 0, let(F.slice(tokens, F.greatest(at, F.lit(1)), F.size(tokens)), inside)
        ),
    )


def extract_arguments(text: Column) -> Column:
    """Array of (type, name) of the first parenthesis of a space-joined function text.

    Every comma separates, empty brackets move from the name to the type, and an empty list is
    the single pair ``("None", "None")``.  NULL when the text has no parenthesis.
    """

    def argument(arg: Column) -> Column:
        brackets = F.array_join(F.regexp_extract_all(arg, F.lit(r"\[ \]"), F.lit(0)), " ")
        plain = let(
            brackets,
            lambda b: F.struct(
                F.split(F.regexp_replace(strip(F.replace(arg, b, F.lit(""))), " +", " "), " ").alias("w"),
                b.alias("b"),
            ),
        )
        return let(
            plain,
            lambda p: F.struct(
                F.array_join(
                    F.concat(F.slice(p["w"], F.lit(1), F.size(p["w"]) - 1), F.array(p["b"])), " "
                ).alias("type"),
                F.element_at(p["w"], -1).alias("name"),
            ),
        )

    none = F.array(F.struct(F.lit("None").alias("type"), F.lit("None").alias("name")))
    return let(
        F.array_join(_first_parenthesis(F.split(text, " ")), " "),
        lambda inner: F.when(inner == "", none).when(
            inner.isNotNull(), F.transform(F.split(inner, ","), argument)
        ),
    )


