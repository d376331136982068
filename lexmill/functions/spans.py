"""Function spans in token arrays, one left fold per row.

A file is one row, so its functions are found where the row is: nothing is exploded, shuffled
or grouped, and neither a huge file count nor many copies of one file can make a hot task.  The
state of the fold has a fixed size: a state carries the span that ends there, if any, and the
spans are picked from the states, so the time is linear in the tokens however many functions a
file has.
Positions count tokens from zero; both ends belong to the span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import fixed
from lexmill.functions.exprs import fold_found, let, one_of

_SPAN = "struct<start:int,end:int,in_class:boolean>"


def _no_span() -> Column:
    return F.lit(None).cast(_SPAN)


def _span(start: Column, end: Column, in_class: Column) -> Column:
    return F.struct(start.alias("start"), end.cast("int").alias("end"), in_class.alias("in_class"))


def _spans(
    events: Column,
    start: Column,
    step: Callable[[Column, Column], Column],
    unclosed: Callable[[Column], Column] | None = None,
) -> Column:
    """Spans of all states of the fold, and of a function that is still open at the end."""

    def finish(found: Column, last: Column) -> Column:
        if unclosed is None:
            return found
        return F.when(last["depth"] > 0, F.array_append(found, unclosed(last))).otherwise(found)

    return let(events, lambda bound: fold_found(bound, start, step, lambda s: s["span"], finish))


def _changed(state: Column, names: tuple[str, ...], **fields: Column) -> Column:
    """The state with other values in some fields, and without a span unless one is given."""
    fields = {"span": _no_span()} | fields
    return F.struct(*((fields[name] if name in fields else state[name]).alias(name) for name in names))


def cpp_spans(pairs: Column) -> Column:
    """Functions with a body in a lexed C or C++ file.

    A header is a parenthesis that closes right before a non-empty body (or before ``throw ( )``
    and such a body) and whose first opening parenthesis follows a name.  Rejected headers are
    searched inside, accepted functions are not.  A body that never closes runs to the end.
    """

    def token(i: Column) -> Column:
        return F.get(pairs, i)["token"]

    def event(p: Column, i: Column) -> Column:
        t = p["token"]
        header = (t == ")") & (
            ((token(i + 1) == "{") & (token(i + 2) != "}"))
            | ((token(i + 1) == "throw") & (token(i + 4) == "{") & (token(i + 5) != "}"))
        )
        named = (t == "(") & one_of(F.get(pairs, i - 1)["tag"], *fixed.NAME_TAGS)
        return F.struct(
            t.alias("t"),
            i.alias("i"),
            F.coalesce(header, F.lit(False)).alias("header"),
            F.coalesce(named, F.lit(False)).alias("named"),
        )

    # Only these tokens can change the state; all others are looked at through them.
    events = F.filter(
        F.transform(
            pairs,
            lambda p, i: F.when(
                one_of(p["token"], "(", ")", "{", "}", ";", "\n", fixed.NEW_LINE, "class", "struct"),
                event(p, i),
            ),
        ),
        lambda e: e.isNotNull(),
    )

    start = F.struct(
        F.lit(-1).alias("bound"),  # last token that ends a statement
        F.lit(-1).alias("open"),  # first parenthesis after it
        F.lit(False).alias("named"),  # ... follows a name
        F.lit(False).alias("header"),  # a body is about to open
        F.lit(False).alias("kind"),  # a class or struct head was seen
        F.lit("").alias("scopes"),  # open braces outside functions, "1" for a class body
        F.lit(0).alias("depth"),  # braces open inside the current function
        F.lit(-1).alias("start"),
        _no_span().alias("span"),
    )

    names = ("bound", "open", "named", "header", "kind", "scopes", "depth", "start", "span")
    none = {"open": F.lit(-1), "named": F.lit(False), "header": F.lit(False), "kind": F.lit(False)}

    def step(s: Column, e: Column) -> Column:
        t = e["t"]
        ended = _changed(s, names, **none, bound=e["i"], depth=F.lit(0), span=_span(s["start"], e["i"], s["scopes"].endswith("1")))
        # A state inside a function has no span, so one that stays is taken as it is.
        inside = (
            F.when(t == "{", _changed(s, names, depth=s["depth"] + 1))
            .when(t != "}", s)
            .when(s["depth"] == 1, ended)
            .otherwise(_changed(s, names, depth=s["depth"] - 1))
        )
        scopes = F.concat(s["scopes"], F.when(s["kind"], "1").otherwise("0"))
        fewer = F.left(s["scopes"], F.length(s["scopes"]) - 1)
        accepted = _changed(s, names, **none, depth=F.lit(1), start=s["bound"] + 1)
        first_open = _changed(s, names, open=e["i"], named=e["named"] & (e["i"] > s["bound"] + 1))
        outside = (
            F.when((t == "(") & (s["open"] < 0), first_open)
            .when(one_of(t, "(", ")"), _changed(s, names, header=s["header"] | e["header"]))
            .when((t == "{") & s["header"] & s["named"], accepted)
            .when(t == "{", _changed(s, names, **none, bound=e["i"], scopes=scopes))
            .when(t == "}", _changed(s, names, **none, bound=e["i"], scopes=fewer))
            .when(one_of(t, "class", "struct"), _changed(s, names, kind=F.lit(True)))
            .when(s["header"], _changed(s, names))
            .otherwise(_changed(s, names, **none, bound=e["i"]))
        )
        return F.when(s["depth"] > 0, inside).otherwise(outside)

    return _spans(
        events, start, step, lambda s: _span(s["start"], F.size(pairs) - 1, s["scopes"].endswith("1"))
    )


def java_spans(tokens: Column) -> Column:
    """Functions in a tokenised Java text.

    A header is a closing parenthesis before a body, or before ``throws X`` and a body; empty
    bodies count.  A comment that stands directly in front belongs to the function.
    """
    # Marks of line ends do not count when looking for the body, so they are taken out; the gap
    # they leave in the positions still ends a statement.
    solid = F.filter(
        F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
        lambda p: p["t"] != fixed.NEW_LINE,
    )
    marks = ("{", "}", ";", ")", "/*", "*/", "//", "\n", fixed.ENDCOM)

    def events(solid: Column) -> Column:
        def ahead(k: Column) -> Column:
            return F.get(solid, k)["t"]

        def event(p: Column, k: Column) -> Column:
            header = (p["t"] == ")") & (
                (ahead(k + 1) == "{") | ((ahead(k + 1) == "throws") & (ahead(k + 3) == "{"))
            )
            return F.struct(
                p["t"].alias("t"),
                p["i"].alias("i"),
                gap(p, k).alias("gap"),
                F.coalesce(header, F.lit(False)).alias("header"),
            )

        def gap(p: Column, k: Column) -> Column:
            return p["i"] > F.coalesce(F.get(solid, k - 1)["i"], F.lit(-1)) + 1

        return F.filter(
            F.transform(
                solid, lambda p, k: F.when(one_of(p["t"], *marks) | gap(p, k), event(p, k))
            ),
            lambda e: e.isNotNull(),
        )

    start = F.struct(
        F.lit(0).alias("begin"),  # where a function would begin
        F.lit(-1).alias("block"),  # last opening of a block comment
        F.lit(-1).alias("line"),  # last opening of a line comment
        F.lit(False).alias("header"),
        F.lit(0).alias("depth"),
        F.lit(-1).alias("start"),
        _no_span().alias("span"),
    )

    names = ("begin", "block", "line", "header", "depth", "start", "span")

    def step(s: Column, e: Column) -> Column:
        t = e["t"]
        # A state inside a function has no span and no header, so one that stays is taken as it is.
        inside = (
            F.when(t == "{", _changed(s, names, depth=s["depth"] + 1))
            .when((t == "}") & (s["depth"] == 1), _changed(s, names, begin=e["i"] + 1, depth=F.lit(0), span=_span(s["start"], e["i"], F.lit(True))))
            .when(t == "}", _changed(s, names, depth=s["depth"] - 1))
            .when(t == "/*", _changed(s, names, block=e["i"]))
            .when(t == "//", _changed(s, names, line=e["i"]))
            .otherwise(s)
        )
        begin = (
            F.when(s["header"], s["begin"])
            .when((t == "*/") & (s["block"] >= 0), s["block"])
            .when((t == fixed.ENDCOM) & (s["line"] >= 0), s["line"])
            .when(one_of(t, ";", "}", "{", "*/", "\n", fixed.ENDCOM), e["i"] + 1)
            .when(e["gap"], e["i"])
            .otherwise(s["begin"])
        )
        other = _changed(
            s, names, begin=begin,
            block=F.when(t == "/*", e["i"]).otherwise(s["block"]),
            line=F.when(t == "//", e["i"]).otherwise(s["line"]),
            header=(t != "{") & (s["header"] | e["header"]),
        )
        accepted = _changed(s, names, header=F.lit(False), depth=F.lit(1), start=s["begin"])
        return F.when(s["depth"] > 0, inside).when((t == "{") & s["header"], accepted).otherwise(other)

    return _spans(
        let(solid, events), start, step, lambda s: _span(s["start"], F.size(tokens) - 1, F.lit(True))
    )


def java_pair_spans(pairs: Column) -> Column:
    """Functions in a lexed Java text, from (token, tag) pairs with comments as one token each.

    A header is a closing parenthesis before a body or before ``throws``, a list of names and a body; empty bodies count.
    A function begins behind the last brace or semicolon, or at a comment that comes later than these.  What stands in the
    parentheses of an annotation, or as a comment in those of a header, ends no statement.
    """

    def token(i: Column) -> Column:
        return F.get(pairs, i)["token"]

    def event(p: Column, i: Column) -> Column:
        header = (p["token"] == ")") & one_of(token(i + 1), "{", "throws")
        return F.struct(
            F.when(p["tag"] == fixed.COMMENT, fixed.COMMENT).otherwise(p["token"]).alias("t"),
            i.alias("i"),
            F.coalesce(header, F.lit(False)).alias("header"),
        )

    events = F.filter(
        F.transform(
            pairs,
            lambda p, i: F.when(
                (p["tag"] == fixed.COMMENT) | one_of(p["token"], "{", "}", ";", "(", ")", "@"), event(p, i)
            ),
        ),
        lambda e: e.isNotNull(),
    )

    def names_between(at: Column, end: Column) -> Column:
        """Whether a name, or names joined by dots, are all that stands between two places."""
        places = F.when(end > at + 1, F.sequence(at + 1, end - 1)).otherwise(F.array().cast("array<int>"))
        dotted = F.forall(places, lambda i: ((i - at) % 2 == 0) == (token(i) == "."))
        return ((end - at) % 2 == 0) & dotted

    start = F.struct(
        F.lit(0).alias("begin"),  # where a function would begin
        F.lit(-1).alias("mark"),  # an @ whose parenthesis may follow
        F.lit(0).alias("annotation"),  # parentheses open in an annotation
        F.lit(0).alias("open"),  # other parentheses open outside functions
        F.lit(False).alias("header"),
        F.lit(0).alias("depth"),
        F.lit(-1).alias("start"),
        _no_span().alias("span"),
    )

    names = ("begin", "mark", "annotation", "open", "header", "depth", "start", "span")

    def step(s: Column, e: Column) -> Column:
        t, header = e["t"], s["header"] | e["header"]
        left, right = t == "(", t == ")"
        none = {"mark": F.lit(-1), "open": F.lit(0), "header": F.lit(False)}
        bound = {"begin": e["i"] + 1, **none}
        # A state inside a function has no span, so one that stays is taken as it is.
        inside = (
            F.when(t == "{", _changed(s, names, depth=s["depth"] + 1))
            .when(t != "}", s)
            .when(s["depth"] == 1, _changed(s, names, **bound, depth=F.lit(0), span=_span(s["start"], e["i"], F.lit(True))))
            .otherwise(_changed(s, names, depth=s["depth"] - 1))
        )
        noted = (
            F.when(left, _changed(s, names, annotation=s["annotation"] + 1, mark=F.lit(-1), header=F.lit(False)))
            .when(right, _changed(s, names, annotation=s["annotation"] - 1, header=F.lit(False)))
            .otherwise(_changed(s, names, header=F.lit(False)))
        )
        free = (
            F.when(
                left & (s["mark"] >= 0) & names_between(s["mark"], e["i"]),
                _changed(s, names, annotation=F.lit(1), mark=F.lit(-1), header=header),
            )
            .when(left, _changed(s, names, open=s["open"] + 1, mark=F.lit(-1), header=header))
            .when(right, _changed(s, names, open=F.greatest(s["open"] - 1, F.lit(0)), header=header))
            .when((t == "{") & s["header"], _changed(s, names, **none, depth=F.lit(1), start=s["begin"]))
            .when(one_of(t, "{", "}", ";"), _changed(s, names, **bound))
            .when(t == "@", _changed(s, names, mark=e["i"], header=header))
            .when((t == fixed.COMMENT) & (s["open"] == 0) & ~s["header"], _changed(s, names, begin=e["i"], header=header))
            .otherwise(_changed(s, names, header=header))
        )
        return F.when(s["depth"] > 0, inside).when(s["annotation"] > 0, noted).otherwise(free)

    return _spans(events, start, step, lambda s: _span(s["start"], F.size(pairs) - 1, F.lit(True)))


def python_spans(tokens: Column) -> Column:
    """Functions in a tokenised Python text: from ``def`` to the mark that ends its block.

    The block depth runs on from function to function; inner functions belong to the outer one
    and a function that never ends is left out.
    """
    events = F.filter(
        F.transform(
            tokens,
            lambda t, i: F.when(one_of(t, "def", fixed.INDENT, fixed.DEDENT), F.struct(t.alias("t"), i.alias("i"))),
        ),
        lambda e: e.isNotNull(),
    )
    start = F.struct(
        F.lit(False).alias("inside"),
        F.lit(0).alias("depth"),
        F.lit(-1).alias("start"),
        _no_span().alias("span"),
    )

    def step(s: Column, e: Column) -> Column:
        change = F.when(e["t"] == fixed.INDENT, 1).when(e["t"] == fixed.DEDENT, -1).otherwise(0)
        depth = s["depth"] + F.when(s["inside"], change).otherwise(F.lit(0))
        ended = s["inside"] & (e["t"] == fixed.DEDENT) & (depth == 0)
        begins = ~s["inside"] & (e["t"] == "def")
        return F.struct(
            ((s["inside"] & ~ended) | begins).alias("inside"),
            depth.alias("depth"),
            F.when(begins, e["i"]).otherwise(s["start"]).alias("start"),
            F.when(ended, _span(s["start"], e["i"], F.lit(True))).alias("span"),
        )

    return _spans(events, start, step)
