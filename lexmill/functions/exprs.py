"""Small helpers that every other expression module builds on."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode-aware regex engines of scripting languages see it.  Java's own \s
# knows ASCII only, so the class is spelled out.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
# The characters of WS one by one.
_WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: States that a scan appends one by one, and such lists that make a chunk.
_CHUNK = 16
#: Items that make a chunk where few states are kept: most texts are one chunk, which is folded once.
_WIDE = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` so that ``body`` may use it often while it is computed once per row.

    The finishing step of a fold over nothing: a transform would copy what ``body`` gives, so nested bindings would copy all tokens each.
    ``body`` gets the bound value alone, whatever further parameters with defaults it has.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, lambda bound: body(bound))


#: A noncharacter that texts do not hold; it keeps an opener that nothing closes from looking like one.
OPEN_MARK = "\ufdd0"


def mark_open_comments(text: Column) -> Column:
    """Put OPEN_MARK inside each ``/*`` that no ``*/`` follows.

    A pattern for block comments would read to the end of the text at each of them; marked, they are no
    match at once, and lexing stays linear.
    """
    tail = F.substring_index(text, "*/", -1)
    head = F.left(text, F.length(text) - F.length(tail))
    marked = F.concat(head, F.replace(tail, F.lit("/*"), F.lit(f"/{OPEN_MARK}*")))
    return F.when(tail.contains("/*") & ~text.contains(OPEN_MARK), marked).otherwise(text)


def mark_open_raw_strings(text: Column) -> Column:
    """Put OPEN_MARK inside each raw string opener that no closer of its delimiter word follows.

    For every distinct delimiter word the last closer is looked up once, and openers behind it are marked; a pattern would read to
    the end of the text at each of them.
    """

    def behind(text: Column, word: Column) -> Column:
        closer = F.concat(F.lit(")"), word, F.lit('"'))
        tail = F.call_function("substring_index", text, closer, F.lit(-1))
        head = F.left(text, F.length(text) - F.length(tail))
        opener = F.concat(F.lit('R"'), word, F.lit("("))
        return F.concat(head, F.replace(tail, opener, F.concat(F.lit(f'R"{OPEN_MARK}'), word, F.lit("("))))

    found = F.regexp_extract_all(text, F.lit(r'R"([^()\\\s]{0,16})\('), F.lit(1))
    return F.when(text.contains('R"'), F.aggregate(F.array_distinct(found), text, behind)).otherwise(text)


def mark_open_text_blocks(text: Column) -> Column:
    """Put OPEN_MARK inside each escaped triple quote that no plain one follows: as an opener it would stay open."""
    head = F.regexp_extract(text, r'(?s)\A(?:.*(?<!\\)(?:\\\\)*+""")?+', 0)
    tail = F.substr(text, F.length(head) + 1)
    marked = F.concat(head, F.replace(tail, F.lit('"""'), F.lit(f'"{OPEN_MARK}""')))
    return F.when(text.contains('\\"""'), marked).otherwise(text)


def unmark(parts: Column) -> Column:
    """Matches of a marked text as they stand in the text itself."""
    plain = F.transform(parts, lambda p: F.replace(p, F.lit(OPEN_MARK), F.lit("")))
    return F.filter(plain, lambda p: p != "")


def strip(text: Column) -> Column:
    """Drop white space from both ends."""
    return F.btrim(text, F.lit(_WS_CHARS))


def words(text: Column) -> Column:
    """Non-blank words of a text."""
    return F.regexp_extract_all(text, F.lit(rf"{NOT_WS}++"), F.lit(0))


def replace_in_order(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements, each one applied to the result of the one before."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def replace_held(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """As :func:`replace_in_order`, for long texts, many pairs (one at least) and few of them held.

    A replacement compares at every byte, even where there is nothing to replace; the search before it looks at first bytes only.
    The fold costs the analyzer a round, so it does not stand for short texts or few pairs.
    """
    table = F.array(*(F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new in pairs))

    def step(text: Column, pair: Column) -> Column:
        return F.when(text.contains(pair["old"]), F.replace(text, pair["old"], pair["new"])).otherwise(text)

    return F.aggregate(table, text, step)


def one_of(value: Column, *options: str) -> Column:
    """Whether ``value`` is one of a few texts, for use inside a lambda: there, a short IN walks its list lazily at every call."""
    return reduce(or_, (value == option for option in options))


def opened(items: Column) -> Column:
    """Array as input for an explode.

    For a bare column the optimizer adds a filter on its size and pushes that below the projection
    that computes it, which would lex every text twice.  An expression keeps it in one place.
    """
    return F.coalesce(items, F.array())


def section(items: Column, start: Column, end: Column) -> Column:
    """Items from ``start`` up to, not including, ``end``.

    Unlike a slice it does not copy the whole array first, so cutting an array into all its parts is
    linear.  ``items`` should be bound.
    """
    return F.transform(_places(start, end), lambda i: F.get(items, i))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """States of a left fold after every item, in time linear in the items; ``items`` should be bound.

    An aggregate copies its whole state at each step, so a state that holds all results so far would be quadratic.  A first pass
    only folds chunks to the state that each is entered with.  A second one opens every chunk by itself from there, where states are
    appended to short lists, and these to the list of the chunk.
    """
    size = F.size(items)
    wide = _CHUNK * _CHUNK

    def open_chunk(state: Column, k: Column) -> Column:
        def open_part(done: Column, j: Column) -> Column:
            start = k * wide + j * _CHUNK
            return F.array_append(
                done,
                F.aggregate(
                    section(items, start, F.least(start + _CHUNK, size)),
                    F.slice(F.element_at(done, -1), F.lit(-1), F.lit(1)),
                    lambda states, x: F.array_append(states, step(F.element_at(states, -1), x)),
                ),
            )

        rest = F.ceil(F.least(size - k * wide, F.lit(wide)) / _CHUNK).cast("int")
        parts = F.aggregate(_places(F.lit(0), rest), F.array(F.array(state)), open_part)
        # Each part begins with the state that it was entered with.
        return F.flatten(F.transform(parts, lambda states: F.slice(states, F.lit(2), F.size(states) - 1)))

    return F.flatten(F.transform(_entered(items, zero, step, wide), open_chunk))


def fold_found(
    items: Column,
    zero: Column,
    step: Callable[[Column, Column], Column],
    found: Callable[[Column], Column],
    finish: Callable[[Column, Column], Column],
) -> Column:
    """``finish`` of what ``found`` takes from the states of a left fold, in order and without NULLs, and of the last state.

    As :func:`scan`, but a chunk keeps only what is found in it, so its steps copy that and one state.
    """
    none = F.slice(F.array(found(zero)), 1, 0)

    def open_chunk(state: Column, k: Column) -> Column:
        def go(done: Column, item: Column) -> Column:
            return let(
                step(done["state"], item),
                lambda s: F.struct(
                    s.alias("state"),
                    F.when(found(s).isNull(), done["found"]).otherwise(F.array_append(done["found"], found(s))).alias("found"),
                ),
            )

        own = F.when(F.size(items) <= _WIDE, items).otherwise(section(items, k * _WIDE, F.least((k + 1) * _WIDE, F.size(items))))
        return F.aggregate(own, F.struct(state.alias("state"), none.alias("found")), go)

    opened_chunks = F.transform(_entered(items, zero, step, _WIDE), open_chunk)
    return let(opened_chunks, lambda c: finish(F.flatten(F.transform(c, lambda x: x["found"])), F.element_at(c, -1)["state"]))


def _entered(items: Column, zero: Column, step: Callable[[Column, Column], Column], wide: int) -> Column:
    """States that the chunks of a fold are entered with; the last chunk is not folded."""
    chunks = F.floor((F.size(items) + wide - 1) / wide).cast("int")

    def enter(entered: Column, k: Column) -> Column:
        own = section(items, k * wide, (k + 1) * wide)
        return F.array_append(entered, F.aggregate(own, F.element_at(entered, -1), step))

    return F.aggregate(_places(F.lit(0), chunks - 1), F.array(zero), enter)


def _places(start: Column, end: Column) -> Column:
    """Numbers from ``start`` up to, not including, ``end``."""
    return F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
