"""Sub-tokenising of string literals and comments, and its inverse for plain strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import fixed
from lexmill.functions.exprs import let, one_of, replace_in_order, strip

Specials = tuple[tuple[str, str], ...]

# The published word-split rule works on punctuation classes without the backslash, and keeps a
# mark that stands between two digits.
_PUNCT = r"[^\P{P}\\]"
# A mark that begins with the character before it would be tried at every character of a text; this begins at marks, and
# takes along the mark that would have been used up as the character before the next one.
_AFTER_NON_DIGIT = rf"(?s)({_PUNCT})(?<=[^\p{{Nd}}].)({_PUNCT}?)"
_BEFORE_NON_DIGIT = rf"({_PUNCT})([^\p{{Nd}}])"
_SYMBOL = r"(\p{S})"


def show_white_space(text: Column) -> Column:
    """Write blanks, line ends and tabs as visible marks."""
    return replace_in_order(
        text,
        (
            (" ", f" {fixed.SPACE_MARK} "),
            ("\n", f" {fixed.STR_NEWLINE} "),
            ("\t", f" {fixed.TAB_SYMBOL} "),
        ),
    )


def mark_specials(text: Column, specials: Specials) -> Column:
    """Replace protected character sequences by their stand-ins, in table order."""
    return replace_in_order(text, ((char, f" {name} ") for name, char in specials))


def restore_specials(text: Column, specials: Specials) -> Column:
    """Put the character sequences back; blanks around a stand-in stay."""
    return replace_in_order(text, specials)


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "  ++", " ")


def cap_runs(text: Column) -> Column:
    """Shorten a run of five or more equal characters to five."""
    return F.regexp_replace(text, r"(?d)(.)\1\1\1\1+", "$1$1$1$1$1")


def is_contentless(text: Column) -> Column:
    """True when fewer than two word characters are in the text."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", "")) < 2


def mark_comment_end(text: Column) -> Column:
    """Close a line comment: at its first line end if it has one, else at the end of the text."""
    return F.regexp_replace(
        text,
        rf"(?s)\A(\s*+STOKEN00(?:(?! {fixed.STR_NEWLINE} ).)*+)(?: {fixed.STR_NEWLINE} |\z)",
        f"$1 {fixed.ENDCOM}",
    )


def split_words_international(text: Column, collapse: bool = False) -> Column:
    """Set punctuation and symbols apart, except a mark between two digits.

    With ``collapse``, for texts whose blanks are collapsed afterwards, a symbol takes the place of those around it.
    """
    apart = F.regexp_replace(text, _AFTER_NON_DIGIT, " $1 $2")
    apart = F.regexp_replace(apart, _BEFORE_NON_DIGIT, " $1 $2")
    return strip(F.regexp_replace(apart, f" *+{_SYMBOL} *+" if collapse else _SYMBOL, " $1 "))


def rejoin_prefix(text: Column) -> Column:
    """Close the gap after a leading letter (literal prefix), wherever that letter occurs."""
    first = F.substring(text, 1, 1)
    return F.when(text.rlike(r"^\p{L}"), F.replace(text, F.concat(first, F.lit(" ")), first)).otherwise(text)


def _whole(text: Column, specials: Specials) -> Column:
    marked = mark_comment_end(mark_specials(show_white_space(text), specials))
    split = collapse_spaces(split_words_international(collapse_spaces(marked), collapse=True))
    return let(restore_specials(F.replace(split, F.lit("\r"), F.lit("")), specials), rejoin_prefix)


def _light_comment(text: Column, specials: Specials) -> Column:
    marked = mark_comment_end(mark_specials(show_white_space(text), specials))
    plain = replace_in_order(marked, ((f" {name} ", char) for name, char in specials))
    return replace_in_order(
        plain,
        (
            (f" {fixed.SPACE_MARK} ", " "),
            (f" {fixed.TAB_SYMBOL} ", "\t"),
            ("\\r", ""),
            (f" {fixed.STR_NEWLINE} ", "\\n"),
        ),
    )


def process_literal(text: Column, specials: Specials = (), whole: bool = True) -> Column:
    """String or character literal; the light mode only makes line ends printable."""
    if whole:
        return _whole(text, specials)
    return replace_in_order(text, (("\n", "\\n"), ("\r", "")))


def process_comment(text: Column, specials: Specials = (), whole: bool = True) -> Column:
    """Comment text; a comment without content becomes the empty string."""
    body = _whole if whole else _light_comment
    return let(
        cap_runs(collapse_spaces(text)),
        lambda t: F.when(is_contentless(t), F.lit("")).otherwise(body(t, specials)),
    )


def tokenize_string(text: Column) -> Column:
    """Pieces of one plain string."""
    return F.split(process_literal(text), " ")


def detokenize_string(pieces: Column) -> Column:
    """Inverse of :func:`tokenize_string` for an array of pieces."""
    return replace_in_order(F.array_join(pieces, " "), ((" ", ""), (fixed.SPACE_MARK, " ")))


def text_pairs(
    pairs: Column, lang: str, keep_comments: bool = False, process_strings: bool = True
) -> Column:
    """Pairs for text modelling: literals sub-tokenised, comments dropped unless kept; every token keeps its tag."""
    specials = fixed.SPECIALS[lang]
    literal_tags = fixed.LITERAL_TAGS[lang][1:]
    kept = pairs if keep_comments else F.filter(pairs, lambda p: p["tag"] != fixed.COMMENT)

    def text(p: Column) -> Column:
        comment = process_comment(p["token"], specials, process_strings)
        literal = process_literal(p["token"], specials, process_strings)
        plain = replace_in_order(p["token"], (("\n", fixed.NEW_LINE), (fixed.NEW_LINE * 2, fixed.NEW_LINE)))
        return F.when(p["tag"] == fixed.COMMENT, comment).when(one_of(p["tag"], *literal_tags), literal).otherwise(plain)

    told = F.transform(kept, lambda p: F.struct(text(p).alias("token"), p["tag"].alias("tag")))
    return F.filter(told, lambda p: p["token"] != "")


def text_tokens(
    pairs: Column, lang: str, keep_comments: bool = False, process_strings: bool = True
) -> Column:
    """The tokens of :func:`text_pairs`."""
    return F.transform(text_pairs(pairs, lang, keep_comments, process_strings), lambda p: p["token"])
