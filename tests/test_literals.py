from lexmill.functions import fixed
from lexmill.functions.literals import (
    cap_runs,
    collapse_spaces,
    detokenize_string,
    mark_comment_end,
    mark_specials,
    process_comment,
    process_literal,
    rejoin_prefix,
    show_white_space,
    split_words_international,
    tokenize_string,
)

C = fixed.C_SPECIALS


def test_white_space_marks(apply):
    assert apply(show_white_space, "a b\nc\td") == ["a ▁ b STRNEWLINE c TABSYMBOL d"]


def test_specials_apply_in_order(apply):
    assert apply(lambda c: mark_specials(c, C), "/**a**/", "a//b;") == [
        " STOKEN01 *a* STOKEN02 ", "a STOKEN00 b STOKEN08 ",
    ]


def test_spaces_and_runs(apply):
    assert apply(collapse_spaces, "a   b\t\t") == ["a b\t\t"]
    assert apply(cap_runs, "====== aaaa bbbbbbb \n\n\n\n\n\n") == ["===== aaaa bbbbb \n\n\n\n\n\n"]


def test_comment_end(apply):
    assert apply(
        mark_comment_end, " STOKEN00 a STRNEWLINE b STRNEWLINE c", " STOKEN00 a", "x STOKEN00"
    ) == [" STOKEN00 a ENDCOMb STRNEWLINE c", " STOKEN00 a ENDCOM", "x STOKEN00"]


def test_word_split(apply):
    assert apply(split_words_international, "a,b 1,5 c. $x", "it's (ok)!", "a\\b") == [
        "a  ,  b 1,5 c  .    $ x", "it  '  s   (  ok  )  !", "a\\b",
    ]


def test_prefix(apply):
    assert apply(rejoin_prefix, 'L " aL b"', '" L x"', "") == ['L" aLb"', '" L x"', ""]


def test_whole_literal(apply):
    assert apply(lambda c: process_literal(c, C), 'L"a b\\n{x};// c"', '"x=$1,000.5!"', "") == [
        'L" a ▁ b \\n { x } ; // ▁ c "', '" x = $ 1,000.5 ! "', "",
    ]


def test_light_literal(apply):
    assert apply(lambda c: process_literal(c, C, False), '"a\nb\r"') == ['"a\\nb"']


def test_comments(apply):
    cases = ["// hi  there", "/* aaaaaaaaa\n b\t1,5 */", "//-", "/* ; */"]
    assert apply(lambda c: process_comment(c, C), *cases) == [
        "// ▁ hi ▁ there ENDCOM", "/* ▁ aaaaa STRNEWLINE ▁ b TABSYMBOL 1,5 ▁ */", "", "",
    ]
    assert apply(lambda c: process_comment(c, C, False), *cases) == [
        "// hi there ENDCOM", "/* aaaaa\\n b\t1,5 */", "", "",
    ]


def test_strings_round_trip(apply):
    assert apply(tokenize_string, '"a b.c"') == [['"', "a", "▁", "b", ".", "c", '"']]
    # A text that starts with a letter loses the gap after each such letter.
    assert apply(tokenize_string, "a b.a c") == [["a▁", "b", ".", "a▁", "c"]]
    texts = ["hello, world 1.5!", "x", ""]
    assert apply(lambda c: detokenize_string(tokenize_string(c)), *texts) == texts
