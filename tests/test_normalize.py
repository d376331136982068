import pytest

from lexmill.functions.normalize import (
    normalize,
    remove_carriage_returns,
    remove_comments,
    remove_empty_lines,
    remove_trailing_space,
)


def test_comments_become_one_space(apply):
    cases = {
        "a = b; // c\nd": "a = b;  \nd",
        "x/*1\n2*/y": "x y",
        'u="http://h/*k*/"; /*z*/': 'u="http://h/*k*/";  ',
        r"c='\''; //q": r"c='\'';  ",
        "a / b /* open": "a / b /* open",
        '"unterminated // x': '"unterminated  ',
        "": "",
    }
    assert apply(remove_comments, *cases) == list(cases.values())


def test_trailing_space(apply):
    cases = {
        "a  \n\n  b": "a\n  b",
        "\n\na": "\na",
        "a\n": "a",
        "a \r\nb": "a\nb",
        "a   b": "a   b",
        "a\u2003\n b\x1c": "a\n b",
    }
    assert apply(remove_trailing_space, *cases) == list(cases.values())


def test_empty_lines(apply):
    assert apply(remove_empty_lines, "\n\na\n\nb", "a\n") == ["a\nb", "a\n"]


def test_carriage_returns(apply):
    assert apply(remove_carriage_returns, "a\r\nb\r") == ["a\nb"]


def test_cleaning_twice_changes_nothing(apply):
    once = apply(normalize, "int a; // x\n\n\n  /* y */ b  \n")
    assert apply(normalize, *once) == once


@pytest.mark.parametrize("size", [5_000, 2_000_000])
def test_long_literals_do_not_overflow(apply, size):
    text = 'x = "' + "a" * size + '"; // c'
    assert apply(remove_comments, text) == [text[:-4] + " "]
    escapes = "y = '" + "\\n" * 50_000 + "';/*k*/"
    assert apply(remove_comments, escapes) == [escapes[:-5] + " "]


def test_long_blank_run_is_linear(apply):
    text = "a" + " " * 300_000 + "b"
    assert apply(remove_trailing_space, text) == [text]
