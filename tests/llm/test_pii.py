import random
import re

import pytest

from lexmill.llm import pii
from tests.llm.conftest import rows

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """The plain patterns, which may take quadratic time."""
    digits = lambda t: re.sub("[^0-9]", "", t)

    def luhn(d):
        total = 0
        for at, c in enumerate(reversed(d)):
            n = int(c) * (1 + at % 2)
            total += n - 9 if n > 9 else n
        return total % 10 == 0

    good = {
        "email": lambda t: True,
        "ip": lambda t: all(int(p) <= 255 for p in t.split(".")),
        "card": lambda t: 13 <= len(digits(t)) <= 19 and luhn(digits(t)),
        "phone": lambda t: 9 <= len(digits(t)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if good[k](m[0])] for k, p in PLAIN.items()}


def test_base_equals_plain_patterns():
    rng = random.Random(11)
    alphabet = ["a", "Z", "@", ".", "-", "+", "_", "0", "1", "9", "25", "255", "256", " ", "(", ")", "é", "\n", "4111111111111111", "a@b.c", "1.2.3.4", "+49 30 1234567"]
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert pii.detect(text) == brute(text), text


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("mail john.doe at example dot com now", "email", "john.doe at example dot com"),
        ("x [at] y [dot] org!", "email", "x [at] y [dot] org"),
        ("x(at)y.de", "email", "x(at)y.de"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("foo​@bar.com", "email", "foo​@bar.com"),
        ("to １９２.１.２.３ ok", "ip", "１９２.１.２.３"),
        ("one nine two dot one dot two dot three", "ip", "one nine two dot one dot two dot three"),
        ("call plus four nine three zero one two three four five six seven", "phone", "plus four nine three zero one two three four five six seven"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("10 dot 0 dot 0 dot 1", "ip", "10 dot 0 dot 0 dot 1"),
    ],
)
def test_disguises(text, kind, part):
    base, full = pii.all_spans(text)
    assert base[kind] == [] or part not in [text[a:b] for a, b in base[kind]]
    assert [text[a:b] for a, b in full[kind]] == [part]


def test_base_spans_stay_and_ordinary_text_is_left_alone():
    text = "a@b.com and c at d dot org, see us at example.com. We are one of two at three. Look at the dot."
    base, full = pii.all_spans(text)
    assert set(base["email"]) < set(full["email"]) and len(full["email"]) == 2
    assert not any(full[k] for k in ("ip", "card", "phone"))


@pytest.mark.parametrize("unit", ["a", "1", "1.", "@", "+1", "one ", "at ", "a@", " dot ", "1 ", "a at b.c ", "a dot ", "а"])
def test_long_texts_take_linear_time(unit):
    pii.all_spans(unit * (200_000 // len(unit)))


def test_table(spark, docs, empty):
    found = pii.find_pii(docs((1, None), (None, "x a@b.c"), (2, ""), (2, ""), (3, "é a@b.c")))
    assert rows(found, "doc_id", "base_spans") == [(1, ""), (2, ""), (2, ""), (3, "email:2:7"), (None, "email:2:7")]
    assert rows(pii.find_pii(empty)) == []


@pytest.mark.parametrize("dot", ["(dot)", "[dot]", "{ punkt }", ".", " . ", "<.>", " dot "])
def test_gate_lets_spelled_addresses_pass(dot):
    text = f"at one nine two{dot}one six eight{dot}one{dot}one ok"
    _, full = pii.all_spans(text)
    assert [text[a:b] for a, b in full["ip"]] == [text[3:-3]]


def test_gate_loses_nothing(monkeypatch):
    rng = random.Random(12)
    parts = ["one", "Two", "drei", "f\u00fcnf", "S\u0130X", "\u017fix", "7", "12", "dot", "(dot)", "[ punkt ]", ".", " . ", "<.>", "at", "(at)", "@", "plus", "x", "mail", "-", ",", "\u201c", "(", ")"]
    texts = ["".join(p + rng.choice(["", " ", " "]) for p in rng.choices(parts[:14] if n % 2 else parts, k=rng.randint(4, 24))) for n in range(6000)]
    gated = [pii.disguised(t) for t in texts]
    monkeypatch.setattr(pii, "hints", lambda text: (True, True, True))
    for text, found in zip(texts, gated):
        free = pii.disguised(text)
        assert {k: v for k, v in found.items() if v} == {k: v for k, v in free.items() if v} or all(
            set(free[k]) - set(found.get(k, ())) <= set(pii.detect(text)[k]) for k in free
        ), text
    assert sum(any(f.get(k) for k in ("ip", "phone")) for f in gated) > 20


@pytest.mark.parametrize(
    "text, kind, plain",
    [
        ("\u0430lice@example.com", "email", "lice@example.com"),
        ("john (dot) doe@example.com", "email", "doe@example.com"),
        ("x@mail.example (dot) com", "email", "x@mail.example"),
        ("\uff119.168.1.20", "ip", "9.168.1.20"),
        ("a@b.c", "email", "a@b.c"),
    ],
)
def test_disguise_in_one_half(text, kind, plain):
    base, full = pii.all_spans(f"to {text}, a@b.org")
    start = 3 + text.index(plain)
    assert (start, start + len(plain)) in base[kind] and set(base[kind]) <= set(full[kind])
    assert full[kind] == sorted({*base[kind], (3, 3 + len(text))})


PLACES = ("home", "noon", "the office", "school", "lunch", "support", "ten", "this", "work", "night")
SENTENCES = [f"{who} at {place} . {then}" for place in PLACES for who, then in (
    ("Meet me", "Then we go ."), ("He sat", "She left ."), ("You can reach us", "Please call ."), ("Look", "It works ."), ("I am", "a dot . and so on"),
    ("We ate", "I . e . nothing"),
)] + [
    "Il est arrivé at Paris . Il est parti .", "at . at . at", "a . b at c . d", "The price @ noon . Then it fell .", "me @ home . You ?", "dot at dot . at",
    "f(a) b.c", "see (a) and (b) . c", "item (a)", "point . dot . at five", "two at three . four at five", "arroba . punto",
]


def test_ordinary_sentences_hold_nothing():
    assert len(SENTENCES) >= 50
    for text in SENTENCES:
        base, full = pii.all_spans(text)
        assert not any(full.values()), (text, full)


def test_at_sign_as_letter_and_spaced_letters():
    for text, found in (("write alice(a)example.com now", "alice(a)example.com"), ("bob (at) a . b (dot) com", "bob (at) a . b (dot) com")):
        _, full = pii.all_spans(text)
        assert [text[a:b] for a, b in full["email"]] == [found]
