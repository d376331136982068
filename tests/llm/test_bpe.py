import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from lexmill.llm import bpe
from tests.llm.conftest import rows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "a", "It's  fine,\n\n ok? \t x ", "naïve été 中文 \U0001f600‍\U0001f600", "a" * 700, " " * 300 + "x", "ab" * 300, "\x1c x\x1c \x00y",
    "12345 67² ½ x_y-z", "don't we'll I'M", "the " * 2000, "=-" * 200, "  x   y",
]


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as file:
        ranks = bpe.read_ranks(file.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(reference, monkeypatch):
    with open(PATH, "rb") as file:
        codec = bpe.codec(file.read(), public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choices("abcdeth '\n.é1 ", k=rng.randint(1, 400))) for _ in range(150)]
    for limits in ((400_000, 400_000), (50, 20)):  # a worker that forgets all the time gives the same
        monkeypatch.setattr(bpe, "PIECES", limits[0])
        monkeypatch.setattr(bpe, "SEGMENTS", limits[1])
        ids = [list(memoryview(raw).cast("I")) for raw in codec.encode(texts)]
        assert ids == [reference.encode_ordinary(text) for text in texts]
    assert codec.decode(codec.encode(texts)) == [text.encode() for text in texts]


def test_unknown_id_fails():
    with open(PATH, "rb") as file:
        codec = bpe.codec(file.read(), public_tokenizers.PATTERN)
    with pytest.raises(ValueError):
        codec.decode([(60_000).to_bytes(4, "little")])


def test_tables(spark, docs, empty, reference):
    table = docs((1, "hello  world"), (None, None), (2, ""), (2, "the cat"))
    ids = bpe.encode_documents(table, PATH, public_tokenizers.PATTERN)
    expected = [(1, reference.encode_ordinary("hello  world")), (2, []), (2, reference.encode_ordinary("the cat")), (None, [])]
    assert rows(ids) == sorted(expected, key=repr)
    decoded = bpe.decode_documents(ids, PATH, public_tokenizers.PATTERN)
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in decoded.collect()) == [(0, b""), (1, b"hello  world"), (2, b""), (2, b"the cat")]
    digests = bpe.round_trip(table, PATH, public_tokenizers.PATTERN)
    assert (1, 3, hashlib.sha256(b"hello  world").hexdigest()) in rows(digests, "doc_id", "n_tokens", "decoded_sha256")
    assert rows(bpe.round_trip(empty, PATH, public_tokenizers.PATTERN)) == []


@pytest.mark.parametrize("unit", ["=", "a", "-", "ab", "==-", "the", "é"])
def test_long_runs(reference, unit):
    with open(PATH, "rb") as file:
        codec = bpe.codec(file.read(), public_tokenizers.PATTERN)
    (short,) = codec.encode([unit * 3000])
    assert list(memoryview(short).cast("I")) == reference.encode_ordinary(unit * 3000)
    text = unit * (400_000 // len(unit))
    began = time.perf_counter()
    ids = codec.encode([text])
    assert time.perf_counter() - began < 30
    assert codec.decode(ids) == [text.encode()]


def test_long_pieces_equal_the_library(reference):
    with open(PATH, "rb") as file:
        codec = bpe.codec(file.read(), public_tokenizers.PATTERN)
    rng = random.Random(6)
    for letters in ("ab", "aab", "etaoinshrdlu", "=-", "abcab", "xyzé", "andthe"):
        for _ in range(6):
            text = "".join(rng.choices(letters, k=rng.randint(129, 500)))
            text = text[:70] + rng.choice(letters) * rng.randint(1, 300) + text[70:]
            assert list(memoryview(codec.encode([text])[0]).cast("I")) == reference.encode_ordinary(text)
