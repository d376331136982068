import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from lexmill.llm import pieces
from tests.llm.conftest import rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "   ", "a", "Hello  world", " leading", "trailing  ", "\n\n\t x\r\n", "naïve été 中文 \U0001f600‍\U0001f600 ͸", "a▁b ▁", "▁",
    "a" * 700, " " * 300 + "x", "=-" * 200, "<s> </s> <unk> <0x41>", "\x00 nul \x00", "12345 67² ½ x_y-z", "�﻿", "the " * 3000,
    "ＡＢＣ　ｶﾞ ﬁ Å é ​­ x", "​", " 　 ", "x ​ ​ y",
]


def content(**rule):
    """The model's bytes, with another normaliser or trainer setting."""
    with open(PATH, "rb") as file:
        model = proto.ModelProto.FromString(file.read())
    for name, value in rule.items():
        part = model.trainer_spec if name == "byte_fallback" else model.normalizer_spec
        setattr(part, name, value)
    if rule.get("byte_fallback") is False:
        for piece in model.pieces:
            if piece.type == pieces.BYTE:
                piece.type = pieces.CONTROL
    return model.SerializeToString()


def charsmap(name):
    return proto.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto()).normalizer_spec.precompiled_charsmap


MODELS = {
    "as given": {},
    "no prefix": {"add_dummy_prefix": False},
    "stripped": {"remove_extra_whitespaces": True},
    "stripped, no prefix": {"remove_extra_whitespaces": True, "add_dummy_prefix": False},
    "nmt_nfkc": {"precompiled_charsmap": "nmt_nfkc", "remove_extra_whitespaces": True},
    "nfkc_cf": {"precompiled_charsmap": "nfkc_cf"},
    "no bytes": {"byte_fallback": False},
    "not escaped": {"escape_whitespaces": False},
}


@pytest.mark.parametrize("name", list(MODELS))
def test_equals_the_library(name):
    rule = dict(MODELS[name])
    if "precompiled_charsmap" in rule:
        rule["precompiled_charsmap"] = charsmap(rule["precompiled_charsmap"])
    raw = content(**rule)
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    own = pieces.Codec(pieces.read_model(raw))
    rng = random.Random(4)
    alphabet = "abcdet the  \n.é1中▁​Ａﬁ½é　\U0001f600"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(300)]
    for text, (ids, begins, ends) in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text
        found = _pieces(library.encode(text, out_type="serialized_proto"))
        assert (ids.tolist()[1:-1], begins.tolist()[1:-1], ends.tolist()[1:-1]) == found, text
        assert (begins[0], ends[0], begins[-1], ends[-1]) == (0, 0, len(text.encode()), len(text.encode()))
        assert own.decode([ids]) == [library.decode(ids.tolist())], text


def _pieces(raw):
    """(ids, begins, ends) of a serialised result: field 2 holds pieces with id (2), begin (4) and end (5)."""

    def fields(data):
        at = 0
        while at < len(data):
            key, at = _varint(data, at)
            value, at = _varint(data, at)
            if key & 7 == 2:
                value, at = data[at : at + value], at + value
            yield key >> 3, value

    found = [dict(fields(value)) for field, value in fields(raw) if field == 2]
    return tuple([piece.get(k, 0) for piece in found] for k in (2, 4, 5))


def _varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def test_both_ways_of_merging():
    with open(PATH, "rb") as file:
        own = pieces.codec(pieces.read_model(file.read()))
    rng = random.Random(2)
    for count in (1, 2, 3000):
        words = ["▁" * rng.randint(0, 5) + "".join(rng.choices("aaabcdethinors=-1é", k=rng.randint(1, 70))) for _ in range(count)]
        ids, sizes, bounds = own.contract(words)
        assert [[own.spec.pieces[i] for i in ids[a:b]] for a, b in zip(bounds, bounds[1:])] == [own.merge(word) for word in words]
        assert [int(sizes[a:b].sum()) for a, b in zip(bounds, bounds[1:])] == list(map(len, words))


def test_decodes_any_ids():
    with open(PATH, "rb") as file:
        raw = file.read()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Codec(pieces.read_model(raw))
    rng = random.Random(8)
    for _ in range(400):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 9))]
        assert own.decode([np.array(ids, dtype=np.int64)]) == [library.decode(ids)], ids
    for wrong in (-1, 32000):
        with pytest.raises(ValueError):
            own.decode([np.array([wrong])])


def test_forgetting_changes_nothing(monkeypatch):
    with open(PATH, "rb") as file:
        spec = pieces.read_model(file.read())
    expected = [pieces.Codec(spec).encode([t])[0][0].tolist() for t in TEXTS]
    assert [made[0].tolist() for made in pieces.Codec(spec).encode(TEXTS)] == expected
    monkeypatch.setattr(pieces, "CHUNKS", 2)
    monkeypatch.setattr(pieces, "RUN_CHARS", 10)
    assert [made[0].tolist() for made in pieces.Codec(spec).encode(TEXTS)] == expected


@pytest.mark.parametrize("unit", ["a", "=", "ab", "é", " "])
def test_long_runs(unit):
    with open(PATH, "rb") as file:
        own = pieces.codec(pieces.read_model(file.read()))
    text = unit * (200_000 // len(unit))
    began = time.perf_counter()
    ((ids, begins, ends),) = own.encode([text])
    assert time.perf_counter() - began < 20
    assert int((ends - begins).sum()) == len(text.encode())
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text, add_bos=True, add_eos=True)


def test_other_models_fail():
    for change in (lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.pieces[500], "type", 4)):
        model = proto.ModelProto.FromString(content())
        change(model)
        with pytest.raises(ValueError):
            pieces.read_model(model.SerializeToString())


def test_tables(spark, docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    table = [(k, t) for k, t in enumerate(TEXTS)] + [(None, None), (3, "again"), (3, "again"), (90, "very long " * 50_000)]
    encoded = pieces.encode_documents(docs(*table), PATH)
    ids = {(i, t): library.encode(t or "", add_bos=True, add_eos=True) for i, t in table}
    assert rows(encoded, "doc_id", "token_ids") == sorted(((i, ids[i, t]) for i, t in table), key=repr)
    assert rows(pieces.decode_documents(encoded, PATH)) == sorted(((i, library.decode(ids[i, t])) for i, t in table), key=repr)
    found = rows(pieces.round_trip(docs(*table), PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    expected = [
        (i, len(ids[i, t]), hashlib.sha256(np.array(ids[i, t], dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids[i, t]).encode()).hexdigest())
        for i, t in table
    ]
    assert found == sorted(expected, key=repr)
    assert rows(pieces.round_trip(empty, PATH)) == rows(pieces.encode_documents(empty, PATH)) == []


def test_spans_of_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for row in docs.join(pieces.encode_documents(docs, PATH), "doc_id").collect():
        raw = (row["text"] or "").encode()
        assert b"".join(raw[b:e] for b, e in zip(row["begins"], row["ends"])) == raw
