import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import infill
from tests.llm.conftest import rows

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
LONG = "word, né 中\n" * 20_000


def plain_output(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def batch(texts):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    return np.frombuffer(b"".join(raw), dtype=np.uint8), bounds


def split(data, bounds):
    return [data[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])]


def test_every_document_against_the_plain_rule(spark, docs):
    rng = random.Random(5)
    table = [(i, "".join(rng.choices("abC <>PSM.é中\n\x00\U0001f600", k=rng.randint(0, 60)))) for i in range(300)]
    table += [(None, "null id"), (400, None), (401, ""), (402, "a <S> b"), (403, LONG), (7, "again"), (7, "again"), (404, ">x<P"), (405, "<")]
    made = infill.transform(docs(*table))
    found = rows(made, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert found == sorted(((i, *plain_output(i, t)) for i, t in table), key=repr)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    back = infill.restore(made.withColumn("restored", made.n))
    assert back.columns == [*made.columns, "restored"]
    assert rows(back, "doc_id", "restored") == sorted(((i, t or "") for i, t in table), key=repr)


def test_empty_table(empty):
    assert rows(infill.restore(infill.transform(empty))) == []


@given(
    st.lists(st.text(alphabet="aZ<>PSM é中\U0001f600", max_size=30), max_size=8),
    st.integers(0, 2**32), st.sampled_from([1, 2, 3, 7, 1 << 20]),
)
@settings(max_examples=150, deadline=None)
def test_tiles_of_any_size(texts, seed, tile):
    chosen = np.random.default_rng(seed).integers(0, 1 << 32, (len(texts), 4))
    data, bounds = batch(texts)
    whole = infill.scatter(data, bounds, chosen)
    before, infill.TILE = infill.TILE, tile
    try:
        tiled = infill.scatter(data, bounds, chosen)
        back = infill.gather(tiled["out"], tiled["bounds"], tiled["form"])
    finally:
        infill.TILE = before
    assert all((whole[k] == tiled[k]).all() for k in whole)
    assert split(*back) == texts


def test_damaged_output_fails():
    for output in ("no marks", "<P>a<M>b<S>c", "x<P>a<S>b<M>c", "<P>a<S>b"):
        with pytest.raises(ValueError):
            infill.gather(*batch([output]), np.array([1]))
