import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import topk
from tests.llm.conftest import rows

SCHEMA = "vec_id long, embedding array<float>, score string, part int"


def vectors(spark, *pairs):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in pairs], SCHEMA)


def brute(pairs, k, scale=64):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in pairs if v and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in dict(kept[::-1]).items():
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "ROW_BLOCK", 7)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    random = np.random.default_rng(5)
    pairs = [(i, random.integers(-3, 4, 4).astype(float).tolist()) for i in range(90)]  # many ties
    pairs += [(100, None), (120, [1.0, None, 0.0, 0.0]), (140, [float("nan")] * 4), (160, []), (180, [1.0, 2.0]), (181, [2.0, 2.0])]
    pairs += [(7, pairs[7][1]), (None, [1.0] * 4), (200, [float("inf")] * 4)]
    found = topk.top_k(vectors(spark, *pairs), F.col("vec_id") % 20 == 0, k=5)
    assert rows(found) == brute(pairs, 5)


def test_fewer_rows_than_k_and_empty(spark):
    pairs = [(0, [0.5, 0.25]), (1, [0.5, -0.25])]
    assert rows(topk.top_k(vectors(spark, *pairs), F.col("vec_id") % 20 == 0)) == [(0, 1, 1, 32 * 32 - 16 * 16)]
    assert rows(topk.top_k(vectors(spark), F.col("vec_id") % 20 == 0)) == []


def test_scores_beyond_doubles():
    big = np.array([[2.0**40, 1.0]])
    assert topk._scores(big, np.array([[2.0**20, 3.0]])).tolist() == [[2**60 + 3]]
    assert topk._scores(big * 2.0**30, big).tolist() == [[2**63 - 1]]
