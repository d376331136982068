import numpy as np
import xxhash

from lexmill.llm import simhash
from lexmill.llm.components import components
from tests.llm.conftest import rows


def plain_fingerprint(text, width=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[at : at + width]) for at in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(links, nodes):
    """Smallest node reachable, by plain search."""
    near = {n: {n} for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            m = todo.pop()
            if m not in root:
                root[m] = n
                todo += near[m]
    return root


def test_fingerprint():
    for text in ("", "One", "a B", "a b c", "The cat\tsat ON\nthe mat " * 40, "é É x y", "x " * 70_000):
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint("A b\x85c d") == simhash.fingerprint("a b\x85c d") != simhash.fingerprint("a b c d")


def test_bit_sliced_forest_against_all_pairs():
    random = np.random.default_rng(1)
    for radius in (0, 1, 2, 3, 5):
        base = random.integers(0, 2**63, 6, dtype=np.uint64)
        values = np.concatenate([b ^ (np.uint64(1) << random.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << random.integers(0, 64, 60, dtype=np.uint64)) for b in base])
        values = np.unique(values)
        half = len(values) // 3
        ends = np.where(np.arange(len(values)) < half, half, len(values))
        links = [(i, j) for i in range(len(values)) for j in range(i + 1, ends[i]) if (int(values[i]) ^ int(values[j])).bit_count() <= radius]
        expected = groups(links, range(len(values)))
        assert simhash.forest(values, ends, radius).tolist() == [expected[i] for i in range(len(values))]


def test_components(spark):
    random = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in random.integers(0, 400, (260, 2))] + [(900 + i, 901 + i) for i in range(40)] + [(1000, x) for x in range(1001, 1100)] + [(5, 5), (None, 7)]
    found = dict(rows(components(spark.createDataFrame(links, "a long, b long"))))
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == groups(real, {n for link in real for n in link})
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


def test_groups(spark, docs, empty, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:299]), " ".join(words[:150]), None, "", "one", "One ", " ".join(words)]
    table = docs(*enumerate(texts[:7], 10), (None, texts[7]), (10, texts[0]))
    fps = [plain_fingerprint(t or "") for t in texts[:7]]
    links = [(i, j) for i in range(7) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = groups(links, range(7))
    expected = [(10 + i, 10 + root[i]) for i in range(7)] + [(None, 10), (10, 10)]
    for tile in (4096, 1):
        monkeypatch.setattr(simhash, "TILE", tile)
        assert rows(simhash.near_duplicates(table), "doc_id", "component_id") == sorted(expected, key=repr)
    assert rows(simhash.near_duplicates(empty)) == []
    assert rows(simhash.near_duplicates(docs((None, "x"))), "component_id") == [(None,)]
