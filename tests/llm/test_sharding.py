import zlib
from collections import Counter


from lexmill.llm import sharding
from tests.llm.conftest import rows


def check(found, texts, leaves):
    by_shard = Counter()
    slots = {}
    for doc_id, size, crc, shard, slot in found:
        by_shard[shard] += size
        slots.setdefault(shard, []).append(slot)
    assert sorted((f[1], f[2]) for f in found) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(by_shard) <= set(range(leaves))
    return by_shard


def test_near_equal_bytes_and_groups(spark, docs):
    texts = [("word é " * (i % 37 + 1)) + "x" * (i * i % 11) + "\n" * (i % 5) for i in range(600)] + [None, ""]
    table = docs(*enumerate(texts))
    for leaves in (1, 3, 8):
        found = rows(sharding.shard_documents(table, leaves=leaves), "doc_id", "size", "text_crc32", "shard", "slot")
        sizes = check(found, texts, leaves)
        mean = sum(sizes.values()) / leaves
        assert len(sizes) == leaves and all(abs(s - mean) < 0.1 * mean + 300 for s in sizes.values())
    homes = {}
    for doc_id, *_, shard, _ in found:
        homes.setdefault(texts[doc_id], set()).add(shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 7


def test_hot_group_is_cut(spark, docs):
    texts = ["same text"] * 700 + [f"other {i}" for i in range(300)]
    sizes = check(rows(sharding.shard_documents(docs(*enumerate(texts)), leaves=8), "doc_id", "size", "text_crc32", "shard", "slot"), texts, 8)
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_leaf_bytes_and_odd_rows(spark, docs, empty):
    texts = ["abc"] * 40
    found = sharding.shard_documents(docs(*((None if i % 4 == 0 else i, t) for i, t in enumerate(texts))), leaf_bytes=50)
    assert set(check(rows(found, "doc_id", "size", "text_crc32", "shard", "slot"), texts, 4)) == {0, 1, 2, 3}
    assert rows(sharding.shard_documents(empty, leaves=8)) == []
    repeats = sharding.shard_documents(docs(*[(1, "a")] * 5, (-(1 << 62), "b"), ((1 << 62), "c")), leaves=2)
    check(rows(repeats, "doc_id", "size", "text_crc32", "shard", "slot"), ["a"] * 5 + ["b", "c"], 2)
