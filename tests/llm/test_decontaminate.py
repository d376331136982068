import random

from lexmill.llm import decontaminate as d
from tests.llm.conftest import rows


def fewest_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for at, byte in enumerate(pattern, 1):
        before, row = row, [at] + [0] * len(text)
        for j in range(1, len(text) + 1):
            row[j] = min(before[j - 1] + (byte != text[j - 1]), before[j] + 1, row[j - 1] + 1)
    return min(row)


def brute(index, texts):
    out = {}
    for at, text in enumerate(texts):
        for pattern, item, budget in zip(index.patterns, index.items, index.edits):
            edits = fewest_edits(pattern.tobytes(), text)
            if edits <= budget:
                out[at, item] = min(edits, out.get((at, item), edits))
    return {(a, i, e) for (a, i), e in out.items()}


def test_against_all_alignments():
    rng = random.Random(4)
    syllables = "the an ion er re st nd ou ha en ti ed on".split()
    sentence = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))
    items = [(i, sentence(n).encode()) for i, n in enumerate((2, 3, 6, 12, 25, 60, 25))]
    items.append((7, items[4][1]))
    index = d.Index(items, d.EDIT_RATE)
    found = 0
    for _ in range(25):
        texts = [b"", b"x"]
        for _ in range(6):
            copy = bytearray(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(copy) // 9))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = b"" if rng.random() < 0.4 else bytes([rng.randrange(97, 123)])
            texts.append(sentence(rng.randint(0, 12)).encode() + bytes(copy) + sentence(rng.randint(0, 12)).encode())
        expected = brute(index, texts)
        found += len(expected)
        assert set(index.search(texts)) == expected
    assert found > 50


def test_table(spark, docs, empty, monkeypatch):
    passage = "Much of what the old benchmark asks is about rivers, hills and towns of the north."
    benchmark = spark.createDataFrame([(1, passage, "k"), (2, None, "k"), (3, " ", "k"), (4, "tiny", "k"), (None, passage, "k"), (5, passage.upper(), "k")], "item_id long, text string, key string")
    table = docs(
        (1, "Before.\n" + passage.replace(" ", "\n  ") + " after"), (2, passage[:40] + passage[42:]), (3, "nothing here"), (4, None), (5, ""), (6, "a tiny text"),
        (None, passage), (7, "filler words " * 20_000 + passage), (8, passage), (8, passage[:10] + "x" + passage[10:]),
    )
    expected = [(8, i, 0) for i in (1, 5)] + [(n, i, e) for n, e in ((1, 0), (2, 2), (7, 0), (None, 0)) for i in (1, 5)] + [(6, 4, 0)]
    assert rows(d.find_passages(table, benchmark)) == sorted(expected, key=repr)
    monkeypatch.setattr(d, "PART_BYTES", 60)  # several passes give the same
    assert rows(d.find_passages(table, benchmark)) == sorted(expected, key=repr)
    assert rows(d.find_passages(empty, benchmark)) == [] == rows(d.find_passages(table, benchmark.limit(0)))
