import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import lines
from tests.llm.conftest import rows
from tests.llm.test_simhash import groups

WORD = re.compile(r"[^\W_]+")


def fingerprint(words):
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def edits(a, b):
    row = list(range(len(b) + 1))
    for at, c in enumerate(a, 1):
        before, row = row, [at]
        for j, d in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
    return row[-1]


def brute(pairs, radius=lines.RADIUS, similarity=lines.SIMILARITY):
    places = {}
    for doc_id, text in pairs:
        if doc_id is not None:
            for at, line in enumerate((text or "").split("\n")):
                norm = " ".join(WORD.findall(line.lower()))
                if norm:
                    places.setdefault(norm, set()).add((doc_id, at))
    norms = sorted(places)
    fps = [fingerprint(n.split(" ")) for n in norms]
    links = []
    for i, a in enumerate(norms):
        for j, b in enumerate(norms[:i]):
            allowed = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
            if (fps[i] ^ fps[j]).bit_count() <= radius and edits(a, b) <= allowed:
                links.append((i, j))
    root = groups(links, range(len(norms)))
    kept = {}
    for i, norm in enumerate(norms):
        kept[root[i]] = min(kept.get(root[i], min(places[norm])), min(places[norm]))
    return sorted((*place, *kept[root[i]]) for i, norm in enumerate(norms) for place in places[norm] if place != kept[root[i]])


def test_against_all_pairs(spark, docs):
    rng = random.Random(8)
    words = [f"w{'abcdefgh'[i % 8]}{i}" for i in range(90)]
    base = [rng.choices(words, k=n) for n in (3, 12, 40, 60, 80)]
    pairs = []
    for doc_id in range(30):
        text = []
        for _ in range(6):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(words)
            if rng.random() < 0.2:
                rng.shuffle(line)  # same fingerprint, other text
            text.append(("# " if rng.random() < 0.3 else "") + " ".join(line).upper() + rng.choice(["", ".", " !"]))
        pairs.append((doc_id, "\n".join(text)))
    found = sorted(rows(lines.duplicate_lines(docs(*pairs))))
    assert found == brute(pairs) and len(found) > 40
    # A bucket of lines whose leader holds them together only before verification.
    same = ["a b c d e f g h", "h g f e d c b a", "h g f e d c a b", "a b c d e f h g", "h g f e d b c a"]
    pairs = [(i, line) for i, line in enumerate(same)]
    assert sorted(rows(lines.duplicate_lines(docs(*pairs)))) == brute(pairs)


def test_odd_rows(spark, docs, empty):
    pairs = [
        (2, "Hello, world!\n\n---\nhello world"), (1, "x\nHELLO  world"), (None, "hello world\nx"), (3, None), (4, ""),
        (5, "same\nother"), (5, "same\nthird"), (6, "third\n" + "long line " * 3000), (7, "long line " * 3000),
    ]
    repeats = lines.duplicate_lines(docs(*pairs))
    assert rows(repeats) == [(2, 0, 1, 1), (2, 3, 1, 1), (6, 0, 5, 1), (7, 0, 6, 1)]
    kept = rows(lines.drop_lines(docs(*pairs), repeats), "doc_id", "text")
    texts = {1: "x\nHELLO  world", 2: "\n---", 3: None, 4: "", 6: "long line " * 3000, 7: ""}
    assert [r for r in kept if r[0] in texts] == sorted(texts.items(), key=repr)
    assert (None, "hello world\nx") in kept and (5, "same\nother") in kept and len(kept) == len(pairs)
    assert lines.drop_lines(docs(*pairs), repeats).columns == docs(*pairs).columns
    assert rows(lines.duplicate_lines(empty)) == []


def test_packed_counts(spark):
    random_ = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in random_.integers(0, 50, n)) for n in (1, 2, 3, 127, 128, 255, 256, 400)] + ["a " * 40_000 + "b"]
    marked = spark.createDataFrame([(i, i, 0, t, i, i) for i, t in enumerate(texts)], "row long, doc_id long, line_no int, norm string, k1 long, k2 long")
    found = {r["doc_id"]: r["fp"] % 2**64 for r in lines.with_simhash(marked).collect()}
    assert found == {i: fingerprint(t.split(" ")) for i, t in enumerate(texts)}


def test_lines_are_cut_once(spark, docs):
    counted = lines.with_simhash(lines._marked(docs((1, "a b\n--\nc")), "doc_id", "text"))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("split(norm") == 1
    assert [(r["line_no"], r["fp"] % 2**64) for r in counted.orderBy("line_no").collect()] == [
        (0, fingerprint(["a", "b"])), (2, fingerprint(["c"]))
    ]


def test_words_are_counted_in_runs(spark, docs):
    texts = [" ".join(f"v{x}" for x in range(n)) for n in (1, 6, 7, 8, 14, 15)] + ["", "--"]
    counted = lines.with_simhash(lines._marked(docs(*enumerate(texts)), "doc_id", "text"))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    # No row per word: a line is opened at every seventh word.
    assert "explode(sequence(0" in plan and "explode(CASE" not in plan
    found = {r["doc_id"]: r["fp"] % 2**64 for r in counted.collect()}
    assert found == {i: fingerprint(t.split(" ")) for i, t in enumerate(texts[:6])}


def test_normalised_leaves_single_blanks(apply):
    marks = [" ", "  ", ", ", " -", "-", "\t", "\u00a0", " \U0001f600", "\U0001f600", "\U0001f600 ", "\u0307", " \t ", "_"]
    rng = random.Random(2)
    texts = ["", " ", "-", "A b", " \u0130x", "\U0001d400 \u00e4\u0662"] + ["".join(rng.choice(["Ab", "\u00e9", "7"]) + rng.choice(marks) for _ in range(8)) for _ in range(100)]
    told = apply(lines.normalised, *texts)
    assert told == apply(lambda line: F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")), *texts)
    # Blanks that stand alone are no match.
    assert apply(lambda c: F.regexp_count(c, F.lit(lines.SEPARATOR)), "a b c, d  e-f") == [3]


def test_edits_in_the_narrowest_band(spark):
    rng = random.Random(6)
    pairs = []
    for n in (9, 10, 60, 99, 100, 150):
        a = "".join(rng.choices("abcde", k=n))
        for many in range(n // 5 - 2, n // 5 + 3):
            b = list(a)
            for at in rng.sample(range(n), max(many, 0)):
                b[at] = "z"
            pairs.append((a, "".join(b)))
    table = spark.createDataFrame(pairs, "a string, b string").withColumn("alike", lines._alike(F.col("a"), F.col("b"), 0.8))
    found = table.collect()
    assert all(r["alike"] == (edits(r["a"], r["b"]) <= int(len(r["a"]) * 0.2 + 1e-9)) for r in found)
    assert {r["alike"] for r in found} == {True, False}
    assert "levenshtein(" in (plan := table._jdf.queryExecution().optimizedPlan().toString()) and ", Some(16)" not in plan


def test_word_edits_are_a_bound(spark):
    rng = random.Random(5)
    words = ["a", "be", "sea", "deer", "eagle", "falcon"]
    pairs = [("a", "be"), ("a be", "be"), ("a", "a"), ("a b c d", "a x y z b c d"), ("a x y z b c d", "a b c d")]
    for _ in range(200):
        line = rng.choices(words, k=rng.randint(1, 12))
        other = [w for w in line if rng.random() < 0.8] or ["a"]
        other.insert(rng.randrange(len(other) + 1), rng.choice(words))
        pairs.append((" ".join(line), " ".join(other)))
    table = spark.createDataFrame(pairs, "a string, b string")
    told = lines._word_edits(F.split("a", " "), F.split("b", " "))
    found = [(r["a"], r["b"], r["told"]) for r in table.withColumn("told", told).collect()]
    assert all(n >= edits(a, b) for a, b, n in found)
    # Words that come or go in several places fill no table.
    assert sum(n == edits(a, b) for a, b, n in found) > 100
    assert [n for a, b, n in found[:5]] == [edits(a, b) for a, b, n in found[:5]]


def test_no_python_in_the_plan(spark, docs):
    plan = lines.duplicate_lines(docs((1, "a\nb"), (2, "a")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
