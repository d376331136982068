import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from lexmill.llm import manifest
from tests.llm.conftest import rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree string, idx int, root string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return H(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes):
    """Root of a run of nodes, and for each node its list of (others before, others after)."""
    paths, at, own = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(own) > 1:
        runs = [own[k : k + 16] for k in range(0, len(own), 16)]
        for path, k in zip(paths, at):
            run, place = runs[k // 16], k % 16
            path.append(("".join(run[:place]), "".join(run[place + 1 :])))
        at, own = [k // 16 for k in at], [H(*run) for run in runs]
    return own[0], paths


def brute(table):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in table:
        touched = text
        if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            touched = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups[source].append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, touched)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        group = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append((group, *climb([r[1] for r in group])))
    root, tops = climb([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (group, subroot, paths), top in zip(trees, tops):
        for (doc_id, own, shown), path in zip(group, paths):
            proof, node = "", shown
            for before, after in path + top:
                proof, node = proof + before + after, H(before, node, after)
            out.append((doc_id, own, subroot, root, H(proof), node, node == root))
    return sorted(out, key=repr)


def table_of(spark, given, folder, height=3):
    df = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in given], SCHEMA)
    df.repartition(5).write.parquet(str(folder / "documents.parquet"))
    return manifest.op13_merkle(spark, str(folder), height)


def corpus(sizes, seed=1):
    rng = random.Random(seed)
    given = []
    for source, size in sizes.items():
        given += [(len(given) * 3 + k, rng.choice(["Text", "lower é", "", None, "MIXED Case\n"]), rng.choice(["en", None]), source, rng.choice([None, k])) for k in range(size)]
    return given


@pytest.mark.parametrize("height", [1, 3])
def test_against_brute_force(spark, tmp_path, height):  # 1: blocks of 16, so that blocks of blocks arise
    given = corpus({None: 5, "": 1, "hot": 700, "b": 16, "é": 17, "z": 256, "one": 1, **{f"s{k}": 2 for k in range(20)}})
    given += [(None, "Null id", "en", "b", 1), (None, "other", "en", "b", 1), (9, "Copy", "en", "b", 2), (9, "Copy", "en", "b", 2), (9, "Twin", "en", "b", 2)]
    given.append((8, "Very Long " * 100_000, None, "z", None))
    found = table_of(spark, given, tmp_path, height)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows(found) == brute(given)


@pytest.mark.parametrize("given", [[], [(5, "A", "en", "s", 1)], [(5, "a", "en", None, 1)] * 40])
def test_smallest_tables(spark, tmp_path, given):
    assert rows(table_of(spark, given, tmp_path)) == brute(given)


def test_witness_of_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = manifest.Manifest(docs)
    root = made.root.first()["root"]
    for row in made.witnesses().collect():
        node = row["digest"]
        for others, place in zip(row["siblings"], row["positions"], strict=True):
            node = H(others[: 64 * place], node, others[64 * place :])
        assert node == root == row["root"]


def test_sql_twin_on_hard_rows(spark, tmp_path):
    given = corpus({None: 3, "hot": 300, "one": 1, **{f"s{k}": 2 for k in range(20)}}) + [(None, "Null id", "en", "hot", 1)]
    found = table_of(spark, given, tmp_path)
    database = duckdb.connect()
    database.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(database.execute(manifest.OP13_SQL).fetchall(), key=repr) == rows(found) == brute(given)
