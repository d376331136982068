"""Registered corpus queries: SQL twins on the smallest tables, and the pipeline against its stages' rules."""

from pathlib import Path

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from lexmill.llm import decontaminate, lines, queries, simhash, toxicity
from tests.llm.conftest import rows
from tests.test_oracle import bag, database  # noqa: F401

SF_DIR = Path("/root/testdata/sf0.001")


def test_registered():
    names = registered.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, len(queries.QUERIES) + 1))
    assert set(queries.SQL) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql_twin(spark, database, name):  # noqa: F811
    ours = bag(queries.QUERIES[name](spark, str(SF_DIR)).toPandas())
    assert ours == bag(database.execute(queries.SQL[name]).df())


def test_stages(spark, docs, empty):
    passage = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where("item_id = 1").first()["text"]
    line = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    table = docs((1, line), (2, line + "\n" + other), (3, "before " + passage), (4, None), (5, "clean text of its own"), (6, ""), (None, other))
    table = table.select("doc_id", "text", "lang", "source", "n_chars")
    kept = table
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(SF_DIR))
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        seen[name] = kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert all(seen[n].columns == table.columns for n, _ in corpus_pipeline.STAGES[:-1])
    deduped = dict(rows(seen["line_dedup"], "doc_id", "text"))
    assert deduped[1] == line and deduped[2] == other and deduped[None] == other and deduped[4] is None
    assert {r[0] for r in rows(seen["near_dedup"], "doc_id")} == {1, 2, 3, 4, 5, None}  # 6 is a copy of 4: empty
    assert {r[0] for r in rows(seen["decontamination"], "doc_id")} == {1, 2, 4, 5, None}
    assert {r[0] for r in rows(seen["bpe"], "doc_id")} == {1, 2, 4, 5, None}
    left = empty.select(*table.columns)
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(SF_DIR))
        assert rows(left) == []


def test_pipeline_equals_its_operators(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")))
    kept = {r["doc_id"]: r["text"] for r in scored.where(f"_score < {toxicity.REJECT}").collect()}
    gone = {(r["doc_id"], r["line_no"]) for r in lines.duplicate_lines(docs.where(docs.doc_id.isin(list(kept)))).collect()}
    kept = {i: "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone) for i, t in kept.items()}
    fps = {i: simhash.fingerprint(t) for i, t in kept.items()}
    ids = sorted(kept)
    from tests.llm.test_simhash import groups

    root = groups([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2], ids)
    kept = {i: t for i, t in kept.items() if root[i] == i}
    items = [(r["item_id"], decontaminate.normalised(r["text"])) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    index = decontaminate.Index(items, decontaminate.EDIT_RATE)
    leaks = {ids for ids, text in kept.items() if list(index.search([decontaminate.normalised(text)]))}
    found = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(SF_DIR)).collect()}
    assert set(found) == set(kept) - leaks
