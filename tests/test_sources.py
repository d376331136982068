import json
import os

import pytest
from pyspark.sql import functions as F

from lexmill.functions import fixed
from lexmill.plans import corpora
from lexmill.sources import blocks, tables
from lexmill.streaming.corpus_stream import read_code_stream, write_corpus_stream

BLOCKS = "\n".join(
    [
        "1 a.c head", "int f() {", "  x;  ", "", "}", "1", "-" * 25,
        "two lines", "0", "-" * 33,
        "bad label", "code", "x", "-" * 80,
        "head", "y; // c", "0",
    ]
)


def test_blocks(spark, tmp_path):
    (tmp_path / "Array_usage.txt").write_text(BLOCKS + "\n")
    (tmp_path / "Pointer_usage.txt").write_text("h\r\nz\r\n1\r\n" + "-" * 25 + "\r\n")
    found = blocks.read_blocks(spark, [str(tmp_path / "Array_usage.txt"), str(tmp_path / "Pointer_usage.txt")])
    good = {tuple(r) for r in blocks.accepted_blocks(found).select("vul_type", "code", "label").collect()}
    assert good == {
        ("Array_usage", "int f() {\nx;\n}", 1), ("Array_usage", "y; // c", 0), ("Pointer_usage", "z", 1),
    }
    assert [tuple(r) for r in blocks.rejected_blocks(found).select("code", "label_text").collect()] == [("code", "x")]


DASHES = "-" * 25
SHAPES = {
    "-head one\ncode1a\ncode1b\n1\n" + DASHES + " end\nh2\ncode2\n0\n" + DASHES + "\n": [("code1a\ncode1b", 1), ("code2", 0)],
    DASHES + "\nh\nc\n1\n" + DASHES: [("c", 1)],
    "-" * 24 + "\nc\nd\n1\n" + "-" * 30 + "x\n-h\n-c\n2\n": [("c\nd", 1), ("-c", 2)],
    "h\nc\n1\n// " + DASHES + " //\nh\nd\n2\n" + "-" * 80 + "\n\n" + "-" * 80 + "\nh\ne\n3": [("c", 1), ("d", 2), ("e", 3)],
    "\n" + DASHES + "\n" + DASHES + "\nh\r\nc\r\n1\r\n" + DASHES + "\r\n-\nc\n4\n": [("c", 1), ("c", 4)],
    "": [], DASHES: [], "one line": [],
}


def test_shapes_of_blocks_in_columns_and_files(spark, tmp_path):
    for at, (text, expected) in enumerate(SHAPES.items()):
        column = spark.createDataFrame([(text,)], "t string").select(F.explode(blocks.split_blocks(F.col("t"))).alias("b"))
        assert [(r.code, r.label) for r in blocks.parse_blocks(column, "b").collect()] == expected
        (tmp_path / f"{at}.txt").write_bytes(text.encode())
    found = blocks.read_blocks(spark, str(tmp_path)).collect()
    for at, expected in enumerate(SHAPES.values()):
        assert sorted((r.code, r.label) for r in found if r.vul_type == str(at)) == sorted(expected)


def test_shapes_in_a_file_that_is_split(spark, tmp_path):
    text = "".join(f"{'-' * (i % 25)}head\ncode {i};\n{i % 2}\n{'-' * (25 + i % 3)}{' end' * (i % 2)}\n" for i in range(5_000))
    (tmp_path / "big.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20011")
    try:
        found = blocks.accepted_blocks(blocks.read_blocks(spark, str(tmp_path / "big.txt"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.code, r.label) for r in found) == sorted((f"code {i};", i % 2) for i in range(5_000))


def test_large_block_file_is_split(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"head\ncode {i};\n{i % 2}\n{'-' * (25 + i % 9)}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        found = blocks.accepted_blocks(blocks.read_blocks(spark, str(path)))
        assert found.rdd.getNumPartitions() > 3
        assert found.count() == 20_000
        assert found.select("code").distinct().count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.fixture
def data_dir(tmp_path):
    raw = tmp_path / "reveal" / "raw_data"
    raw.mkdir(parents=True)
    for name, n in (("vulnerables", 30), ("non-vulnerables", 70)):
        rows = [
            {"code": f"int {name[:3]}{i}() {{ // c\n  return {i};\n}}\n", "hash": "h", "project": "p", "size": i}
            for i in range(n)
        ]
        (raw / f"{name}.json").write_text(json.dumps(rows))
    raw = tmp_path / "sysevr" / "raw_data"
    raw.mkdir(parents=True)
    for name in fixed.SYSEVR_FILES:
        (raw / f"{name}.txt").write_text(BLOCKS.replace("y;", f"{name};"))
    return tmp_path


def test_labelled_json(spark, data_dir):
    root = data_dir / "reveal" / "raw_data"
    both = tables.read_labelled_json(spark, {1: str(root / "vulnerables.json"), 0: str(root / "non-vulnerables.json")})
    assert {r.label: r["count"] for r in both.groupBy("label").count().collect()} == {1: 30, 0: 70}
    assert dict(both.dtypes)["size"] == "bigint"


def test_reveal_build(spark, data_dir):
    built = corpora.reveal(spark, str(data_dir), exact=True)
    counts = {r.split: r["count"] for r in built.groupBy("split").count().collect()}
    assert counts == {"train": 80, "validation": 10, "test": 10}
    assert set(built.columns) == {"id", "code", "label", "split", "tokens", "tags"}
    row = built.where("label = 1").first()
    assert "//" not in row.code and len(row.tokens) == len(row.tags)
    assert row.tokens[:2] == ["int", row.tokens[1]] and "comment" not in row.tags


def test_sysevr_build(spark, data_dir):
    built = corpora.sysevr(spark, str(data_dir))
    assert built.count() == 8
    assert {r.vul_type for r in built.collect()} == set(fixed.SYSEVR_FILES)
    found = corpora.sysevr_blocks(spark, str(data_dir))
    assert {r.kind: r["count"] for r in found.groupBy("kind").count().collect()} == {"accepted": 8, "rejected": 4}


def test_codexglue_build(spark, tmp_path):
    root = tmp_path / "code_x_glue_cc_defect_detection" / "raw_data"
    for k, split in enumerate(("train", "validation", "test")):
        rows = [(k, "p", "c", f"int f() {{ return {k}; /* c */ }}", k % 2 == 1)]
        df = spark.createDataFrame(rows, "id int, project string, commit_id string, func string, target boolean")
        df.write.parquet(str(root / split))
    built = corpora.codexglue(spark, str(tmp_path))
    assert {(r.split, r.label) for r in built.collect()} == {("train", 0), ("validation", 1), ("test", 0)}
    assert dict(built.dtypes)["label"] == "tinyint"
    rows = corpora.read_for_training(
        spark, str(tmp_path / "code_x_glue_cc_defect_detection" / "tokenized"), "test", limit=3, label_mode="strict"
    ).collect()
    assert [(r.tokens, r.label) for r in rows] == [(["int", "f", "("], 0)]


def test_saved_splits_are_pruned_and_built_once(spark, tmp_path):
    path = str(tmp_path / "saved")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")

    tables.build_once(spark, path, build)
    tables.build_once(spark, path, build)
    assert len(calls) == 1
    os.remove(f"{path}/_SUCCESS")  # a crash in the middle of a save
    tables.build_once(spark, path, build)
    assert len(calls) == 2
    part = tables.load_split(spark, path, "test")
    assert [r.id for r in part.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().executedPlan().toString()


def test_stream_matches_the_batch_build(spark, tmp_path):
    source = spark.range(50).select(
        F.col("id"), F.format_string("int f%s() { /* c */ return 1; }", F.col("id")).alias("code")
    )
    source.write.parquet(str(tmp_path / "in"))
    stream = read_code_stream(spark, str(tmp_path / "in"), "id bigint, code string")
    query = write_corpus_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out")).select("id", "code", "tokens", "tags", "split")
    from lexmill.operators.splitting import hash_split

    batch = hash_split(corpora.clean_and_tokenize(source, "code")).select(written.columns)
    assert written.count() == 50 and written.exceptAll(batch).count() == 0
