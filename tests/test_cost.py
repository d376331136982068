"""Steps that must not be done twice, in one task, or at places where nothing can be found."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexmill.functions import fixed, literals, signatures
from lexmill.functions.exprs import one_of, replace_held, replace_in_order
from lexmill.operators.ranking import _scratch_folder
from lexmill.plans.code_tables import code_table
from lexmill.plans.oracle_sql import oracle_sql
from lexmill.plans.queries import QUERIES


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A folder with a part table of one file and one row group."""
    folder = str(tmp_path_factory.mktemp("parts"))
    rows = [(i, f"name {i}", f"TYPE {i % 3}", f"Brand#{i % 5}", i % 50 + 1) for i in range(40)]
    df = spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int")
    df.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def test_code_is_written_out_in_more_tasks_than_cores(spark, parts):
    files = code_table(spark, parts, "java_file")
    assert files.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert files.count() == 40


def test_rejected_sources_are_lexed_once(spark, parts):
    told = QUERIES["l4_rejected_sources"](spark, parts)
    assert "regexp_extract_all(" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert {row.kind: row.n for row in told.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"accepted": 32, "rejected": 8}


@pytest.fixture
def documents(spark, tmp_path):
    """Writes a folder with documents and the given labels."""

    def write(*labels):
        words = [" ".join(f"word{i * k % 97}" for k in range(60)) + " rest" * (i % 3) for i in range(1, 120)]
        docs = [(i, None if i == 50 else text, f"src{i % 4}") for i, text in enumerate([*words, ""])]
        folder = tmp_path / f"labels{len(labels)}"
        spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        return str(folder)

    return write


def scratch_tables(spark):
    folder = Path(_scratch_folder(spark).removeprefix("file:"))
    return {str(path) for path in folder.glob("table-*")}


@pytest.mark.parametrize("name", ["d7_encode_rare_terms", "d7_encode_filtered_vocabulary"])
def test_terms_are_left_on_disk_once(spark, documents, name):
    """Where ids come from the join, no table of term arrays is left, and no label join moves texts or terms."""
    folder, before = documents((1, 0), (2, 1), (None, 1)), scratch_tables(spark)
    found = QUERIES[name](spark, folder)
    left = [spark.read.parquet(path) for path in scratch_tables(spark) - before]
    assert left and not any("tokens" in df.columns for df in left)
    assert "doc_id" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("token_id > 1").count() > 0


@pytest.mark.parametrize("name", ["d7_encode", "d7_encode_rare_terms", "d7_encode_filtered_vocabulary"])
def test_labels_of_encoded_documents(spark, documents, name):
    """As the SQL twin; a document with two labels is encoded twice, NULL ids have none."""
    duckdb = pytest.importorskip("duckdb")
    folder = documents((1, 0), (2, 1), (None, 1), (None, 0))
    database = duckdb.connect()
    for table in ("documents", "labels"):
        database.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    columns = ["id", "pos", "token_id", "tag_id"]
    once = Counter(map(tuple, QUERIES[name](spark, folder).select(columns).collect()))
    assert once == Counter(database.execute(f"select {', '.join(columns)} from ({oracle_sql()[name]})").fetchall())
    twice = documents((1, 0), (2, 1), (2, 1))
    found = Counter((r.id, r.pos) for r in QUERIES[name](spark, twice).collect())
    assert found == Counter({(id, pos): 2 if id == 2 else 1 for id, pos, *_ in once})


def test_blanks_stay_where_nothing_is_collapsed(apply):
    """Marks set apart as by the published rule, which begins at the character before each mark."""
    texts = ["a;;b", "1;;2", ";a", "x,;.!5", "1.5 a.b", "a\\.b", "\n.\n", "..", "a ; ; b", "+ +", "a+b  =c", "é,é.", "\U0001f600.\U0001f600,"]

    def plain(text):
        mark = "[" + re.escape("!\"#%&'()*,-./:;?@[]_{}") + "]"
        text = re.sub(rf"([^0-9])({mark})", r"\1 \2 ", text)
        text = re.sub(rf"({mark})([^0-9])", r" \1 \2", text)
        return re.sub("([+=\U0001f600])", r" \1 ", text).strip()

    assert apply(literals.split_words_international, *texts) == [plain(t) for t in texts]
    collapsed = apply(lambda c: literals.collapse_spaces(literals.split_words_international(c, collapse=True)), *texts)
    assert collapsed == [re.sub(" +", " ", plain(t)) for t in texts]


def test_replacements_in_order(apply):
    pairs = (("a", "bb"), ("b", "c"), ("cc", "a"), ("x", ""))
    texts = ("axb", "", None, "zz", "ccxab")
    assert apply(lambda c: replace_held(c, pairs), *texts) == apply(lambda c: replace_in_order(c, pairs), *texts) == ["ac", "", None, "zz", "aac"]
    assert apply(lambda c: one_of(c, "a", "b"), "a", "c", None) == [True, False, None]


def test_old_python_is_told_behind_a_literal_part(apply):
    texts = ["print x", "raise E , y", "except E , y", "n = 5 L", "print (x)", "n = 5", "d . iteritems ( )", ""]
    assert apply(signatures.is_python2, *texts) == [True, True, True, True, False, False, True, False]
    assert len(signatures._PYTHON2_PARTS) == len(fixed.PYTHON2_PATTERNS)
