from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexmill.operators import columns, splitting, tokens, training, vocabulary
from lexmill.operators.languages import Language, language, register
from lexmill.operators.ranking import drop_pinned, pin, with_rank


@pytest.fixture
def lexed(spark):
    rows = [(1, "int a; a = b;", 1), (2, "a ( b ) ;", 0), (3, "", None), (4, "rare_word x", 1)]
    return tokens.tokenize(spark.createDataFrame(rows, "id bigint, code string, label int"), "code")


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", 300), (2, "b", 1)], "id int, text string, target int")
    assert columns.drop_columns(df, "text").columns == ["id", "target"]
    renamed = columns.rename_column(df, "target", "label")
    with pytest.raises(ValueError):
        columns.rename_column(df, "absent", "label")
    cast = columns.cast_label(renamed)
    assert [r.label for r in cast.orderBy("id").collect()] == [None, 1]
    assert dict(cast.dtypes)["label"] == "tinyint"
    assert columns.choose_columns(df, {"code": "text"}).columns == ["code"]
    both = columns.union_all(columns.constant_label(df, 1, "label"), df)
    assert both.count() == 4 and both.where("label is null").count() == 2


def test_label_modes(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "label string")

    def typed(mode):
        return [r[0] for r in df.select(columns.typed_label(F.col("label"), mode)).collect()]

    assert typed("string") == ["1", "x", None]
    assert typed("lenient") == [1, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        typed("strict")
    with pytest.raises(ValueError):
        typed("other")


def test_long_and_wide(lexed):
    wide = tokens.to_wide(tokens.to_long(lexed, "id"), "id").orderBy("id").collect()
    before = lexed.where("size(tokens) > 0").orderBy("id").collect()
    assert [(r.id, r.tokens, r.tags) for r in wide] == [(r.id, r.tokens, r.tags) for r in before]


def test_pairs_are_cut_to_the_shorter_array(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["x", "y"])], "tokens array<string>, tags array<string>")
    row = training.pair_tokens(df).first()
    assert (row.tokens, row.tags) == (["a", "b"], ["x", "y"])
    row = training.pair_tokens(df, limit=1).first()
    assert (row.tokens, row.tags) == (["a"], ["x"])
    assert training.pair_tokens(df.drop("tags"), tags=None, limit=2).first().tokens == ["a", "b"]
    assert tokens.to_long(df).count() == 2


def test_training_rows(lexed):
    rows = training.training_rows(lexed, 2, "string").orderBy("id").collect()
    assert [r.label for r in rows] == ["1", "0", None, "1"]
    assert [r.tokens for r in rows] == [["int", "a"], ["a", "("], [], ["rare_word", "x"]]


def test_class_counts(spark):
    df = spark.createDataFrame(
        [("a", "train", 0), ("a", "test", 1), ("b", "train", 2), ("b", "train", None)],
        "vul_type string, split string, label int",
    )
    assert {tuple(r) for r in training.class_counts(df, "vul_type").collect()} == {("a", 1, 1), ("b", 1, 0)}
    assert {tuple(r) for r in training.class_counts_by_split(df).collect()} == {
        ("a", None, False, 1, 1), ("b", None, False, 1, 0), (None, "train", True, 1, 1), (None, "test", True, 1, 0),
    }
    unknown = training.class_counts_by_split(df.limit(1).withColumn("vul_type", F.lit(None).cast("string")))
    assert {tuple(r) for r in unknown.collect()} == {(None, None, False, 0, 1), (None, "train", True, 0, 1)}


def test_encode_with_gaps(spark):
    """Ids that are missing from the vocabulary lose no other term, whatever the head holds."""
    terms = [("tokens", t, 1, 2 + i) for i, t in enumerate("abcdef") if t != "b"]
    vocab = spark.createDataFrame(terms, "namespace string, term string, n long, term_id int")
    df = spark.createDataFrame([(1, ["a", "b", "c", "d", "e", "f", None, "f", "zz"]), (2, []), (3, None)], "id int, tokens array<string>")
    for head in (1, 3, 4, 5, 100):
        ids = vocabulary.encode(df, vocab, {"tokens": ("tokens", "token_ids")}, head_terms=head)
        found = {r["id"]: r["token_ids"] for r in ids.collect()}
        assert found == {1: [2, 1, 4, 5, 6, 7, 1, 7, 1], 2: [], 3: None}


def test_encode_with_shared_ids(spark):
    """Terms that share the id at the cut keep it, whichever of them the head holds."""
    terms = [("tokens", t, 1, i) for t, i in zip("abcdef", (2, 3, 3, 3, 4, 4))]
    vocab = spark.createDataFrame(terms, "namespace string, term string, n long, term_id int")
    df = spark.createDataFrame([(["a", "b", "c", "d", "e", "f", "zz"],)], "tokens array<string>")
    for head in (2, 3, 5, 6):
        ids = vocabulary.encode(df, vocab, {"tokens": ("tokens", "token_ids")}, head_terms=head)
        assert ids.first()["token_ids"] == [2, 3, 3, 3, 4, 4, 1]


@pytest.mark.parametrize("cells", [1, 7, 1000])
def test_encode_in_blocks(spark, monkeypatch, cells):
    """Rows come back whole, whatever block they are in and wherever their terms are found."""
    monkeypatch.setattr(vocabulary, "BLOCK_CELLS", cells)
    monkeypatch.setattr(vocabulary, "_BATCH_BYTES", 1)
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    long = ["comment " * 9 + c for c in "xy"]
    terms = [("tokens", t, 1, 2 + i) for i, t in enumerate(["a", "b", *long, "c", "\xe9"])]
    terms += [("tags", t, 1, 2 + i) for i, t in enumerate("pqr")] + [("tokens", None, 1, 40)]
    vocab = spark.createDataFrame(terms, "namespace string, term string, n long, term_id int")
    at = datetime(2020, 1, 2, 3, 4, 5)
    rows = [
        (1, ["a", long[1], "zz", None, "\xe9"], ["p", "q", "p", "r", None], at, Decimal("1.50"), {"k": [1]}),
        (1, ["a", long[1], "zz", None, "\xe9"], ["p", "q", "p", "r", None], at, Decimal("1.50"), {"k": [1]}),
        (2, [], ["r"], None, None, None),
        (3, None, None, at, None, {}),
        (None, ["zz", long[0], "c", "c"], [], None, Decimal("0.25"), {"k": None}),
    ] * 3
    df = spark.createDataFrame(
        rows, "id int, tokens array<string>, tags array<string>, `at.time` timestamp, d decimal(5,2), m map<string, array<int>>"
    )
    ids = {(space, term): i for space, term, _, i in terms if term}

    def numbers(space, sequence):
        return None if sequence is None else [ids.get((space, t), 1) for t in sequence]

    wanted = sorted(repr((*r, numbers("tokens", r[1]), numbers("tags", r[2]))) for r in rows)
    for head in (1, 2, 4):
        found = vocabulary.encode(df.coalesce(2), vocab, head_terms=head)
        assert found.columns == [*df.columns, "token_ids", "tag_ids"]
        assert sorted(repr(tuple(r)) for r in found.collect()) == wanted
        chosen = vocabulary.encode(df, vocab, head_terms=head, keep=["at.time", "id"])
        assert chosen.columns == ["at.time", "id", "token_ids", "tag_ids"] and chosen.count() == len(rows)
    over = vocabulary.encode(df, vocab, {"tokens": ("tokens", "tokens")}, head_terms=2)
    assert over.columns == df.columns and over.where("id = 2").first()["tokens"] == []
    assert vocabulary.encode(df.limit(0), vocab, head_terms=2).collect() == []
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == size


def test_encode_takes_the_lowest_of_repeated_terms(spark):
    terms = [("tokens", t, 1, i) for t, i in (("a", 2), ("b", 9), ("b", 4), ("b", 7), ("a", 3))]
    vocab = spark.createDataFrame(terms, "namespace string, term string, n long, term_id int")
    df = spark.createDataFrame([(["a", "b", "zz"],)], "tokens array<string>")
    for head in (1, 2, 100):
        ids = vocabulary.encode(df, vocab, {"tokens": ("tokens", "token_ids")}, head_terms=head)
        assert ids.first()["token_ids"] == [2, 4, 1]


def test_encode_asks_for_a_term_once_a_block(spark):
    """Neither the terms nor the columns that are not kept are moved with the rows."""
    vocab = spark.createDataFrame([("tokens", f"t{i}", 1, 2 + i) for i in range(9)], "namespace string, term string, n long, term_id int")
    rows = spark.range(500, numPartitions=1).select("id", F.array(*(F.lit(f"t{i}") for i in range(9))).alias("tokens"))
    found = vocabulary.encode(rows, vocab, {"tokens": ("tokens", "token_ids")}, head_terms=1, keep=["id"])
    plan = found._jdf.queryExecution().optimizedPlan()
    assert "tokens#" not in plan.toString()
    asked = spark.read.parquet(*(f for f in found.inputFiles() if "keys" in spark.read.parquet(f).columns))
    assert [sorted(r["keys"]) for r in asked.select("keys").collect()] == [[f"0 t{i}" for i in range(1, 9)]]
    assert {(len(r.token_ids), r.token_ids[8]) for r in found.collect()} == {(9, 10)}


def test_null_keys_share_a_split(spark):
    df = spark.createDataFrame([(None,)] * 5 + [(str(i),) for i in range(40)], "id string")
    for split in (splitting.hash_split(df, "id", "s"), splitting.exact_split(df, "id", "s")):
        assert split.where("id is null").select("split").distinct().count() == 1


def test_hash_split_is_stable_and_keeps_copies_together(spark):
    df = spark.range(20_000).select((F.col("id") % 10_000).alias("id"))
    split = splitting.hash_split(df, "id", "s")
    shares = {r.split: r.n / 20_000 for r in splitting.split_counts(split).collect()}
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["test"] - 0.1) < 0.02
    assert split.groupBy("id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    again = splitting.hash_split(df.repartition(7), "id", "s")
    assert split.exceptAll(again).count() == 0


@pytest.mark.parametrize("rows", [0, 1, 3, 9, 10, 11, 101, 70_001])
def test_exact_split_sizes(spark, rows):
    counts = {r.split: r.n for r in splitting.split_counts(splitting.exact_split(spark.range(rows))).collect()}
    train, validation, test = splitting.split_sizes(rows)
    wanted = {"train": train, "validation": validation, "test": test}
    assert counts == {name: n for name, n in wanted.items() if n}


def test_exact_split_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"))
    split = splitting.exact_split(df)
    assert split.count() == 3000
    assert split.groupBy("id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_rank_is_dense_and_total(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    ranked = with_rank(df.repartition(9), [F.col("k")])
    assert ranked.where("k <> rank").count() == 0 and ranked.count() == 5000


def test_pin_keeps_rows(spark):
    pinned = pin(spark.range(100).withColumn("r", F.rand()))
    assert pinned.exceptAll(pinned).count() == 0 and pinned.count() == 100


def test_drop_pinned(spark, tmp_path):
    pinned, other = pin(spark.range(10)), pin(spark.range(3))
    folder = Path(pinned.inputFiles()[0].removeprefix("file:").replace("//", "")).parent
    drop_pinned(pinned, other, pinned.where("id > 3"))
    assert pinned.count() == 10
    drop_pinned(pinned, other)
    assert not folder.exists() and other.count() == 3
    spark.range(5).write.parquet(f"{tmp_path}/own")
    with pytest.raises(ValueError):
        drop_pinned(spark.read.parquet(f"{tmp_path}/own"))
    assert spark.read.parquet(f"{tmp_path}/own").count() == 5


def test_vocabulary_order_and_ids(lexed):
    vocab = vocabulary.build_vocabulary(lexed).collect()
    tokens_ = [(r.term, r.n, r.term_id) for r in sorted(vocab, key=lambda r: r.term_id) if r.namespace == "tokens"]
    assert tokens_ == [
        (";", 3, 2), ("a", 3, 3), ("b", 2, 4), ("(", 1, 5), (")", 1, 6), ("=", 1, 7), ("int", 1, 8),
        ("rare_word", 1, 9), ("x", 1, 10),
    ]
    assert {(r.term, r.term_id) for r in vocab if r.namespace == "labels"} == {("1", 0), ("0", 1)}


@pytest.mark.parametrize("head", [200_000, 3, 1])
def test_encode(spark, lexed, head):
    long_text = "/* " + "long words " * 30 + "*/"
    extra = spark.createDataFrame([(5, f"{long_text} a", 0), (5, f"{long_text} a", 0)], lexed.select("id", "code", "label").schema)
    corpus = lexed.unionByName(tokens.tokenize(extra, "code"))
    vocab = vocabulary.build_vocabulary(corpus, min_count=2).collect()
    ids = {(r.namespace, r.term): r.term_id for r in vocab}
    table = spark.createDataFrame(vocab)
    encoded = vocabulary.encode(corpus, table, head_terms=head).collect()
    assert len(encoded) == 6
    for row in encoded:
        assert row.token_ids == [ids.get(("tokens", t), 1) for t in row.tokens]
        assert row.tag_ids == [ids.get(("tags", t), 1) for t in row.tags]


def test_encode_keeps_null_sequences(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None), (3, [])], "id int, tokens array<string>")
    vocab = spark.createDataFrame([("tokens", "a", 1, 2)], "namespace string, term string, n bigint, term_id int")
    rows = vocabulary.encode(df, vocab, {"tokens": ("tokens", "token_ids")}).orderBy("id").collect()
    assert [r.token_ids for r in rows] == [[2], None, []]


def test_rejected_python(spark):
    df = spark.createDataFrame([(1, "x = 1\n"), (2, "f(\n")], "id int, code string")
    good, bad = tokens.accepted_and_rejected(tokens.text_tokens_table(df, "code", "python"))
    assert [r.id for r in good.collect()] == [1]
    assert [r.id for r in bad.collect()] == [2] and "tokens" not in bad.columns


def test_languages(spark):
    with pytest.raises(ValueError):
        language("cobol")
    with pytest.raises(ValueError):
        register("Cobol", Language())
    df = spark.createDataFrame(
        [(1, "cpp", "a->b"), (2, "java", "a >>> b"), (3, "python", "a ** b"), (4, "other", "a")],
        "id int, lang string, code string",
    )
    rows = tokens.tokenize_mixed(df).orderBy("id").collect()
    assert [r.tokens for r in rows] == [["a", "->", "b"], ["a", ">>>", "b"], ["a", "**", "b", "NEW_LINE"], None]


def test_user_functions(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id int, code string")
    rows = tokens.map_rows(df, lambda r: {"id": r["id"], "n": len(r["code"].split())}, "id int, n int")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 2), (2, 1)]


def test_rank_within_groups(spark):
    df = spark.range(1000).select(F.concat(F.lit("g"), F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    ranked = with_rank(df.repartition(5), [F.col("g"), F.col("k")], "r", group="g")
    assert ranked.where("r <> k div 3").count() == 0 and ranked.count() == 1000
