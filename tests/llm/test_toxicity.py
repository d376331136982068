import random

from pyspark.sql import functions as F

from lexmill.llm import toxicity
from tests.llm.conftest import rows


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("tha", "ond", "eri", "len", "ous") for b in ("n", "sh", "ra", "tio", "le")]
    texts, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 60))
        toxic = rng.random() < 0.3
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moron", "grobax", "grobaxu"]))
        texts.append((i, " ".join(text)))
        labels.append((i, int(toxic), 1))
    return texts, labels


def test_learns_and_ignores_held_out_labels(spark, docs):
    texts, labels = corpus(900, 1)
    table = docs(*texts)
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.fit(table, known)
    assert "grobax" in model.lexicon.words
    scored = toxicity.score(table, model)
    assert set(scored.columns) == {*table.columns, "_score"}
    found = scored.join(known, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    pairs = rows(found, "_score", "toxic")
    assert all(0 <= s <= 1 for s, _ in pairs)
    assert sum((s >= toxicity.REJECT) == bool(t) for s, t in pairs) > 0.95 * len(pairs)
    turned = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(table, toxicity.fit(table, turned))
    assert rows(again, "doc_id", "_score") == rows(scored, "doc_id", "_score")


def test_odd_rows(spark, docs, empty):
    known = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    table = docs((1, None), (2, ""), (None, "you idiot"), (2, "x" * 300_000))
    model = toxicity.fit(table, known)
    scores = rows(toxicity.score(table, model), "doc_id", "_score")
    assert len(scores) == 4 and all(0 <= s <= 1 for _, s in scores)
    assert rows(toxicity.score(empty, toxicity.fit(empty, known.limit(0)))) == []


def test_features():
    lexicon = toxicity.Lexicon(frozenset({"grobax"}), frozenset({"grob"}))
    named = lambda text: dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon)))
    assert named("")["length"] == 0 and set(named("")) == set(toxicity.FEATURES)
    near, far = named("you are an idiot"), named("you " + "word " * 30 + "idiot")
    assert near["near_second"] > 0 == far["near_second"] and near["insults"] == 0.25
    assert named("such an 1d10t !")["obfuscated_insults"] == 1 and named("i.d.i.o.t went on and on")["obfuscated_insults"] == 1
    assert named("GO AWAY now")["capital_words"] == 1 / 3 and named("sooooo")["stretched"] == 1
    assert named("grobaxlike")["beginnings"] == 1 and named("grobax")["learned"] == 1
