"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

A text is described by densities of insult words (a fixed list, and words and word beginnings learned from labelled
texts), how near they stand to second-person words, rates of capitals, exclamation and question marks, obfuscated
spellings and stretched letters.  For each of ``FOLDS`` parts of the labelled rows, trees are fitted on the other parts by
Spark's ``GBTClassifier`` and their margin is calibrated on this part by ``IsotonicRegression``; a score is the mean over
the parts.

Labels are learned from training rows only (crc32 of the id, modulo 3, is not 1).  At most ``SAMPLE_ROWS`` labelled rows
are used, the first by a hash of their id, which also deals them into parts.  Labels, language, source and id are no
inputs of a score.

Defined cases: a NULL or empty text has features zero and gets a score; a document labelled twice differently counts by
its larger label; labels that are NULL are left out; without both classes among the training rows every score is the share of
toxic rows (0 if there are none); rows with a NULL id are not held out; repeated rows are scored each; other columns are kept
by ``score``, whose own begin with an underscore.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import byte_slices, as_text, pin, read, slices

#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 24_000
REJECT = 0.7
FOLDS = 3
TREES, DEPTH, LEAST_ROWS, SEED = 20, 3, 5, 7
#: Terms of the learned lexicon at most, the texts that must hold one, and how surely it must be toxic.
LEXICON_TERMS, LEXICON_TEXTS, LEXICON_Z = 4096, 4, 4.0
#: Lengths of word beginnings that the lexicon may hold besides words.
BEGINNINGS = (4, 5, 6)

# Insults in the languages of the corpus.
INSULTS = frozenset(
    """
    idiot idiots moron morons stupid dumb fool loser losers clown clowns scum trash garbage pathetic worthless disgusting
    ugly jerk bastard bitch asshole crap shit fuck fucking damn retard creep pig liar coward hate kill die shut
    idiotin dumm dummkopf trottel depp arsch arschloch scheisse scheiße dreck abschaum versager widerlich ekelhaft
    imbécile crétin connard connasse salaud merde ordure débile abruti pathétique dégoûtant
    idiota imbécil estúpido estúpida tonto basura mierda cabrón escoria patético asqueroso inútil
    """.split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split())
# Signs that stand for letters in obfuscated spellings.
DISGUISES = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_MIXED = re.compile(r"(?<!\S)(?=\S*[@$!0-57*])(?=\S*[A-Za-z])[A-Za-z@$!0-57*]{3,24}(?!\S)")
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
_SIGN = re.compile(r"[@$!0-57*]")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\w)")
#: Words on either side of an insult in which a second-person word is near.
REACH = 5

FEATURES = (
    "insults", "insult_count", "learned", "learned_count", "beginnings", "beginning_count", "near_second", "second",
    "capitals", "capital_words", "exclamations", "questions", "punctuation", "obfuscated", "obfuscated_insults", "stretched", "length",
)


#: Words whose flags a Python worker remembers; it forgets all of them at this number.
REMEMBERED = 300_000
# Flags of a word; the number of lexicon beginnings and of capitals stand above them.
_INSULT, _LEARNED, _SECOND, _SHOUTED, _LETTER = 1, 2, 4, 8, 16
_BEGUN, _CAPITALS = 8, 16


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[str]
    beginnings: frozenset[str]


class Words(dict):
    """What a word counts for, as one number per word; most words count for nothing."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        low = word.lower()
        begun = sum(len(low) > size and low[:size] in self.lexicon.beginnings for size in BEGINNINGS)
        told = (
            _INSULT * (low in INSULTS) | _LEARNED * (low in self.lexicon.words) | _SECOND * (low in SECOND_PERSON)
            | _SHOUTED * (len(word) > 2 and word.isupper()) | _LETTER * (len(word) == 1)
            | begun << _BEGUN | sum(map(str.isupper, word)) << _CAPITALS
        )
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 40:
            self[word] = told
        return told


@lru_cache(maxsize=2)
def known_words(lexicon: Lexicon) -> Words:
    return Words(lexicon)


def _has_run(text: str) -> bool:
    """Whether any character stands four times in a row."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    same = codes[1:] == codes[:-1]
    return bool((same[:-2] & same[1:-1] & same[2:]).any())


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The numbers of FEATURES for one text."""
    words = _WORD.findall(text)
    n, size = max(1, len(words)), max(1, len(text))
    told = [(at, flags) for at, flags in enumerate(map(known_words(lexicon).__getitem__, words)) if flags]
    count = lambda flag: sum(1 for _, flags in told if flags & flag)
    insults, learned, second = count(_INSULT), count(_LEARNED), count(_SECOND)
    begun = sum(flags >> _BEGUN & 255 for _, flags in told)
    near = 0
    if second and insults + learned:
        persons = np.array([at for at, flags in told if flags & _SECOND])
        bad = np.array([at for at, flags in told if flags & (_INSULT | _LEARNED)])
        right = np.searchsorted(persons, bad)
        gap = np.minimum(
            np.where(right > 0, bad - persons[right - 1], REACH + 1),
            np.where(right < len(persons), persons[np.minimum(right, len(persons) - 1)] - bad, REACH + 1),
        )
        near = int((gap <= REACH).sum())
    mixed = _MIXED.findall(text) if _SIGN.search(text) else []
    hidden = 0
    for token in mixed:
        plain = "".join(DISGUISES.get(c, c) for c in token.lower()).strip("*")
        hidden += plain in INSULTS or plain in lexicon.words
    if count(_LETTER) >= 4:
        for token in _SPACED.findall(text):
            hidden += re.sub(r"[ .*_-]", "", token).lower() in INSULTS
    stretched = len(_STRETCHED.findall(text)) if _has_run(text) else 0
    return [
        insults / n, insults, learned / n, learned, begun / n, begun, near / n, second / n,
        sum(flags >> _CAPITALS for _, flags in told) / size, count(_SHOUTED) / n, text.count("!") / size, text.count("?") / size,
        sum(map(text.count, "!?.,;:")) / size, len(mixed) / n, hidden, stretched / n, log(1 + len(words)),
    ]


def _terms(text: str) -> set[str]:
    """Words, and word beginnings marked by a bar, of a text."""
    words = {w.lower() for w in _WORD.findall(text)}
    return words | {w[:size] + "|" for w in words for size in BEGINNINGS if len(w) > size}


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Terms that texts labelled toxic hold far more often than others do; ``labelled`` has (text, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[int(label > 0)].update(_terms(text))
            terms = list(seen[0].keys() | seen[1].keys())
            for at in range(0, len(terms), 10_000):
                part = terms[at : at + 10_000]
                yield pa.RecordBatch.from_pydict({"term": part, "clean": [seen[0][t] for t in part], "toxic": [seen[1][t] for t in part]})

    totals = labelled.agg(F.count(F.when(F.col("label") > 0, 1)), F.count(F.when(F.col("label") == 0, 1))).first()
    n_toxic, n_clean = max(1, totals[0]), max(1, totals[1])
    counts = labelled.select("text", "label").mapInArrow(count, "term string, clean long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Standardised log odds with half a text added everywhere.
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (n_clean - F.col("clean") + 0.5))
    z = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    chosen = counts.where(F.col("toxic") >= LEXICON_TEXTS).withColumn("z", z).where(F.col("z") >= LEXICON_Z)
    terms = [r["term"] for r in chosen.orderBy(F.col("z").desc(), "term").limit(LEXICON_TERMS).collect()]
    return Lexicon(frozenset(t for t in terms if t[-1] != "|"), frozenset(t[:-1] for t in terms if t[-1] == "|"))


def with_features(docs: DataFrame, text_col: str, lexicon: Lexicon) -> DataFrame:
    """``docs`` with a column ``_features`` (array of doubles)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = docs.withColumn("_features", F.array(F.lit(0.0))).schema
    names = [field.name for field in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            for own in byte_slices(batch, at):
                texts = [text or "" for text in own.column(at).to_pylist()]
                for start, end in slices(texts):
                    rows = [features(text, shared.value) for text in texts[start:end]]
                    part = own.slice(start, end - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.float64()))], names=names)

    return docs.mapInArrow(run, schema)


@dataclass
class Model:
    lexicon: Lexicon
    #: Trees and calibration of each part.
    parts: list[tuple]
    share: float


def _vector(df: DataFrame) -> DataFrame:
    parts = [F.get("_features", F.lit(at)).alias(f"_f{at}") for at in range(len(FEATURES))]
    named = [f"_f{at}" for at in range(len(FEATURES))]
    wide = df.select("*", *parts)
    return VectorAssembler(inputCols=named, outputCol="_vector").transform(wide).drop(*named)


def _margin(trees, df: DataFrame) -> DataFrame:
    scored = trees.transform(df)
    return scored.withColumn("_margin", vector_to_array("_raw").getItem(1)).drop("_raw", "_chance", "_class")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled training rows of ``docs``; ``labels`` has (doc_id, toxic)."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = pin(known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample_rows))
    # At most sample_rows rows of three numbers: bounded, whatever the corpus.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(text_col).alias("text"))
    rows = pin(texts.join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.col("order"), F.lit(FOLDS))))
    lexicon = learn_lexicon(rows)
    shown = with_features(rows.select("text", "label", "part"), "text", lexicon)
    shown = _vector(shown.select(F.col("label").cast("double").alias("label"), "part", "_features").coalesce(4))
    shown = pin(shown.drop("_features"))
    sizes = {(r["part"], r["label"]): r["count"] for r in shown.groupBy("part", "label").count().collect()}
    share = sum(n for (_, label), n in sizes.items() if label) / max(1, sum(sizes.values()))
    if any(not sizes.get((part, label)) for part in range(FOLDS) for label in (0.0, 1.0)):
        return Model(lexicon, [], share)
    boosted = GBTClassifier(
        featuresCol="_vector", predictionCol="_class", labelCol="label", maxIter=TREES, maxDepth=DEPTH,
        minInstancesPerNode=LEAST_ROWS, stepSize=0.3, seed=SEED,
    )
    parts = []
    for part in range(FOLDS):
        trees = boosted.fit(shown.where(F.col("part") != part))
        trees.setRawPredictionCol("_raw").setProbabilityCol("_chance")
        margins = _margin(trees, shown.where(F.col("part") == part))
        calibration = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_part").fit(margins)
        parts.append((trees, calibration))
    return Model(lexicon, parts, share)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``_score`` from 0 to 1."""
    if not model.parts:
        return docs.withColumn("_score", F.lit(float(model.share)))
    scored = _vector(with_features(docs, text_col, model.lexicon))
    for at, (trees, calibration) in enumerate(model.parts):
        scored = calibration.transform(_margin(trees, scored)).withColumnRenamed("_part", f"_part{at}").drop("_margin")
    mean = sum((F.col(f"_part{at}") for at in range(len(model.parts))), F.lit(0.0)) / len(model.parts)
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean))
    return scored.withColumn("_score", bounded).select(*docs.columns, "_score")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and decision of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= REJECT).cast("int").alias("predicted")
    )
