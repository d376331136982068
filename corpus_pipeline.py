"""A corpus cleaned in five stages, each a corpus operator over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each as Parquet into the shared folder and gives
the reread table to the next stage.  All but the last return the columns of ``documents``.

Defined cases are those of the operators: a document with a NULL id is scored and encoded like any other, keeps its lines and stays in the
near-duplicate stage, because no decision can name it; rows that share an id share decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, decontaminate, lines, simhash, toxicity
from lexmill.llm.common import drop_scratch, pin, read

#: The stages have no SQL twin: trees, fingerprints and byte pairs are tested against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below ``toxicity.REJECT``."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("_score") < toxicity.REJECT).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of each group of like lines only the first occurrence is left."""
    kept = lines.drop_lines(docs, lines.duplicate_lines(docs))
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``ids`` (_gone)."""
    return docs.join(pin(ids), docs["doc_id"] == F.col("_gone"), "left_anti")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-equal fingerprints, as op3 has them (three words, two bits)."""
    groups = simhash.near_duplicates(docs)
    return _without(docs, groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontaminate.find_passages(docs, read(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("doc_id").alias("_gone")).where("_gone is not null").distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_sha256) of every document; the ids are decoded again as a check."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_checked(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` through all stages."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
        if before is not None:
            drop_scratch(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
