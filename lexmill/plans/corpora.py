"""The three corpus builds: read, split, clean, lex, save."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import fixed
from lexmill.functions.normalize import (
    remove_comments,
    remove_empty_lines,
    remove_trailing_space,
)
from lexmill.operators.columns import cast_label, drop_columns, rename_column, rewrite_column
from lexmill.operators.splitting import exact_split, hash_split
from lexmill.operators.tokens import tokenize
from lexmill.operators.training import training_rows
from lexmill.sources import blocks, tables


def clean_and_tokenize(df: DataFrame, key: str) -> DataFrame:
    """Clean the code column and add ``tokens`` and ``tags``: one narrow stage."""
    cleaned = rewrite_column(df, key, remove_comments, remove_trailing_space, remove_empty_lines)
    return tokenize(cleaned, key)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("id", F.md5(F.col(key).cast("binary")))


def _split(df: DataFrame, seed: str, exact: bool) -> DataFrame:
    return (exact_split if exact else hash_split)(df, "id", seed)


def reveal(spark: SparkSession, data_dir: str, seed: str = "", exact: bool = False, lines: bool = False) -> DataFrame:
    """Two JSON files, one per class."""
    root = f"{data_dir}/reveal"
    raw_path = f"{root}/raw_data"

    def build_raw() -> DataFrame:
        both = tables.read_labelled_json(
            spark,
            {1: f"{raw_path}/vulnerables.json", 0: f"{raw_path}/non-vulnerables.json"},
            lines=lines,
        )
        return _split(_keyed(drop_columns(both, "hash", "size", "project"), "code"), seed, exact)

    raw = tables.build_once(spark, f"{root}/split_data", build_raw)
    return tables.build_once(spark, f"{root}/tokenized", lambda: clean_and_tokenize(raw, "code"))


def sysevr_blocks(spark: SparkSession, data_dir: str) -> DataFrame:
    """All blocks of the four files with their ``kind``, accepted or rejected (label that is no integer).

    One scan writes both kinds as one table, so either both are there or neither.
    """
    root = f"{data_dir}/sysevr"
    files = [f"{root}/raw_data/{name}.txt" for name in fixed.SYSEVR_FILES]

    def parse() -> DataFrame:
        kind = F.when(F.col("label").isNull(), blocks.REJECTED).otherwise(blocks.ACCEPTED)
        return blocks.read_blocks(spark, files).withColumn("kind", kind)

    return tables.build_once(spark, f"{root}/blocks", parse, by="kind")


def sysevr(spark: SparkSession, data_dir: str, seed: str = "", exact: bool = False) -> DataFrame:
    """Four block files; the origin stays as ``vul_type``, and blocks with bad labels stay in the table of blocks."""
    root = f"{data_dir}/sysevr"

    def build_raw() -> DataFrame:
        found = sysevr_blocks(spark, data_dir)
        accepted = found.where(F.col("kind") == blocks.ACCEPTED).drop("kind", "label_text")
        return _split(_keyed(accepted, "code"), seed, exact)

    raw = tables.build_once(spark, f"{root}/split_data", build_raw)
    return tables.build_once(spark, f"{root}/tokenized", lambda: clean_and_tokenize(raw, "code"))


def codexglue(spark: SparkSession, data_dir: str, fmt: str = "parquet") -> DataFrame:
    """An exported data set that comes with its splits."""
    root = f"{data_dir}/code_x_glue_cc_defect_detection"

    def build() -> DataFrame:
        table = tables.read_presplit(spark, f"{root}/raw_data", fmt=fmt)
        table = rename_column(drop_columns(table, "id", "project", "commit_id"), "target", "label")
        return clean_and_tokenize(cast_label(table, "label", "tinyint"), "func")

    return tables.build_once(spark, f"{root}/tokenized", build)


def read_for_training(
    spark: SparkSession,
    path: str,
    split: str,
    limit: int | None = None,
    label_mode: str = "string",
    token_key: str = "tokens",
    tag_key: str | None = "tags",
    label_key: str = "label",
) -> DataFrame:
    """Rows of one saved split, ready for a trainer; only the needed columns are read."""
    table = tables.load_split(spark, path, split)
    wanted = [c for c in (token_key, tag_key, label_key) if c and c in table.columns]
    return training_rows(table.select(*wanted), limit, label_mode, token_key, tag_key, label_key)
