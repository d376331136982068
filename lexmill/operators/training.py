"""Rows for a trainer: truncation, pairing, labels and class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.columns import typed_label


def truncate(items: Column, limit: int | None) -> Column:
    """First ``limit`` items; everything when there is no limit."""
    return items if limit is None else F.slice(items, F.lit(1), F.lit(limit))


def pair_tokens(
    df: DataFrame, tokens: str = "tokens", tags: str | None = "tags", limit: int | None = None
) -> DataFrame:
    """Cut both arrays to the same length and to the limit; tags may be absent."""
    if tags is None:
        return df.withColumn(tokens, truncate(F.col(tokens), limit))
    shared = F.least(F.size(tokens), F.size(tags))
    if limit is not None:
        shared = F.least(shared, F.lit(limit))
    return df.withColumns(
        {tokens: F.slice(tokens, F.lit(1), shared), tags: F.slice(tags, F.lit(1), shared)}
    )


def training_rows(
    df: DataFrame,
    limit: int | None = None,
    label_mode: str = "string",
    token_key: str = "tokens",
    tag_key: str | None = "tags",
    label_key: str = "label",
) -> DataFrame:
    """Paired, truncated sequences with a typed label; rows without a label stay."""
    rows = pair_tokens(df, token_key, tag_key, limit)
    if label_key in df.columns:
        rows = rows.withColumn(label_key, typed_label(F.col(label_key), label_mode))
    return rows


def class_counts(df: DataFrame, *by: str, label: str = "label") -> DataFrame:
    """Rows with label 0 and with any other label, per group."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(label) != 0).alias("vulnerable"),
        F.count_if(F.col(label) == 0).alias("clean"),
    )


def class_counts_by_split(df: DataFrame, origin: str = "vul_type", label: str = "label") -> DataFrame:
    """Class counts per origin and per split from one pass over the rows.

    ``by_split`` tells the two kinds of rows apart, also where an origin or a split is NULL.
    """
    sets = [[F.col(origin)], [F.col("split")]]
    return df.groupingSets(sets, F.col(origin), F.col("split")).agg(
        (F.grouping(F.col(origin)) == 1).alias("by_split"),
        F.count_if(F.col(label) != 0).alias("vulnerable"),
        F.count_if(F.col(label) == 0).alias("clean"),
    )
