"""Token columns and token rows of a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.exprs import opened
from lexmill.operators.languages import by_language, language, lex_by_language


def tokenize(
    df: DataFrame,
    key: str = "func",
    lang: str = "cpp",
    lexer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add the aligned arrays ``tokens`` and ``tags`` for the code in column ``key``."""
    return _with_arrays(df, (lexer or language(lang).lex)(F.col(key)))


def tokenize_mixed(df: DataFrame, key: str = "code", lang_column: str = "lang") -> DataFrame:
    """As :func:`tokenize`, with the language taken from each row."""
    return _with_arrays(df, lex_by_language(F.col(lang_column), F.col(key)))


def _with_arrays(df: DataFrame, pairs: Column) -> DataFrame:
    # Two projections: the pairs are computed once and read twice.
    return (
        df.withColumn("_pairs", pairs)
        .withColumn("tokens", F.col("_pairs.token"))
        .withColumn("tags", F.col("_pairs.tag"))
        .drop("_pairs")
    )


def text_tokens_table(
    df: DataFrame,
    key: str = "code",
    lang: str = "cpp",
    keep_comments: bool = False,
    process_strings: bool = True,
) -> DataFrame:
    """Add ``tokens`` for text modelling; NULL where the source cannot be read."""
    return df.withColumn("tokens", language(lang).tokenize(F.col(key), keep_comments, process_strings))


def rendered(
    df: DataFrame, key: str = "code", lang: str = "cpp", keep_comments: bool = True, process_strings: bool = True
) -> DataFrame:
    """Add ``text``: the code as it is laid out again from its tokens for text modelling and their tags."""
    spec = language(lang)
    pairs = df.withColumn("_pairs", spec.text_pairs(F.col(key), keep_comments, process_strings))
    return pairs.withColumn("text", spec.render(F.col("_pairs"))).drop("_pairs")


def rendered_mixed(df: DataFrame, key: str = "code", lang_column: str = "lang") -> DataFrame:
    """As :func:`rendered`, with the language taken from each row; NULL where a source cannot be read."""
    return df.withColumn("text", by_language(F.col(lang_column), "code_layout", F.col(key)))


def accepted_and_rejected(df: DataFrame, column: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Rows that could be read, and those that could not."""
    return df.where(F.col(column).isNotNull()), df.where(F.col(column).isNull()).drop(column)


def to_long(
    df: DataFrame, *keep: str, tokens: str = "tokens", tags: str = "tags", number: str | None = None
) -> DataFrame:
    """One row per (token, tag) pair with its position; the longer array is cut.

    ``number`` names a column that tells texts apart whose ids are equal: copies of one text stay
    texts of their own when the rows are put together again.  Then a text without tokens has one row
    with a NULL position, so that no text is lost on the way back.
    """
    if number:
        df = df.withColumn(number, F.monotonically_increasing_id())
        keep = (*keep, number)
    shared = F.least(F.size(tokens), F.size(tags))
    pairs = F.arrays_zip(
        F.slice(tokens, F.lit(1), shared).alias("token"), F.slice(tags, F.lit(1), shared).alias("tag")
    )
    opener = F.posexplode_outer if number else F.posexplode
    return df.select(*keep, opener(pairs).alias("pos", "_pair")).select(
        *keep, "pos", "_pair.token", "_pair.tag"
    )


def to_wide(df: DataFrame, *key: str) -> DataFrame:
    """Arrays back from token rows, ordered by position.

    ``key`` must identify one text, so that a group is never larger than a text; where ids repeat,
    the number from :func:`to_long` belongs into it.
    """
    cells = F.when(F.col("pos").isNotNull(), F.struct("pos", "token", "tag"))  # a text without tokens has none
    ordered = F.array_sort(F.collect_list(cells))
    return (
        df.groupBy(*key)
        .agg(ordered.alias("_rows"))
        .select(*key, F.col("_rows.token").alias("tokens"), F.col("_rows.tag").alias("tags"))
    )


def tag_counts(df: DataFrame, *by: str) -> DataFrame:
    """Tokens per tag; counted per task before the shuffle, so common tags stay cheap."""
    return (
        df.select(*by, F.explode(opened(F.col("tags"))).alias("tag"))
        .groupBy(*by, "tag")
        .agg(F.count("*").alias("n"))
    )


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Run a user function over Arrow batches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        return map(fn, batches)

    return df.mapInPandas(run, schema)


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Run a user function over single rows, still sent in batches."""

    def per_batch(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([fn(row) for row in batch.to_dict("records")])

    return map_batches(df, per_batch, schema)
