"""Column choice, label handling and unions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns:
        raise ValueError(f"no column {old!r} in {df.columns}")
    return df.withColumnRenamed(old, new)


def cast_label(df: DataFrame, column: str = "label", to: str = "tinyint") -> DataFrame:
    """Cast to a small integer; what does not fit becomes NULL instead of stopping the job."""
    return df.withColumn(column, F.col(column).try_cast(to))


def constant_label(df: DataFrame, value: int, column: str = "label") -> DataFrame:
    return df.withColumn(column, F.lit(value))


def rewrite_column(df: DataFrame, column: str, *steps: Callable[[Column], Column]) -> DataFrame:
    """Apply text functions to one column in order; they fuse into one projection."""
    return df.withColumn(column, reduce(lambda c, step: step(c), steps, F.col(column)))


def choose_columns(df: DataFrame, chosen: Mapping[str, str]) -> DataFrame:
    """Select and rename by a mapping of output name to input name."""
    return df.select(*(F.col(source).alias(name) for name, source in chosen.items()))


def union_all(*tables: DataFrame) -> DataFrame:
    """Bag union by column name; a column that a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def typed_label(label: Column, mode: str = "string") -> Column:
    """Label as text (``string``), as integer or an error (``strict``), or integer or NULL (``lenient``).

    A NULL label stays NULL in every mode.
    """
    if mode == "string":
        return label.cast("string")
    if mode == "strict":
        return label.cast("int")
    if mode == "lenient":
        return label.try_cast("int")
    raise ValueError(f"unknown label mode {mode!r}")


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Give heavy per-row work at least ``per_core`` partitions per core when the input files are few.

    For scans: a frame with joins would have to run them to know its partitions.  Inputs that
    already come in many splits are left alone, so there is no shuffle at scale.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
