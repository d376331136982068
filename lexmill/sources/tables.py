"""JSON and parquet corpora, and saved split tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.columns import constant_label, union_all

REVEAL_SCHEMA = "code string, hash string, project string, size bigint"


def read_labelled_json(
    spark: SparkSession,
    paths_by_label: Mapping[int, str | list[str]],
    schema: str = REVEAL_SCHEMA,
    lines: bool = False,
) -> DataFrame:
    """Union of JSON files, one class per entry, with the class as ``label``.

    A file that holds one JSON array can only be read by one task each; ``lines=True`` reads
    line-delimited JSON, which splits.
    """
    return union_all(
        *(
            constant_label(
                spark.read.schema(schema).json(paths, multiLine=not lines, mode="FAILFAST"), label
            )
            for label, paths in paths_by_label.items()
        )
    )


def read_presplit(
    spark: SparkSession,
    root: str,
    splits: Iterable[str] = ("train", "validation", "test"),
    fmt: str = "parquet",
    schema: str | None = None,
) -> DataFrame:
    """Union of one exported folder or file per split, with its name as ``split``."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    return union_all(
        *(reader.load(f"{root}/{name}").withColumn("split", F.lit(name)) for name in splits)
    )


def save_splits(df: DataFrame, path: str, mode: str = "overwrite", by: str = "split") -> None:
    """Write one folder per split."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def load_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read a saved table; a split is chosen by its folder."""
    table = spark.read.parquet(path)
    return table if split is None else table.where(F.col("split") == split)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when the last write to ``path`` was committed."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def build_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], by: str = "split") -> DataFrame:
    """Saved table at ``path``; built and written first unless a committed one is there."""
    if not is_complete(spark, path):
        save_splits(build(), path, by=by)
    return load_split(spark, path)
