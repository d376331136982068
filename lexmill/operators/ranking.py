"""Dense global positions without a one-partition window."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession) -> str:
    """Fresh path in the shared folder that the session names for checkpoints.

    Only on a local master, where one machine does all work, a temporary folder stands in for it.
    Everything lies in one folder per application, which :func:`drop_scratch` deletes.
    """
    return f"{_scratch_folder(spark)}/table-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application pinned; call it when their results have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _scratch_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if folder is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-checkpoint-"))
        folder = context.getCheckpointDir()
    return f"{folder}/lexmill-{context.applicationId}"


def pin(df: DataFrame, dictionary: bool = True, **options) -> DataFrame:
    """Write ``df`` as a table to the shared folder and go on from there.

    What is read back no longer depends on how rows were placed, so lost executors cannot change
    it, and later filters and column choices reach the files.  For hashes, which hardly repeat, a
    ``dictionary`` of values only costs time.  ``options`` are those of the parquet writer.
    """
    path = scratch_path(df.sparkSession)
    writer = df.write if dictionary else df.write.option("parquet.enable.dictionary", "false")
    writer.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_pinned(pinned: DataFrame, *used: DataFrame) -> None:
    """Delete the table of a frame from :func:`pin` if none of the frames ``used`` reads it."""
    spark, files = pinned.sparkSession, pinned.inputFiles()
    read = {file for frame in used for file in frame.inputFiles()}
    if not files or not read.isdisjoint(files):
        return
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
    scratch = jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    if folder.getParent().toUri().getPath() != scratch.toUri().getPath():
        raise ValueError(f"{folder} is not a pinned table")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def with_rank(
    df: DataFrame, order: list[Column], name: str = "rank", group: str | None = None
) -> DataFrame:
    """Add the zero-based position of each row in a total order.

    The range sort spreads over the cluster.  Only one count per sorted partition is brought
    together, and comes back as a constant array, so the result is a scan with a projection.
    With ``group``, which must be the first sort column and have few values, positions start over
    in each group.
    """
    placed = pin(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).cast("int")
    groups = [group] if group else []
    sizes = placed.groupBy(part.alias("part"), *groups).count().collect()
    rows_of_part = Counter()
    rows_of_group = Counter()
    for row in sizes:
        rows_of_part[row["part"]] += row["count"]
        rows_of_group[row[group] if group else None] += row["count"]
    parts = range(max(rows_of_part, default=0) + 1)
    before_part = accumulate((rows_of_part[p] for p in parts), initial=0)
    offset = F.get(_constants(list(before_part)[:-1]), part)
    rank = offset + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    if group:
        names = sorted(rows_of_group, key=lambda g: str(g).encode())
        starts = accumulate((rows_of_group[g] for g in names), initial=0)
        for value, start in zip(names, starts):
            rank = F.when(F.col(group) == value, rank - start).otherwise(rank) if start else rank
    return placed.withColumn(name, rank).drop("_place")


def _constants(numbers: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{n}L' for n in numbers)})")
