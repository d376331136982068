"""Text corpora of blocks that end with a line of dashes.

A block is a header line, the code lines, and the label as its last line.  A line with 25 dashes in a row is a delimiter as a
whole, whatever else it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import fixed
from lexmill.functions.exprs import let, strip

#: Up to so many files (a path and a number each) their first records are broadcast.
BROADCAST_FILES = 50_000
ACCEPTED, REJECTED = "accepted", "rejected"
_DELIMITER_LINE = rf"\n[^\n]*{fixed.BLOCK_DELIMITER}[^\n]*+"


def block_lines(block: Column) -> Column:
    """Stripped, non-blank lines of one block."""
    return F.filter(F.transform(F.split(block, "\n"), lambda t: strip(t)), lambda t: t != "")


def parse_block(block: Column) -> Column:
    """Code and label of a block as an array of at most one row.

    A block of fewer than three lines gives none; the label is NULL when it is not an integer.
    """

    def row(lines: Column) -> Column:
        label = F.element_at(lines, -1)
        return F.array(
            F.struct(
                F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 2), "\n").alias("code"),
                label.try_cast("int").alias("label"),
                label.alias("label_text"),
            )
        )

    return let(block_lines(block), lambda lines: F.when(F.size(lines) >= 3, row(lines)))


def split_blocks(text: Column) -> Column:
    """Blocks of a text that is held in a column: what lies between its delimiter lines."""
    return F.split(F.concat(F.lit("\n"), text), _DELIMITER_LINE)


def parse_blocks(df: DataFrame, block: str, *keep: str) -> DataFrame:
    """One row per block of at least three lines; shorter blocks are dropped on their own."""
    return df.select(*keep, F.inline(parse_block(F.col(block))))


def accepted_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("label").isNotNull()).drop("label_text")


def rejected_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("label").isNull()).drop("label")


def read_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Blocks of one or more files with the file name as ``vul_type``.

    A line end and 25 dashes separate the records, so one large file is split over many tasks.  Such a record begins with the rest of
    a delimiter line, except the first one of a file, which is told by its place: the least record number where a file begins.  A last block without delimiter is kept.
    """
    files = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    # A folder may stand for a file and hold its parts.
    path = F.col("_metadata.file_path")
    origin = F.when(path.rlike(r"\.txt/[^/]+$"), F.regexp_extract(path, r"([^/]+)\.txt/[^/]+$", 1)).otherwise(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    )
    raw = (
        spark.read.option("lineSep", "\n" + fixed.BLOCK_DELIMITER)
        .text(files)
        .select(
            F.col("_metadata.file_path").alias("path"),
            origin.alias("vul_type"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("record"),
            "value",
        )
    )
    firsts = raw.groupBy("path").agg(F.min(F.when(F.col("block_start") == 0, F.col("record"))).alias("record"))
    firsts = firsts.withColumn("first", F.lit(True))
    # Without the broadcast the records meet by file and number, so a large file is no hot key either.
    firsts = F.broadcast(firsts) if len(raw.inputFiles()) <= BROADCAST_FILES else firsts
    rest = F.regexp_replace("value", r"\A[^\n]*+(?:\n|\z)", "")
    text = F.when(F.col("first"), F.col("value")).otherwise(rest)
    blocks = raw.join(firsts, ["path", "record"], "left").select("vul_type", F.explode(split_blocks(text)).alias("value"))
    return parse_blocks(blocks, "value", "vul_type")
