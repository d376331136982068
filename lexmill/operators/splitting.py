"""Seeded train / validation / test splits.

Both splits hash the row key, so a row keeps its split when files are re-read, re-ordered or
extended, and rows with equal keys always stay together (no leak between the splits).  Rows with a NULL
key are one such group.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import fixed
from lexmill.operators.ranking import pin

_STEP = 4  # hex digits resolved per pass: at most 65,536 counters come back


# Rows without a key are one group, like rows of any other key.
_NO_KEY = "\x00"


def _digest(key: Column, seed: str) -> Column:
    named = F.coalesce(key.cast("string"), F.lit(_NO_KEY))
    return F.md5(F.concat(F.lit(seed), named).cast("binary"))


def split_bucket(key: Column, seed: str = "") -> Column:
    """Bucket 0-99 of a key."""
    return F.conv(F.substring(_digest(key, seed), 1, 8), 16, 10).cast("bigint") % 100


def hash_split(df: DataFrame, key: str = "id", seed: str = "") -> DataFrame:
    """80 / 10 / 10 split by hash bucket: one narrow projection, shares are approximate."""
    bucket = split_bucket(F.col(key), seed)
    return df.withColumn(
        "split",
        F.when(bucket < 80, fixed.TRAIN).when(bucket < 90, fixed.VALIDATION).otherwise(fixed.TEST),
    )


def split_sizes(rows: int) -> tuple[int, int, int]:
    """Row counts of the three splits: a fifth is held out, rounded up, and then halved."""
    held = -(-rows // 5)
    test = -(-held // 2)
    return rows - held, held - test, test


def _cut_digest(digests: DataFrame, rank: int) -> str:
    """Smallest digest prefix that splits off the first ``rank`` rows in digest order.

    Radix refinement: each pass counts rows by the next digits below the prefix found so far, so
    only bounded counters leave the executors and no row is sorted or moved.
    """
    prefix = ""
    while True:
        digits = F.substring("digest", len(prefix) + 1, _STEP)
        below = digests.where(F.col("digest").startswith(prefix)) if prefix else digests
        counts = sorted(below.groupBy(digits.alias("d")).count().collect())
        ends = list(accumulate(n for _, n in counts))
        at = bisect_left(ends, rank)
        if at == len(ends):
            return prefix + "g"  # beyond every digest
        before = ends[at - 1] if at else 0
        prefix += counts[at][0]
        if ends[at] == rank or len(prefix) >= 32:
            # The whole group belongs to the left side; "g" sorts after each hex digit.
            return prefix + "g"
        rank -= before


def exact_split(df: DataFrame, key: str = "id", seed: str = "") -> DataFrame:
    """Split with exact sizes in digest order of the key.

    Keys should be unique; copies of one key stay together, and then the sizes are exact up to the
    group of copies at each cut.
    """
    # Written once: the passes below read 32 characters per row, not the corpus again.
    digests = pin(df.select(_digest(F.col(key), seed).alias("digest")))
    train, validation, _ = split_sizes(digests.count())
    first = _cut_digest(digests, train) if train else ""
    second = _cut_digest(digests, train + validation) if train + validation else ""
    digest = _digest(F.col(key), seed)
    return df.withColumn(
        "split",
        F.when(digest < first, fixed.TRAIN).when(digest < second, fixed.VALIDATION).otherwise(fixed.TEST),
    )


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))
