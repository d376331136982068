"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.ranking import pin

__all__ = ["as_text", "byte_slices", "drop_scratch", "map_rows", "pin", "read", "signed", "slices"]

#: Texts that one Python step holds at a time: rows, and characters unless a single text is longer.
SLICE_ROWS = 512
SLICE_CHARS = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_text(column: str):
    """The column as text; NULL is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that are worked on together."""
    start = chars = 0
    for at, text in enumerate(texts):
        if at > start and (at - start >= SLICE_ROWS or chars + len(text) > SLICE_CHARS):
            yield start, at
            start, chars = at, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def byte_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts in ``column`` have at most ``SLICE_CHARS`` bytes, or of one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for at, size in enumerate(sizes):
        if at > start and total + size > SLICE_CHARS:
            yield batch.slice(start, at - start)
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def map_rows(
    df: DataFrame, step: Callable[[list, list[str]], Iterable[tuple]], schema: str
) -> DataFrame:
    """Rows that ``step(ids, texts)`` gives for runs of rows of ``df``, whose columns are (id, text).

    Runs are bounded (``slices``), so the memory of a Python worker follows the longest text and not
    the partition.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):  # only a slice of the batch is held as Python texts
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for start, end in slices(texts):
                    rows = list(step(ids[start:end], texts[start:end]))
                    if rows:
                        columns = zip(*rows)
                        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                        yield pa.RecordBatch.from_arrays(arrays, names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    types = [to_arrow_type(field.dataType) for field in StructType.fromDDL(schema)]
    return df.mapInArrow(run, schema)


def signed(value: int) -> int:
    """An unsigned 64-bit number as the long with the same bits."""
    return value - (1 << 64) if value >> 63 else value


def drop_scratch(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of pinned tables that no later step reads."""
    hadoop = spark._jsc.hadoopConfiguration()
    for frame in frames:
        for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
