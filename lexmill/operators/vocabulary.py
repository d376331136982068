"""Vocabularies per namespace, and sequences of ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.operators.ranking import pin, with_rank

PAD, UNKNOWN = 0, 1
# Sequence namespaces keep two ids for padding and unknown terms; labels have neither.
FIRST_ID = {"tokens": 2, "tags": 2, "labels": 0}

# Terms looked up inside the tasks.  Ids follow frequency, so these are the most frequent ones;
# with keys of at most 33 characters the broadcast stays below 70 MB even if each character takes
# four bytes, whatever the corpus.
HEAD_TERMS = 500_000
_KEY_CHARS = 32

#: Items of all sequences after which a block ends: more items share more terms, fewer take less memory.
BLOCK_CELLS = 1 << 22
#: A block is made of many batches, which an executor holds in several copies.
_BATCH_BYTES = 1 << 23


def build_vocabulary(
    df: DataFrame,
    namespaces: dict[str, str] | None = None,
    label: str | None = "label",
    min_count: int = 1,
) -> DataFrame:
    """``(namespace, term, n, term_id)``: ids by falling count, then by term.

    ``namespaces`` maps a namespace to an array column; the arrays of a row are aligned.  Each
    position is opened once for all of them and counted per task before the shuffle, so a term that
    makes up a third of the corpus is one row per task, and the second count sees distinct
    combinations only.
    """
    columns = namespaces or {"tokens": "tokens", "tags": "tags"}
    zipped = F.arrays_zip(*(F.col(c).alias(space) for space, c in columns.items()))
    cells = (
        df.select(F.explode(zipped).alias("c"))
        .groupBy(*(F.col(f"c.{space}").alias(space) for space in columns))
        .agg(F.count("*").alias("n"))
    )
    terms = F.array(
        *(F.struct(F.lit(s).alias("namespace"), F.col(s).alias("term"), "n") for s in columns)
    )
    entries = cells.select(F.inline(terms))
    if label is not None:
        labels = df.groupBy(F.col(label).cast("string").alias("term")).agg(F.count("*").alias("n"))
        entries = entries.unionByName(labels.withColumn("namespace", F.lit("labels")))
    counted = (
        entries.where(F.col("term").isNotNull())
        .groupBy("namespace", "term")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= min_count)
    )
    order = [F.col("namespace"), F.col("n").desc(), F.col("term")]
    first = F.coalesce(
        *(F.when(F.col("namespace") == s, F.lit(i)) for s, i in FIRST_ID.items()), F.lit(2)
    )
    return with_rank(counted, order, "_rank", group="namespace").select(
        "namespace", "term", "n", (F.col("_rank") + first).cast("int").alias("term_id")
    )


def _term_key(term: Column) -> Column:
    """Short stand-in for a term: long literals and comments travel as a digest."""
    digest = F.concat(F.lit("\x00"), F.md5(term.cast("binary")))
    return F.when(F.length(term) > _KEY_CHARS, digest).otherwise(term)


def encode(
    df: DataFrame,
    vocabulary: DataFrame,
    columns: dict[str, tuple[str, str]] | None = None,
    head_terms: int = HEAD_TERMS,
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """Add an id array per sequence column; a term outside the vocabulary gets the unknown id.

    ``columns`` maps a namespace to its input and output column.  The ``head_terms`` lowest ids of each
    namespace are looked up inside the tasks.  Where a namespace has further terms, whatever ids it lacks,
    all of them are taken from one shuffle join.  A NULL term is unknown without any lookup.
    ``keep`` names the columns of ``df`` that the result has beside the ids, all if not given; the join
    writes no others to disk.
    """
    chosen = columns or {"tokens": ("tokens", "token_ids"), "tags": ("tags", "tag_ids")}
    sources = {target: source for source, target in chosen.values()}
    if keep is not None:
        keep = [c for c in keep if c not in sources]
    heads, tails = {}, {}
    for space, (_, target) in chosen.items():
        keyed = vocabulary.where(F.col("namespace") == space).select(
            _term_key(F.col("term")).alias("key"), "term_id"
        )
        head = keyed.orderBy("term_id").limit(head_terms).toArrow()
        heads[target] = _Head(head["key"], head["term_id"])
        last = pc.max(head["term_id"]).as_py()
        # Terms may share the id at the cut: the tail has all of them, also those that the head took.
        tail = keyed.where(F.col("term_id") >= last) if last is not None else keyed.limit(0)
        taken = pc.sum(pc.equal(head["term_id"], last)).as_py() if last is not None else 0
        if head.num_rows == head_terms and tail.limit(taken + 1).count() > taken:
            tails[target] = tail
    if tails:
        return _encode_by_join(df, sources, heads, tails, keep)
    # Only the keys are sent to the lookup.
    lookups = {t: _head_lookup(df, heads[t])(F.transform(source, _term_key)) for t, source in sources.items()}
    looked = df.withColumns(lookups)
    return looked if keep is None else looked.select(*map(_column, [*keep, *sources]))


def _column(name: str) -> Column:
    """A column of that very name, also where it holds a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


class _Head:
    """Known keys and their ids; the hash table over the keys is built once per worker, at its first batch."""

    def __init__(self, keys: pa.ChunkedArray, ids: pa.ChunkedArray) -> None:
        self.keys, self.ids = keys.combine_chunks().cast(pa.string()), ids.combine_chunks().cast(pa.int32())
        self.table: pd.Index | None = None

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "ids": self.ids, "table": None}

    def find(self, asked: pa.Array) -> pa.Array:
        """Ids of distinct keys; NULL where a key is not known."""
        if self.table is None:
            keys = pd.Index(self.keys.to_numpy(zero_copy_only=False))
            repeated = keys.duplicated()
            if repeated.any():  # the first of equal keys counts
                self.ids, keys = self.ids.filter(pa.array(~repeated)), keys[~repeated]
            self.table = keys
        places = self.table.get_indexer(asked.to_numpy(zero_copy_only=False))
        return self.ids.take(pa.array(places, mask=places < 0))


def _head_lookup(df: DataFrame, head: _Head):
    """Ids of known keys; others are unknown."""
    table = df.sparkSession.sparkContext.broadcast(head)

    @F.arrow_udf("array<int>")
    def lookup(sequences: pa.Array) -> pa.Array:
        # Every distinct key of the batch is asked for once.
        asked = sequences.flatten().cast(pa.string()).dictionary_encode()
        settled = pc.fill_null(table.value.find(asked.dictionary), UNKNOWN)
        cells = pc.fill_null(pc.take(settled, asked.indices), UNKNOWN)
        lengths = pc.fill_null(pc.list_value_length(sequences), 0)
        return pa.ListArray.from_arrays(_offsets(lengths), cells, mask=pc.is_null(sequences))

    return lookup


def _offsets(lengths: pa.Array) -> pa.Array:
    """Where the items of each list begin among all items."""
    return pa.array(np.concatenate(([0], np.cumsum(lengths.to_numpy(zero_copy_only=False)))).astype(np.int32))


def _encode_by_join(
    df: DataFrame, sources: dict[str, str], heads: dict[str, _Head], tails: dict[str, DataFrame], keep: list[str] | None
) -> DataFrame:
    """Ids of the heads inside the tasks, all others from one join for all namespaces.

    The rows are written once, packed into blocks: the kept columns, and numbers in place of terms, each term of a block once.  A block
    asks for each term that its heads left open once, however many of its rows hold it, and the answers come back as one list per
    block.  So neither terms nor texts are moved with the rows, and a term that makes up a third of the corpus is asked for once a block.
    """
    shaped = df.withColumns({target: F.lit(None).cast("array<int>") for target in sources})
    kept = [c for c in shaped.columns if c not in sources] if keep is None else keep
    order = shaped.columns if keep is None else [*kept, *sources]
    table = df.sparkSession.sparkContext.broadcast(heads)
    numbers = {target: f"{number} " for number, target in enumerate(tails)}
    taken = [*map(_column, kept), *map(F.col, sources.values())]
    packed = df.select(*(c.alias(f"_{i}") for i, c in enumerate(taken))).mapInArrow(
        _packer(table, list(sources), numbers, BLOCK_CELLS), "rows binary, keys array<string>"
    )
    # Few and long rows: the writer looks at its memory at each of them.
    parquet = {"parquet.block.size": 1 << 25, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    with _batches_of(df.sparkSession, _BATCH_BYTES):
        blocks = pin(
            packed.withColumn("_block", F.monotonically_increasing_id()), dictionary=False, compression="zstd", **parquet
        )
    terms = reduce(
        DataFrame.unionByName,
        (tail.select(F.concat(F.lit(numbers[t]), "key").alias("key"), "term_id") for t, tail in tails.items()),
    )
    # About one block per task, so what a task holds doesn't grow with the corpus.
    tasks = max(blocks.count(), 1)
    asked = blocks.select("_block", F.posexplode("keys").alias("place", "key"))
    answers = (
        asked.join(terms, "key")
        .select("_block", "place", "term_id")
        .repartition(tasks, "_block")
        .groupBy("_block")
        .agg(F.collect_list(F.struct("place", "term_id")).alias("answers"))
    )
    answered = blocks.select("_block", "rows").repartition(tasks, "_block").join(answers, "_block", "left")
    schema = StructType([shaped.schema[c] for c in [*kept, *sources]])
    return answered.select("rows", "answers").mapInArrow(_unpacker(len(kept)), schema).select(*map(_column, order))


@contextmanager
def _batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Send about ``size`` bytes at once to the Python workers of the jobs that run meanwhile."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _short_keys(terms: pa.Array) -> pa.Array:
    """As :func:`_term_key`."""
    long = pc.greater(pc.utf8_length(terms), _KEY_CHARS)
    digests = ["\x00" + hashlib.md5(t.encode()).hexdigest() for t in terms.filter(long).to_pylist()]
    return pc.replace_with_mask(terms, long, pa.array(digests, pa.string()))


def _packer(table, targets: list[str], numbers: dict[str, str], most: int):
    """Blocks of rows from batches whose last columns are the sequences.

    ``rows`` of a block is an Arrow stream: the other columns, and lists that point into the ids of the block's terms.  Ids that the
    tails may hold are NULL there; ``keys`` has their keys in the same order.
    """

    def coded(sequences: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        lengths = pc.fill_null(pc.list_value_length(sequences), 0)
        return sequences.flatten().cast(pa.string()).dictionary_encode(), lengths, pc.is_null(sequences)

    def numbered(parts: list[tuple[pa.Array, pa.Array, pa.Array]], target: str) -> tuple[pa.Array, pa.Array]:
        terms, lengths, missing = zip(*parts)
        terms = pa.chunked_array(terms).unify_dictionaries().combine_chunks()
        keys = _short_keys(terms.dictionary)
        ids = table.value[target].find(keys)
        if target in numbers:
            rest = pc.binary_join_element_wise(numbers[target], keys.filter(pc.is_null(ids)), "")
        else:
            ids, rest = pc.fill_null(ids, UNKNOWN), keys.slice(0, 0)
        cells = pa.DictionaryArray.from_arrays(terms.indices, ids)
        return pa.ListArray.from_arrays(_offsets(pa.concat_arrays(lengths)), cells, mask=pa.concat_arrays(missing)), rest

    def block(parts: list[tuple[list[pa.Array], list]]) -> pa.RecordBatch:
        others, sequences = (list(zip(*columns)) for columns in zip(*parts))
        lists, keys = zip(*map(numbered, sequences, targets))
        columns = [*map(pa.concat_arrays, others), *lists]
        rows = pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(rows)
        asked = pa.concat_arrays(keys)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(asked)], pa.int32()), asked),
            ],
            ["rows", "keys"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            others = batch.num_columns - len(targets)
            # Copies, which don't keep the memory of the whole batch.
            every = pa.array(np.arange(batch.num_rows))
            sequences = [coded(c) for c in batch.columns[others:]]
            parts.append(([c.take(every) for c in batch.columns[:others]], sequences))
            held += sum(len(terms) for terms, *_ in sequences)
            if held >= most:
                yield block(parts)
                parts, held = [], 0
        if parts:
            yield block(parts)

    return pack


def _unpacker(others: int):
    """Rows of blocks, with the answers to their keys filled in; a key without an answer is unknown."""

    def filled(lists: pa.Array, ids: np.ndarray) -> pa.Array:
        cells = pc.fill_null(pa.array(ids).take(lists.values.indices), UNKNOWN)
        return pa.ListArray.from_arrays(lists.offsets, cells, mask=pc.is_null(lists))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (rows,) = pa.ipc.open_stream(batch.column(0)[i].as_buffer())
                tables = [lists.values.dictionary for lists in rows.columns[others:]]
                ids = pa.concat_arrays(tables)
                known = pc.fill_null(ids, UNKNOWN).to_numpy().copy()
                given = batch.column(1).slice(i, 1).flatten()
                # The lowest id of a key counts, as in the heads.
                numbers = given.field("term_id").cast(pa.int32()).to_numpy()
                falling = np.argsort(-numbers.astype(np.int64), kind="stable")
                places = np.flatnonzero(pc.is_null(ids).to_numpy(zero_copy_only=False))
                known[places[given.field("place").to_numpy()[falling]]] = numbers[falling]
                ends = np.cumsum([len(t) for t in tables])
                own = map(filled, rows.columns[others:], np.split(known, ends[:-1]))
                yield pa.RecordBatch.from_arrays([*rows.columns[:others], *own], [str(k) for k in range(rows.num_columns)])

    return unpack
