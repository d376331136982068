"""Near-duplicate texts by SimHash: bit-sliced comparison inside blocks of similar fingerprints.

A fingerprint has bit i set if over half of the hashes of the text's word shingles have it.  Texts
whose fingerprints differ in at most ``radius`` bits are linked; groups are what links connect.

Only distinct fingerprints are compared.  With ``blocks`` = radius + 2 parts of the 64 bits, two of
them agree wherever at most ``radius`` bits differ, so each fingerprint is dealt to one bucket per pair of parts.
Inside a bucket the fingerprints stand vertically: word w of plane i holds bit i of 64 of them.  One
fingerprint is compared with 64 at a time: the differing bits of each plane are added into carry-save
counters, and a word is abandoned once all 64 exceed the radius.  A bucket beyond ``TILE``
fingerprints is dealt into tiles and every two tiles are compared in a task of their own.  Each task
gives the links of a spanning forest, at most one per fingerprint, and never all pairs.

Defined cases: a NULL or empty text has no words and fingerprint zero, linked like any other; fewer words than a shingle give
one shingle of all words; rows with a NULL id get a group but never name it (a group of such rows
only has a NULL name); repeated rows are rows of the same group; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import as_text, map_rows, pin, read, signed
from lexmill.llm.components import components

SEED = 42
BITS = 64
#: Fingerprints of one bucket that a task takes at a time.
TILE = 4096
#: (fingerprint, word) comparisons that are in memory together.
STRIP = 1 << 15
#: Shingles whose bits are counted together.
SHINGLES = 1 << 16


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of the text's word shingles; ASCII letters are lower-cased and ASCII blanks separate."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[at:] for at in range(width))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=">u8", count=len(words) - width + 1)
    count = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES):
        part = hashes[at : at + SHINGLES]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as the long with the same bits."""

    def step(ids, texts):
        return [(doc_id, signed(fingerprint(text, width))) for doc_id, text in zip(ids, texts)]

    return map_rows(docs.select(F.col(id_col).cast("long"), as_text(text_col)), step, "doc_id long, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit i of value j is bit j % 64 of word j // 64 of plane i."""
    words = -(-len(values) // BITS)
    bits = np.zeros((words * BITS, BITS), dtype=np.uint8)
    bits[: len(values)] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is over the radius."""
    over = np.zeros_like(counters[0])
    equal = ~over
    for place in reversed(range(len(counters))):
        if radius >> place & 1:
            equal &= counters[place]
        else:
            over |= equal & counters[place]
            equal &= ~counters[place]
    return over


def forest(values: np.ndarray, ends: np.ndarray, radius: int) -> np.ndarray:
    """For each value the first value it is connected to; ``ends[i]`` is where the bucket of i ends."""
    planes = bit_planes(values)
    label = np.arange(len(values))
    own = label // BITS
    sizes = np.where(ends > label + 1, (ends - 1) // BITS - own + 1, 0)
    stops = np.cumsum(sizes)
    start = 0
    while start < len(values):
        base = stops[start] - sizes[start]
        end = max(start + 1, int(np.searchsorted(stops, base + STRIP, side="right")))
        query = np.repeat(np.arange(start, end), sizes[start:end])
        word = np.arange(len(query)) - np.repeat(stops[start:end] - sizes[start:end] - base, sizes[start:end]) + own[query]
        start = end
        # Only later values of the same bucket count; other lanes are over from the start.
        low = np.clip(query + 1 - word * BITS, 0, BITS).astype(np.uint64)
        high = np.clip(word * BITS + BITS - ends[query], 0, BITS).astype(np.uint64)
        ones = np.uint64(2**64 - 1)
        valid = np.where(low < BITS, ones << (low % np.uint64(BITS)), np.uint64(0))
        valid &= np.where(high < BITS, ones >> (high % np.uint64(BITS)), np.uint64(0))
        over = ~valid
        counters = [np.zeros_like(over) for _ in range((radius + 1).bit_length())]
        for place in range(BITS):
            bit = (values[query] >> np.uint64(place)) & np.uint64(1)
            differ = planes[place][word] ^ (np.uint64(0) - bit)
            for counter in counters:
                carry = counter & differ
                counter ^= differ
                differ = carry
            over |= differ
            if place % 8 == 7:
                live = (over | _exceeds(counters, radius)) != ones
                query, word, over = query[live], word[live], over[live]
                counters = [counter[live] for counter in counters]
        near = ~(over | _exceeds(counters, radius))
        lanes = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(lanes)
        _connect(label, query[row], word[row] * BITS + lane)
    return _settled(label)


def _settled(label: np.ndarray) -> np.ndarray:
    while True:
        further = label[label]
        if np.array_equal(further, label):
            return label
        label[:] = further


def _connect(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Let linked values have the smallest label among them."""
    while len(left):
        _settled(label)
        a, b = label[left], label[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside each bucket of sorted rows (bucket columns, then fp)."""
    kept: pa.Table | None = None

    def links(table: pa.Table) -> pa.RecordBatch:
        values = table.column("fp").to_numpy().view(np.uint64)
        change = np.zeros(len(values), dtype=bool)
        for name in ("parts", "key", "tile", "other"):
            column = table.column(name).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts, len(values))[np.searchsorted(starts, np.arange(len(values)), side="right")]
        first = forest(values, ends, radius)
        hung = np.flatnonzero(first != np.arange(len(values)))
        return pa.RecordBatch.from_arrays(
            [pa.array(values[hung].view(np.int64)), pa.array(values[first[hung]].view(np.int64))], names=["a", "b"]
        )

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        last = tuple(table.column(name)[-1].as_py() for name in ("parts", "key", "tile", "other")) if table.num_rows else ()
        # The last bucket may go on in the next batch.
        cut = table.num_rows
        columns = [table.column(name).to_numpy() for name in ("parts", "key", "tile", "other")] if cut else []
        if cut:
            same = np.logical_and.reduce([c == v for c, v in zip(columns, last)])
            cut = int(np.argmax(same))
        kept = table.slice(cut)
        if cut:
            yield links(table.slice(0, cut))
    if kept is not None and kept.num_rows:
        yield links(kept)


def buckets(fp: Column, radius: int) -> Column:
    """One (parts, key) for each choice of two of ``radius + 2`` parts of the fingerprint."""
    bounds = [BITS * at // (radius + 2) for at in range(radius + 3)]
    masks = [((1 << high) - 1) & ~((1 << low) - 1) for low, high in zip(bounds, bounds[1:])]
    chosen = [signed(a | b) for a, b in combinations(masks, 2)]
    return F.array(*(F.struct(F.lit(at).alias("parts"), fp.bitwiseAND(F.lit(mask)).alias("key")) for at, mask in enumerate(chosen)))


def link_fingerprints(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect what fingerprints within ``radius`` bits connect; ``distinct`` has fp."""
    dealt = distinct.select("fp", F.explode(buckets(F.col("fp"), radius)).alias("bucket")).select("fp", "bucket.*")
    large = pin(dealt.groupBy("parts", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE))
    tiled = dealt.join(large, ["parts", "key"], "left").withColumn("tiles", F.ceil(F.coalesce("n", F.lit(1)) / TILE).cast("int"))
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = tiled.select("parts", "key", "fp", "own", every.alias("with"))
    rows = tiled.select("parts", "key", F.least("own", "with").alias("tile"), F.greatest("own", "with").alias("other"), "fp")
    keys = ("parts", "key", "tile", "other")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return rows.mapInArrow(lambda batches: _compare(batches, radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2
) -> DataFrame:
    """(doc_id, fp, component_id) of every row; the component is named by its smallest id."""
    marked = pin(fingerprints(docs, id_col, text_col, width))
    distinct = pin(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = pin(components(link_fingerprints(distinct.select("fp"), radius)))
    rooted = pin(
        distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    )
    names = pin(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = pin(rooted.join(names, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
