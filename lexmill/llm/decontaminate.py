"""Benchmark passages in documents, by the q-gram lemma over diagonal bands and banded alignment.

Benchmark items and documents are lower-cased, runs of blanks become one space, and both are compared as
UTF-8 bytes.  An item is a pattern as a whole; an item of over ``PATTERN + STRIDE`` bytes is cut into
overlapping patterns of ``PATTERN`` bytes, so that a part of it is found as well.  A pattern of n bytes has an edit budget
e of ``rate * n``; any occurrence within it shares at least n - q + 1 - q * e of the pattern's q-grams,
all on diagonals at most 2e apart.  Shared q-grams are counted in bands of 2 * (2e + 1) diagonals that
overlap by half, bands that meet the bound are kept, and banded alignment decides.  Nothing that is
within the budget is lost by the filter.

The benchmark index is broadcast.  Its size is checked first: a larger benchmark is worked on in parts of about
``PART_BYTES``, one pass over the documents each.

Defined cases: NULL and empty texts contain nothing; a NULL or blank item matches nothing; an item shorter than q
must occur literally; items with equal texts are all reported; rows with equal ids are reported once
per item with the fewest edits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import as_text, map_rows, read

#: q bytes are one unsigned 64-bit number.
Q = 8
EDIT_RATE = 0.08
PATTERN, STRIDE = 160, 80
PART_BYTES = 8 << 20
#: Document bytes whose shared q-grams are counted together.
CHUNK = 1 << 16
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str) -> bytes:
    return " ".join(text.lower().replace("\0", " ").split()).encode()


def edit_budget(size: int, rate: float) -> int:
    """Edits allowed for a pattern, so that the lemma's bound stays at least one."""
    return max(0, min(int(size * rate), (size - Q) // Q))


def align(pattern: np.ndarray, text: np.ndarray, width: int, budget: int) -> int:
    """Fewest edits of the pattern against any part of the text on its first ``width`` diagonals.

    Stops with a number over the budget once no alignment can stay within it.
    """
    steps = np.arange(width)
    padded = np.concatenate([text, np.zeros(max(0, len(pattern) + width - len(text)), dtype=np.uint8)])
    row = np.zeros(width, dtype=np.int64)
    for at, byte in enumerate(pattern):
        best = row + (padded[at : at + width] != byte)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best[-1] = min(best[-1], row[-1] + 1)
        row = np.minimum.accumulate(best - steps) + steps
        if at % 16 == 15 and row.min() > budget:
            break
    return int(row.min())


class Index:
    """Patterns of one part of the benchmark and where their q-grams stand."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float) -> None:
        self.items: list[int] = []
        self.patterns: list[np.ndarray] = []
        self.short: list[tuple[int, bytes]] = []
        for item, text in items:
            if len(text) < Q:
                if text:
                    self.short.append((item, text))
                continue
            starts = range(0, len(text) - PATTERN + 1, STRIDE) if len(text) > PATTERN + STRIDE else ()
            cuts = [text[at : at + PATTERN] for at in starts] or [text]
            if starts and (len(text) - PATTERN) % STRIDE:
                cuts.append(text[-PATTERN:])
            self.items += [item] * len(cuts)
            self.patterns += [np.frombuffer(cut, dtype=np.uint8) for cut in cuts]
        sizes = np.array([len(p) for p in self.patterns], dtype=np.int64)
        self.sizes = sizes
        self.edits = np.array([edit_budget(n, rate) for n in sizes.tolist()], dtype=np.int64)
        self.needed = sizes - Q + 1 - Q * self.edits
        self.band = 2 * self.edits + 1
        self.reach = int((sizes + 2 * self.edits).max(initial=0)) + Q
        #: A region with enough q-grams has a 64-byte block with at least so many.
        self.dense = int((-(-self.needed // ((sizes + self.edits) // 64 + 2))).min(initial=64))
        grams = [np.lib.stride_tricks.sliding_window_view(p, Q) for p in self.patterns]
        values = np.concatenate([np.ascontiguousarray(g).view("<u8").ravel() for g in grams] or [np.empty(0, "<u8")])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] or [np.empty(0, np.int64)])
        order = np.argsort(values, kind="stable")
        self.values, first, counts = np.unique(values[order], return_index=True, return_counts=True)
        self.first, self.counts = first, counts
        self.owner, self.place = owner[order], place[order]
        self.bloom = np.zeros(1 << _BITS, dtype=bool)
        self.bloom[self._slot(self.values)] = True

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return (values * _MIX) >> np.uint64(64 - _BITS)

    def hits(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Sorted positions whose q-gram is in the index, and which one."""
        found, which = [], []
        for offset in range(min(Q, len(buffer) - Q + 1)):
            values = np.frombuffer(buffer, dtype="<u8", count=(len(buffer) - offset) // Q, offset=offset)
            at = np.flatnonzero(self.bloom[self._slot(values)])
            gram = np.searchsorted(self.values, values[at])
            gram[gram == len(self.values)] = 0
            same = self.values[gram] == values[at]
            found.append(at[same] * Q + offset)
            which.append(gram[same])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found, which = np.concatenate(found), np.concatenate(which)
        order = np.argsort(found, kind="stable")
        return found[order], which[order]

    def regions(self, positions: np.ndarray, grams: np.ndarray) -> Iterator[tuple[int, int]]:
        """(pattern, first diagonal) of bands that meet the lemma's bound."""
        blocks = positions >> 6
        base = blocks[0] if len(blocks) else 0
        full = np.bincount(blocks - base) >= self.dense if len(blocks) else np.zeros(0, dtype=bool)
        if not full.any():
            return
        # Only what lies near a dense block can be part of a region.
        wide = self.reach // 64 + 2
        near = np.convolve(full, np.ones(2 * wide + 1, dtype=np.int32))[wide : wide + len(full)] > 0
        keep = near[blocks - base]
        positions, grams = positions[keep], grams[keep]
        counts = self.counts[grams]
        starts = np.repeat(self.first[grams] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        pattern = self.owner[starts]
        diagonal = np.repeat(positions, counts) - self.place[starts] + self.reach
        key = (pattern << 40) | diagonal // self.band[pattern]
        bands, shared = np.unique(key, return_counts=True)
        after = np.append(bands[1:] == bands[:-1] + 1, False)
        both = shared + np.where(after, np.append(shared[1:], 0), 0)
        # A band pair may also begin one band earlier, with nothing in it: then the next pair has all.
        for band in bands[both >= self.needed[bands >> 40]].tolist():
            yield band >> 40, (band & ((1 << 40) - 1)) * int(self.band[band >> 40]) - self.reach

    def width(self, pattern: int) -> int:
        """Diagonals of two neighbouring bands with the edit budget on both sides."""
        return 2 * int(self.band[pattern]) + 2 * int(self.edits[pattern])

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text, item, fewest edits) of every occurrence within the budget, once per text and item."""
        buffer = b"\0".join(texts) + b"\0" * Q
        raw = np.frombuffer(buffer, dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        best: dict[tuple[int, int], int] = {}
        edited: list[tuple[tuple[int, int], int, int]] = []
        positions, grams = self.hits(buffer)

        def region(text: int, pattern: int, low: int) -> tuple[int, int, int]:
            """Bounds of the band's bytes in the text, and how many bytes it begins before the text."""
            end = low + len(self.patterns[pattern]) + self.width(pattern)
            first, last = int(ends[text]) - 1 - len(texts[text]), int(ends[text]) - 1
            return max(first, low), max(first, min(last, end)), max(0, first - low)

        for start in range(0, len(buffer), CHUNK):
            low, high = np.searchsorted(positions, (start, start + CHUNK + 2 * self.reach))
            for pattern, diagonal in self.regions(positions[low:high], grams[low:high]):
                low_at = diagonal - int(self.edits[pattern])
                span = (max(0, low_at), low_at + len(self.patterns[pattern]) + self.width(pattern))
                first, last = np.searchsorted(ends, span, side="right")
                for text in range(first, min(last + 1, len(texts))):
                    key = (text, self.items[pattern])
                    begin, end, _ = region(text, pattern, low_at)
                    if self.patterns[pattern].tobytes() in buffer[begin:end]:
                        best[key] = 0
                    elif best.get(key) != 0:
                        edited.append((key, pattern, low_at))
        for key, pattern, low_at in edited:
            budget = best.get(key, int(self.edits[pattern]) + 1) - 1
            budget = min(budget, int(self.edits[pattern]))
            if budget > 0:
                begin, end, ahead = region(key[0], pattern, low_at)
                # Where a text begins inside the band, bytes that match nothing stand before it.
                part = np.concatenate([np.zeros(ahead, dtype=np.uint8), raw[begin:end]])
                edits = align(self.patterns[pattern], part, self.width(pattern) + 1, budget)
                if edits <= budget:
                    best[key] = edits
        for item, word in self.short:
            for text, raw_text in enumerate(texts):
                if word in raw_text:
                    best[text, item] = 0
        yield from ((text, item, edits) for (text, item), edits in best.items())


def find_passages(
    docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, edits) for each document and each benchmark item found in it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long"), as_text(text_col))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), as_text("text").alias("text")).where("item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    found = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()  # about PART_BYTES, as counted above
        index = spark.sparkContext.broadcast(Index([(r["item_id"], normalised(r["text"])) for r in own], rate))

        def step(ids, texts, index=index):
            for text, item, edits in index.value.search([normalised(t) for t in texts]):
                yield ids[text], item, edits

        hits = map_rows(rows, step, "doc_id long, item_id long, edits int")
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it holds."""
    return find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
