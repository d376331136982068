"""Byte-level BPE encoding and decoding by DuckDB queries inside the tasks.

Encoding: a text is cut at single spaces between other characters, where the tokenizer's pattern always
begins a new match, and each segment is split by the pattern.  The distinct pieces of a run of texts
become token-position rows (piece, position, id and the right neighbour) of a DuckDB table, at first
one row per byte.  A recursive query keeps the merge that each pair of neighbours would make,
contracts each piece's leftmost pair of minimum rank, and looks the new pairs up in the merge table,
until no piece has a pair left; pieces are then read in order of position.

In a piece of over ``LONG`` bytes several contractions are made in one step: a pair that is the
leftmost minimum within ``reach`` positions on both sides, twice the longest token that the piece's
bytes can form, is contracted before anything outside that window can touch it, because what grows
elsewhere stays one token.  Of equal minima the later ones are contracted with the first where no token that
holds their bytes and that the piece can form has a lower rank, so that nothing new can come between them; where such pairs overlap ("aaaa"),
every second one from the first is taken.  So runs of one sign or of a short unit halve at each step.

Decoding: (row, position, id) rows join the vocabulary, and an ordered aggregate puts the bytes of
each row together.

A Python worker remembers pieces and segments up to fixed numbers and then forgets them; results
do not depend on it.

Defined cases: a NULL text is empty and has no ids; rows keep their id, NULL or repeated; other columns
are ignored.  NULL ids decode to nothing; an id outside the vocabulary makes decoding fail.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import as_text, map_rows, read

#: Pieces and segments whose ids a Python worker remembers; it forgets all of a kind at this number.
PIECES, SEGMENTS = 800_000, 400_000
#: Longest piece or segment that is remembered, so that the memory for them is bounded.
REMEMBERED_CHARS = 48
#: Bytes of new pieces that one recursive query takes, and ids that one decoding query takes.
QUERY_BYTES, QUERY_IDS = 1 << 19, 1 << 20
#: Bytes from which a piece is contracted in several places at once.
LONG = 128

STEPS = """
with recursive step(n, piece, pos, next, id, right_id, merged) as (
    select 0, s.piece, s.pos, s.next, s.id, s.right_id, m.merged
    from start s left join merges m on m.pair = (s.id::bigint << 20) + s.right_id
    union all
    (
        with best as (
            select piece, min((merged::bigint << 32) + pos) as least, arg_min(next, (merged::bigint << 32) + pos) as gone
            from step where merged is not null group by piece
        ), cut as (
            select b.piece, (b.least & 4294967295)::int as pos, b.gone, (b.least >> 32)::int as merged, s.next, s.right_id
            from best b join step s on s.piece = b.piece and s.pos = b.gone
        ), moved as (
            select s.n + 1 as n, s.piece, s.pos,
                case when s.pos = c.pos then c.next else s.next end as next,
                case when s.pos = c.pos then c.merged else s.id end as id,
                case when s.pos = c.pos then c.right_id when s.next = c.pos then c.merged else s.right_id end as right_id,
                s.merged, s.pos = c.pos or coalesce(s.next = c.pos, false) as changed
            from step s join cut c on s.piece = c.piece where s.pos <> c.gone
        )
        select v.n, v.piece, v.pos, v.next, v.id, v.right_id, case when v.changed then m.merged else v.merged end
        from moved v left join merges m on m.pair = case when v.changed then (v.id::bigint << 20) + v.right_id end
    )
)
"""
LONG_STEPS = """
with recursive step(n, piece, pos, id) as (
    select 0, piece, pos, id from start
    union all
    (
        with pairs as (
            select *, lead(id) over (order by pos) as right_id, row_number() over (order by pos) as k from step
        ), ranked as (
            select p.*, m.merged, o.merged is null as plain, (m.merged::bigint << 32) + p.pos as rank
            from pairs p left join merges m on m.pair = (p.id::bigint << 20) + p.right_id left join overruled o on o.merged = m.merged
        ), least as (
            select *, min(rank) over near as low, lag(merged) over (order by k) as before, bool_or(rank is not null) over () as open
            from ranked window near as (order by k rows between {reach} preceding and {reach} following)
        ), chained as (
            select *, max(case when merged is distinct from before then k end) over (order by k) as first, merged = low >> 32 as equal
            from least where open
        ), marked as (
            select *, coalesce(rank = low or (plain and equal and (k - first) % 2 = 0
                and max(case when k = first then equal end) over (partition by first)), false) as best
            from chained
        ), taken as (
            select *, lag(best, 1, false) over (order by k) as gone from marked
        )
        select n + 1, piece, pos, case when best then merged else id end from taken where not gone
    )
)
"""
#: The last state of each piece.
DONE = """, done as (select piece, max(n) as n from step group by piece)
select piece, id from step join done using (piece, n) order by piece, pos
"""


@lru_cache(maxsize=4)
def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank from the content of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Codec:
    """Encoder and decoder of one vocabulary, with a DuckDB connection of its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.segments: dict[str, bytes] = {}
        self.uneven = re.compile(r"\s\s|^\s|\s\Z").search
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        self._load("vocabulary", {"id": pa.array([i for _, i in tokens], pa.int32()), "bytes": pa.array([t.decode("latin-1") for t, _ in tokens])})
        pairs = [
            ((ranks[token[:at]] << 20) + ranks[token[at:]], rank)
            for token, rank in tokens
            for at in range(1, len(token))
            if token[:at] in ranks and token[at:] in ranks
        ]
        self._load("merges", {"pair": pa.array([p for p, _ in pairs], pa.int64()), "merged": pa.array([m for _, m in pairs], pa.int32())})

    def _load(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create or replace temp table {name} as select * from given")
        self.db.unregister("given")

    def _contract(self, pieces: list[bytes], query: str) -> list[np.ndarray]:
        """Ids of each piece, by a recursive query."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        pos = (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32)
        last = np.zeros(len(ids), dtype=bool)
        last[ends - 1] = True
        start = {
            "piece": pa.array(np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)),
            "pos": pa.array(pos),
            "next": pa.array(pos + 1, mask=last),
            "id": pa.array(ids),
            "right_id": pa.array(np.roll(ids, -1), mask=last),
        }
        self._load("start", start)
        found = self.db.sql(query + DONE).to_arrow_table()
        ids = found.column("id").to_numpy().astype("<u4")
        return np.split(ids, np.searchsorted(found.column("piece").to_numpy(), np.arange(1, len(pieces))))

    @cached_property
    def holders(self) -> list[tuple[int, bytes]]:
        """(rank, token of a lower rank that holds the bytes of the one with this rank)."""
        found = set()
        for token, rank in self.ranks.items():
            for start in range(len(token)):
                for end in range(start + 2, len(token) + 1):
                    held = self.ranks.get(token[start:end])
                    if held is not None and held > rank:
                        found.add((held, token))
        return sorted(found)

    def _contract_long(self, piece: bytes) -> bytes:
        own = bytes(set(piece))  # tokens of other bytes cannot come up in this piece
        reach = 2 * max(len(token) for token in self.ranks if not token.strip(own))
        overruled = sorted({held for held, token in self.holders if not token.strip(own)})
        self._load("overruled", {"merged": pa.array(overruled, pa.int32())})
        return self._contract([piece], LONG_STEPS.format(reach=reach))[0].tobytes()

    def _learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Little-endian ids of pieces that are not remembered yet."""
        new: dict[str, bytes] = {}
        waiting: list[tuple[str, bytes]] = []
        room = QUERY_BYTES

        def contract() -> None:
            for (piece, _), ids in zip(waiting, self._contract([raw for _, raw in waiting], STEPS)):
                new[piece] = ids.tobytes()
            waiting.clear()

        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                new[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                new[piece] = self._contract_long(raw)
            else:
                if waiting and len(raw) > room:
                    contract()
                    room = QUERY_BYTES
                waiting.append((piece, raw))
                room -= len(raw)
        if waiting:
            contract()
        return new

    def _ids(self, split: Sequence[Sequence[str]]) -> list[bytes]:
        """Ids of rows of pieces."""
        known = self.pieces
        wanted = set().union(*split)
        new = self._learn(sorted(wanted.difference(known)))
        if len(known) + len(new) > PIECES:
            new |= {piece: known[piece] for piece in wanted.intersection(known)}
            known.clear()
        known |= new
        rows = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for piece in [piece for piece in new if len(piece) > REMEMBERED_CHARS]:
            del known[piece]
        return rows

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        whole, rows, heads = [], [], []
        for text in texts:
            if self.uneven(text):
                heads.append(len(whole))
                whole.append(self.split(text))
                rows.append([])
            else:  # a piece begins at every space, so all but the first segment have a space before
                first, *rest = text.split(" ")
                heads.append(len(whole))
                whole.append(self.split(first))
                rows.append(rest)
        known = self.segments
        wanted = set().union(*rows)
        missing = sorted(wanted.difference(known))
        found = self._ids([*whole, *(self.split(" " + segment) for segment in missing)])
        new = dict(zip(missing, found[len(whole) :]))
        if len(known) + len(new) > SEGMENTS:
            new |= {segment: known[segment] for segment in wanted.intersection(known)}
            known.clear()
        known |= new
        out = [found[head] + b"".join(map(known.__getitem__, row)) for head, row in zip(heads, rows)]
        for segment in [segment for segment in new if len(segment) > REMEMBERED_CHARS]:
            del known[segment]
        return out

    def decode(self, rows: Sequence[bytes]) -> list[bytes]:
        """Bytes of each row of ids."""
        out = [b""] * len(rows)
        start = size = 0
        for at, row in enumerate(rows):
            if at > start and size + len(row) > 4 * QUERY_IDS:
                out[start:at] = self._decode(rows[start:at])
                start, size = at, 0
            size += len(row)
        out[start:] = self._decode(rows[start:])
        return out

    def _decode(self, rows: Sequence[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(rows), dtype="<u4").astype(np.int32)
        sizes = [len(row) // 4 for row in rows]
        out = [b""] * len(rows)
        if not len(ids):
            return out
        self.db.register(
            "given", pa.table({"text": np.repeat(np.arange(len(rows), dtype=np.int32), sizes), "pos": np.arange(len(ids), dtype=np.int32), "id": ids})
        )
        found = self.db.sql(
            "select text, string_agg(bytes, '' order by pos) as bytes, count(*) as n from given join vocabulary using (id) group by text"
        ).to_arrow_table()
        self.db.unregister("given")
        if sum(found.column("n").to_pylist()) != len(ids):
            raise ValueError("an id is not in the vocabulary")
        for text, raw in zip(found.column("text").to_pylist(), found.column("bytes").to_pylist()):
            out[text] = raw.encode("latin-1")
        return out


@lru_cache(maxsize=2)
def codec(content: bytes, pattern: str) -> Codec:
    """One codec per vocabulary and Python worker."""
    return Codec(read_ranks(content), pattern)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, token_ids) of every row; ``ranks_path`` is a rank file that the driver can read."""
    with open(ranks_path, "rb") as file:  # under a megabyte, and the same for every corpus
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def step(ids, texts):
        for doc_id, raw in zip(ids, codec(content.value, pattern).encode(texts)):
            yield doc_id, np.frombuffer(raw, dtype="<i4")

    rows = docs.select(F.col(id_col).cast("long"), as_text(text_col))
    return map_rows(rows, step, "doc_id long, token_ids array<int>")


def decode_documents(rows: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, decoded) with the bytes of each row of ids."""
    with open(ranks_path, "rb") as file:
        content = rows.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [array("i", [i for i in row or () if i is not None]).tobytes() for row in part.column(1).to_pylist()]
                decoded = codec(content.value, pattern).decode(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), ids_col).mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, for every row, in one pass."""
    with open(ranks_path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def step(ids, texts):
        own = codec(content.value, pattern)
        encoded = own.encode(texts)
        for doc_id, raw, text in zip(ids, encoded, own.decode(encoded)):
            yield doc_id, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest()

    rows = docs.select(F.col(id_col).cast("long"), as_text(text_col))
    return map_rows(rows, step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_sha256); fails if ids do not decode to the text they come from."""
    with open(ranks_path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def step(ids, texts):
        own = codec(content.value, pattern)
        encoded = own.encode(texts)
        for doc_id, raw, text, source in zip(ids, encoded, own.decode(encoded), texts):
            if text != source.encode():
                raise ValueError(f"the ids of document {doc_id} decode to another text")
            yield doc_id, len(raw) // 4, np.frombuffer(raw, dtype="<i4"), hashlib.sha256(text).hexdigest()

    rows = docs.select(F.col(id_col).cast("long"), as_text(text_col))
    return map_rows(rows, step, "doc_id long, n_tokens long, token_ids array<int>, decoded_sha256 string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
