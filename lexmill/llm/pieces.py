"""SentencePiece encoding and decoding with the source bytes of every piece.

A text is first normalised: at each place the longest prefix that the model's compiled character map knows is
replaced, blanks are handled and escaped as the model says, and every character of the result remembers the source byte
that it came from.  The result is cut where no piece of the vocabulary reaches across (before blanks), and each chunk is merged by
falling score, leftmost first, over a heap, so that a long chunk of n characters takes n log n steps; the distinct words of a run of texts are
merged together in one array, and a worker remembers them up to a fixed number.  Running sums of piece lengths, looked up in the remembered places, give
the source span [begin, end) of every piece.  Characters outside the vocabulary become one piece per byte; the last of these has the
character's span, the others an empty one.

Models of type BPE with normal, control, unknown and byte pieces are read; other kinds raise an error.

Defined cases: a NULL text is an empty text, which has only the begin and end ids; NULL ids and repeated rows are kept as they are;
a very long text, also one without blanks, is one chunk list of its task; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import as_text, byte_slices, read

#: Chunks that a worker remembers (besides those of one run of texts), and characters of a run.
CHUNKS, RUN_CHARS = 200_000, 1 << 20
#: Characters of a chunk that is merged together with others and remembered; longer ones have a heap of their own.
WORD_CHARS = 40
INF = float("inf")
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in the model file


@dataclass(frozen=True)
class Spec:
    """What a model file says."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip: bool = False
    escape: bool = True
    byte_fallback: bool = True
    unknown_surface: str = " ⁇ "


def read_model(content: bytes) -> Spec:
    """The model of a file's bytes (on the driver)."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(content)
    rule, trainer = model.normalizer_spec, model.trainer_spec
    kinds = tuple(p.type for p in model.pieces)
    if trainer.model_type != trainer.BPE or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE models without user-defined or unused pieces are read")
    if trainer.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
        raise ValueError("models with blanks as suffix or a denormaliser are not read")
    return Spec(
        tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), kinds, rule.precompiled_charsmap,
        rule.add_dummy_prefix, rule.remove_extra_whitespaces, rule.escape_whitespaces, trainer.byte_fallback, trainer.unk_surface,
    )


def read_charsmap(blob: bytes) -> dict[str, str]:
    """What a compiled character map replaces by what.

    The blob is the size of a double-array trie, its 32-bit units, and the replacements, each ended by a zero byte.  All nodes of one
    depth are opened at a time: a child by byte b of the node with base p is the unit at p xor b, if that unit is labelled b.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").astype(np.int64)
    pool = blob[4 + size :]

    def base(place: np.ndarray) -> np.ndarray:
        unit = units[place]
        return place ^ ((unit >> 10) << ((unit & 512) >> 6))

    found: dict[str, str] = {}
    keys, bases = [b""], base(np.zeros(1, dtype=np.int64))
    while keys:
        child = bases[:, None] ^ np.arange(1, 256)
        label = units[np.minimum(child, len(units) - 1)] & 0x800000FF
        node, byte = np.nonzero((child < len(units)) & (label == np.arange(1, 256)))
        places = child[node, byte]
        keys = [keys[n] + bytes([b + 1]) for n, b in zip(node, byte)]
        bases = base(places)
        for key, unit, leaf in zip(keys, units[places], bases):
            if unit >> 8 & 1:
                at = int(units[leaf] & 0x7FFFFFFF)
                found[key.decode()] = pool[at : pool.index(b"\0", at)].decode()
    return found


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


class Normalizer:
    """Normalised text, and for each of its characters (and its end) the byte of the source that it comes from."""

    def __init__(self, spec: Spec) -> None:
        self.spec = spec
        self.map = read_charsmap(spec.charsmap)
        self.longest = max(map(len, self.map), default=0)
        heads = "".join(sorted({key[0] for key in self.map}))
        self.heads = re.compile(f"[{re.escape(heads)}]") if heads else None

    def _prefix(self, text: str, at: int) -> tuple[str, int] | None:
        """Replacement and length of the longest key that the text has at a place."""
        for size in range(min(self.longest, len(text) - at), 0, -1):
            new = self.map.get(text[at : at + size])
            if new is not None:
                return new, size
        return None

    def _mapped(self, text: str) -> tuple[str, np.ndarray, int]:
        """The text with all keys replaced, the source character of each new one, and how many blanks lead."""
        lead = 0
        while self.spec.strip and lead < len(text):
            new, size = (self.heads and self._prefix(text, lead)) or (text[lead], 1)
            if new != " ":
                break
            lead += size
        if self.heads is None:
            return text, np.arange(len(text)), lead
        parts, places, at = [], [], 0
        for found in self.heads.finditer(text):
            start = found.start()
            key = self._prefix(text, start) if start >= at else None
            if key is None:
                continue
            parts += [text[at:start], key[0]]
            places += [np.arange(at, start), np.full(len(key[0]), start)]
            at = start + key[1]
        parts.append(text[at:])
        places.append(np.arange(at, len(text)))
        return "".join(parts), np.concatenate(places), lead

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        byte_of = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        mapped, places, lead = self._mapped(text)
        end = len(text)
        if lead == len(text):
            return "", np.array([len(raw)])
        if self.spec.strip:
            points = _points(mapped)
            blank = points == 32
            kept = ~(blank & np.concatenate(([True], blank[:-1])))
            # Escaped blanks at the end go as well, whether or not the source has them as such.
            closing = blank | (points == ord(BLANK)) if self.spec.escape else blank
            last = np.flatnonzero(kept & ~closing)
            stop = last[-1] + 1 if len(last) else 0
            cut = np.flatnonzero(kept[stop:])
            end = places[stop + cut[0]] if len(cut) else end
            kept[stop:] = False
            mapped, places = points[kept].tobytes().decode("utf-32-le"), places[kept]
            if not len(places) and self.spec.dummy_prefix:  # the added blank is one at the end
                return "", byte_of[[lead]]
        if self.spec.dummy_prefix:
            mapped, places = " " + mapped, np.concatenate(([lead], places))
        return mapped.replace(" ", BLANK) if self.spec.escape else mapped, byte_of[np.append(places, end)]


class Codec:
    """Encoder and decoder of one model; ``encode`` gives ids and byte spans, ``decode`` takes ids."""

    def __init__(self, spec: Spec) -> None:
        self.spec = spec
        self.normalize = Normalizer(spec)
        self.ids = {piece: at for at, piece in enumerate(spec.pieces)}
        self.cost = {p: -s for p, s, kind in zip(spec.pieces, spec.scores, spec.kinds) if kind == NORMAL}
        self.unknown = spec.kinds.index(UNKNOWN)
        self.begin, self.end = self.ids["<s>"], self.ids["</s>"]
        apart = not any(re.search(f"[^{BLANK}]{BLANK}", piece) for piece in self.cost)
        self.chunk = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+" if apart else "(?s:.+)")
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.characters = np.full(0x110000, -1, dtype=np.int64)
        for piece, at in self.ids.items():
            if len(piece) == 1:
                self.characters[ord(piece)] = at
        joins = sorted(
            (self.ids[piece[:k]] * len(spec.pieces) + self.ids[piece[k:]], cost, self.ids[piece])
            for piece, cost in self.cost.items() for k in range(1, len(piece)) if piece[:k] in self.ids and piece[k:] in self.ids
        )
        keys, costs, joined = zip(*joins) if joins else ((-1,), (INF,), (0,))
        self.pairs, self.pair_cost, self.pair_id = np.array(keys, dtype=np.int64), np.array(costs), np.array(joined, dtype=np.int64)
        self.control = np.array(spec.kinds) == CONTROL
        surfaces = []
        for piece, kind in zip(spec.pieces, spec.kinds):
            plain = {CONTROL: "", UNKNOWN: spec.unknown_surface}.get(kind, piece.replace(BLANK, " "))
            surfaces.append(bytes([int(piece[1:-1], 16)]) if kind == BYTE else plain.encode())
        self.surfaces = pa.array(surfaces, pa.large_binary())

    def contract(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, characters, bounds) of the pieces of words, whose characters are all in the vocabulary.

        All words lie in one array, and each step joins the best pair of every word that still has one, the leftmost of equals;
        the steps follow the longest word.
        """
        lengths = np.array([len(word) for word in words])
        ids = self.characters[_points("".join(words))]
        sizes, word = np.ones(len(ids), dtype=np.int64), np.repeat(np.arange(len(words)), lengths)
        cost, joined = self._pair(ids, word, np.arange(len(ids)))
        done = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(cost, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(ids))))
            open_ = best < INF
            done.append((word[~open_], ids[~open_], sizes[~open_]))
            ids, sizes, word, cost, joined, best = (x[open_] for x in (ids, sizes, word, cost, joined, best))
            places = np.flatnonzero(cost == best)
            places = places[np.concatenate(([True], word[places][1:] != word[places][:-1]))[: len(places)]]
            ids[places] = joined[places]
            sizes[places] += sizes[places + 1]
            kept = np.ones(len(ids), dtype=bool)
            kept[places + 1] = False
            places -= np.arange(len(places))  # one symbol has gone before each earlier place
            ids, sizes, word, cost, joined = (x[kept] for x in (ids, sizes, word, cost, joined))
            again = np.concatenate((places, places[places > 0] - 1))
            cost[again], joined[again] = self._pair(ids, word, again)
        word, ids, sizes = (np.concatenate(parts) for parts in zip(*done))
        order = np.argsort(word, kind="stable")
        return ids[order], sizes[order], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words)))))

    def _pair(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and id of the symbols at these places joined to the next one of their word."""
        after = np.minimum(at + 1, len(ids) - 1)
        wanted = ids[at] * len(self.spec.pieces) + ids[after]
        found = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        hit = (self.pairs[found] == wanted) & (word[at] == word[after]) & (after > at)
        return np.where(hit, self.pair_cost[found], INF), self.pair_id[found]

    def merge(self, chunk: str) -> list[str]:
        """Pieces of any chunk: as ``contract``, with a heap in place of a look at all pairs."""
        parts: list[str | None] = list(chunk)
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        heap = []

        def offer(left: int) -> None:
            right = after[left]
            if right >= 0:
                joined = parts[left] + parts[right]
                cost = self.cost.get(joined)
                if cost is not None:
                    heapq.heappush(heap, (cost, left, joined))

        for left in range(len(parts) - 1):
            offer(left)
        while heap:
            _, left, joined = heapq.heappop(heap)
            right = after[left]
            if parts[left] is None or right < 0 or parts[left] + parts[right] != joined:
                continue  # one of the two has been joined to another since
            parts[left], parts[right] = joined, None
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [part for part in parts if part is not None]

    def _merged(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids of a chunk, and how many characters of it each piece takes."""
        ids, sizes = [], []
        for piece in self.merge(chunk):
            at = self.ids.get(piece, self.unknown)
            if at == self.unknown and self.spec.byte_fallback:
                own = [self.ids[f"<0x{byte:02X}>"] for byte in piece.encode()]
                ids += own
                sizes += [0] * (len(own) - 1) + [1]
            else:
                ids.append(at)
                sizes.append(len(piece))
        return np.array(ids, dtype="<u4").tobytes(), np.array(sizes, dtype="<u4").tobytes()

    def _learn(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids and sizes of chunks: words of known characters together, others (long, or with rare characters) one by one."""
        words = [chunk for chunk in chunks if len(chunk) <= WORD_CHARS]
        lengths = np.array([len(word) for word in words], dtype=np.int64)
        strange = np.flatnonzero(self.characters[_points("".join(words))] < 0)
        odd = set(np.searchsorted(np.cumsum(lengths), strange, side="right").tolist())
        made = {chunk: self._merged(chunk) for chunk in [*(words[at] for at in odd), *(c for c in chunks if len(c) > WORD_CHARS)]}
        words = [word for at, word in enumerate(words) if at not in odd]
        if words:
            ids, sizes, bounds = self.contract(words)
            raw, raw_sizes, at = ids.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), (4 * bounds).tolist()
            made.update((word, (raw[a:b], raw_sizes[a:b])) for word, a, b in zip(words, at, at[1:]))
        return made

    def encode(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begins, ends) of each text, with begin and end id."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        start = total = 0
        for at, text in enumerate(texts):
            if at > start and total + len(text) > RUN_CHARS:
                out += self._encode(texts[start:at])
                start, total = at, 0
            total += len(text)
        return out + self._encode(texts[start:])

    def _encode(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        normal = [self.normalize(text) for text in texts]
        chunks = [self.chunk.findall(text) for text, _ in normal]
        if len(self.known) > CHUNKS:
            self.known.clear()
        known = self.known
        fresh = self._learn([c for c in dict.fromkeys(chain.from_iterable(chunks)) if c not in known])
        long = {chunk: made for chunk, made in fresh.items() if len(chunk) > WORD_CHARS}
        known.update((chunk, made) for chunk, made in fresh.items() if len(chunk) <= WORD_CHARS)
        return [
            self._spans(text, byte_of, [known.get(chunk) or long[chunk] for chunk in own])
            for text, (_, byte_of), own in zip(texts, normal, chunks)
        ]

    def _spans(self, text: str, byte_of: np.ndarray, made: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text's chunks in one, with the source bytes of each piece."""
        ids = np.frombuffer(b"".join([m[0] for m in made]), dtype="<u4")
        sizes = np.frombuffer(b"".join([m[1] for m in made]), dtype="<u4").astype(np.int64)
        stops = np.cumsum(sizes)
        begins, ends = byte_of[stops - sizes], byte_of[stops]
        if not self.spec.byte_fallback:  # neighbours outside the vocabulary are one piece
            unknown = ids == self.unknown
            first = ~(unknown & np.concatenate(([False], unknown))[:-1])
            last = np.append(first, True)[1:]
            ids, begins, ends = ids[first], begins[first], ends[last]
        elif (sizes == 0).any():  # bytes before the last of a character have no span of their own
            own = np.minimum.accumulate(np.where(sizes > 0, np.arange(len(sizes)), len(sizes))[::-1])[::-1]
            begins = byte_of[(stops - sizes)[own]]
            ends = np.where(sizes > 0, ends, begins)
        whole = len(text.encode())
        return (
            np.concatenate(([self.begin], ids, [self.end])).astype("<u4"),
            np.concatenate(([0], begins, [whole])),
            np.concatenate(([0], ends, [whole])),
        )

    def _blanks(self, ids: Sequence[int]) -> int:
        """How many blanks at the head of the decoded text encoding has put there."""
        lead = 0
        if not (self.spec.dummy_prefix or self.spec.strip):
            return lead
        for at in ids:
            if self.spec.kinds[at] == CONTROL:
                continue
            piece = self.spec.pieces[at]
            if self.spec.kinds[at] != NORMAL or not piece.startswith(BLANK):
                break
            lead += 1
            if not self.spec.strip or len(piece) > 1:
                break
        return lead

    def decode(self, rows: Sequence[np.ndarray]) -> list[str]:
        """The text of each row of ids; bytes that are no UTF-8 become replacement characters."""
        flat = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        if len(flat) and not 0 <= flat.min() <= flat.max() < len(self.spec.pieces):
            raise ValueError("an id is not in the vocabulary")
        taken = self.surfaces.take(pa.array(flat))
        offsets, data = taken.buffers()[1:]
        bounds = np.frombuffer(offsets, dtype="<i8")
        raw, out, at = memoryview(data or b""), [], 0
        for row in rows:
            # Bytes on both sides of a begin or end id are no character together.
            stops = [*bounds[at + np.flatnonzero(self.control[row.astype(np.int64)])], bounds[at + len(row)]]
            start, text = bounds[at] + self._blanks(row.tolist()), ""
            for stop in stops:
                if stop > start:
                    text += bytes(raw[start:stop]).decode(errors="lexmill-each-byte")
                    start = stop
            at += len(row)
            out.append(text)
        return out


codecs.register_error("lexmill-each-byte", lambda error: ("�" * (error.end - error.start), error.end))


@lru_cache(maxsize=2)
def codec(spec: Spec) -> Codec:
    """One codec per model and Python worker."""
    return Codec(spec)


def _shared(spark, model_path: str):
    with open(model_path, "rb") as file:  # half a megabyte, and the same for every corpus
        return spark.sparkContext.broadcast(read_model(file.read()))


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(rows).astype(kind.to_pandas_dtype()), kind))


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids, begins, ends) of every row: ids and the source bytes [begin, end) of each piece.

    ``model_path`` is a model file that the driver can read.
    """
    spec = _shared(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for batch in batches:
            for part in byte_slices(batch, 1):
                ids, begins, ends = zip(*own.encode(part.column(1).to_pylist()))
                lists = [_lists(ids, pa.int32()), _lists(begins, pa.int64()), _lists(ends, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["doc_id", "token_ids", "begins", "ends"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(text_col))
    return rows.mapInArrow(run, "doc_id long, token_ids array<int>, begins array<long>, ends array<long>")


def decode_documents(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, decoded) with the text of each row of ids; NULL rows and NULL ids are left out of the text."""
    spec = _shared(rows.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [np.array([i for i in row or () if i is not None], dtype=np.int64) for row in part.column(1).to_pylist()]
                decoded = pa.array(codec(spec.value).decode(ids), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), decoded], names=["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), ids_col).mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ids, decoded text and spans of every row, in one pass; ``covered_bytes`` is what the spans hold of the source."""
    spec = _shared(docs.sparkSession, model_path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "covered_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for batch in batches:
            for part in byte_slices(batch, 1):
                made = own.encode(part.column(1).to_pylist())
                decoded = own.decode([ids for ids, _, _ in made])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(ids) for ids, _, _ in made], pa.int64()),
                        pa.array([hashlib.sha256(ids.tobytes()).hexdigest() for ids, _, _ in made], pa.string()),
                        pa.array([hashlib.sha256(text.encode()).hexdigest() for text in decoded], pa.string()),
                        pa.array([hashlib.sha256(np.stack([b, e], axis=1).astype("<u4").tobytes()).hexdigest() for _, b, e in made], pa.string()),
                        pa.array([int((e - b).sum()) for _, b, e in made], pa.int64()),
                    ],
                    names=names,
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(text_col))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered_bytes long"
    return rows.mapInArrow(run, schema)


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, what they decode to and which source bytes each stands for, as digests."""
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
