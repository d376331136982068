"""Fill-in-the-middle: cut every text in three, write the middle last behind marks, and put it back.

A text is a row of units (runs of letters, or single other characters).  Numbers that belong to the document
choose its cuts and its form: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``
(unchanged).  All texts of a batch lie in one byte array: a scan marks unit starts and finds the cuts, a
difference array over the cuts sums up to the shift of every byte, and one scatter writes all outputs.  The way
back needs only output and form: marks are found again, and a gather with the inverse shifts restores the texts.
Texts that hold a mark stay plain, and no mark can arise where parts meet, so the way back is exact.

Dense arrays exist only for ``TILE`` bytes at a time, so a task holds a few times its largest text.

Defined cases: a NULL text is an empty text, which is plain; a NULL id gives the numbers of "1:"; rows that repeat
an id get the same numbers; a very long text is worked on in tiles; an empty table gives no rows; further columns are ignored,
except in ``restore``, which keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexmill.llm.common import as_text, byte_slices, read

#: Bytes for which dense arrays of numbers are held.
TILE = 1 << 20
#: Per cent of texts that are cut, and of these the share in the form ``spm``.
CUT_PERCENT, SPM_PERCENT = 90, 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = ("plain", "psm", "spm")
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def numbers(doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers that belong to a document, from the digest of ``1:`` and its id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and where each begins (one more for the end)."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype="<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _texts(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype("<i4")), pa.py_buffer(data)])


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """True at the first byte of every unit."""
    starts = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[bounds[:-1][np.diff(bounds) > 0]] = True
    return starts


def count_before(mask: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many True values lie before each place; ``places`` ascend."""
    out = np.zeros(len(places), dtype=np.int64)
    seen = at = 0
    for start in range(0, len(mask) + 1, TILE):
        tile = mask[start : start + TILE]
        end = np.searchsorted(places, start + TILE) if start + TILE <= len(mask) else len(places)
        if end > at:
            sums = np.concatenate(([0], np.cumsum(tile, dtype=np.int64)))
            out[at:end] = seen + sums[places[at:end] - start]
        seen, at = seen + np.count_nonzero(tile), end
    return out


def places_of(mask: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Where the True values with these numbers (from 0, any order) lie."""
    order = np.argsort(ranks, kind="stable")
    wanted, found = ranks[order], np.zeros(len(ranks), dtype=np.int64)
    seen = at = 0
    for start in range(0, len(mask), TILE):
        inside = np.flatnonzero(mask[start : start + TILE])
        end = np.searchsorted(wanted, seen + len(inside))
        found[order[at:end]] = start + inside[wanted[at:end] - seen]
        seen, at = seen + len(inside), end
    return found


def marks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all marks, and the text that each lies in."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inner = data[1:-1]
    found = (data[:-2] == 60) & (data[2:] == 62) & ((inner == 80) | (inner == 83) | (inner == 77))
    places = np.flatnonzero(found)
    text = np.searchsorted(bounds, places, side="right") - 1
    whole = places + 3 <= bounds[text + 1]  # not across two texts
    return places[whole], text[whole]


def _shifts(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Tiles of the running sum of a difference array: the shift changes to ``shifts[k]`` at ``starts[k]`` (ascending)."""
    steps = np.diff(shifts, prepend=0)
    carry = at = 0
    for start in range(0, size, TILE):
        tile = np.zeros(min(TILE, size - start), dtype=np.int64)
        end = np.searchsorted(starts, start + len(tile))
        np.add.at(tile, starts[at:end] - start, steps[at:end])
        tile[0] += carry
        np.cumsum(tile, out=tile)
        carry, at = tile[-1], end
        yield start, tile


def scatter(data: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> dict[str, np.ndarray]:
    """Outputs of all texts; ``chosen`` holds four numbers per text."""
    begin, end = bounds[:-1], bounds[1:]
    units = unit_starts(data, bounds)
    before = count_before(units, bounds)
    n = np.diff(before)
    pair = np.sort(chosen[:, :2] % (n + 1)[:, None], axis=1)
    cuts = np.stack([end, end], axis=1)
    inner = pair < n[:, None]
    cuts[inner] = places_of(units, (before[:-1, None] + pair)[inner])
    marked = np.zeros(len(n), dtype=bool)
    marked[marks(data, bounds)[1]] = True
    plain = (end == begin) | marked | (chosen[:, 2] % 100 >= CUT_PERCENT)
    spm = ~plain & (chosen[:, 3] % 100 < SPM_PERCENT)
    prefix, middle, suffix = cuts[:, 0] - begin, cuts[:, 1] - cuts[:, 0], end - cuts[:, 1]
    out_bounds = np.concatenate(([0], np.cumsum(end - begin + np.where(plain, 0, 9))))
    first = out_bounds[:-1]
    # Where each part lands; the marks stand three bytes before their part.
    to_prefix = np.where(plain, first, np.where(spm, first + 6 + suffix, first + 3))
    to_suffix = np.where(plain, first + prefix + middle, np.where(spm, first + 3, first + 6 + prefix))
    to_middle = np.where(plain, first + prefix, first + 9 + prefix + suffix)
    starts = np.stack([begin, cuts[:, 0], cuts[:, 1]], axis=1).ravel()
    shifts = np.stack([to_prefix, to_middle, to_suffix], axis=1).ravel() - starts
    out = np.empty(out_bounds[-1], dtype=np.uint8)
    for start, shift in _shifts(starts, shifts, len(data)):
        shift += np.arange(start, start + len(shift))
        out[shift] = data[start : start + len(shift)]
    for mark, places in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        for k, byte in enumerate(mark):
            out[places[~plain] - 3 + k] = byte
    points = (data & 0xC0) != 0x80
    chars = count_before(points, starts).reshape(-1, 3)
    return {
        "out": out, "bounds": out_bounds, "n": n, "form": np.where(plain, 0, np.where(spm, 2, 1)),
        "prefix": chars[:, 1] - chars[:, 0], "middle": chars[:, 2] - chars[:, 1],
    }


def gather(data: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that ``scatter`` has cut, from its outputs and forms (numbers of ``FORMS``)."""
    begin, end = bounds[:-1], bounds[1:]
    cut = form > 0
    places, text = marks(data, bounds)
    places, text = places[cut[text]], text[cut[text]]
    if (np.bincount(text, minlength=len(form))[cut] != 3).any():
        raise ValueError("an output does not hold three marks")
    own = places.reshape(-1, 3)
    order = np.where((form[cut] == 2)[:, None], [[83, 80, 77]], [[80, 83, 77]])
    if len(own) and ((data[own + 1] != order).any() or (own[:, 0] != begin[cut]).any()):
        raise ValueError("the marks of an output do not fit its form")
    first, second, third = own[:, 0] + 3, own[:, 1] + 3, own[:, 2] + 3
    spm = form[cut] == 2
    # (start, size) of prefix, middle and suffix in the output; a plain text is all prefix.
    starts = np.stack([begin, end, end], axis=1)
    sizes = np.stack([end - begin, np.zeros_like(end), np.zeros_like(end)], axis=1)
    one, two = own[:, 1] - first, own[:, 2] - second
    starts[cut] = np.stack([np.where(spm, second, first), third, np.where(spm, first, second)], axis=1)
    sizes[cut] = np.stack([np.where(spm, two, one), end[cut] - third, np.where(spm, one, two)], axis=1)
    ends = np.concatenate(([0], np.cumsum(sizes.ravel())))
    back = np.empty(ends[-1], dtype=np.uint8)
    for start, shift in _shifts(ends[:-1], starts.ravel() - ends[:-1], len(back)):
        shift += np.arange(start, start + len(shift))
        back[start : start + len(shift)] = data[shift]
    return back, ends[::3]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    rows = docs.select(F.col(id_col).cast("long"), as_text(text_col), *numbers(F.col(id_col).cast("long")))

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 1):
                chosen = np.stack([part.column(k).to_numpy() for k in range(2, 6)], axis=1)
                made = scatter(*text_bytes(part.column(1)), chosen)
                plain = made["form"] == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(made["n"]),
                        pa.array(FORMS).take(pa.array(made["form"])),
                        pa.array(made["prefix"], mask=plain),
                        pa.array(made["middle"], mask=plain),
                        _texts(made["out"], made["bounds"]),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(run, schema)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", into: str = "restored") -> DataFrame:
    """``rows`` with the text that each output was made of, as column ``into`` (an older one of that name is replaced)."""
    kept = rows.drop(into)
    names = kept.columns
    out_at, form_at = names.index(output_col), names.index(form_col)
    kept = kept.withColumn(output_col, as_text(output_col))
    schema = StructType([*kept.schema.fields, StructField(into, StringType())])

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, out_at):
                form = np.array([FORMS.index(f) for f in part.column(form_at).to_pylist()], dtype=np.int64)
                back = _texts(*gather(*text_bytes(part.column(out_at)), form))
                yield pa.RecordBatch.from_arrays([*part.columns, back], names=[*names, into])

    return kept.mapInArrow(run, schema)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Units, form and cut sizes of every document, and digests of its output and of the text restored from it."""
    rows = restore(transform(read(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


OP11_SQL = """
with cut as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
chosen as (
  select *, len(units) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
    cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
  from cut),
parts as (
  select doc_id, text, cast(n as bigint) as n,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form,
    array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') as prefix,
    array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') as middle,
    array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') as suffix
  from chosen)
select doc_id, n, form,
  case when form <> 'plain' then length(prefix) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(prefix || middle || suffix) as restored_sha256
from parts
"""
