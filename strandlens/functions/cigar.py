"""Cigar and MD strings.

Counts over a cigar are linear in any form, but the positions of aligned blocks and of
mismatches need running sums along the string. Spark's ``aggregate`` can only build
those by copying the array at each step, which is quadratic in the number of
operations (a long read has 10^5 of them). The Arrow functions below do one numpy pass
over the whole batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from strandlens.functions.arrowtext import byte_view, numbers_before


def _members(letters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in letters]] = True
    return table


_ALIGNED = _members("M=X")
_ON_REFERENCE = _members("M=XDN")
_ON_READ = _members("M=XIS")
_OPERATION = _members("M=XDNISHP")


def cigar_ops(cigar: Column) -> Column:
    """Array of ``struct(op, len)``."""
    return F.transform(
        F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), 0),
        lambda x: F.struct(
            F.right(x, F.lit(1)).alias("op"),
            F.substring(x, F.lit(1), F.length(x) - 1).cast("bigint").alias("len"),
        ),
    )


def _walk(cigars: pa.Array):
    """Operations of a batch in order: (row, op byte, length, place on reference, place on read)."""
    data, starts, _ = byte_view(cigars)
    at = np.flatnonzero(_OPERATION[data])
    row = np.searchsorted(starts, at, "right") - 1
    before = np.empty_like(at)
    before[:1] = -1
    before[1:] = at[:-1]
    length = numbers_before(data, at, at - np.maximum(before + 1, starts[row]))
    op = data[at]
    first = np.searchsorted(row, np.arange(len(cigars)))

    def places(moves: np.ndarray) -> np.ndarray:
        end = np.cumsum(np.where(moves[op], length, 0))
        begin = np.concatenate([[0], end])
        return begin[:-1] - begin[first][row]

    return row, op, length, places(_ON_REFERENCE), places(_ON_READ)


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


@F.arrow_udf(ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))
def _blocks(cigar: pa.Array, pos: pa.Array) -> pa.Array:
    row, op, length, ref, _ = _walk(cigar)
    keep = _ALIGNED[op] & (length > 0)
    row, length, ref = row[keep], length[keep], ref[keep]
    start = ref + np.asarray(pos.fill_null(0))[row]
    end = start + length
    # only D and N part two blocks; an insertion or a change between M, = and X does not
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != end[:-1])
    last = np.roll(new, -1)
    blocks = pa.StructArray.from_arrays([pa.array(start[new]), pa.array(end[last])], ["start", "end"])
    return _lists(row[new], len(cigar), blocks)


def block_array(cigar: Column, pos: Column) -> Column:
    """Half-open blocks of bases that count for depth (M, =, X; parted by D and N)."""
    return _blocks(cigar, pos)


_SUMMARY = ["aligned", "ins_bases", "ins_count", "del_bases", "del_count", "skipped", "soft_clip", "ref_span"]


@F.arrow_udf(StructType([StructField(name, LongType()) for name in _SUMMARY]))
def _summary(cigar: pa.Array) -> pa.Array:
    row, op, length, _, _ = _walk(cigar)
    n = len(cigar)

    def total(letters: str, weight: np.ndarray) -> pa.Array:
        chosen = _members(letters)[op]
        return pa.array(np.bincount(row[chosen], weights=weight[chosen], minlength=n).astype(np.int64))

    one = np.ones_like(length)
    return pa.StructArray.from_arrays(
        [
            total("M=X", length),
            total("I", length),
            total("I", one),
            total("D", length),
            total("D", one),
            total("N", length),
            total("S", length),
            total("M=XDN", length),
        ],
        _SUMMARY,
    )


def cigar_summary(cigar: Column) -> Column:
    """Struct of sums: aligned, ins_bases, ins_count, del_bases, del_count, skipped, soft_clip, ref_span."""
    return _summary(cigar)


def _read_lengths(walk, n: int) -> np.ndarray:
    row, op, length, _, _ = walk
    return np.bincount(row, weights=np.where(_ON_READ[op], length, 0), minlength=n).astype(np.int64)


def _mismatch_places(walk, read_len: np.ndarray, md: pa.Array, reverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and cycle of each mismatch."""
    n = len(read_len)
    row, op, length, _, read_at = walk
    m = _ALIGNED[op] & (length > 0)
    m_row, m_len, m_read = row[m], length[m], read_at[m]
    m_begin = np.concatenate([[0], np.cumsum(m_len)])  # aligned bases of the whole batch, in order
    row_begin = m_begin[np.searchsorted(m_row, np.arange(n + 1))]

    data, starts, _ = byte_view(md)
    place = np.arange(len(data))
    md_row = np.searchsorted(starts, place, "right") - 1
    digit = (data >= 48) & (data <= 57)
    fresh = place == starts[md_row]
    # a letter belongs to a deletion when a caret, not a number, came last before it
    caret_at = np.maximum.accumulate(np.where(data == 94, place, -1)) if len(data) else place
    other_at = np.maximum.accumulate(np.where(digit | fresh & (data != 94), place, -1)) if len(data) else place
    mismatch = ~digit & (data != 94) & (other_at >= caret_at)
    closes = digit & ~np.concatenate([digit[1:] & ~fresh[1:], [False]])
    opens = digit & (fresh | ~np.concatenate([[False], digit[:-1]]))
    step = mismatch.astype(np.int64)
    close_at = np.flatnonzero(closes)
    step[close_at] = numbers_before(data, close_at + 1, close_at + 1 - np.flatnonzero(opens))
    gone = np.concatenate([[0], np.cumsum(step)])
    hit = np.flatnonzero(mismatch)
    hit_row = md_row[hit]
    spot = gone[hit] - gone[starts[hit_row]] + row_begin[hit_row]
    inside = spot < row_begin[hit_row + 1]
    spot, hit_row = spot[inside], hit_row[inside]
    block = np.searchsorted(m_begin, spot, "right") - 1
    read_pos = m_read[block] + spot - m_begin[block]
    return hit_row, np.where(reverse[hit_row], read_len[hit_row] - read_pos, read_pos + 1)


def _flags(values: pa.Array) -> np.ndarray:
    return np.asarray(values.fill_null(False).cast(pa.uint8())).astype(bool)


@F.arrow_udf(ArrayType(LongType()))
def _cycles(cigar: pa.Array, md: pa.Array, reverse: pa.Array) -> pa.Array:
    walk = _walk(cigar)
    rows, cycle = _mismatch_places(walk, _read_lengths(walk, len(cigar)), md, _flags(reverse))
    return _lists(rows, len(cigar), pa.array(cycle))


def mismatch_cycles(cigar: Column, md: Column, reverse: Column) -> Column:
    """1-based sequencing cycles of a read's mismatches, from its MD tag and cigar."""
    return _cycles(cigar, md, reverse)


def _gap_places(walk, read_len: np.ndarray, reverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and cycle of each inserted base and each deletion."""
    row, op, length, _, read_at = walk
    gap = ((op == ord("I")) | (op == ord("D"))) & (length > 0)
    row, op, at = row[gap], op[gap], read_at[gap]
    inserted = op == ord("I")
    count = np.where(inserted, length[gap], 1)
    # inserted bases one by one; a deletion between two bases once
    row, at, inserted = np.repeat(row, count), np.repeat(at, count), np.repeat(inserted, count)
    at = at + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    forward = np.where(inserted, at + 1, at)
    return row, np.where(reverse[row], read_len[row] - at, forward)


@F.arrow_udf(ArrayType(LongType()))
def _gap_cycles(cigar: pa.Array, reverse: pa.Array) -> pa.Array:
    walk = _walk(cigar)
    rows, cycle = _gap_places(walk, _read_lengths(walk, len(cigar)), _flags(reverse))
    return _lists(rows, len(cigar), pa.array(cycle))


ERROR_KINDS = ("mismatch", "gap", "end", "bases", "inserted", "deleted", "edits")


def count_errors(groups: np.ndarray, cigar: pa.Array, md: pa.Array, nm: pa.Array, reverse: pa.Array) -> tuple[np.ndarray, ...]:
    """Partial counts of a batch from one walk over its cigars: (group, kind, cycle, count), kinds as numbers.

    Mismatches, gaps and read ends are counted by cycle over the records with an MD tag; aligned and inserted bases, inserted and deleted
    ones and edits are summed (cycle 0) over those with NM.
    """
    n = len(cigar)
    walk = _walk(cigar)
    row, op, length, _, _ = walk
    read_len, back = _read_lengths(walk, n), _flags(reverse)
    has_md = ~np.asarray(md.is_null())
    found = []
    for kind, (rows, cycles) in enumerate((_mismatch_places(walk, read_len, md, back), _gap_places(walk, read_len, back), (np.arange(n), read_len))):
        keep = has_md[rows] & (cycles > 0)
        found.append((groups[rows[keep]], np.full(keep.sum(), kind), cycles[keep], np.ones(keep.sum(), np.int64)))
    has_nm = np.flatnonzero(~np.asarray(nm.is_null()))

    def total(letters: str) -> np.ndarray:
        chosen = _members(letters)[op]
        return np.bincount(row[chosen], weights=length[chosen], minlength=n).astype(np.int64)

    for kind, values in enumerate((total("M=XI"), total("I"), total("D"), np.asarray(nm.fill_null(0))), 3):
        found.append((groups[has_nm], np.full(len(has_nm), kind), np.zeros(len(has_nm), np.int64), values[has_nm]))
    group, kind, cycle, count = (np.concatenate([f[i] for f in found]) for i in range(4))
    order = np.lexsort((cycle, kind, group))
    group, kind, cycle, count = group[order], kind[order], cycle[order], count[order]
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (kind[1:] != kind[:-1]) | (cycle[1:] != cycle[:-1]))[: len(group)])
    sums = np.add.reduceat(count, first) if len(first) else count
    return group[first], kind[first], cycle[first], sums


def gap_cycles(cigar: Column, reverse: Column) -> Column:
    """1-based cycles of inserted bases, and for each deletion the cycle right before it."""
    return _gap_cycles(cigar, reverse)


def read_length_of_cigar(summary: Column) -> Column:
    """Bases of the read that are not soft-clipped."""
    return summary["aligned"] + summary["ins_bases"]


def identity(summary: Column, nm: Column, de: Column) -> Column:
    """Gap-compressed identity in percent: from ``de`` where given, else from NM and the cigar."""
    gaps = summary["ins_bases"] + summary["del_bases"]
    gap_count = summary["ins_count"] + summary["del_count"]
    columns = F.nullif(summary["aligned"] + gap_count, F.lit(0))
    return F.coalesce(
        100.0 * (1.0 - de),
        100.0 * (1.0 - (nm - gaps + gap_count) / columns),
    )
