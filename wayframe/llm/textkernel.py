"""Vectorised text kernels over Arrow string buffers.

Everything here works on the raw UTF-8 bytes of a batch of documents at once,
so a Python worker never loops over words or characters.  Batches are cut into
slices of about ``SLICE_BYTES`` (whole documents, never part of one), which
keeps the temporary arrays of a worker small whatever the document lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _table(which: str, n: int) -> np.ndarray:
    """Powers of the hash base (or of its inverse) modulo 2**64, at least n."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        t = np.full(size, _BASE if which == "p" else _BASE_INV, dtype=_U)
        t[0] = 1
        have = _powers[which] = np.cumprod(t, dtype=_U)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def salt(n: int) -> np.uint64:
    """The n-th of a series of well spread 64-bit numbers."""
    return _U(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = texts.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``limit`` bytes each, one row at least."""
    limit = limit or SLICE_BYTES
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def pieces(buf: np.ndarray, offs: np.ndarray, member: np.ndarray, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes in pieces of at most ``limit``, each with offsets of all rows within it.

    A piece ends behind a byte that is no member, so that no run of members is
    cut; a run that is longer than the limit stays whole.
    """
    limit = limit or 4 * SLICE_BYTES
    n, at = len(buf), 0
    if n <= limit:
        yield buf, offs
        return
    while at < n:
        end = min(n, at + limit)
        if end < n:
            gaps = np.flatnonzero(~member[buf[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < n and member[buf[end : end + limit]].all():
                    end = min(n, end + limit)
                end = min(n, end + (int(np.argmin(member[buf[end : end + limit]])) + 1 if end < n else 0))
        yield buf[at:end], np.clip(offs, at, end) - at
        at = end


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters in UTF-8 bytes."""
    out = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
    if len(buf) > 1:
        lead = buf[:-1] == 0xC3
        if lead.any():
            nxt = buf[1:]
            up = lead & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)
            out[1:] += up.astype(np.uint8) * np.uint8(32)
    return out


def runs(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes; runs stop at row ends."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    first = offs[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def _word_bytes() -> np.ndarray:
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = True
    t[128:] = True
    return t


WORD = _word_bytes()
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 13, 32]] = True


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters and digits (any non-ASCII byte counts as a letter)."""
    return runs(WORD[buf], offs)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes that are no blank, tab or line end."""
    return runs(~BLANK[buf], offs)


def counts_per_row(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each row."""
    return np.diff(np.searchsorted(starts, offs, side="left"))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes anywhere.

    The spans are in order and don't overlap; they are taken SLICE_BYTES at a
    time, so that the temporary arrays stay small.
    """
    n = len(starts)
    out = np.zeros(n, _U)
    i = 0
    while i < n:
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + SLICE_BYTES, side="right"))
        if j > i:
            part = buf[base : int(ends[j - 1])]
            c = np.zeros(len(part) + 1, _U)
            np.cumsum((part.astype(_U) + _U(1)) * _table("p", len(part))[: len(part)], out=c[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (c[e] - c[s]) * _table("q", len(part) + 1)[s]
        else:
            j, total = i + 1, 0
            for at in range(base, int(ends[i]), SLICE_BYTES):
                part = buf[at : min(at + SLICE_BYTES, int(ends[i]))]
                total += int(((part.astype(_U) + _U(1)) * _table("p", len(part))[: len(part)]).sum()) * pow(_BASE, at - base, 1 << 64)
            out[i] = _U(total & (1 << 64) - 1)
        i = j
    return mix(out + (ends - starts).astype(_U))


def sequence_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of hashes; equal runs give equal hashes anywhere."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    c = np.zeros(len(h) + 1, _U)
    np.cumsum(h * _table("p", len(h))[: len(h)], out=c[1:])
    return mix((c[ends] - c[starts]) * _table("q", len(h) + 1)[starts] + (ends - starts).astype(_U))


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]] along axis 0; empty segments give 0."""
    lo, hi = bounds[:-1], bounds[1:]
    full = hi > lo
    out = np.zeros((len(lo), *values.shape[1:]), values.dtype)
    if full.any():
        out[full] = np.add.reduceat(values, lo[full], axis=0)
    return out
