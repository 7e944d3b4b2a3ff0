"""Vectorised words and 64-bit word hashes of Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is `[^\\x20\\x09-\\x0D]+` over UTF-8.
All arithmetic is modulo 2**64 on numpy arrays; no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        have = _powers[key] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; different seeds give unrelated orders."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most limit bytes of text each (a longer row comes alone)."""
    n = batch.num_rows
    if not n:
        return
    size = np.zeros(n + 1, np.int64)
    np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), out=size[1:])
    at = 0
    while at < n:
        end = int(np.searchsorted(size, size[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), at + rows, n)
        yield batch.slice(at, end - at)
        at = end


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Whole rows of all batches, as many at a time as have at most limit bytes of text (a longer row comes alone). Where
    one batch ends and the next begins makes no difference."""
    held, size, n = [], 0, 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        total = np.zeros(batch.num_rows + 1, np.int64)
        np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), out=total[1:])
        at = 0
        while at < batch.num_rows:
            end = min(int(np.searchsorted(total, total[at] + limit - size, side="right")) - 1, at + rows - n, batch.num_rows)
            if end <= at and held:
                yield joined()
                held, size, n = [], 0, 0
                continue
            end = max(end, at + 1)
            held.append(batch.slice(at, end - at))
            size, n, at = size + int(total[end] - total[at]), n + end - at, end
    if held:
        yield joined()


class Words:
    """Words of a block of rows: hash, byte span, and first[row] to first[row + 1] as each row's words."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, raw: np.ndarray):
        self.hashes, self.starts, self.ends, self.first, self.raw = hashes, starts, ends, first, raw

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans are in order and don't overlap. Bytes are taken in bounded segments, and
    a span longer than one is hashed by itself."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + SEGMENT, side="right"))
        if to <= at:
            out[at] = int.from_bytes(hashlib.blake2b(raw[base : ends[at]], digest_size=8).digest(), "little")
            at += 1
            continue
        b = raw[base : ends[to - 1]]
        c = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * _power(len(b), False), out=c[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((c[e] - c[s]) * _power(len(b), True)[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def _spans(b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans in b; a word also ends at each of the cuts."""
    solid = np.concatenate(([False], ~_SPACE[b], [False]))
    begins, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    cuts = cuts[(cuts > 0) & (cuts < len(b))]
    begins[cuts] |= solid[1:-1][cuts]
    ends[cuts - 1] |= solid[1:-1][cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(column: pa.Array, lower: bool = False) -> Words:
    """Words of a string column, A-Z lower-cased before hashing if lower; bytes are taken in bounded segments."""
    raw, off = text_buffer(column)
    hashes, starts, ends = [], [], []
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + SEGMENT)
        if end < n:
            row_end = off[np.searchsorted(off, end, side="right") - 1]
            if row_end > at:
                end = int(row_end)
            else:  # inside one long row: cut at white space
                gap = np.flatnonzero(_SPACE[raw[at:end]])
                step = SEGMENT
                while not len(gap) and end < n:
                    end = min(n, end + step)
                    step *= 2
                    gap = np.flatnonzero(_SPACE[raw[at:end]])
                last = int(off[np.searchsorted(off, at, side="right")])
                end = at + int(gap[-1]) + 1 if len(gap) and end < n else end
                end = min(end, last) if last > at else end
        b = raw[at:end]
        lo, hi = np.searchsorted(off, [at, end])
        s, e = _spans(b, off[lo:hi] - at)
        if len(s):
            hashes.append(span_hashes(LOWER[b] if lower else b, s, e))
            starts.append(s + at)
            ends.append(e + at)
        at = end
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(off), np.int64), raw)
    s = np.concatenate(starts)
    return Words(np.concatenate(hashes), s, np.concatenate(ends), np.searchsorted(s, off), raw)


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of size hashes (rows not regarded): entry i covers i to i + size - 1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out += hashes[k : k + n] * np.uint64(pow(_BASE, k + 1, 1 << 64))
        return mix(out, seed)
    c = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power(len(hashes), False), out=c[1:])
    return mix((c[size:] - c[:-size]) * _power(len(hashes), True)[:n], seed)


def pack(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")
