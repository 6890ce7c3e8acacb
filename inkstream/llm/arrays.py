"""Words, n-grams and window minima of whole texts as numpy arrays.

Texts stay in their Arrow buffers: a batch of strings is one byte array with offsets, and words are found, hashed
and combined by array steps, a bounded slice of documents at a time.  Word separators are the bytes 0x20 and
0x09-0x0D, which never occur inside a longer UTF-8 sequence, so byte positions and characters agree.

Hashes are 64 bits wide and the same in every process.  A window hash is the pair of two independent ones, so equal
pairs stand for equal windows (a false match among ``n`` windows has a chance of about ``n * n / 2**128``).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes of text handled at once; arrays of eight bytes for each of them are alive together.
SLICE_BYTES = 1 << 19

#: Rows of a batch whose results are gathered before they are passed on.
PIECE_ROWS = 2000

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (shift-multiply finaliser)."""
    x = x + _U(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTES = mix(np.arange(256, dtype=_U), 17)
_BYTES_LOWER = _BYTES[_LOWER]
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)  # odd, so that they have inverses modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a base and of its inverse, modulo 2**64."""
    known = _powers.get(which)
    if known is None or len(known[0]) < n:
        base = _BASES[which]
        size = max(n, SLICE_BYTES + 1, 0 if known is None else 2 * len(known[0]))
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, _U(b), dtype=_U)
            out[0] = 1
            both.append(np.multiply.accumulate(out, out=out))
        known = _powers[which] = (both[0], both[1])
    return known[0][:n], known[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Position-independent polynomial hashes of ``values[start:end]`` for many spans."""
    up, down = powers(len(values) + 1, which)
    total = np.empty(len(values) + 1, dtype=_U)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U), which)


def blocks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs ``(first, stop)`` of rows with about ``limit`` in total, one row at least."""
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, stop
        first = stop


def give_back() -> None:
    """Return freed memory to the system: Python workers live on, and later stages need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
        give_back()


@dataclass
class Words:
    """Words of a slice of documents; document ``d`` owns words ``first[d] : first[d + 1]``."""

    data: np.ndarray  # the bytes of all documents
    offsets: np.ndarray  # where each document starts in data, and the end
    starts: np.ndarray  # byte span of each word
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of rows with about ``limit`` bytes; null counts as empty.

    A text longer than the limit is a run of its own: texts are never cut.
    """
    texts = pa.array(texts).cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop
    if n > PIECE_ROWS:
        give_back()


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """All words of a run of documents, with their hashes (of A-Z lower-cased bytes with ``lower``)."""
    n = len(data)
    separator = _SEPARATOR[data]
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = after[-1] = True
        before[1:] = separator[:-1]
        after[:-1] = separator[1:]
        inner = offsets[1:-1]
        before[inner[inner < n]] = True
        after[inner[inner > 0] - 1] = True
        np.logical_not(separator, out=separator)
    starts = np.flatnonzero(separator & before)
    ends = np.flatnonzero(separator & after) + 1
    hashes = span_hashes((_BYTES_LOWER if lower else _BYTES)[data], starts, ends)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)


def ngram_hashes(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words, whatever documents they are in."""
    starts = np.arange(max(0, len(hashes) - n + 1))
    return span_hashes(hashes, starts, starts + n, which)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every run of ``width`` values.

    Running minima from both ends of blocks of ``width`` values: linear in the input whatever the width.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=values.dtype)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    square = padded.reshape(-1, width)
    forward = np.minimum.accumulate(square, axis=1).ravel()
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def pack(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """Rows of 64-bit columns as one byte string for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    rows = np.stack([c.view(np.uint64) for c in columns], axis=1)[order]
    names, first = np.unique(bucket[order], return_index=True)
    return names, [part.tobytes() for part in np.split(rows, first[1:])] if len(names) else []


def unpack(blobs: list[bytes], width: int) -> np.ndarray:
    """All rows of byte strings made by :func:`pack`, as a matrix of ``width`` columns."""
    return np.frombuffer(b"".join(blobs), dtype=np.uint64).reshape(-1, width)
