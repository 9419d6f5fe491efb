"""Words of Arrow batches as 64-bit hashes, by numpy over the bytes of many texts at once.

Also the packed form in which hashes travel: a row of a shuffle carries a compressed block
of thousands of them, so that Spark moves few rows and numpy does the work.
"""

from __future__ import annotations

import ctypes
import inspect
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

#: Text bytes whose words are handled at once, and those that are hashed at once.
SLICE_BYTES, PIECE_BYTES = 2 << 20, 1 << 19
U = np.uint64


@lru_cache(maxsize=1)
def _trim():
    """Gives freed memory back to the system; nothing where the C library can't."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


#: What a worker keeps from task to task, until it gets a task of another operator.
KEPT: dict = {}


def lean(run, keeps: bool = False):
    """A worker's function that holds on to no freed memory: Spark keeps workers for later tasks,
    and those of one executor share its memory with the JVM. keeps: it uses what is in KEPT."""

    def begin():
        if not keeps:
            KEPT.clear()
        return _trim()

    if inspect.isgeneratorfunction(run):

        def wrapped(batches):
            trim = begin()
            for out in run(batches):
                yield out
                del out
                trim(0)
            trim(0)

    else:

        def wrapped(group):
            trim = begin()
            try:
                return run(group)
            finally:
                trim(0)

    return wrapped


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240301)
    letters = rng.integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    is_space = np.zeros(256, bool)
    is_space[[9, 10, 11, 12, 13, 32]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return letters, is_space, lower


BASE = U(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser, so that all bits of a hash are even."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets): without a copy; null texts are empty."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bounds, data = column.buffers()[1:3]
    offsets = np.frombuffer(bounds, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, piece: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text) for texts ``raw[offsets[i]:offsets[i+1]]``.

    Bytes are looked at in pieces, so that a text or a word of any length costs memory by the
    number of its words only; a word that a piece's end cuts is put together again.
    """
    first, end = int(offsets[0]), int(offsets[-1])
    sums, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    open_at = -1  # where the word begins that goes on in the next piece
    for begin in range(first, end, piece):
        stop = min(begin + piece, end)
        texts = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, stop)] - begin
        part, at, goes_on = _word_sums(raw[begin:stop], texts, lower)
        if open_at >= 0 and len(at) and at[0] == 0 and not (len(texts) and texts[0] == 0):
            with np.errstate(over="ignore"):
                sums[-1][-1] += part[0] * U(pow(int(BASE), begin - open_at, 1 << 64))
            part, at = part[1:], at[1:]
            own = open_at
        else:
            own = -1
        sums.append(part)
        places.append(at + begin)
        open_at = -1 if not goes_on else int(places[-1][-1]) if len(at) else own
        if not len(at):  # the open word stays the last one
            sums.pop()
            places.pop()
    at = np.concatenate(places)
    return mix(np.concatenate(sums)), np.diff(np.searchsorted(at, offsets, "left"))


def word_spans(raw: np.ndarray, offsets: np.ndarray, piece: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of the words of ``word_hashes``, in its order."""
    is_space = _tables()[1]
    first, end = int(offsets[0]), int(offsets[-1])
    starts, stops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin in range(first, end, piece):
        stop = min(begin + piece, end)
        low, high = max(begin - 1, first), min(stop + 1, end)
        inside = ~is_space[raw[low:high]]
        edge = np.zeros(len(inside) + 1, bool)
        edge[[0, -1]] = low == first, high == end
        edge[offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, "right")] - low] = True
        here = slice(begin - low, stop - low)
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        starts.append(np.flatnonzero(opens[here]) + begin)
        stops.append(np.flatnonzero(closes[here]) + begin + 1)
    at = np.concatenate(starts)
    return at, np.concatenate(stops) - at


def _word_sums(b: np.ndarray, texts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(sum of letters times powers, begin) of each word of a piece, and whether its last word reaches the end."""
    letters, is_space, low = _tables()
    if lower:
        b = low[b]
    inside = ~is_space[b]
    starts = inside.copy()
    begins = np.zeros(len(b), bool)
    begins[texts] = True
    starts[1:] &= ~inside[:-1] | begins[1:]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), at, False
    place = np.arange(at[0], len(b)) - np.repeat(at, np.diff(np.append(at, len(b))))
    value = letters[b[at[0] :]] * powers(max(PIECE_BYTES, len(b)))[place]
    value[~inside[at[0] :]] = 0
    return np.add.reduceat(value, at - at[0]), at, bool(inside[-1])


def compress(*arrays: np.ndarray) -> bytes:
    """Arrays as one block. Sorted 64-bit hashes are stored as differences, byte planes apart."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        rising = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        data = np.diff(a, prepend=U(0)) if rising else a
        planes = np.ascontiguousarray(data.view(np.uint8).reshape(len(a), -1).T) if len(a) and a.itemsize > 1 else data
        parts.append(struct.pack("<cBq", a.dtype.char.encode(), rising, len(a)) + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def decompress(block: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    out, at, head = [], 0, struct.calcsize("<cBq")
    while at < len(data):
        kind, rising, n = struct.unpack_from("<cBq", data, at)
        at += head
        dtype = np.dtype(kind.decode())
        size = n * dtype.itemsize
        planes = np.frombuffer(data, np.uint8, size, at)
        if n and dtype.itemsize > 1:
            planes = np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).reshape(-1)
        a = planes.view(dtype)
        out.append(np.cumsum(a, dtype=np.uint64) if rising else a)
        at += size
    return out


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Places at which sorted keys pass from one of n equal key ranges to the next; n + 1 of them."""
    step = (1 << 64) // n
    edges = np.array([i * step for i in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges, "left"), [len(keys)]]).astype(np.int64)
