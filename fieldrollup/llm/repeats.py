"""Repeated strings by merged Burrows-Wheeler transforms.

Every byte covered by a string of LENGTH bytes that also starts anywhere else goes. Sorting
all suffixes of a corpus isn't feasible, and isn't needed:

1. Each window of LENGTH bytes is given to its anchor, the GRAM bytes in it of the least
   hash (the leftmost of equals). Equal windows have equal anchors at equal places, so
   that windows only have to be compared within an anchor. Consecutive windows of one anchor
   occurrence form a segment. Anchors that occur once are done with; they are the most.
   Segments whose whole text occurs twice are repeated as a whole. A window holds the
   LENGTH / 2 bytes before its anchor or those from it on, so that the windows of a segment
   only have to be compared with those that share that half: common phrases end here.
2. For halves that different segments share, the texts of those windows go to the task of the
   half's key range. What one chunk of documents sends is a shard. Its transform is built,
   over symbols of STEP bytes at every byte place (hashes of the bytes, so that a suffix
   is read STEP bytes at a time), and the shards' transforms are merged by interleave
   refinement, in LENGTH / STEP passes. Intervals of common prefixes of LENGTH bytes with
   two suffixes or more are the repeated strings; their suffixes are the places where they start.
   A half that more than HOT_SEGMENTS different segments share would be one task of any size:
   there, each window goes by the hash of its LENGTH bytes, and a chunk sends one of equal ones.
3. Places go back to their documents, where the covered bytes are cut out.

Texts that are equal as a whole are known from their SHA-256 and are told apart from other
texts by its first 128 bits. Segments and symbols are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldrollup.llm.bwt import merge, transform
from fieldrollup.llm.common import Staging, id_filter, text_or_empty
from fieldrollup.llm.tokens import BASE, U, _tables, compress, decompress, lean, mix, powers, text_bytes

LENGTH, GRAM, STEP = 400, 32, 100
#: Text bytes that are looked at at once; places within them and the hash share 64 bits.
PIECE, PLACE_BITS = 1 << 19, 22
#: Text bytes of a chunk, anchors of a key range, segment bytes of a shard and of a merge, text bytes of a final range, hot windows of a range.
CHUNK_BYTES, RANGE_ANCHORS, SHARD_BYTES, MERGE_BYTES, RANGE_BYTES, RANGE_WINDOWS = 8 << 20, 100_000, 4 << 20, 1 << 19, 8 << 20, 1_000_000
#: Different segments that a merge compares in one half; beyond that, each window is dealt by its own hash.
HOT_SEGMENTS = 500
#: Verdicts. A segment's windows are all repeated (WHOLE, SHOWN) or not known yet (OPEN); all but WHOLE are compared,
#: with HOT those of a half that very many segments share.
WHOLE, OPEN, SHOWN, HOT = 1, 2, 3, 4


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on that has as many, by doubling."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    letters = _tables()[0]
    n = len(data) - size + 1
    level, width = letters[data], 1
    out, done = None, 0
    power = BASE
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                part = level[done : done + n]
                out = part.copy() if out is None else out * power + part
                done += width
            if done == size:
                return mix(out)
            level = level[: len(level) - width] * power + level[width:]
            width *= 2
            power = power * power


def least_places(value: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each run of ``window`` values."""
    level, width = value, 1
    while width * 2 <= window:
        level = np.minimum(level[: len(level) - width], level[width:])
        width *= 2
    n = len(value) - window + 1
    return np.minimum(level[:n], level[window - width : window - width + n])


def segments(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor hash, hash of the bytes, of the half window before the
    anchor, of that from it on, windows that have the former) of the segments of texts
    ``data[bounds[i]:bounds[i + 1]]``.

    Windows are given by their place in data; the first ones of a segment have the half before
    the anchor, the others that from it on.
    """
    none = (*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint64)] * 4, np.zeros(0, np.int32))
    if len(data) < length:
        return none
    hashes = gram_hashes(data, gram)
    value = (hashes & ~U((1 << PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (least_places(value, length - gram + 1) & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    fits = np.arange(len(anchor)) + length <= bounds[1:][owner]
    place = np.flatnonzero(fits)
    if not len(place):
        return none
    new = np.ones(len(place), bool)
    new[1:] = (anchor[place[1:]] != anchor[place[:-1]]) | (owner[place[1:]] != owner[place[:-1]])
    first = place[new]
    begins = np.flatnonzero(new)
    windows = np.diff(np.append(begins, len(place)))
    # hash of the bytes from first to the last window's end, from sums of powers
    letters = _tables()[0]
    power = powers(PIECE)[: len(data)]
    total = np.concatenate([[U(0)], np.cumsum(letters[data] * power, dtype=np.uint64)])
    stop = first + windows - 1 + length
    own = (total[stop] - total[first]) * _inverse_powers(PIECE)[first]
    own = mix(own + windows.astype(np.uint64) * U(0x632BE59BD9B4E019))
    at, half = anchor[first], length // 2
    halves = gram_hashes(data, half) | U(1)
    earlier = np.clip(at - half - first + 1, 0, windows)
    left = np.where(earlier > 0, halves[np.clip(at - half, 0, len(halves) - 1)], U(0))
    right = np.where(earlier < windows, halves[np.minimum(at, len(halves) - 1)], U(0))
    # least hashes are small; mixed again, they are even over the key ranges
    return owner[first], first, windows, mix(hashes[at]), own, left, right, earlier.astype(np.int32)


_INVERSE: dict[int, np.ndarray] = {}


def _inverse_powers(n: int) -> np.ndarray:
    if n not in _INVERSE:
        out = np.full(n, U(pow(int(BASE), -1, 1 << 64)), dtype=np.uint64)
        out[0] = 1
        _INVERSE[n] = np.cumprod(out)
    return _INVERSE[n]


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(first text, bounds in bytes, bytes of the first text that lie before) of parts of PIECE bytes at most.

    A longer text is cut into parts that overlap by less than a window; each window is in one.
    """
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1
        if end > at:
            yield at, offsets[at : end + 1], 0
            at = end
            continue
        start = int(offsets[at])
        while True:
            stop = min(start + PIECE, int(offsets[at + 1]))
            yield at, np.array([start, stop]), start - int(offsets[at])
            if stop == offsets[at + 1]:
                break
            start = stop - length + 1
        at += 1


def _range_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def _rows(kind: np.ndarray, arrays: list[np.ndarray], extra=None) -> Iterator[tuple[int, bytes]]:
    """Blocks of the arrays' entries by the value of ``kind``."""
    order = np.argsort(kind, kind="stable")
    begins = np.flatnonzero(np.diff(kind[order], prepend=-1))
    for a, b in zip(begins, np.append(begins[1:], len(order))[: len(begins)], strict=True):
        own = order[a:b]
        yield int(kind[own[0]]), compress(*[x[own] for x in arrays])


_BLOCKS = pa.schema([("at", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])
BLOCKS = "at int, kind int, block binary"


def _blocks(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BLOCKS)], schema=_BLOCKS)


def _occurrences(length: int, gram: int, n_ranges: int, n_docs: int):
    """(text, sha) to blocks. kind 0, by range of anchors: occurrences; kind 1, by range of documents: verdicts.

    Segments that a chunk holds twice are told so at once, and only one of them goes on.
    """

    def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate([p[i] for p in parts]) for i in range(9)]
        order = np.lexsort((columns[2], columns[1], columns[0], columns[5], columns[4]))
        k1, k2, first, windows, anchor, own, left, right, earlier = (x[order] for x in columns)
        keep, times = _tally(k1, k2, first, anchor, own, np.ones(len(k1), np.int64))
        whole = times > 1
        rows = [(at, 1, b) for at, b in _rows(_range_of(k1[whole], n_docs), [x[whole] for x in (k1, k2, first, windows, np.full(len(k1), WHOLE, np.uint8), anchor)])] if whole.any() else []
        times = np.minimum(times, 2).astype(np.uint8)
        return _blocks([(at, 0, b) for at, b in _rows(_range_of(anchor[keep], n_ranges), [x[keep] for x in (k1, k2, first, windows, anchor, own, left, right, earlier, times)])] + rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            sha = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.dtype("<u8")).reshape(-1, 2)
            for at, bounds, before in pieces(offsets, length):
                doc, first, *found = segments(raw[bounds[0] : bounds[-1]], bounds - bounds[0], length, gram)
                if len(doc):
                    parts.append((sha[at + doc, 0], sha[at + doc, 1], first - (bounds[:-1] - bounds[0])[doc] + before, *found))
                held += int(bounds[-1] - bounds[0])
                if held >= CHUNK_BYTES and parts:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return lean(run)


def _tally(k1, k2, first, anchor, own, times) -> tuple[np.ndarray, np.ndarray]:
    """For sorted occurrences: (the first of each segment text, occurrences of each one's text).

    The same place of the same text (in copies of a document) counts once.
    """
    same_text = np.zeros(len(anchor), bool)
    same_text[1:] = (anchor[1:] == anchor[:-1]) & (own[1:] == own[:-1])
    again = same_text.copy()
    again[1:] &= (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (first[1:] == first[:-1])
    group = np.cumsum(~same_text) - 1
    # of a place that comes again, the highest of its counts
    place = np.cumsum(~again) - 1
    best = np.zeros(int(place[-1]) + 1 if len(place) else 0, np.int64)
    np.maximum.at(best, place, times)
    total = np.bincount(group[~again], weights=best) if len(group) else np.zeros(0)
    return np.flatnonzero(~same_text), total[group]


def _compared(key: np.ndarray, there: np.ndarray, alone: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries share their key with another, in a group where at least one text is alone, and which with very many."""
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    open_ = np.bincount(back, weights=alone & there, minlength=len(n))
    return there & (n > 1)[back] & (open_ > 0)[back], (n > many)[back]


def _verdicts(n_docs: int, many: int):
    """Occurrences of a range of anchors to verdicts by range of documents."""

    def run(group: pa.Table) -> pa.Table:
        blocks = [decompress(b.as_py()) for b in group.column("block")]
        columns = [np.concatenate([b[i] for b in blocks]) for i in range(10)]
        del blocks
        order = np.lexsort((columns[2], columns[1], columns[0], columns[5], columns[4]))
        k1, k2, first, windows, anchor, own, left, right, earlier, times = (x[order] for x in columns)
        keep, total = _tally(k1, k2, first, anchor, own, times.astype(np.int64))
        whole = total > 1
        told = [(k1[whole], k2[whole], first[whole], windows[whole], np.full(int(whole.sum()), WHOLE, np.uint8), anchor[whole])]
        for half, begin, n in ((left, first, earlier), (right, first + earlier, windows - earlier)):
            key = mix(anchor[keep] * BASE + half[keep])
            chosen, hot = _compared(key, half[keep] != 0, ~whole[keep], many)
            ok = keep[chosen]
            verdict = (np.where(whole[ok], SHOWN, OPEN) + np.where(hot[chosen], HOT, 0)).astype(np.uint8)
            told.append((k1[ok], k2[ok], begin[ok], n[ok].astype(np.int64), verdict, mix(anchor[ok] * BASE + half[ok])))
        told = [np.concatenate(x) for x in zip(*told, strict=True)]
        rows = [(at, 1, b) for at, b in _rows(_range_of(told[0], n_docs), told)]
        return pa.Table.from_batches([_blocks(rows)])

    return lean(run)


def _by_document(group: pa.Table) -> pa.Table:
    """Verdicts of a range of documents, one row for each: (k1, k2, block of first, windows, verdict, anchor)."""
    blocks = [decompress(b.as_py()) for b in group.column("block")]
    k1, k2, first, windows, verdict, anchor = (np.concatenate([b[i] for b in blocks]) for i in range(6))
    order = np.lexsort((first, k2, k1))
    k1, k2 = k1[order], k2[order]
    new = np.ones(len(k1), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(k1))
    out = [compress(*[x[order[a:b]] for x in (first, windows, verdict, anchor)]) for a, b in zip(begins, ends, strict=True)]
    return pa.table({"k1": k1[begins].view(np.int64), "k2": k2[begins].view(np.int64), "block": pa.array(out, pa.binary())})


def _shards(length: int, n_merges: int, n_hot: int, n_docs: int):
    """(k1, k2, text, block) to the segments that must be compared. kind 0: shards by range of halves;
    kind 2: windows of hot halves by range of their hash; kind 1: verdicts, as in ``_occurrences``.
    """

    def flush(parts, texts) -> pa.RecordBatch:
        k1, k2, first, windows, verdict, anchor = (np.concatenate([p[i] for p in parts]) for i in range(6))
        hot = np.flatnonzero(verdict > HOT)
        rows = _hot_windows(k1[hot], k2[hot], first[hot], windows[hot], [texts[i] for i in hot], length, n_hot, n_docs)
        own = np.flatnonzero(verdict < HOT)
        at = _range_of(anchor[own], n_merges)
        order = np.argsort(at, kind="stable")
        begins = np.flatnonzero(np.diff(at[order], prepend=-1))
        for a, b in zip(begins, np.append(begins[1:], len(order))[: len(begins)], strict=True):
            one = own[order[a:b]]
            data = np.frombuffer(b"".join(texts[i] for i in one), np.uint8)
            rows.append((int(at[order[a]]), 0, compress(k1[one], k2[one], first[one], windows[one], data)))
        return _blocks(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, texts, held = [], [], 0
        for batch in batches:
            for k1, k2, text, block in zip(*(batch.column(c) for c in ("k1", "k2", "text", "block")), strict=True):
                first, windows, verdict, anchor = decompress(block.as_py())
                shown = np.flatnonzero(verdict >= OPEN)
                if not len(shown):
                    continue
                data = text.as_py().encode()
                key = np.array([k1.as_py(), k2.as_py()], np.int64).view(np.uint64)
                parts.append((np.full(len(shown), key[0]), np.full(len(shown), key[1]), first[shown], windows[shown], verdict[shown], anchor[shown]))
                own = [data[a : a + n - 1 + length] for a, n in zip(first[shown].tolist(), windows[shown].tolist(), strict=True)]
                texts.extend(own)
                held += sum(map(len, own))
                if held >= SHARD_BYTES:
                    yield flush(parts, texts)
                    parts, texts, held = [], [], 0
        if parts:
            yield flush(parts, texts)

    return lean(run)


def _hot_windows(k1, k2, first, windows, texts: list[bytes], length: int, n_hot: int, n_docs: int) -> list[tuple[int, int, bytes]]:
    """Blocks of the windows of hot segments: one of each text that the chunk has, and runs of those that it has twice."""
    if not len(first):
        return []
    segment = np.repeat(np.arange(len(first)), windows)
    place = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows) + first[segment]
    value = np.concatenate([gram_hashes(np.frombuffer(t, np.uint8), length) for t in texts])
    _, one, back, times = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
    at = _range_of(value[one], n_hot)
    columns = [value[one], k1[segment[one]], k2[segment[one]], place[one], np.minimum(times, 2).astype(np.uint8)]
    rows = [(i, 2, b) for i, b in _rows(at, columns)]
    return rows + _runs_of(times[back] > 1, segment, place, k1, k2, n_docs)


def _runs_of(hit: np.ndarray, segment: np.ndarray, place: np.ndarray, k1: np.ndarray, k2: np.ndarray, n_docs: int) -> list[tuple[int, int, bytes]]:
    """Runs of the windows that are hit, (k1, k2, first, windows) by range of documents."""
    at = np.flatnonzero(hit)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(place[at]) != 1) | (segment[at[1:]] != segment[at[:-1]])
    begins = np.flatnonzero(new)
    runs = np.diff(np.append(begins, len(at)))
    own = segment[at[begins]]
    return [(d, 1, b) for d, b in _rows(_range_of(k1[own], n_docs), [k1[own], k2[own], place[at[begins]], runs])]


def _counted(n_docs: int):
    """Windows of a range of hashes to those that occur twice, as runs by range of documents."""

    def run(group: pa.Table) -> pa.Table:
        blocks = [decompress(b.as_py()) for b in group.column("block")]
        value, k1, k2, place, times = (np.concatenate([b[i] for b in blocks]) for i in range(5))
        del blocks
        _, back = np.unique(value, return_inverse=True)
        hit = np.flatnonzero(np.bincount(back, weights=times)[back] > 1)
        hit = hit[np.lexsort((place[hit], k2[hit], k1[hit]))]
        k1, k2, place = k1[hit], k2[hit], place[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        owner = np.cumsum(new) - 1
        return pa.Table.from_batches([_blocks(_runs_of(np.ones(len(hit), bool), owner, place, k1[new], k2[new], n_docs))])

    return lean(run)


def repeated_windows(shards: list[tuple[np.ndarray, np.ndarray]], length: int, step: int) -> list[np.ndarray]:
    """For shards (bytes, window counts of consecutive segments): which windows start a repeated string, by segment and place.

    Each shard's transform is built over symbols of ``step`` bytes; the transforms are merged.
    """
    hashed, layout = [], []
    for data, windows in shards:
        sizes = windows + length - 1
        begin = np.cumsum(sizes) - sizes
        spots = sizes - step + 1  # places that have a whole symbol
        where = np.repeat(begin, spots) + np.arange(int(spots.sum())) - np.repeat(np.cumsum(spots) - spots, spots)
        hashed.append(gram_hashes(data, step)[where])
        layout.append((windows, spots))
    code = np.unique(np.concatenate(hashed), return_inverse=True)[1].astype(np.int32)
    built, valid, at = [], [], 0
    for (windows, spots), own in zip(layout, hashed, strict=True):
        n = len(own)
        chains = np.minimum(spots, step)  # strings of a segment: one for each place modulo step
        ends = np.arange(int(chains.sum()))
        codes = np.concatenate([code[at : at + n] + 1, np.zeros(len(ends), np.int32)])
        at += n
        inside = (np.arange(n) - np.repeat(np.cumsum(spots) - spots, spots)).astype(np.int32)
        left = np.repeat(spots.astype(np.int32), spots) - inside
        after = np.arange(len(codes), dtype=np.int32)
        after[:n] += step
        # the last symbol of a chain is followed by the chain's sentinel
        last = left <= step
        chain = np.repeat(np.cumsum(chains) - chains, spots) + inside % step
        after[:n][last] = n + chain[last]
        longest = int(-(-spots.max() // step)) if n else 1
        built.append(transform(codes, after, longest))
        ok = np.zeros(len(codes), bool)
        ok[:n] = inside < np.repeat(windows, spots)
        valid.append(ok)
    order, prefix = merge(built, length // step)
    sizes = [len(b.rows) for b in built]
    base = np.cumsum(sizes) - sizes
    rows = np.concatenate([b.rows + o for b, o in zip(built, base, strict=True)])[order]
    real = np.concatenate(valid)[rows]
    interval = np.cumsum(prefix < length // step) - 1
    members = np.bincount(interval, weights=real) if len(interval) else np.zeros(0)
    found = np.zeros(len(rows), bool)
    found[rows] = real & (members[interval] > 1)
    return [found[o : o + n][v] for o, n, v in zip(base, sizes, valid, strict=True)]


def _merged(length: int, step: int, n_docs: int):
    """Shards of a range of anchors to runs of repeated windows (k1, k2, first, windows), by range of documents."""

    def run(group: pa.Table) -> pa.Table:
        blocks = [decompress(b.as_py()) for b in group.column("block")]
        found = repeated_windows([(b[4], b[3]) for b in blocks], length, step)
        k1, k2, first, windows = (np.concatenate([b[i] for b in blocks]) for i in range(4))
        hit = np.concatenate(found)
        segment = np.repeat(np.arange(len(windows)), windows)
        place = np.repeat(first, windows) + np.arange(len(hit)) - np.repeat(np.cumsum(windows) - windows, windows)
        rows = _runs_of(hit, segment, place, k1, k2, n_docs)
        return pa.Table.from_batches([_blocks(rows)])

    return lean(run)


def _cut(length: int):
    """A range of documents: texts with their whole segments (kind 0) and runs of windows (kind 1) to what is left."""

    def run(group: pa.Table) -> pa.Table:
        runs: dict[tuple[int, int], list] = {}
        kinds = group.column("kind").to_numpy()
        for kind, block in zip(kinds, group.column("block"), strict=True):
            if kind == 1:
                k1, k2, first, windows = decompress(block.as_py())
                order = np.lexsort((k2, k1))
                k1, k2, first, windows = (x[order] for x in (k1, k2, first, windows))
                begins = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))) if len(k1) else []
                for a, b in zip(begins, [*begins[1:], len(k1)], strict=True):
                    runs.setdefault((int(k1[a]), int(k2[a])), []).append((first[a:b], windows[a:b]))
        out = []
        for i in np.flatnonzero(kinds == 0):
            k1, k2 = group.column("k1")[int(i)].as_py(), group.column("k2")[int(i)].as_py()
            data = group.column("text")[int(i)].as_py().encode()
            first, windows, verdict, _ = decompress(group.column("block")[int(i)].as_py())
            whole = verdict % HOT != OPEN
            mine = runs.get((k1 & (1 << 64) - 1, k2 & (1 << 64) - 1), [])
            begin = np.concatenate([first[whole], *[r[0] for r in mine]])
            end = np.concatenate([first[whole] + windows[whole], *[r[0] + r[1] for r in mine]]) - 1 + length
            left, removed, spans = cut(data, begin, end)
            out.append((k1, k2, removed, spans, hashlib.sha256(left).hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(_CUT.items(), columns, strict=True)})

    return lean(run)


_CUT = {"k1": pa.int64(), "k2": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}


def cut(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """(bytes outside all of the spans, bytes inside, maximal spans)."""
    if not len(begin):
        return data, 0, 0
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    starts = begin[new]
    stops = end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    edges = [0, *np.stack([starts, stops], axis=1).reshape(-1).tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), int((stops - starts).sum()), len(starts)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, step: int = STEP, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each input row.

    Texts are UTF-8 bytes; null is empty. Strings are judged on the input, may overlap, never
    cross texts, and may repeat within one. Texts shorter than ``length`` keep all. Repeated
    rows are copies of each other, so that from ``length`` bytes on they lose all. Null ids
    stay null. An empty table gives an empty result; further columns aren't looked at. Ids are integers.
    """
    if length % step or gram > length:
        raise ValueError("step must divide length, and gram be at most length")
    spark = df.sparkSession
    stage, n_rows = Staging(spark, "repeats"), df.count()
    text = text_or_empty(text_col)
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha"))
    docs = stage.write(rows.select("doc_id", "sha", F.octet_length("text").cast("bigint").alias("n_bytes")), "docs", n_rows)
    n_bytes = docs.agg(F.sum("n_bytes")).first()[0] or 0
    n_ranges = max(4, math.ceil(n_bytes / (length / 2) / RANGE_ANCHORS))
    n_docs = max(4, math.ceil(n_bytes / RANGE_BYTES))
    key = F.substring(F.unhex("sha"), 1, 16)
    found = rows.where(F.octet_length("text") >= length).select("text", key.alias("key")).mapInArrow(_occurrences(length, gram, n_ranges, n_docs), BLOCKS)
    found = stage.write(found, "occurrences")
    told = found.where("kind = 0").groupBy("at").applyInArrow(_verdicts(n_docs, hot), BLOCKS).unionAll(found.where("kind = 1"))
    verdicts = told.groupBy("at").applyInArrow(lean(_by_document), "k1 long, k2 long, block binary")
    half = lambda k: F.conv(F.reverse(F.regexp_replace(F.substring("sha", 1 + 16 * k, 16), "(.)(.)", "$2$1")), 16, -10).cast("bigint")
    copies = docs.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("_rep"))
    named = copies.select(F.col("sha").alias("_sha"), "_rep", half(0).alias("_k1"), half(1).alias("_k2"))
    named = stage.write(verdicts.join(named, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).select("k1", "k2", "block", "_sha", "_rep"), "named", n_rows)
    texts = rows.select("doc_id", "text").where(id_filter(named, "_rep")(F.col("doc_id")))
    texts = texts.join(named.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_rep")))
    texts = texts.where(F.sha2(F.col("text").cast("binary"), 256) == F.col("_sha")).select("k1", "k2", "text", "block")
    texts = stage.write(texts, "texts")
    stage.drop("occurrences")
    stage.drop("named")
    if texts.groupBy("k1", "k2").count().where("count > 1").count():  # rows repeated under one id
        texts = stage.write(texts.dropDuplicates(["k1", "k2"]), "distinct_texts")
    n_open, n_hot = (x or 0 for x in texts.select("k1", "block").mapInArrow(_open_bytes(length), "n long, hot long").agg(F.sum("n"), F.sum("hot")).first())
    shards = texts.mapInArrow(_shards(length, max(4, math.ceil(n_open / MERGE_BYTES)), max(1, math.ceil(n_hot / RANGE_WINDOWS)), n_docs), BLOCKS)
    shards = stage.write(shards, "shards")
    runs = shards.where("kind = 0").groupBy("at").applyInArrow(_merged(length, step, n_docs), BLOCKS).unionAll(shards.where("kind = 1"))
    if n_hot:
        runs = runs.unionAll(shards.where("kind = 2").groupBy("at").applyInArrow(_counted(n_docs), BLOCKS))
    at = F.shiftright(F.shiftrightunsigned("k1", 32) * F.lit(n_docs), 32).cast("int")
    empty = {"k1": "bigint", "k2": "bigint", "text": "string"}
    both = texts.select(at.alias("at"), F.lit(0).alias("kind"), "block", "k1", "k2", "text")
    both = both.unionAll(runs.select("at", "kind", "block", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()]))
    left = both.groupBy("at").applyInArrow(_cut(length), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string")
    left = left.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "n_removed", "n_spans", "kept_sha256")
    judged = copies.select(F.col("sha").alias("_sha"), "copies", half(0).alias("k1"), half(1).alias("k2"))
    judged = stage.write(judged.join(left, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left").select("_sha", "copies", "n_removed", "n_spans", "kept_sha256"), "judged", n_rows)
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return docs.join(judged, F.col("sha") == F.col("_sha")).select(
        "doc_id", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def _open_bytes(length: int):
    """Bytes that merges compare, and windows of hot halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = hot = 0
            for block in batch.column(1):
                _, windows, verdict, _ = decompress(block.as_py())
                merged = (verdict >= OPEN) & (verdict < HOT)
                n += int((windows[merged] + length - 1).sum())
                hot += int(windows[verdict > HOT].sum())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([hot], pa.int64())], ["n", "hot"])

    return lean(run)
