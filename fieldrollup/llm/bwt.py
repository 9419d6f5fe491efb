"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

A collection is a set of strings over 64-bit symbols, each ended by one sentinel (0), laid
out so that the symbol after the one at row ``i`` is at ``after[i]``. Sorting the suffixes of
a shard gives its transform (the symbol before each suffix) and its LF mapping. To merge
shards, their suffixes are not sorted again: starting from any interleave, a pass over it
that deals the preceding symbols into buckets, stably, yields the interleave that is right
for one symbol more. Places where the dealt prefixes part are the common-prefix lengths, and
runs without a parting are the intervals of repeated strings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """A shard in suffix order: the rows, the code before each, and where the longer suffix is."""

    rows: np.ndarray
    before: np.ndarray
    lf: np.ndarray


def stable_order(code: np.ndarray) -> np.ndarray:
    """Stable argsort of small non-negative codes: one sort of (code, place) words."""
    n = len(code)  # below 2**31: a merge is one bounded task
    bits = max(1, int(n - 1).bit_length()) if n else 1
    word = (code.astype(np.uint64) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    word.sort()
    word &= np.uint64((1 << bits) - 1)
    return word.astype(np.int32)


def transform(code: np.ndarray, after: np.ndarray, longest: int) -> Shard:
    """The transform of a shard. code: by row, 0 for the sentinel rows; after: the next row, its own for sentinels.

    Rows are sorted by their whole suffixes, of ``longest`` symbols at most, by one stable
    pass for each symbol from the last to the first; equal suffixes keep the order of rows.
    """
    n = len(code)
    ahead = [np.arange(n, dtype=np.int32)]
    for _ in range(longest - 1):
        ahead.append(after[ahead[-1]])
    order = np.arange(n, dtype=np.int32)
    for k in range(longest - 1, -1, -1):
        order = order[stable_order(code[ahead[k][order]])]
    before = np.zeros(n, code.dtype)
    inner = np.flatnonzero(code)
    before[after[inner]] = code[inner]
    # a sentinel is entered from the last symbol of its own string; the first symbol of a string follows a sentinel
    before = before[order]
    lf = np.empty(n, np.int32)
    lf[stable_order(before)] = np.arange(n, dtype=np.int32)
    return Shard(order, before, lf)


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in merged order, common-prefix lengths with the suffix before, ``rounds`` at most).

    A suffix is the number of its shard's first row plus its rank there. The order is right
    for the first ``rounds`` symbols.
    """
    sizes = [len(s.rows) for s in shards]
    base = np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
    before = np.concatenate([s.before for s in shards])
    lf = np.concatenate([s.lf for s in shards]) + base
    interleave = np.arange(len(before), dtype=np.int32)
    block = np.zeros(len(before), np.int32)
    prefix = np.full(len(before), rounds, np.int32)
    for k in range(rounds):
        symbol = before[interleave]
        order = stable_order(symbol)
        symbol, block = symbol[order], block[order]
        parts = np.ones(len(order), bool)
        parts[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        interleave = lf[interleave[order]]
        block = np.cumsum(parts, dtype=np.int32)
        # blocks only ever split, so that a parting that is new in this pass has k symbols in common
        prefix[parts & (prefix == rounds)] = k
    return interleave, prefix
