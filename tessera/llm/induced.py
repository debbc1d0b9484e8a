"""Suffix order by recursive induced sorting, in blocks that can live on disk.

Suffixes are S or L (smaller or larger than the next one). Blocks of symbols are a priority queue: the L pass takes them
upwards, the S pass downwards, and a block's tuples (symbol, length of the run, class of the suffix behind the run) are
complete when its turn comes, since what they are induced from has a smaller (greater) symbol. Equal tuples get one class:
from seeds that only know their symbols a first round names the substrings between leftmost S suffixes; if names repeat,
their sequence is sorted by the same procedure; a second round from seeds in order gives all suffixes.

Arrays of more than `memory` bytes live in unlinked temporary files of the task (spill files, gone with the task); no more
than a block of tuples and its keys is in memory at a time besides what the system caches of them.
"""

from __future__ import annotations

import tempfile

import numpy as np

BLOCK = 1 << 18


class Arrays:
    """Integer arrays in memory, or, beyond a bound, in temporary files."""

    def __init__(self, memory: int):
        self.memory = memory

    def full(self, n: int, value: int, dtype=np.int32) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory:
            return np.full(n, value, dtype)
        with tempfile.TemporaryFile() as file:
            out = np.memmap(file, dtype, "w+", shape=(n,))
        out[:] = value
        return out


def _kinds(text: np.ndarray, arrays: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """(end of the run of equal symbols at each place, whether the suffix is of type S), from right to left in steps."""
    n = len(text)
    end, small = arrays.full(n, n), arrays.full(n, 0, np.bool_)
    nearest, rises = n, False  # of the place after the step: end of its run, its type
    for high in range(n, 0, -BLOCK):
        low = max(0, high - BLOCK)
        here = text[low:high].astype(np.int64)
        following = np.append(here[1:], text[high] if high < n else here[-1])
        differs = here != following
        at = np.where(differs, np.arange(low + 1, high + 1), n + 1)
        stop = np.minimum.accumulate(at[::-1])[::-1]
        beyond = stop > n
        stop[beyond] = nearest if high < n else n
        inside = np.flatnonzero(differs)
        kind = np.zeros(high - low, bool)
        kind[inside] = following[inside] > here[inside]
        source = np.minimum(stop - 1 - low, high - low - 1)
        up = np.where(beyond, rises if high < n else False, kind[source])
        end[low:high], small[low:high] = stop, up
        nearest, rises = int(stop[0]), bool(up[0])
    return end, small


def _blocks(symbols: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of blocks of sorted symbols: whole symbols, about BLOCK entries."""
    out, low, n = [], 0, len(symbols)
    while low < n:
        high = min(n, low + BLOCK)
        if high < n:
            cut = int(np.searchsorted(symbols[low:high], symbols[high], side="left")) + low
            high = cut if cut > low else int(np.searchsorted(symbols, symbols[low], side="right"))
        out.append((low, high))
        low = high
    return out


def _induce_block(text, at, symbol, run, end, classes, base, n) -> None:
    """Give the suffixes at `at` (sorted by symbol) their classes: base of the symbol and how many are smaller. Suffixes
    behind the runs may stand in this block too; then the order is settled when a further turn changes nothing."""
    change = np.append(True, symbol[1:] != symbol[:-1])
    first = np.flatnonzero(change)
    offset = np.repeat(first, np.diff(np.append(first, len(at))))
    behind = end[at]
    next_symbol = text[np.minimum(behind, n - 1)]
    within = bool(((next_symbol >= symbol[0]) & (next_symbol <= symbol[-1]) & (behind < n)).any())
    low = run.min()
    bits_run, bits_class = int(run.max() - low).bit_length(), int(n + 1).bit_length()
    fits = len(first).bit_length() + bits_run + bits_class < 63
    if fits:  # the tuple as one number
        head = ((np.cumsum(change) << bits_run) + (run - low)) << bits_class
    while True:
        source = np.where(behind < n, classes[np.minimum(behind, n - 1)], -1).astype(np.int64) + 1
        new = np.ones(len(at), bool)
        if fits:
            key = head + source
            order = np.argsort(key)
            new[1:] = np.diff(key[order]) != 0
        else:
            order = np.lexsort((source, run, symbol))
            s, r, c = symbol[order], run[order], source[order]
            new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1])
        place = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        value = np.empty(len(at), classes.dtype)
        value[order] = base[order] + place - offset[order]
        changed = not np.array_equal(classes[at], value)
        classes[at] = value
        if not changed or not within:
            return


def _induce(text, end, small, seeds, seed_class, starts, small_count, arrays) -> np.ndarray:
    n = len(text)
    classes = arrays.full(n, -1, np.int32 if n < 2**31 else np.int64)
    classes[seeds] = seed_class
    for of_small in (False, True):
        at = np.flatnonzero(small if of_small else ~small)
        at = at[np.argsort(text[at], kind="stable")]
        symbols = text[at].astype(np.int64)
        blocks = _blocks(symbols)
        for low, high in reversed(blocks) if of_small else blocks:
            here, symbol = at[low:high], symbols[low:high]
            run = (end[here] - here).astype(np.int64)
            base = starts[symbol + 1] - small_count[symbol] if of_small else starts[symbol]
            _induce_block(text, here, symbol, -run if of_small else run, end, classes, base, n)
    return classes


def suffix_classes(text: np.ndarray, memory: int = 1 << 27) -> np.ndarray:
    """The rank of each suffix of an array of small integers from 0."""
    arrays = Arrays(memory)
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32)
    end, small = _kinds(text, arrays)
    counts = np.bincount(text)
    small_count = np.bincount(text[small], minlength=len(counts))
    starts = np.concatenate([[0], np.cumsum(counts)])
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    symbol = text[seeds].astype(np.int64)
    base = starts[symbol + 1] - small_count[symbol]
    named = _induce(text, end, small, seeds, base, starts, small_count, arrays)[seeds]
    values, names = np.unique(named, return_inverse=True)
    if len(values) < len(seeds):
        names = suffix_classes(names.astype(np.int32), memory)
    order = np.lexsort((names, symbol))
    first = np.concatenate([[0], np.flatnonzero(np.diff(symbol[order])) + 1]) if len(seeds) else np.zeros(0, int)
    within = np.arange(len(seeds)) - np.repeat(first, np.diff(np.append(first, len(seeds)))) if len(seeds) else np.zeros(0, int)
    seed_class = np.empty(len(seeds), np.int64)
    seed_class[order] = base[order] + within
    return _induce(text, end, small, seeds, seed_class, starts, small_count, arrays)


def repeated_windows(text: np.ndarray, valid: np.ndarray, length: int, memory: int = 1 << 27) -> np.ndarray:
    """True at valid places whose `length` symbols also start at another valid place: neighbours in the suffix order, with
    a common prefix of that length. Valid windows must not reach over the text's end."""
    n = len(text)
    out = np.zeros(n, bool)
    if n == 0:
        return out
    rank = suffix_classes(text, memory)
    order = Arrays(memory).full(n, 0)
    order[rank] = np.arange(n)
    inside = order[valid[order]]  # equal windows are neighbours also among valid places alone
    for low in range(0, len(inside) - 1, BLOCK):
        a, b = inside[low : low + BLOCK], inside[low + 1 : low + BLOCK + 1]
        a = a[: len(b)].astype(np.int64)
        b = b.astype(np.int64)
        for step in range(0, length, 8):
            if not len(a):
                break
            same = np.ones(len(a), bool)
            for k in range(step, min(step + 8, length)):
                same &= text[a + k] == text[b + k]
            a, b = a[same], b[same]
        out[a] = out[b] = True
    return out
