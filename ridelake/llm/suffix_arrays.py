"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The steps are those of induced sorting: suffixes are classified as larger (L) or smaller (S) than
their successor, leftmost-smaller (LMS) substrings are sorted and named, the string of names is
sorted in turn, and all suffixes are induced from the LMS ones in two linear scans. A scan takes a
whole bucket (first character) per step, so it costs a few vector operations per character value.
"""

from __future__ import annotations

import numpy as np

#: Strings of names over fewer symbols are sorted recursively; others are ranked by doubling,
#: as a scan takes one step per symbol.
RECURSION_SYMBOLS = 2048


def _smaller_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last symbol is the unique smallest."""
    differs = np.flatnonzero(s[:-1] != s[1:])
    smaller = s[differs] < s[differs + 1]
    return np.append(np.repeat(smaller, np.diff(differs, prepend=-1)), True)


def _by_symbol(values: np.ndarray, symbols: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append values to the lists of their symbols, in the given order."""
    if not len(values):
        return
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    cuts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    for part in np.split(order, cuts):
        into[symbols[part[0]]].append(values[part])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    if len(parts) == 1:
        return parts[0]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)


def _induced(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order."""
    starts: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    _by_symbol(lms, s[lms], starts)
    larger: list[np.ndarray] = []
    coming: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    for c in range(symbols):
        current = _joined(coming[c])
        rounds = [current]
        while len(current):
            before = current[current > 0] - 1
            current = before[(s[before] == c) & ~smaller[before]]
            rounds.append(current)
        larger.append(_joined(rounds))
        bucket = np.concatenate([larger[c], _joined(starts[c])])
        before = bucket[bucket > 0] - 1
        first = s[before]
        up = ~smaller[before] & (first > c)
        _by_symbol(before[up], first[up], coming)
    coming = [[] for _ in range(symbols)]
    buckets: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * symbols
    coming[0].append(np.array([len(s) - 1], dtype=np.int32))
    for c in range(symbols - 1, -1, -1):
        current = _joined(coming[c])
        rounds = [current]
        while len(current):
            before = current[current > 0] - 1
            current = before[(s[before] == c) & smaller[before]]
            rounds.append(current)
        falling = np.concatenate([_joined(rounds), larger[c][::-1]])
        before = falling[falling > 0] - 1
        first = s[before]
        down = smaller[before] & (first < c)
        _by_symbol(before[down], first[down], coming)
        buckets[c] = falling[::-1]
    return np.concatenate(buckets)


def _names(s: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Order number of each LMS substring, equal for equal ones, in order of position."""
    size = np.zeros(len(s), dtype=np.int32)
    size[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = ranked[:-1], ranked[1:]
    differs = size[a] != size[b]
    active = np.flatnonzero(~differs)
    step = 0
    while len(active):
        left, right = a[active] + step, b[active] + step
        unequal = s[left] != s[right]
        differs[active[unequal]] = True
        step += 1
        active = active[~unequal & (size[a[active]] > step)]
    names = np.empty(len(s), dtype=np.int64)
    names[ranked] = np.concatenate([[0], np.cumsum(differs)])
    return names[lms]


def _doubled(names: np.ndarray, depth: int | None) -> np.ndarray:
    """Order of the suffixes of a string of names, by their first ``depth`` names at least."""
    rank, reach = names, 1
    while True:
        top = int(rank.max()) + 1
        ahead = np.zeros(len(rank), dtype=np.int64)
        ahead[: max(len(rank) - reach, 0)] = rank[reach:] + 1
        keys = rank * (top + 1) + ahead
        order = np.argsort(keys)
        ranked = keys[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(len(keys), dtype=np.int64)
        rank[order] = fresh
        reach *= 2
        if fresh[-1] == len(keys) - 1 or reach >= len(keys) or (depth is not None and reach >= depth):
            return order


def suffix_array(s: np.ndarray, symbols: int, depth: int | None = None) -> np.ndarray:
    """Positions of ``s`` in the order of their suffixes.

    The last symbol must be 0 and occur nowhere else. With ``depth``, suffixes that agree in
    their first ``depth`` symbols may come in any order among each other.
    """
    smaller = _smaller_types(s)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    if len(lms) <= 1:
        return _induced(s, smaller, lms, symbols)
    is_lms = np.zeros(len(s), dtype=bool)
    is_lms[lms] = True
    substrings = _induced(s, smaller, lms, symbols)
    ranked = substrings[is_lms[substrings]]
    names = _names(s, lms, ranked)
    top = int(names.max()) + 1
    if top < len(lms):
        # An LMS substring moves on by two symbols at least.
        deep = None if depth is None else (depth + 1) // 2
        if top <= RECURSION_SYMBOLS:
            order = suffix_array(names, top, deep)
        else:
            order = _doubled(names, deep)
        ranked = lms[order]
    return _induced(s, smaller, ranked, symbols)


def common_prefixes(s: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Permuted common prefixes of the suffixes in ``order``, cut at ``limit``.

    Entry i, in order of position, is the length of what the i-th suffix in text order shares
    with its predecessor in ``order`` (0 for the first one). ``s`` holds bytes and ``limit`` more
    symbols behind the last suffix.
    """
    before = np.full(len(s), -2, dtype=np.int64)
    before[order[:1]] = -1
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before > -2)
    phi = before[at]
    shared = np.zeros(len(at), dtype=np.int64)
    active = np.flatnonzero(phi >= 0)
    eight = np.lib.stride_tricks.as_strided(s, (len(s) - 7, 8), (1, 1))
    for step in range(0, limit, 8):
        a = eight[at[active] + step].view(np.uint64).ravel()
        b = eight[phi[active] + step].view(np.uint64).ravel()
        apart = a ^ b
        same = apart == 0
        lowest = apart[~same] & (~apart[~same] + np.uint64(1))
        shared[active[~same]] = step + (np.frexp(lowest.astype(np.float64))[1] - 1) // 8
        active = active[same]
    shared[active] = limit
    return np.minimum(shared, limit)
