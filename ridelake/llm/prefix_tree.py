"""Prefix tree of sorted sets, searched for sets of high Jaccard similarity."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def similar(shared: int, a: int, b: int, percent: int) -> bool:
    """Whether ``shared`` members make two sets of sizes a and b similar enough."""
    return 100 * shared >= percent * (a + b - shared)


@dataclass
class Node:
    """A run of members that all sets below share, the sizes below, and the sets that end here."""

    run: np.ndarray
    least: int
    most: int
    ends: list[int] = field(default_factory=list)
    below: list[Node] = field(default_factory=list)


def _shared_run(first: np.ndarray, last: np.ndarray) -> int:
    """Length of what two sorted sets share from their start on."""
    n = min(len(first), len(last))
    apart = np.flatnonzero(first[:n] != last[:n])
    return int(apart[0]) if len(apart) else n


def build(sets: list[np.ndarray]) -> Node:
    """Tree of sorted sets; runs without a branch are one node."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    root = Node(np.empty(0, dtype=np.uint64), 0, 0)
    # Ranges of sets, in order, that agree up to a depth; a stack instead of recursion.
    pending = [(root, 0, len(order), 0)]
    while pending:
        node, low, high, depth = pending.pop()
        # The first and the last set in order agree only where all between them do.
        reach = depth + _shared_run(sets[order[low]][depth:], sets[order[high - 1]][depth:])
        node.run = sets[order[low]][depth:reach]
        sizes = [len(sets[i]) for i in order[low:high]]
        node.least, node.most = min(sizes), max(sizes)
        at = low
        while at < high and len(sets[order[at]]) == reach:
            node.ends.append(order[at])
            at += 1
        while at < high:
            member = sets[order[at]][reach]
            stop = at + 1
            while stop < high and sets[order[stop]][reach] == member:
                stop += 1
            child = Node(root.run, 0, 0)
            node.below.append(child)
            pending.append((child, at, stop, reach))
            at = stop
    return root


def search(root: Node, probe: np.ndarray, percent: int) -> list[int]:
    """Numbers of the sets in the tree that are similar to the sorted set ``probe``.

    The overlap of a run counts for all sets below it. A subtree is left when its overlap so far,
    plus the fewer of what the probe and its largest set have left, is too small for its smallest.
    """
    found: list[int] = []
    n = len(probe)
    pending = [(root, 0, 0)]
    while pending:
        node, overlap, depth = pending.pop()
        if len(node.run):
            at = np.searchsorted(probe, node.run)
            overlap += int((probe[np.minimum(at, n - 1)] == node.run).sum()) if n else 0
            depth += len(node.run)
            left = n - int(np.searchsorted(probe, node.run[-1], side="right"))
        else:
            left = n
        bound = overlap + min(left, node.most - depth)
        if not similar(bound, n, max(node.least, bound), percent):
            continue
        if similar(overlap, n, depth, percent):
            found += node.ends
        pending += [(child, overlap, depth) for child in node.below]
    return found
