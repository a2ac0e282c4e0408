"""Degree caps over a list of edges."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def within_degree(ends: Sequence[tuple[str, str]], rank: Sequence[int], most: int, order: Iterable[str] = ()) -> list[bool]:
    """Which edges stay if no node may have more than `most`: each node in turn gives up its worst edges that still stand.

    ends: the edges, earlier ones better among equals; rank: how good each is, low first. Nodes come in `order`, others
    after them as edges name them. An edge that one end gave up counts no more at the other.
    """
    at: dict[str, list[int]] = {k: [] for k in order}
    for k, pair in enumerate(ends):
        for node in pair:
            at.setdefault(node, []).append(k)
    stands = [True] * len(ends)
    for own in at.values():
        best_first = sorted((rank[k], k) for k in own if stands[k])
        for _, k in best_first[most:]:
            stands[k] = False
    return stands
