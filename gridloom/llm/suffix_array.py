"""Suffix arrays by linear grouping: suffixes are grouped by their Lyndon prefixes.

Groups start as equal first symbols and are processed from the highest down. Each suffix of a group
points to the nearest position before it in a lower group (previous-smaller pointers skip what is
higher). The context of the one pointed at grows by the group's context, so it moves to a new group
right above its own; those pointed at more often go higher. When all groups are done, the order
inside them follows from one pass over the array from its low end: what stands before a placed
suffix comes next in its own group, and so along its pointers. Nothing is renamed or recursed.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order; a suffix precedes those it is a prefix of."""
    start, prev = _grouped(text)
    return _ordered(len(text), start, prev)


def _grouped(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """For each position the start of its final group in the array, and its pointer (-1: none)."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, start, size = [0] * n, [0] * n, [0] * n
    first = 0
    for at, i in enumerate(order):
        if text[i] != text[order[first]]:
            first = at
        place[i], start[i] = at, first
        size[first] += 1
    prev = [-1] * n
    end = n - 1
    while end >= 0:
        group = start[order[end]]
        pointed: dict[int, int] = {}
        members = order[group : end + 1]
        if end > group:
            members.sort()
        for i in members:
            j = i - 1
            while j >= 0 and start[j] > group:
                j = prev[j]
            if j >= 0 and start[j] == group:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            most = max(pointed.values())
            if most == 1:
                _raise(pointed, order, place, start, size)
            else:
                levels: dict[int, list[int]] = {}
                for j, times in pointed.items():
                    levels.setdefault(times, []).append(j)
                for times in sorted(levels, reverse=True):
                    _raise(levels[times], order, place, start, size)
        end = group - 1
    return start, prev


def _raise(chosen, order: list[int], place: list[int], start: list[int], size: list[int]) -> None:
    """Move ``chosen`` to new groups right above the rest of their own."""
    moved: dict[int, int] = {}
    for j in chosen:
        group = start[j]
        done = moved.get(group, 0)
        moved[group] = done + 1
        at, to = place[j], group + size[group] - 1 - done
        if at != to:
            other = order[to]
            order[at], place[other] = other, at
            order[to], place[j] = j, to
    for group, count in moved.items():
        left = size[group] - count
        size[group] = left
        fresh = group + left
        size[fresh] = count
        if left:
            for at in range(fresh, fresh + count):
                start[order[at]] = fresh


def _ordered(n: int, start: list[int], prev: list[int]) -> list[int]:
    array, front, placed = [-1] * n, list(range(n)), [False] * n
    # The empty suffix after the text is the lowest of all.
    before = n - 1
    at = -1
    while True:
        j = before
        while j >= 0 and not placed[j]:
            group = start[j]
            array[front[group]] = j
            front[group] += 1
            placed[j] = True
            j = prev[j]
        at += 1
        if at >= n:
            return array
        before = array[at] - 1
