"""Suffix arrays by linear grouping of suffixes with equal Lyndon prefixes."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` (non-negative ints) in ascending order.

    First, suffixes are put into groups by their longest Lyndon prefix. Groups begin as
    equal first symbols and are closed from the largest down. Closing a group finds, for
    each member, the nearest earlier suffix of a smaller group; that suffix's prefix then
    grows by the prefix of the closed group as often as it was found, so it moves into a
    new group just above its old one, further up the more often.

    Then the order inside the groups is emitted: suffixes are taken in ascending order,
    and those that end their Lyndon prefix just before the taken one, a chain of smaller
    predecessors, go to the next free place of their group. Nothing is renamed or sorted
    again.
    """
    text = [*symbols, -1]
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n  # of each suffix in ``order``
    group = [0] * n  # first place of its group
    size = [0] * n  # of the group that begins at a place
    first, last = 0, None
    for i, x in enumerate(order):
        if text[x] != last:
            first, last = i, text[x]
        place[x], group[x] = i, first
        size[first] += 1
    smaller = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        found: dict[int, int] = {}
        for x in sorted(order[start:end]) if end - start > 1 else order[start:end]:
            p = x - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[x] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, times in found.items():
            by_count.setdefault(times, []).append(p)
        for times in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[times]:
                old = group[p]
                moved[old] = moved.get(old, 0) + 1
                at = old + size[old] - moved[old]  # swap with the last that stays
                other = order[at]
                here = place[p]
                order[here], place[other] = other, here
                order[at], place[p] = p, at
            for old, count in moved.items():
                size[old] -= count
            for old, count in moved.items():
                new = old + size[old]
                if size[old]:
                    size[new] = count
                    for p in order[new : new + count]:
                        group[p] = new
                else:
                    size[old] = count
        end = start
    free = list(range(n))
    result = [n - 1] * n
    placed = [False] * n
    placed[n - 1] = True
    for i in range(n):
        x = result[i] - 1
        while x >= 0 and not placed[x]:
            g = group[x]
            result[free[g]] = x
            free[g] += 1
            placed[x] = True
            x = smaller[x]
    return result[1:]
