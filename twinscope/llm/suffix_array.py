"""Suffix arrays by linear grouping, for integer alphabets.

Phase one puts suffixes with the same longest Lyndon prefix into one group, the groups
in order: starting from groups of equal first symbols, groups are taken from the highest
down, and every suffix that is the closest one in a lower group before some members is
moved up within its own group, further the more members point at it. Phase two fills
each group from its front: going up the order, a suffix settles those whose Lyndon
prefix ends where it starts, found along the pointers to the previous lower group.
Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence


def _group(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """(first place of each suffix's group in the order, previous suffix in a lower group)."""
    n = len(text)
    counts: dict[int, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    size = [0] * (n + 1)  # of the group that starts at a place
    begin, at = {}, 0
    for c in sorted(counts):
        begin[c] = at
        size[at] = counts[c]
        at += counts[c]
    group = [begin[c] for c in text]
    fill = dict(begin)
    order, where = [0] * n, [0] * n
    for i, c in enumerate(text):
        p = fill[c]
        fill[c] = p + 1
        order[p] = i
        where[i] = p
    lower = list(range(-1, n - 1))  # until a suffix is taken, its left neighbour
    end = n
    while end > 0:
        start = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for k in range(start, end):
            i = order[k]
            j = lower[i]
            while j >= 0 and group[j] >= start:
                j = lower[j]
            lower[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = start
        if not pointed:
            continue
        by_count: dict[int, list[int]] = {}
        for j, k in pointed.items():
            by_count.setdefault(k, []).append(j)
        for k in sorted(by_count, reverse=True):
            moved = by_count[k]
            taken: dict[int, int] = {}
            for j in moved:  # to the back of what is left of its group
                g = group[j]
                last = g + size[g] - 1
                size[g] -= 1
                taken[g] = taken.get(g, 0) + 1
                p, other = where[j], order[last]
                order[p], where[other] = other, p
                order[last], where[j] = j, last
            fresh = {g: g + size[g] for g in taken}
            for j in moved:
                group[j] = fresh[group[j]]
            for g, m in taken.items():
                size[fresh[g]] = m
    return group, lower


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of all suffixes of ``text`` in ascending order; a suffix that is a
    prefix of another comes first."""
    n = len(text)
    group, lower = _group(text)
    front = list(range(n + 1))  # the next free place of the group that starts there
    placed = [False] * n
    out = [0] * n

    def settle(j: int) -> None:
        while j >= 0 and not placed[j]:
            placed[j] = True
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            j = lower[j]

    settle(n - 1)
    for k in range(n):
        settle(out[k] - 1)
    return out
