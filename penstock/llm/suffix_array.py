"""Suffix arrays in linear time by grouping (Baier's construction).

Suffixes are kept in ordered groups by a prefix that grows to the suffix's longest Lyndon prefix. Groups are
processed from the highest down: each member's previous-smaller pointer leads to the nearest earlier suffix of a lower
group, whose prefix is extended by that of the current group as often as members point to it, and which moves to a
new group just above its old one. When all groups are done, suffixes of a group differ only after their Lyndon prefix, so
going through the order from the smallest on and filling each group from its front sorts all, without renaming and recursion.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Start places of the suffixes of a list of integers, in order; a suffix precedes those it is a prefix of."""
    n = len(text)
    order = {v: k + 1 for k, v in enumerate(sorted(set(text)))}
    group = [order[v] for v in text] + [0]  # group 0: the end, below all
    members: list[list[int]] = [[] for _ in range(len(order) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    size = len(members)
    below, above = list(range(-1, size - 1)), list(range(1, size + 1))
    above[-1] = -1
    length, done = [1] * size, [False] * size
    smaller = [-1] * (n + 1)
    current = size - 1
    while current >= 0:
        done[current] = True
        own = [i for i in members[current] if group[i] == current]
        members[current] = own
        pointed: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[group[p]]:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            by_count: dict[int, list[int]] = {}
            for p, count in pointed.items():
                by_count.setdefault(count, []).append(p)
            for count in sorted(by_count, reverse=True):
                made: dict[int, int] = {}
                for p in sorted(by_count[count]):
                    old = group[p]
                    new = made.get(old)
                    if new is None:
                        new = made[old] = len(members)
                        members.append([])
                        length.append(length[old] + count * length[current])
                        done.append(False)
                        below.append(old)
                        above.append(above[old])
                        below[above[old]] = new
                        above[old] = new
                    group[p] = new
                    members[new].append(p)
        current = below[current]
    # Emit: a suffix is placed when the suffix after its Lyndon prefix has been reached.
    front = [0] * len(members)
    at, g = 0, 0
    while g >= 0:
        front[g] = at
        at += len(members[g])
        g = above[g]
    waiting: list[list[int] | None] = [None] * (n + 1)
    for i in range(n):
        j = i + length[group[i]]
        if waiting[j] is None:
            waiting[j] = [i]
        else:
            waiting[j].append(i)
    out = [0] * (n + 1)
    out[0] = n
    for r in range(n + 1):
        ready = waiting[out[r]]
        if ready:
            for i in ready:
                g = group[i]
                out[front[g]] = i
                front[g] += 1
    return out[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in order with the one before it (0 for the first)."""
    n = len(text)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if not r:
            h = 0
            continue
        j = order[r - 1]
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out
