"""Suffix sorting by linear grouping: suffixes are grouped by their Lyndon
prefixes, then each group's order is emitted; nothing is renamed recursively."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The starts of all suffixes of ``text`` (non-negative numbers), least first;
    a suffix that is a prefix of another one comes first."""
    n = len(text)
    if n == 0:
        return []
    # groups, in a linked list from low to high; at first by first symbol
    members: list[list[int]] = []
    group = [0] * n
    first: dict[int, int] = {}
    for i, c in enumerate(text):
        g = first.get(c)
        if g is None:
            g = first[c] = len(members)
            members.append([])
        members[g].append(i)
        group[i] = g
    order = [first[c] for c in sorted(first)]
    below, above = [-1] * len(members), [-1] * len(members)
    for a, b in zip(order, order[1:]):
        above[a], below[b] = b, a

    # groups from high to low; pointer[s]: the nearest earlier suffix of a lower
    # group, found through the pointers of what lies between
    pointer, done = [-1] * n, bytearray(n)
    g = order[-1]
    while g != -1:
        own = [s for s in members[g] if group[s] == g]
        own.sort()
        members[g] = own
        for s in own:
            done[s] = 1
        times: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and done[p]:
                p = pointer[p]
            pointer[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            # more followers: higher, next to the group they leave
            split: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                split.setdefault((-k, group[p]), []).append(p)
            for key in sorted(split) if len(split) > 1 else split:
                old, new, moved = key[1], len(members), split[key]
                members.append(moved)
                for p in moved:
                    group[p] = new
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up != -1:
                    below[up] = new
        g = below[g]

    # each group's order: the suffix before an emitted one is the next of its group
    g = order[0]
    while below[g] != -1:
        g = below[g]
    place, at = [0] * len(members), 0  # the next free place of each group
    while g != -1:
        place[g] = at
        at += len(members[g])
        g = above[g]
    out, placed = [-1] * n, bytearray(n)
    s = n - 1  # the end is below all symbols: the last suffix starts the induction
    while s >= 0 and not placed[s]:
        placed[s] = 1
        out[place[group[s]]] = s
        place[group[s]] += 1
        s = pointer[s]
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = 1
            out[place[group[s]]] = s
            place[group[s]] += 1
            s = pointer[s]
    return out
