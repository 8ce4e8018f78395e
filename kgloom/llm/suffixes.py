"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified (smaller or larger than the next one), leftmost-smaller
substrings are sorted and named, the string of names is sorted the same way if names
repeat, and the order of all suffixes is induced from it: upwards for the larger type,
then downwards for the smaller type. Single steps of induction are slow in Python, so they
are taken together in one of three ways, which give the same order: over few
characters the predecessors of a whole bucket are dealt to their buckets at once; over
many, as in strings of names, suffixes join by their distance from the type that is
sorted already; where such distances are long, one suffix follows another.
"""

from __future__ import annotations

import numpy as np

#: Strings of more characters than this aren't induced by buckets, and those with longer runs of a type not by distances.
FEW_CHARACTERS, LONG_RUNS = 1024, 64


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last, the sentinel, counts as smaller."""
    out = np.ones(len(t), dtype=bool)
    change = np.flatnonzero(t[1:] != t[:-1])
    out[:-1] = np.repeat(t[change] < t[change + 1], np.diff(np.append(-1, change)))
    return out


def _deal(lists: dict[int, list], suffixes: np.ndarray, chars: np.ndarray) -> None:
    if len(suffixes):
        order = np.argsort(chars, kind="stable")
        chars = chars[order]
        cut = np.append(0, np.flatnonzero(chars[1:] != chars[:-1]) + 1)
        for c, part in zip(chars[cut].tolist(), np.split(suffixes[order], cut[1:]), strict=True):
            lists[c].append(part)


def induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones (``seeds``) in order."""
    if t.max() < FEW_CHARACTERS:
        return induce_buckets(t, small, seeds)
    up, down = distances(~small, np.sort(seeds)), distances(small, np.flatnonzero(~small))
    if max(up.max(), down.max()) > LONG_RUNS:
        return induce_each(t, small, seeds)
    first = joined(t, seeds, up, 0)
    larger = first[~small[first]]
    down[-1] = 0
    return joined(t, np.append(len(t) - 1, larger), down, 1)


def distances(of: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How far the next of ``ends`` is from each place where ``of`` holds; 0 elsewhere."""
    out = np.zeros(len(of), dtype=np.int64)
    at = np.flatnonzero(of)
    nearest = np.searchsorted(ends, at)
    at, nearest = at[nearest < len(ends)], nearest[nearest < len(ends)]
    out[at] = ends[nearest] - at
    return out


def joined(t: np.ndarray, base: np.ndarray, distance: np.ndarray, after: int) -> np.ndarray:
    """The sorted suffixes ``base`` and, in their order with them, all that are some distance from one of them: a
    suffix is placed by its first character and the place of the next suffix, which came before it. ``after``: whether
    those that join come after the suffixes of ``base`` with the same first character, or before."""
    n = len(t)
    first = t.astype(np.int64) * 2 + after
    beside = t[base].astype(np.int64) * 2 + 1 - after
    by = np.argsort(distance, kind="stable")
    cut = np.searchsorted(distance[by], np.arange(1, int(distance.max()) + 2))
    total = len(base) + int(cut[-1] - cut[0])
    # places are labels with gaps, so that most who join change nobody else's
    bits = 62 - int(first.max()).bit_length()
    gap = (1 << bits) // (total + 2)
    label = np.zeros(n + 1, dtype=np.int64)

    def placed_anew(order: np.ndarray) -> np.ndarray:
        label[order] = np.arange(1, len(order) + 1) * gap
        key = (first[order] << bits) + label[order + 1]
        fixed = is_base[order]
        key[fixed] = (beside << bits) + np.arange(len(base))
        return key

    is_base = np.zeros(n, dtype=bool)
    is_base[base] = True
    order = base
    have = placed_anew(order)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        new = by[a:b]
        key = (first[new] << bits) + label[new + 1]
        turn = np.argsort(key)
        new, key = new[turn], key[turn]
        at = np.searchsorted(have, key)
        # those who join at one place share its gap evenly
        start = np.append(True, at[1:] != at[:-1])
        group = np.flatnonzero(start)
        size = np.diff(np.append(group, len(at)))
        low = np.where(at[group] > 0, label[order[at[group] - 1]], 0)
        high = np.where(at[group] < len(order), label[order[np.minimum(at[group], len(order) - 1)]], (len(order) + 1) * gap)
        step = (high - low) // (size + 1)
        nth = np.arange(len(at)) - np.repeat(group, size) + 1
        label[new] = np.repeat(low, size) + np.repeat(step, size) * nth
        to = at + np.arange(len(at))
        old = np.ones(len(order) + len(new), dtype=bool)
        old[to] = False
        more = np.empty(len(old), dtype=np.int64)
        more[to], more[old] = new, order
        order = more
        if len(step) and step.min() < 1:
            have = placed_anew(order)
        else:
            keys = np.empty(len(old), dtype=np.int64)
            keys[to], keys[old] = key, have
            have = keys
    return order


def induce_each(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    counts = np.bincount(t)
    ends = np.cumsum(counts)
    text, larger, out = t.tolist(), (~small).tolist(), [-1] * len(t)
    tail = ends.tolist()
    for s in reversed(seeds.tolist()):
        c = text[s]
        tail[c] -= 1
        out[tail[c]] = s
    out[0] = len(t) - 1
    head = (ends - counts).tolist()
    for i in range(len(t)):
        j = out[i] - 1
        if j >= 0 and larger[j]:
            c = text[j]
            out[head[c]] = j
            head[c] += 1
    tail = ends.tolist()
    for i in range(len(t) - 1, -1, -1):
        j = out[i] - 1
        if j >= 0 and not larger[j]:
            c = text[j]
            tail[c] -= 1
            out[tail[c]] = j
    return np.array(out)


def induce_buckets(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    none = np.zeros(0, dtype=np.int64)
    alphabet = np.unique(t).tolist()
    seeded: dict[int, list] = {c: [] for c in alphabet}
    _deal(seeded, seeds, t[seeds])
    larger: dict[int, list] = {c: [] for c in alphabet}
    for c in alphabet:
        wave, done = (np.concatenate(larger[c]) if larger[c] else none), []
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            chars = t[before]
            same = chars == c
            _deal(larger, before[~same], chars[~same])
            wave = before[same]
        larger[c] = done
        if seeded[c]:
            before = np.concatenate(seeded[c])
            before = before[before > 0] - 1
            _deal(larger, before, t[before])
    smaller: dict[int, list] = {c: [] for c in alphabet}
    smaller[alphabet[0]].append(np.array([len(t) - 1]))
    parts = []
    for c in reversed(alphabet):
        wave, done = (np.concatenate(smaller[c]) if smaller[c] else none), []
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            before = before[small[before]]
            chars = t[before]
            same = chars == c
            _deal(smaller, before[~same], chars[~same])
            wave = before[same]
        down = np.concatenate(larger[c])[::-1] if larger[c] else none
        before = down[down > 0] - 1
        before = before[small[before]]
        _deal(smaller, before, t[before])
        parts += [*done, down]
    return np.concatenate(parts)[::-1]


def named(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Names in order of the substrings from each seed to the next, which it includes: equal ones have one name. They are
    compared by character, then type; where all these agree, one ends where the other does."""
    code = t.astype(np.int64) * 2 + small
    size = np.append(seeds[1:] + 1, len(t)) - seeds
    width = int(code.max()) + 1
    # the name of a substring is how many start smaller
    name = np.zeros(len(seeds), dtype=np.int64)
    live, at = np.arange(len(seeds)), 0
    while len(live):
        key = name[live] * width + code[seeds[live] + at]
        order = np.argsort(key)
        live, key = live[order], key[order]
        new = np.append(True, key[1:] != key[:-1])
        group = np.append(True, name[live][1:] != name[live][:-1])
        place = np.arange(len(live))
        name[live] += np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        at += 1
        alone = new & np.append(new[1:], True)
        live = live[~alone & (size[live] > at)]
    return np.unique(name, return_inverse=True)[1]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of ``t`` in order; ``t`` ends in a unique smallest sentinel, 0."""
    small = smaller_than_next(t)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(seeds) < 2:
        return induce_each(t, small, seeds)
    names = named(t, small, seeds)
    # the last seed is the sentinel, whose name is the only 0
    order = suffix_array(names) if names.max() + 1 < len(seeds) else np.argsort(names)
    return induce(t, small, seeds[order])


def permuted_common_prefixes(t: np.ndarray, order: np.ndarray, most: int, starts: np.ndarray | None = None) -> np.ndarray:
    """For every suffix, by its place in ``t``: characters in common with the suffix before it in ``order``, up to ``most``.

    Where the characters before the two are the same, that is one less than at the place before, so only the
    other places are compared, character by character, and the rest follows. ``starts`` are compared in
    any case, so that no comparison needs to reach further than from one of them to the next.
    """
    n = len(t)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    follows = (i > 0) & (before > 0)
    follows[follows] = t[i[follows] - 1] == t[before[follows] - 1]
    if starts is not None:
        follows[starts] = False
    direct = np.flatnonzero(~follows)
    reach = most + int(np.diff(np.append(direct, n)).max())
    common = np.zeros(len(direct), dtype=np.int64)
    live, at = np.flatnonzero(before[direct] >= 0), 0
    while len(live) and at < reach:
        live = live[t[direct[live] + at] == t[before[direct[live]] + at]]
        at += 1
        common[live] = at
    last = np.repeat(np.arange(len(direct)), np.diff(np.append(direct, n)))
    return np.clip(common[last] + direct[last] - i, 0, most)
