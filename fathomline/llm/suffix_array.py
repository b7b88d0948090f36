"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classified into smaller-type and larger-type. The leftmost smaller ones (LMS) begin the LMS substrings: these
are sorted by induction, named by rank, and the string of names, at most half as long, is sorted by the same function, and
so on until names are all different. From the sorted LMS suffixes all others are induced, in a sweep over the buckets of
first characters upward (larger-type suffixes) and one downward (smaller-type ones).

A sweep takes many buckets in one numpy step. What a bucket induces lies in buckets further on, so a run of buckets none of
which induces into another one of the run can be swept at once; the runs follow from the pairs of neighbouring characters
alone. A bucket that induces into itself (a character that repeats) is followed level by level. Strings of bytes have
few buckets; strings of names have many, and runs of about the root of their number.

Permuted common prefixes (in text order, what each suffix shares with the one before it in the suffix array) are compared
only where they are irreducible, that is where the characters before the two suffixes differ; from there to the next such
place each is one less than the one before.
"""

from __future__ import annotations

import numpy as np

#: Characters up to which each bucket is a step of its own.
FEW = 512


def types(s: np.ndarray) -> np.ndarray:
    """True for smaller-type suffixes; the last character is a unique smallest sentinel."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the character changes
    out = np.ones(n, bool)
    inside = following < n - 1
    out[:-1][inside] = step[following[inside]] > 0
    return out


def upward_runs(s: np.ndarray, small: np.ndarray, size: int) -> list[tuple[int, int, bool]]:
    """(first bucket, bucket after the last, whether it induces into itself) of each run of the upward sweep."""
    at = np.flatnonzero(~small[:-1])
    source, target = s[at + 1], s[at]
    own = np.zeros(size + 1, bool)
    own[source[source == target]] = True
    nearest = np.full(size + 1, size)
    up = source < target
    np.minimum.at(nearest, source[up], target[up])
    alone = np.where(own, np.arange(size + 1), size)
    stop = np.minimum.accumulate(nearest[::-1])[::-1]
    stop[:-1] = np.minimum(stop[:-1], np.minimum.accumulate(alone[::-1])[::-1][1:])
    runs, c, ends, selfs = [], 0, stop.tolist(), own.tolist()
    while c < size:
        to = c + 1 if selfs[c] else max(ends[c], c + 1)
        runs.append((c, to, selfs[c]))
        c = to
    return runs


def downward_runs(s: np.ndarray, small: np.ndarray, size: int) -> list[tuple[int, int, bool]]:
    """The same for the downward sweep, from the last bucket on."""
    at = np.flatnonzero(small[:-1])
    source, target = s[at + 1], s[at]
    own = np.zeros(size + 1, bool)
    own[source[source == target]] = True
    nearest = np.full(size + 1, -1)
    down = target < source
    np.maximum.at(nearest, source[down], target[down])
    alone = np.where(own, np.arange(size + 1), -1)
    start = np.maximum.accumulate(nearest)
    start[1:] = np.maximum(start[1:], np.maximum.accumulate(alone)[:-1])
    runs, c, begins, selfs = [], size - 1, start.tolist(), own.tolist()
    while c >= 0:
        to = c if selfs[c] else min(begins[c] + 1, c)
        runs.append((to, c + 1, selfs[c]))
        c = to - 1
    return runs


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array induced from LMS suffixes given in order; ``size`` is the number of characters."""
    n = len(s)
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    if size <= FEW:
        used = np.flatnonzero(counts).tolist()
        upward, downward = [(c, c + 1, True) for c in used], [(c, c + 1, True) for c in used[::-1]]
    else:
        upward, downward = upward_runs(s, small, size), downward_runs(s, small, size)
    begin, stop = [*starts.tolist(), n], [0, *ends.tolist()]
    sa = np.full(n, -1, np.int64)
    first = s[lms]
    many = np.bincount(first, minlength=size)
    lms_at = ends[first] - many[first] + np.arange(len(lms)) - (np.cumsum(many) - many)[first]
    sa[lms_at] = lms
    larger = ~small

    def grouped(ch: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes by first character, in the order met: (suffixes, characters, rank among their character's, the characters, their numbers)."""
        order = np.argsort(ch, kind="stable")
        ch, own = ch[order], own[order]
        edge = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
        number = np.diff(np.append(edge, len(ch)))
        return own, ch, np.arange(len(ch)) - np.repeat(edge, number), ch[edge], number

    head = starts.copy()
    for a, b, selfish in upward:
        lo, hi = begin[a], stop[b]
        if lo == hi:
            continue
        if selfish:
            front = sa[lo : head[a]]
            while len(front):
                front = front[front > 0] - 1
                front = front[s[front] == a]
                sa[head[a] : head[a] + len(front)] = front
                head[a] += len(front)
        own = sa[lo:hi]
        own = own[own > 0] - 1
        own = own[larger[own]]
        ch = s[own]
        if selfish:
            up = ch > a
            own, ch = own[up], ch[up]
        if len(own):
            own, ch, rank, each, number = grouped(ch, own)
            sa[head[ch] + rank] = own
            head[each] += number
    sa[lms_at] = -1
    sa[0] = n - 1
    tail = ends.copy()
    tail[s[n - 1]] = 0
    for a, b, selfish in downward:
        lo, hi = begin[a], stop[b]
        if lo == hi:
            continue
        if selfish and hi > 1:
            front = sa[tail[a] : hi][::-1]
            while len(front):
                front = front[front > 0] - 1
                front = front[s[front] == a]
                sa[tail[a] - len(front) : tail[a]] = front[::-1]
                tail[a] -= len(front)
        own = sa[lo:hi][::-1]
        own = own[own > 0] - 1
        own = own[small[own]]
        ch = s[own]
        if selfish:
            down = ch < a
            own, ch = own[down], ch[down]
        if len(own):
            own, ch, rank, each, number = grouped(ch, own)
            sa[tail[ch] - 1 - rank] = own
            tail[each] -= number
    return sa


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of a string of characters below ``size`` that ends in its only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = types(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    sa = induce(s, small, lms[np.argsort(s[lms], kind="stable")], size)
    order = sa[is_lms[sa]]
    # name the LMS substrings: neighbours in order have one name if they are equal, end to end
    after = np.full(n, n - 1)
    after[lms[:-1]] = lms[1:]
    length = after[order] - order
    new = np.ones(len(order), bool)
    new[1:] = length[1:] != length[:-1]
    todo = np.flatnonzero(~new)
    k = 0
    while len(todo):  # compare the equally long neighbours, character by character, until they differ
        differ = s[order[todo] + k] != s[order[todo - 1] + k]
        new[todo[differ]] = True
        todo = todo[~differ]
        todo = todo[length[todo] >= k + 1]
        k += 1
    if not new.all():
        names = np.empty(n, np.int64)
        names[order] = np.cumsum(new) - 1
        order = lms[suffix_array(names[lms], int(new.sum()))]
    return induce(s, small, order, size)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """In text order, the number of characters that each suffix shares with the one before it in the suffix array.

    Irreducible values are compared four characters at a time, then the last few one by one.
    """
    n = len(s)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    irreducible = np.ones(n, bool)
    irreducible[1:] = (before[1:] < 1) | (s[:-1] != s[np.maximum(before[1:], 1) - 1])
    irreducible[sa[0]] = True
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = s
    padded[:n] += np.uint64(1)  # what lies behind the end is no character
    quad = padded[:-3] | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(32) | padded[3:] << np.uint64(48)
    at = np.flatnonzero(irreducible & (before >= 0))
    value = np.zeros(n, np.int64)
    a, b, k = at, before[at], 0
    while len(a):  # no two suffixes are equal up to the end, so each comparison ends
        same = quad[a + k] == quad[b + k]
        ended = ~same
        x, y, i = a[ended], b[ended], a[ended]
        more = np.zeros(len(x), np.int64)
        for j in range(3):
            more += (more == j) & (padded[x + k + j] == padded[y + k + j])
        value[i] = k + more
        a, b = a[same], b[same]
        k += 4
    last = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    return value[last] - (np.arange(n) - last)
