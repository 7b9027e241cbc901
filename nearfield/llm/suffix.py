"""Suffix arrays by induced sorting, and permuted common prefixes, over whole numpy arrays.

Suffixes are classified as larger (L) or smaller (S) than their right neighbour; leftmost S positions (LMS) are sorted
by the substrings between them, recursively where substrings repeat; all others are induced from them in two linear
scans. A scan works through the buckets of first symbols; within one, what a bucket induces is written at once by a
stable sort on the symbol before, and runs of one symbol go in waves. Names of a recursion have too many values for
buckets and are written in two digits, which keeps their order.
"""

from __future__ import annotations

import numpy as np

from nearfield.llm.common import powers

#: Levels of recursion; what still repeats below them, a few hundredths of a text, is sorted by rank doubling.
DEEPEST = 2


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes. The end counts as a symbol below all others."""
    n = len(t)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    up[-1] = -1
    at = np.where(up != 0, np.arange(n, dtype=np.int32), np.int32(n))
    at = np.minimum.accumulate(at[::-1])[::-1]  # next position that differs from its neighbour
    return up[at] > 0


def _scan(t: np.ndarray, kind: np.ndarray, sa: np.ndarray, starts: np.ndarray, ends: np.ndarray, given: list[np.ndarray], down: bool) -> list[np.ndarray]:
    """One scan: places all suffixes of ``kind`` and returns them by bucket, in the order they were placed.

    ``given``: for each bucket the suffixes that the scan meets there besides those it places itself.
    """
    k = len(starts)
    free = (ends if down else starts).copy()
    placed: list[np.ndarray] = [np.zeros(0, sa.dtype)] * k
    n = len(t)

    def put(p: np.ndarray) -> None:
        """Suffixes in the order met, each to the next free place of its bucket."""
        c = t[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        count = np.bincount(c, minlength=k)
        first = np.cumsum(count) - count
        rank = np.arange(len(p)) - first[c]
        if down:
            sa[free[c] - 1 - rank] = p
            free[:] -= count
        else:
            sa[free[c] + rank] = p
            free[:] += count

    if not down:
        put(np.array([n - 1], sa.dtype))  # before the end stands an L suffix
    for c in range(k - 1, -1, -1) if down else range(k):
        if ends[c] == starts[c]:
            continue
        done = ends[c] if down else starts[c]
        met = []
        while True:  # waves of one symbol
            now = sa[free[c] : done][::-1] if down else sa[done : free[c]]
            if not len(now):
                break
            now = now.copy()
            met.append(now)
            done = free[c]
            p = now[now > 0] - 1
            p = p[(t[p] == c) & kind[p]]
            if len(p):
                if down:
                    sa[free[c] - len(p) : free[c]] = p[::-1]
                    free[c] -= len(p)
                else:
                    sa[free[c] : free[c] + len(p)] = p
                    free[c] += len(p)
        placed[c] = np.concatenate(met) if met else np.zeros(0, sa.dtype)
        source = np.concatenate([placed[c], given[c]])
        p = source[source > 0] - 1
        p = p[kind[p] & (t[p] < c if down else t[p] > c)]
        if len(p):
            put(p)
    return placed


def _induce(t: np.ndarray, small: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS ones in order (or, to sort LMS substrings, in any order)."""
    count = np.bincount(t, minlength=k)
    ends = np.cumsum(count)
    starts = ends - count
    sa = np.zeros(len(t), np.int32)
    c = t[lms]
    order = np.argsort(c, kind="stable")
    cut = np.cumsum(np.bincount(c, minlength=k))
    by = np.split(lms[order].astype(np.int32), cut[:-1])
    large = _scan(t, ~small, sa, starts, ends, by, False)
    _scan(t, small, sa, starts, ends, [x[::-1] for x in large], True)
    return sa


def _doubling(t: np.ndarray) -> np.ndarray:
    n = len(t)
    rank, step = t.astype(np.int64), 1
    rank -= rank.min()
    wide = max(int(rank.max()), n) + 2
    while True:
        key = rank * wide
        key[:-step] += rank[step:] + 1
        order = np.argsort(key)
        ahead = key[order]
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(ahead[1:] != ahead[:-1])
        if rank[order[-1]] == n - 1 or step >= n:
            return order.astype(np.int32)
        wide, step = n + 2, min(2 * step, n - 1)


def suffix_array(t: np.ndarray, k: int, depth: int = 0) -> np.ndarray:
    """Suffixes of ``t``, symbols below ``k``, in order; a suffix that begins another comes first."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    if depth > DEEPEST or n < 32:
        return _doubling(t)
    t = t.astype(np.uint16)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        sa = _induce(t, small, k, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]  # sorted by LMS substrings
        until = np.zeros(n, np.int32)
        until[lms[:-1]] = lms[1:]
        until[lms[-1]] = n - 1
        p = np.zeros(n + 1, np.uint64)
        p[1:] = t
        p[1:] *= np.uint64(0x9E3779B97F4A7C15)
        p[1:] += np.uint64(0xD1B54A32D192ED03)
        p[1:] *= powers(n)
        np.cumsum(p[1:], out=p[1:])
        start, end = order.astype(np.int64), until[order] + 1
        h = (p[end] - p[start]) * powers(n + 1, inverse=True)[start]
        same = (h[1:] == h[:-1]) & ((end - start)[1:] == (end - start)[:-1]) & (order[1:] != lms[-1]) & (order[:-1] != lms[-1])
        names = np.concatenate([[0], np.cumsum(~same)])
        del p, h, start, end, until, is_lms, sa
        if names[-1] + 1 < len(lms):
            at = np.zeros(n, np.int32)
            at[order] = names
            r = at[lms]
            base = int(np.ceil(np.sqrt(names[-1] + 1)))
            two = np.empty(2 * len(r), np.uint16)
            two[0::2], two[1::2] = r // base, r % base
            sub = suffix_array(two, base, depth + 1)
            lms = lms[sub[sub % 2 == 0] // 2]
        else:
            lms = order.astype(np.int64)
    return _induce(t, small, k, lms)


def permuted_lcp(data: np.ndarray, sa: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): for each position its predecessor in ``sa`` (-1 for the first), and how many bytes they share.

    Nothing is shared beyond ``ends``, the end of the piece of text that a position lies in. A position whose left
    neighbours agree as well shares one byte less than the position before; only the others are compared, by words.
    """
    n = len(data)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    j = np.arange(n, dtype=np.int32)
    ends = ends.astype(np.int32)
    has = phi >= 0
    room = ends - j
    most = np.where(has, np.minimum(room, room[np.maximum(phi, 0)]), 0)
    chain = has.copy()
    chain[0] = False
    i = np.flatnonzero(chain)
    i = i[phi[i] > 0]
    chain[:] = False
    # the left neighbours agree and lie in the same pieces, and follow each other in the order, too
    left = (phi[i - 1] == phi[i] - 1) & (data[i - 1] == data[phi[i] - 1]) & (ends[i - 1] == ends[i]) & (ends[phi[i] - 1] == ends[phi[i]])
    chain[i[left]] = True
    head = np.flatnonzero(has & ~chain)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    words = np.lib.stride_tricks.as_strided(padded, (n + 8, 8), (1, 1))
    lcp = np.zeros(n, np.int32)
    live, done = head, np.zeros(len(head), np.int64)
    while len(live):
        a, b = live + done, phi[live] + done
        x = words[a].copy().view("<u8").ravel() ^ words[b].copy().view("<u8").ravel()
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64)) >> 3)
        now = np.minimum(done + same, most[live])
        on = (same == 8) & (now < most[live])
        lcp[live[~on]] = now[~on]
        live, done = live[on], now[on]
    last = np.maximum.accumulate(np.where(has & ~chain, j, 0))
    return np.where(chain, np.maximum(lcp[last] - (j - last), 0), lcp), phi
