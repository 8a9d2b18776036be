"""Suffix arrays by induced sorting, on NumPy arrays.

``suffix_array`` follows SA-IS (Nong, Zhang, Chan 2009): suffixes are classified
as S or L; leftmost S positions (LMS) are bucketed by first byte; one induced
sort orders the LMS substrings, which get names; the string of names is sorted
(recursively while its alphabet is small, else by doubling ranks); a second
induced sort yields the array.  An induced sort sweeps the buckets in order; all
suffixes that a bucket induces are moved at once, a run of one byte in as many
steps as it is long.

The order is exact for the first ``depth`` bytes of a suffix, which is all that
repeated windows of at most ``depth`` bytes need.
"""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 512


def classify(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes; the end of the text counts as smaller than any byte."""
    n = len(t)
    s = np.zeros(n, bool)
    if n > 1:
        change = np.flatnonzero(t[1:] != t[:-1])
        up = np.zeros(len(change) + 1, bool)
        up[:-1] = t[change] < t[change + 1]
        s = np.repeat(up, np.diff(np.concatenate([[-1], change, [n - 1]])))
    return s


def _sweep(t: np.ndarray, is_s: np.ndarray, seeds: list[np.ndarray], alphabet: int, up: bool) -> list[list[np.ndarray]]:
    """One induction: by bucket, the L suffixes in order (``up``), or the S suffixes from behind.

    ``seeds`` holds, by bucket, what the sweep starts from, in sweep order."""
    out: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    if up:  # the suffix that is the end of the text is induced by the (empty) end itself
        last = len(t) - 1
        out[int(t[last])].append(np.array([last]))
    for c in (range(alphabet) if up else range(alphabet - 1, -1, -1)):
        done = 0
        while True:
            if done < len(out[c]):
                now = np.concatenate(out[c][done:]) if len(out[c]) - done > 1 else out[c][done]
                done = len(out[c])
            elif done >= 0 and len(seeds[c]):
                now, seeds[c] = seeds[c], np.empty(0, np.int64)
            else:
                break
            prev = now[now > 0] - 1
            prev = prev[is_s[prev] != up]
            to = t[prev]
            # an L suffix goes to its own bucket or a later one, an S suffix to its own or an earlier
            if not len(prev):
                continue
            order = np.argsort(to, kind="stable")
            prev, to = prev[order], to[order]
            ends = np.flatnonzero(np.diff(to)) + 1
            starts = np.concatenate([[0], ends])
            for part, d in zip(np.split(prev, ends), to[starts]):
                out[int(d)].append(part)
    return out


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes, induced from the LMS positions in the given order."""
    order = np.argsort(t[lms], kind="stable")
    by_char = np.split(lms[order], np.searchsorted(t[lms][order], np.arange(1, alphabet)))
    large = _sweep(t, is_s, list(by_char), alphabet, True)
    back = [np.concatenate(x)[::-1] if x else np.empty(0, np.int64) for x in large]
    small = _sweep(t, is_s, list(back), alphabet, False)
    whole = []
    for c in range(alphabet):
        whole += large[c]
        whole += [x[::-1] for x in reversed(small[c])]
    return np.concatenate(whole) if whole else np.empty(0, np.int64)


def _names(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings by rank, in text order; equal substrings share a name."""
    nxt = np.full(len(t) + 1, len(t))
    nxt[lms[:-1]] = lms[1:]
    length = nxt[sorted_lms] - sorted_lms + 1      # to the next LMS position, included
    a, b = sorted_lms[:-1], sorted_lms[1:]
    same = (length[1:] == length[:-1]) & (nxt[a] < len(t)) & (nxt[b] < len(t))
    open_ = np.flatnonzero(same)
    at = 0
    while len(open_):
        x, y = a[open_] + at, b[open_] + at
        differ = (t[x] != t[y]) | (is_s[x] != is_s[y])
        same[open_[differ]] = False
        at += 1
        open_ = open_[~differ & (length[open_] > at)]
    rank = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(len(t) + 1, np.int64)
    names[sorted_lms] = rank
    return names[lms]


def _by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a string over a large alphabet, by ranks of doubled prefixes up to ``depth`` names."""
    n = len(names)
    rank, step = names + 1, 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:n - step] = rank[step:] if step < n else 0
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])])
        rank, step = new, step * 2
        if rank.max() == n or step >= min(depth, n):
            return order


def suffix_array(t: np.ndarray, depth: int = 1 << 62) -> np.ndarray:
    """Start positions of the suffixes of ``t`` (small non-negative integers) in order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    alphabet = int(t.max()) + 1
    is_s = classify(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if not len(lms):
        return _induce(t, is_s, lms, alphabet)
    first = _induce(t, is_s, lms, alphabet)
    mark = np.zeros(n, bool)
    mark[lms] = True
    names = _names(t, is_s, lms, first[mark[first]])
    if names.max() + 1 == len(lms):
        order = np.argsort(names)
    elif names.max() < SMALL_ALPHABET:
        order = suffix_array(names, depth)
    else:
        order = _by_doubling(names, depth)
    return _induce(t, is_s, lms[order], alphabet)


def common_prefixes(t: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Permuted common prefixes: by text position, the bytes (``cap`` at most) that a
    suffix shares with the one before it in the array.

    Compared in words of 8 bytes in text order; positions that already differ drop out."""
    n = len(t)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([t.astype(np.uint8), np.zeros(cap + 8, np.uint8)])
    words = np.ndarray((n + cap + 1,), "<u8", padded, strides=(1,))
    shared = np.zeros(n, np.int64)
    open_ = np.flatnonzero(before >= 0)
    for at in range(0, cap, 8):
        differ = words[open_ + at] ^ words[before[open_] + at]
        low = differ & (~differ + np.uint64(1))    # the lowest bit that differs
        bits = np.zeros(len(open_), np.int64)
        hit = differ != 0
        bits[hit] = np.log2(low[hit].astype(np.float64)).astype(np.int64) // 8
        shared[open_] = at + np.where(hit, bits, 8)
        open_ = open_[~hit]
        if not len(open_):
            break
    limit = n - np.maximum(np.arange(n), before)
    return np.minimum(np.minimum(shared, cap), np.where(before >= 0, limit, 0))
