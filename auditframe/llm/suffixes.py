"""Suffix arrays by induced sorting, bucket by bucket with array operations, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

from auditframe.llm.words import mix, powers

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(258, dtype=np.uint64), 23)


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; runs of one character take the type of their end."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1].astype(np.int32))
    step[-1] = 1  # the sentinel is the smallest suffix
    at = np.where(step != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(at[::-1])[::-1]
    return step[decided] > 0


def _induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array that follows from ``seeds``: the leftmost-smaller suffixes in order.

    One scan upwards places every larger-type suffix after the suffix that follows it, one scan downwards
    every smaller-type one. A bucket is scanned in batches: suffixes that a batch places in its own bucket
    are the next batch, all others go to their bucket in the order of the scan.
    """
    first = s[seeds]
    order = np.argsort(first, kind="stable")
    cuts = np.searchsorted(first[order], np.arange(sigma + 1))
    seeded = [seeds[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    up: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    down: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def place(batch: np.ndarray, c: int, into: list[list[np.ndarray]], kind: bool) -> np.ndarray:
        """Hand the predecessors of a batch to their buckets; gives those of the scanned bucket itself."""
        before = batch[batch > 0] - 1
        before = before[smaller[before] == kind]
        if not len(before):
            return before
        chars = s[before]
        order = np.argsort(chars, kind="stable")
        chars, before = chars[order], before[order]
        cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
        own = before[:0]
        for part, char in zip(np.split(before, cuts), chars[np.concatenate([[0], cuts])].tolist(), strict=True):
            into[char].append(part)
            if char == c:
                own = part
        return own

    for c in range(sigma):
        done = 0
        while done < len(up[c]):
            batch = up[c][done] if len(up[c]) == done + 1 else np.concatenate(up[c][done:])
            done = len(up[c])
            place(batch, c, up, False)
        if len(seeded[c]):
            place(seeded[c], c, up, False)
    larger = [np.concatenate(x) if x else seeds[:0] for x in up]
    for c in range(sigma - 1, -1, -1):
        done = 0
        while done < len(down[c]):
            batch = np.concatenate(down[c][done:])
            done = len(down[c])
            place(batch, c, down, True)
        if len(larger[c]):
            place(larger[c][::-1], c, down, True)
    out = []
    for c in range(sigma):
        out.append(larger[c])
        if down[c]:
            out.append(np.concatenate(down[c])[::-1])
        elif len(seeded[c]):
            out.append(seeded[c])  # only the sentinel has no successor to induce it
    return np.concatenate(out)


def _prefix_hashes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(_BYTE[s] * powers(_BASE, len(s)), out=sums[1:])
    return sums, powers(pow(_BASE, -1, 1 << 64), len(s) + 1)


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``s`` in the order of at least their first ``depth`` characters.

    ``s`` holds numbers below 258 and ends with a 0 that occurs nowhere else. Suffixes are classified;
    a first induction sorts the substrings between leftmost-smaller places, which get names; the string of
    names is sorted by naming pairs of names, pairs of pairs and so on until all are distinct or ``depth``
    is covered; and a second induction places all suffixes from that order.
    """
    s = s.astype(np.uint16)
    smaller = _types(s)
    seeds = np.flatnonzero(smaller & ~np.concatenate([[True], smaller[:-1]]))
    if len(s) == 1:
        return np.zeros(1, np.int64)
    if len(seeds) < 2:
        return _induce(s, smaller, seeds, 258)
    is_seed = np.zeros(len(s), bool)
    is_seed[seeds] = True
    rough = _induce(s, smaller, seeds, 258)
    sorted_seeds = rough[is_seed[rough]]
    # Substrings from one seed to the next, both included: equal if length and content are.
    sums, inverse = _prefix_hashes(s)
    ends = np.minimum(np.append(seeds[1:], len(s) - 1) + 1, len(s))
    content = (sums[ends] - sums[seeds]) * inverse[seeds]
    number = np.empty(len(s), np.int64)
    number[seeds] = np.arange(len(seeds))
    at = number[sorted_seeds]
    new = np.ones(len(at), bool)
    new[1:] = (content[at[1:]] != content[at[:-1]]) | ((ends - seeds)[at[1:]] != (ends - seeds)[at[:-1]])
    names = np.empty(len(seeds), np.int64)
    names[at] = np.cumsum(new)
    span, covered = 1, 2  # a substring is at least two characters long
    while names.max() < len(names) and covered < depth:
        second = np.zeros(len(names), np.int64)
        second[:-span] = names[span:]
        pair = names * (len(names) + 1) + second
        order = np.argsort(pair, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = pair[order][1:] != pair[order][:-1]
        names[order] = np.cumsum(new)
        span, covered = span * 2, covered * 2
    return _induce(s, smaller, seeds[np.argsort(names, kind="stable")], 258)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, most: int, least: int = 0) -> np.ndarray:
    """For every place, how many characters its suffix shares with the one before it in ``sa``, ``most`` at most.

    Places that share fewer than ``least`` get 0. Found over hashes of substrings, for all places at once: one
    look for ``least`` characters, then steps that halve.
    """
    sums, inverse = _prefix_hashes(s.astype(np.uint16))
    before = np.empty(len(s), np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = len(s)
    shared = np.zeros(len(s), np.int64)
    steps = [least] if least else []
    rest = most - least
    steps += [1 << b for b in range(rest.bit_length() - 1, -1, -1)]
    live = np.flatnonzero(before < len(s))
    for number, step in enumerate(steps):
        a, b = live + shared[live], before[live] + shared[live]
        fits = (np.maximum(a, b) + step <= len(s)) & (shared[live] + step <= most)
        a, b, who = a[fits], b[fits], live[fits]
        equal = (sums[a + step] - sums[a]) * inverse[a] == (sums[b + step] - sums[b]) * inverse[b]
        shared[who[equal]] += step
        if least and number == 0:
            live = who[equal]
    return shared
