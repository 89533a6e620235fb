"""Suffix arrays by linear grouping construction.

First phase: suffixes are grouped by their longest Lyndon prefix. Groups are taken in descending order; each suffix of
the group finds its previous smaller suffix by the pointers of those already done, and that suffix's group context grows by
the current one: it moves to a new group right above its old one, the further up the more suffixes of the current group
point to it. Second phase: beginning with the least suffix, each suffix of the finished order puts the suffix before
it, and those that its previous-smaller pointers lead to, at the next free place of their groups. Nothing is
renamed or sorted recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: list[int]) -> list[int]:
    """The order of all suffixes of `symbols`; the last symbol must be less than all others."""
    n = len(symbols)
    if n < 2:
        return list(range(n))
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        by_symbol.setdefault(c, []).append(i)
    members: list[list[int]] = []
    group = [0] * n
    below: list[int] = []  # the next lower group
    for g, c in enumerate(sorted(by_symbol)):
        members.append(by_symbol[c])
        below.append(g - 1)
        for i in by_symbol[c]:
            group[i] = g
    above = [*range(1, len(members)), -1]
    top = len(members) - 1

    previous = [-2] * n  # -2: not done yet
    jump = [-2] * n  # as previous, but shortened as chains are followed
    at = top
    while at >= 0:
        context = at
        run = [i for i in members[context] if group[i] == context]
        run.sort()
        members[context] = run
        pointed: dict[int, int] = {}
        for s in run:
            p = s - 1
            if p >= 0 and previous[p] != -2:
                start = p
                while p >= 0 and previous[p] != -2:
                    p = jump[p]
                while start != p and start >= 0 and previous[start] != -2:
                    jump[start], start = p, jump[start]
            previous[s] = jump[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            moves: dict[tuple[int, int], list[int]] = {}
            for p, times in pointed.items():
                moves.setdefault((-times, group[p]), []).append(p)
            for key in sorted(moves):
                old, new = key[1], len(members)
                moved = moves[key]
                members.append(moved)
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                below[up] = new
                for p in moved:
                    group[p] = new
        at = below[context]

    start = [0] * len(members)
    place, at = 0, 0
    while below[at] >= 0:
        at = below[at]
    while at >= 0:
        start[at] = place
        place += len(members[at])
        at = above[at]
    order = [-1] * n
    placed = [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    start[group[n - 1]] += 1
    for k in range(n):
        e = order[k] - 1
        while e >= 0 and not placed[e]:
            g = group[e]
            order[start[g]] = e
            start[g] += 1
            placed[e] = True
            e = previous[e]
    return order


def byte_suffix_order(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The order of all suffixes of several byte strings laid end to end, each suffix up to its own string's end.

    The strings are cut into tokens that end after a blank or control byte, or with the string. As no token is a proper
    beginning of another within a string, tokens' ranks keep the order of the bytes, so the grouping construction
    runs on tokens; a suffix that begins inside a token is ordered by the rest of the token, then by the next token's suffix.
    Of suffixes where one is a beginning of the other the order is arbitrary but equal beginnings of at least the compared
    length stay together.
    """
    n = len(raw)
    stops = raw <= 32
    stops[ends - 1] = True
    token_ends = np.flatnonzero(stops) + 1
    token_starts = np.concatenate([[0], token_ends[:-1]])
    data = raw.tobytes()
    last = np.zeros(len(token_ends), dtype=bool)
    last[np.searchsorted(token_ends, ends)] = True
    tokens = [data[a:b] for a, b in zip(token_starts.tolist(), token_ends.tolist(), strict=True)]
    distinct = {t: None for t in tokens}
    rests = sorted({t[k:] for t in distinct for k in range(len(t))})
    rank = {r: k + 1 for k, r in enumerate(rests)}
    separators = np.cumsum(last)
    symbols: list[int] = []
    where = np.arange(len(tokens)) + np.concatenate([[0], separators[:-1]])
    many = len(ends) + 1
    for t, is_last, k in zip(tokens, last.tolist(), separators.tolist(), strict=True):
        symbols.append(rank[t] + many)
        if is_last:
            symbols.append(many - k)  # a different, low symbol after each string
    symbols.append(0)
    order = suffix_array(symbols)
    token_rank = np.empty(len(symbols), dtype=np.int64)
    token_rank[order] = np.arange(len(order))
    size = token_ends - token_starts
    rests_of = {t: [rank[t[k:]] for k in range(len(t))] for t in distinct}
    first = np.fromiter((r for t in tokens for r in rests_of[t]), dtype=np.int64, count=n)
    second = np.repeat(token_rank[where + 1], size)
    return np.lexsort((second, first))
