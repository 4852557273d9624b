"""Common subsequences of two sequences, in tasks.

A longest common subsequence is found with one large number for each element of the first sequence: a bit for each
place in the second, all of them worked on at once. Where the table of these numbers would be large, the first
sequence is halved and the halves are worked on by themselves, so memory stays bounded and the result exact.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Hashable, Sequence

import numpy as np

#: Bits of the table that is kept for one pair of sequences.
TABLE_BITS = 1 << 28

Rows = Sequence[tuple[Hashable, ...]]


def places_of(b: Rows) -> list[dict[Hashable, int]]:
    """For each column, the places at which each value stands, as bits."""
    found: list[dict[Hashable, int]] = [defaultdict(int) for _ in (b[0] if b else ())]
    for j, row in enumerate(b):
        for places, value in zip(found, row, strict=True):
            places[value] |= 1 << j
    return found


def rows_of_bits(a: Rows, b: Rows, keep: bool) -> list[int]:
    """After each row of `a` (the last one only, unless `keep`) a number with a zero bit at each place of `b` where the common
    subsequence grows."""
    places, full = places_of(b), (1 << len(b)) - 1
    bits, kept = full, []
    for row in a:
        same = 0
        for known, value in zip(places, row, strict=True):
            same |= known.get(value, 0)
        both = bits & same
        bits = ((bits + both) | (bits - both)) & full
        if keep:
            kept.append(bits)
    return kept if keep else [bits]


def growth(bits: int, n: int) -> np.ndarray:
    """The length of the common subsequence with the first 0, 1, ..., n places."""
    raw = np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(raw, bitorder="little")[:n].astype(np.int64))])


def common(a: Rows, b: Rows) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places. Rows are the same if any of their columns is."""
    found, open_pieces = [], [(0, len(a), 0, len(b))]
    same = lambda i, j: any(x == y for x, y in zip(a[i], b[j], strict=True))
    while open_pieces:
        i, i_end, j, j_end = open_pieces.pop()
        while i < i_end and j < j_end and same(i, j):
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and same(i_end - 1, j_end - 1):
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        if i_end - i > 1 and (i_end - i) * (j_end - j) > TABLE_BITS:
            half = (i + i_end) // 2
            left = growth(rows_of_bits(a[i:half], b[j:j_end], False)[0], j_end - j)
            right = growth(rows_of_bits(a[half:i_end][::-1], b[j:j_end][::-1], False)[0], j_end - j)[::-1]
            middle = j + int(np.argmax(left + right))
            open_pieces += [(i, half, j, middle), (half, i_end, middle, j_end)]
            continue
        table = rows_of_bits(a[i:i_end], b[j:j_end], True)
        row, column = i_end - i, j_end - j
        while row and column:
            if table[row - 1] >> (column - 1) & 1:
                column -= 1
                continue
            row -= 1
            if not row or table[row - 1] >> (column - 1) & 1:
                column -= 1
                found.append((i + row, j + column))
    return sorted(found)


def rising(values: Sequence[int]) -> list[int]:
    """The places of a longest rising subsequence of distinct numbers."""
    tops, at, before = [], [], []
    for k, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            at.append(k)
        else:
            tops[pile], at[pile] = value, k
        before.append(at[pile - 1] if pile else -1)
    found, k = [], at[-1] if at else -1
    while k >= 0:
        found.append(k)
        k = before[k]
    return found[::-1]


def patience(a: Rows, b: Rows) -> list[tuple[int, int]]:
    """Matching places of two sequences, rising in both: rows that are unique on both sides first, as many as go in order, then
    the same between these, and longest common subsequences where no row is unique."""
    found, open_pieces = [], [(0, len(a), 0, len(b))]
    while open_pieces:
        i, i_end, j, j_end = open_pieces.pop()
        sides = []
        for rows, low, high in ((a, i, i_end), (b, j, j_end)):
            once: dict = {}
            for k in range(low, high):
                once[rows[k]] = -1 if rows[k] in once else k
            sides.append(once)
        shared = sorted((k, sides[1][row]) for row, k in sides[0].items() if k >= 0 and sides[1].get(row, -1) >= 0)
        if not shared:
            found += [(i + x, j + y) for x, y in common(a[i:i_end], b[j:j_end])]
            continue
        chain = [shared[k] for k in rising([y for _, y in shared])]
        found += chain
        for (x, y), (x_end, y_end) in zip([(i - 1, j - 1), *chain], [*chain, (i_end, j_end)], strict=True):
            if x_end - x > 1 and y_end - y > 1:
                open_pieces.append((x + 1, x_end, y + 1, y_end))
    return sorted(found)


def threaded(short: str, long: str, more: str) -> list[tuple[str, str]] | None:
    """The parts of `long`: "equal" where the characters of `short` stand in it, in order and each as early as may be, `more` for the
    rest. None if `short` is no subsequence of `long`. Each character is looked at once."""
    found, i, j, n, m = [], 0, 0, len(long), len(short)
    while j < m:
        start = i
        while j < m and i < n and long[i] == short[j]:
            i, j = i + 1, j + 1
        if i > start:
            found.append(("equal", long[start:i]))
        if j < m:
            start, i = i, long.find(short[j], i)
            if i < 0:
                return None
            found.append((more, long[start:i]))
    return [*found, (more, long[i:])] if i < n else found


def spans(before: str, after: str, most: float) -> list[tuple[str, str]] | None:
    """What is equal, deleted and inserted, in order; None if more characters go and come than `most` of the longer text. Where one text is what
    is left of the other, or their characters, in whatever order, already tell that they are too far apart, no common subsequence is searched."""
    limit = most * max(len(before), len(after))
    if abs(len(before) - len(after)) > limit:
        return None
    only = threaded(after, before, "delete") if len(after) <= len(before) else threaded(before, after, "insert")
    if only is not None:
        return only
    if (Counter(before) - Counter(after)).total() + (Counter(after) - Counter(before)).total() > limit:
        return None
    matched = common([(c,) for c in before], [(c,) for c in after])
    if len(before) + len(after) - 2 * len(matched) > limit:
        return None
    found: list[list[str]] = []

    def put(kind: str, text: str) -> None:
        if text and found and found[-1][0] == kind:
            found[-1][1] += text
        elif text:
            found.append([kind, text])

    i = j = 0
    for x, y in [*matched, (len(before), len(after))]:
        put("delete", before[i:x])
        put("insert", after[j:y])
        put("equal", before[x : x + 1])
        i, j = x + 1, y + 1
    return [(kind, text) for kind, text in found]
