"""Deterministic rank-interval summaries of numeric columns, in array form for many groups at once.

A summary of n values is an ascending list of tuples (value, lo, hi): the value's rank among the n lies from lo to hi.
The gap of a summary, the largest hi[i+1] - lo[i], bounds what it leaves open: any rank is met within half of it.
"""

from __future__ import annotations

import numpy as np

Tuples = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.zeros(0, np.int64)


def _since(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Running sum of ``values`` that begins anew at each of ``starts``."""
    total = np.cumsum(values)
    base = np.where(starts > 0, total[starts - 1], 0)
    return total - np.repeat(base, np.diff(np.append(starts, n)))


def merge(group: np.ndarray, source: np.ndarray, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Tuples:
    """One summary per group from the tuples of all summaries (``source``) of the group; (group, value, lo, hi) ascending.

    ``source`` names a summary within the whole input and the tuples of a source ascend. A merged tuple's lo is the sum
    over the sources of the last lo up to it, its hi the sum of what each source allows before its next tuple.
    """
    n = len(value)
    if n == 0:
        return group, value, lo, hi
    by_source = np.lexsort((hi, lo, value, source))
    group, source, value, lo, hi = (x[by_source] for x in (group, source, value, lo, hi))
    new = np.diff(source, prepend=source[0] - 1) != 0
    last = np.append(new[1:], True)
    lo_step = lo - np.where(new, 0, np.roll(lo, 1))
    # What the source allows behind its tuple i: hi[i+1] - 1, or all its values (its last hi) at the end.
    behind = np.where(last, hi, np.roll(hi, -1) - 1)
    ahead = hi - 1
    order = np.lexsort((np.arange(n), value, group))
    group, value, lo_step, behind, ahead, own = group[order], value[order], lo_step[order], behind[order], ahead[order], hi[order]
    first = new[order]
    starts = _starts(group)
    # Before its first tuple a source allows hi[0] - 1.
    begin = np.add.reduceat(np.where(first, ahead, 0), starts)
    allowed = np.repeat(begin, np.diff(np.append(starts, n))) + _since(behind - ahead, starts, n)
    return group, value, _since(lo_step, starts, n), allowed - behind + own


def compress(tuples: Tuples, width: np.ndarray) -> Tuples:
    """Fewer tuples: of those whose lo lies in the same stretch of ``width[group]`` ranks the last, and each group's first.

    That adds at most ``width`` to a summary's gap; a width under 1 keeps all.
    """
    group, value, lo, hi = tuples
    if not len(value):
        return tuples
    cell = (lo / np.maximum(width[group], 1)).astype(np.int64)
    keep = np.append((np.diff(cell) != 0) | (np.diff(group) != 0), True)
    keep[_starts(group)] = True
    return group[keep], value[keep], lo[keep], hi[keep]


def gaps(tuples: Tuples, groups: int) -> np.ndarray:
    """The gap of each group's summary."""
    group, _, lo, hi = tuples
    out = np.zeros(groups, np.int64)
    np.maximum.at(out, group, hi - lo)
    inside = np.flatnonzero(np.diff(group) == 0)
    np.maximum.at(out, group[inside], hi[inside + 1] - lo[inside])
    return out


def value_at(tuples: Tuples, starts: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group (its tuples from ``starts`` to ``ends``) the value nearest to ``rank`` and the rank error it may have."""
    _, value, lo, hi = tuples
    out, err = np.full(len(starts), np.nan), np.zeros(len(starts), np.int64)
    for g, (a, b, r) in enumerate(zip(starts.tolist(), ends.tolist(), rank.tolist(), strict=True)):
        worst = np.maximum(np.abs(lo[a:b] - r), np.abs(hi[a:b] - r))
        if len(worst):
            i = int(worst.argmin())
            out[g], err[g] = value[a + i], worst[i]
    return out, err
