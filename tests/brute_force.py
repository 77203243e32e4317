"""Plain-Python versions of the metrics for small tables, by definition."""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations


def uniques(rows, cols, drop_nulls=False):
    keys = [tuple(r[c] for c in cols) for r in rows]
    if drop_nulls:
        keys = [k for k in keys if None not in k]
    return sum(1 for n in Counter(keys).values() if n == 1)


def cell_gains(rows, qi):
    """Per row, per column: KL divergence of the column among rows equal on the others."""
    out = []
    for r in rows:
        gains = {}
        for c in qi:
            others = [o for o in qi if o != c]
            peers = Counter(s[c] for s in rows if all(s[o] == r[o] for o in others))
            overall = Counter(s[c] for s in rows)
            n = sum(peers.values())
            gains[c] = sum(k / n * math.log2((k / n) / (overall[v] / len(rows))) for v, k in peers.items())
        out.append(gains)
    return out


def msus(rows, qi, usable=lambda row, col: True):
    """Per row index: the minimal column sets on which the row is unique."""
    found = {i: [] for i in range(len(rows))}
    for size in range(1, len(qi) + 1):
        for cols in combinations(qi, size):
            fit = [i for i, r in enumerate(rows) if all(usable(r, c) for c in cols)]
            counts = Counter(tuple(rows[i][c] for c in cols) for i in fit)
            for i in fit:
                alone = counts[tuple(rows[i][c] for c in cols)] == 1
                if alone and not any(set(s) < set(cols) for s in found[i]):
                    found[i].append(cols)
    return found


def percentile(values, fraction):
    values = sorted(values)
    position = fraction * (len(values) - 1)
    low, high = math.floor(position), math.ceil(position)
    return values[low] + (values[high] - values[low]) * (position - low)
