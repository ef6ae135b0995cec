"""One-to-one pairs of a group's two sides, worked out group by group without a table of all pairs.

Texts that read alike (and have the same slots) are one class, with the sorted
ids of its rows.  A group's classes go to one Python worker, which holds them
and, at a time, a block of similarities and a band of ranks.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# workers get these functions with the task, as they needn't have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Classes of either side in a block of similarities, grams in a step of its sums, pairs of classes in a band (more only if all are equal).
BLOCK, GRAMS, BAND = 1024, 4096, 2_000_000
#: Where the bands of ranks begin; a band with too many pairs is cut shorter.
STEPS = (0.999999, 0.98, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6)


def weights(grams: list, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(bounds, columns, weights, number of columns): rows of TF-IDF weights, of unit length; row k stands for n[k] texts."""
    lengths = np.array([0 if g is None else len(g) for g in grams])
    flat = np.concatenate([np.asarray(g, dtype=object) for g in grams if g is not None and len(g)]) if lengths.any() else np.array([], dtype=object)
    codes, names = pd.factorize(flat)
    width = max(len(names), 1)
    cells, tf = np.unique(np.repeat(np.arange(len(grams)), lengths) * width + codes, return_counts=True)
    row, column = cells // width, cells % width
    df = np.bincount(column, weights=n[row], minlength=width)
    w = tf * (np.log((1.0 + n.sum()) / (1.0 + df[column])) + 1)
    w = w / np.sqrt(np.bincount(row, weights=w * w, minlength=len(grams)))[row]
    return np.searchsorted(row, np.arange(len(grams) + 1)), column, w, width


def _dense(bounds, column, w, rows: np.ndarray, low: int, high: int) -> np.ndarray:
    out = np.zeros((len(rows), high - low))
    lengths = bounds[rows + 1] - bounds[rows]
    at = np.repeat(bounds[rows] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    mine = (column[at] >= low) & (column[at] < high)
    out[np.repeat(np.arange(len(rows)), lengths)[mine], column[at][mine] - low] = w[at][mine]
    return out


def products(table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows a with rows b."""
    bounds, column, w, width = table
    total = np.zeros((len(a), len(b)))
    for low in range(0, width, GRAMS):
        high = min(low + GRAMS, width)
        total += _dense(bounds, column, w, a, low, high) @ _dense(bounds, column, w, b, low, high).T
    return total


def take(a: np.ndarray, b: np.ndarray, rank: np.ndarray, ids: list, used: np.ndarray) -> list[tuple]:
    """(class, class, i, j, rank) of pairs taken in the order of rank, i and j, from all pairs of classes of these ranks.

    A class's ids are always taken in their order: of equal rank the smallest
    goes first, and where a class finds no partner none of its later ids does.
    So ``used``, how many of each class are taken, is all that is kept.
    """
    out, size = [], np.array([len(x) for x in ids])
    if not len(rank):
        return out
    order = np.lexsort((b, a, -rank))
    a, b, rank = a[order], b[order], rank[order]
    ends = np.append(np.flatnonzero(rank[1:] != rank[:-1]) + 1, len(rank))
    begin = 0
    for end in ends:
        x, y = a[begin:end], b[begin:end]
        free = (used[x] < size[x]) & (used[y] < size[y])
        level, begin = rank[begin], end
        if not free.any():
            continue
        near: dict[int, list[int]] = {}
        for p, q in zip(x[free].tolist(), y[free].tolist(), strict=True):
            near.setdefault(p, []).append(q)
        heads = [(ids[p][used[p]], p) for p in near]
        heapq.heapify(heads)
        while heads:
            i, p = heapq.heappop(heads)
            near[p] = left = [q for q in near[p] if used[q] < size[q]]
            if not left:
                continue
            q = min(left, key=lambda c: ids[c][used[c]])
            out.append((p, q, i, ids[q][used[q]], level))
            used[p] += 1
            used[q] += 1
            if used[p] < size[p]:
                heapq.heappush(heads, (ids[p][used[p]], p))
    return out


def matched(classes: pd.DataFrame, least: float, digits: int, slot_least: float, worth: dict[str, float], near_worth: float) -> pd.DataFrame:
    """i, j, similarity (NaN below ``least``) and rank of a group's pairs.  ``classes``: side, ids, grams and, where ``worth`` names any, slots (and due_year)."""
    side, ids = classes["side"].to_numpy(), [list(x) for x in classes["ids"]]
    size = np.array([len(x) for x in ids], dtype=np.int64)
    table, used, taken = weights(list(classes["grams"]), size.astype(float)), np.zeros(len(ids), dtype=np.int64), []
    codes = {f: pd.factorize(classes[f].where(classes[f] != "", None))[0] for f in worth}
    year = pd.to_numeric(classes["due_year"]).to_numpy(dtype=float) if worth else None
    scale = 10.0**digits

    def ranks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = products(table, a, b)
        s = np.where(s >= least, np.floor(s * scale + 0.5) / scale, np.nan)
        if not worth:
            return s, np.nan_to_num(s)
        slot = np.zeros_like(s)
        for f, w in worth.items():
            slot += w * ((codes[f][a][:, None] == codes[f][b][None, :]) & (codes[f][a] >= 0)[:, None])
        gap = np.abs(year[a][:, None] - year[b][None, :])
        slot = np.round((slot + near_worth * ((gap > 0) & (gap <= 1))) * 1000) / 1000
        return s, np.maximum(np.where(s >= least, s, 0.0), np.where(slot >= slot_least, slot, 0.0))

    high = np.inf
    while high > 0:
        low = next((x for x in STEPS if x < high), 0.0)
        a, b = (np.flatnonzero((side == k) & (used < size)) for k in "ab")
        if not len(a) or not len(b):
            break
        found: list[tuple] = []
        count = 0
        for m in range(0, len(a), BLOCK):
            for n in range(0, len(b), BLOCK):
                x, y = a[m : m + BLOCK], b[n : n + BLOCK]
                s, r = ranks(x, y)
                p, q = np.nonzero((r >= low) & (r < high) & (r > 0))
                found.append((x[p], y[q], r[p, q], s[p, q]))
                count += len(p)
                if count > BAND:  # the band ends higher; the rest comes again in the next
                    rank = np.concatenate([f[2] for f in found])
                    low = max(low, np.partition(rank, len(rank) // 2)[len(rank) // 2])
                    found = [tuple(c[f[2] >= low] for c in f) for f in found]
                    count = sum(len(f[2]) for f in found)
        p, q, r, s = (np.concatenate([f[k] for f in found]) for k in range(4))
        got = take(p, q, r, ids, used)
        if got:
            keep = np.isin(p * len(ids) + q, np.array([x * len(ids) + y for x, y, *_ in got]))
            alike = dict(zip(zip(p[keep].tolist(), q[keep].tolist(), strict=True), s[keep].tolist(), strict=True))
            taken += [(i, j, alike[x, y], level) for x, y, i, j, level in got]
        high = low
    return pd.DataFrame(taken, columns=["i", "j", "similarity", "rank"])
