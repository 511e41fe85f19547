"""Exact nearest neighbours: different points with their numbers, in leaves with bounding boxes."""

from __future__ import annotations

from typing import Any

import numpy as np

#: Points of a leaf, and queries that are looked up together.
LEAF, TILE = 512, 32
#: With more features than this boxes hardly keep anything out, so all points are looked at.
BOXED = 16
#: Distances that are held at once.
HELD = 1 << 22


def split(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of points in which runs of at most size, cut at the median of their widest side, lie close together; and where runs begin (and the end)."""
    order, starts, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        a, z = todo.pop()
        if z - a <= size:
            starts.append(a)
            continue
        own = points[order[a:z]]
        side, mid = own[:, int(np.argmax(np.ptp(own, axis=0)))], (z - a) // 2
        order[a:z] = order[a:z][np.argpartition(side, mid)]
        todo += [(a + mid, z), (a, a + mid)]
    return order, np.array([*starts, len(points)])


def prepared(points: np.ndarray, values: np.ndarray, counts: np.ndarray) -> dict[str, Any]:
    """What search() needs; each row is a point, its value and how many training rows have both."""
    rank = np.lexsort((values, *points.T))  # equal distances go by the last feature, then the others, then the value
    points, values, counts = points[rank], values[rank], counts[rank]
    held = {"points": points, "values": values, "counts": counts}
    if points.shape[1] > BOXED or len(points) <= LEAF:
        return held
    order, starts = split(points, LEAF)
    low, high = (f.reduceat(points[order], starts[:-1], axis=0) for f in (np.minimum, np.maximum))
    return held | {"order": order, "starts": starts, "low": low, "high": high}


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each point."""
    if x.shape[1] > BOXED:
        return (x**2).sum(1)[:, None] - 2 * x @ points.T + (points**2).sum(1)[None]
    out = np.zeros((len(x), len(points)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - points[None, :, j]) ** 2
    return out


def first(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least of each row, least first, equal ones in order."""
    if d.shape[1] <= 4 * k:
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    there = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    some = np.argsort(~there, axis=1, kind="stable")[:, : int(there.sum(1).max())]
    near = np.where(np.take_along_axis(there, some, 1), np.take_along_axis(d, some, 1), np.inf)
    return np.take_along_axis(some, np.argsort(near, axis=1, kind="stable")[:, :k], 1)


def candidates(state: dict[str, Any], x: np.ndarray, k: int) -> np.ndarray:
    """Places of all points that can be among the k nearest of a row of x, in order: those of the leaves no further than
    the k-th of a few leaves close by."""
    order, starts, low, high = state["order"], state["starts"], state["low"], state["high"]
    a, z = x.min(axis=0), x.max(axis=0)
    gap, far = np.zeros(len(low)), np.zeros(len(low))
    for j in range(x.shape[1]):
        gap += np.maximum(np.maximum(low[:, j] - z[j], a[j] - high[:, j]), 0) ** 2
        far += np.maximum(high[:, j] - a[j], z[j] - low[:, j]) ** 2
    size = np.diff(starts)
    by = np.argsort(far, kind="stable")
    close = by[: int(np.searchsorted(np.cumsum(size[by]), k)) + 1]
    places = np.concatenate([order[starts[i] : starts[i + 1]] for i in close])
    most = np.partition(distances(x, state["points"][places]), min(k, len(places)) - 1, axis=1)[:, min(k, len(places)) - 1].max()
    return np.sort(np.concatenate([order[starts[i] : starts[i + 1]] for i in np.flatnonzero(gap <= most)]))


def decide(state: dict[str, Any], x: np.ndarray, places: np.ndarray | slice, k: int, vote: bool) -> np.ndarray:
    points, values, counts = state["points"][places], state["values"][places], state["counts"][places]
    out, step = np.empty(len(x)), max(1, HELD // len(points))
    for i in range(0, len(x), step):
        near = first(distances(x[i : i + step], points), k)
        own = counts[near]
        taken = np.clip(k - (np.cumsum(own, axis=1) - own), 0, own)  # so many rows of each point, k in all
        if vote:
            votes = np.zeros((len(near), int(values[near].max()) + 1))
            np.add.at(votes, (np.arange(len(near))[:, None], values[near].astype(int)), taken)
            out[i : i + step] = votes.argmax(axis=1)
        else:
            out[i : i + step] = (values[near] * taken).sum(axis=1) / taken.sum(axis=1)
    return out


def search(state: dict[str, Any], x: np.ndarray, k: int, vote: bool) -> np.ndarray:
    """For each row the commonest value of its k nearest training rows (the least of several), or their mean."""
    if x.shape[1] > BOXED:
        return decide(state, x, slice(None), k, vote)
    rows, back = np.unique(x, axis=0, return_inverse=True)
    if "order" not in state:
        return decide(state, rows, slice(None), k, vote)[back.reshape(-1)]
    out = np.empty(len(rows))
    order, starts = split(rows, TILE)
    for a, z in zip(starts, starts[1:], strict=False):
        own = order[a:z]
        out[own] = decide(state, rows[own], candidates(state, rows[own], k), k, vote)
    return out[back.reshape(-1)]
