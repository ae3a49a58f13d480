"""The nearest points of one unit's queries, found in grids of halving side.

A query is searched in the finest grid whose 27 cells around it hold enough points; it is done once enough of them lie
within the side of a cell, else it goes on to the next coarser grid.  Pairs are made in bounded batches.
"""

from __future__ import annotations

import numpy as np

from pulseframe.operators.pyramid import spans

FINEST = 20  # halvings of the reach
PAIRS = 2_000_000  # pairs held at once


class Grid:
    """Points in the order of their cells, which are a hair wider than ``radius``; cells of one column follow one another."""

    def __init__(self, points: np.ndarray, corner: np.ndarray, extent: np.ndarray, radius: float):
        self.corner, self.radius, self.side = corner, radius, radius * (1.0 + 1e-6) + 1e-6
        self.dims = np.floor(extent / self.side).astype(np.float64) + 4
        self.fits = self.dims.prod() < 2.0 ** 62
        self.flat = not self.fits  # heights that no number can hold share a cell
        if self.flat:
            self.dims[2] = 4
        key = self.keys(points)
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def keys(self, points: np.ndarray) -> np.ndarray:
        cells = np.floor((points - self.corner) / self.side) + 1
        if self.flat:
            cells[:, 2] = 1
        cells = cells.astype(np.int64)
        return (cells[:, 0] * int(self.dims[1]) + cells[:, 1]) * int(self.dims[2]) + cells[:, 2]

    def crowd(self) -> float:
        """Points that a point's cell holds on average."""
        first = np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1])))
        held = np.diff(np.append(first, len(self.key))).astype(float)
        return (held * held).sum() / len(self.key)

    def around(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nine runs of points for each key: the 27 cells around it."""
        column = np.array([(i * int(self.dims[1]) + j) * int(self.dims[2]) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        middle = keys[:, None] + column
        return np.searchsorted(self.key, middle - 1), np.searchsorted(self.key, middle + 1, "right")


def nearest(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, reach: float, *,
            positive_only: bool = False, crowded: float = np.inf, final: bool = False) -> tuple[np.ndarray, ...]:
    """``row, id, d2, rank`` of the ``k`` nearest points of each query that has as many within ``reach``, ties by id, and which queries are done.

    With ``final`` the others give what they have.  Queries with more than ``crowded`` candidates in all but the finest grid are left undone.
    """
    done = np.zeros(len(queries), bool)
    sound = np.isfinite(points).all(axis=1)
    points, ids = points[sound], ids[sound]
    todo = np.flatnonzero(np.isfinite(queries).all(axis=1))
    out = [[], [], [], []]
    if len(points) and len(todo):
        both = np.vstack([points.min(axis=0), points.max(axis=0), queries[todo].min(axis=0), queries[todo].max(axis=0)])
        corner, extent = both.min(axis=0), both.max(axis=0) - both.min(axis=0)
        grids = [Grid(points, corner, extent, reach)]
        while len(grids) <= FINEST and grids[-1].crowd() > 1.0 + 0.9 * (k + 1):
            finer = Grid(points, corner, extent, reach / 2.0 ** len(grids))
            if not finer.fits:
                break
            grids.append(finer)
        px, py, pz = np.ascontiguousarray(points.T)
        for h in range(len(grids) - 1, -1, -1):
            grid, last = grids[h], h == 0 and final
            cells, cell = np.unique(grid.keys(queries[todo]), return_inverse=True)
            starts, ends = grid.around(cells)
            held = (ends - starts).sum(axis=1)[cell]
            ready = held > (0 if last else k - 1)
            if not final and h < len(grids) - 1:
                ready &= held <= crowded
            some = np.flatnonzero(ready)
            some = some[np.argsort(cell[some], kind="stable")]
            batch = np.cumsum(held[some]) // PAIRS
            for part in np.split(some, np.flatnonzero(np.diff(batch)) + 1) if len(some) else []:
                rows = todo[part]
                at = grid.order[spans(starts[cell[part]].ravel(), ends[cell[part]].ravel())]
                of = np.repeat(np.arange(len(part)), held[part])
                q = queries[rows]
                dx, dy, dz = px[at] - q[of, 0], py[at] - q[of, 1], pz[at] - q[of, 2]
                d2 = dx * dx + dy * dy + dz * dz
                near = np.flatnonzero(d2 <= grid.radius * grid.radius)
                at, of, d2 = at[near], of[near], d2[near]
                other = ids[at] != query_ids[rows][of]
                if positive_only:
                    other &= d2 > 0
                at, of, d2 = at[other], of[other], d2[other]
                full = np.bincount(of, minlength=len(part)) >= k
                done[rows] = full
                if not last:
                    kept = full[of]
                    at, of, d2 = at[kept], of[kept], d2[kept]
                order = np.lexsort((ids[at], d2, of))
                at, of, d2 = at[order], of[order], d2[order]
                rank = np.arange(len(of)) - np.searchsorted(of, of)
                best = rank < k
                for column, values in zip(out, (rows[of[best]], ids[at[best]], d2[best], rank[best] + 1)):
                    column.append(values)
            todo = todo[~done[todo]]
            if not len(todo):
                break
    if final:
        done[:] = True
    row, found, d2, rank = (np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(out, (np.int64, np.int64, float, np.int64)))
    return row, found, d2, rank, done


def coincident(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Queries in whose very place a point of another id lies."""
    if not len(queries):
        return np.zeros(0, bool)
    for axis in range(3):  # most points share a coordinate with no query
        some = np.isin(points[:, axis], queries[:, axis])
        points, ids = points[some], ids[some]
    rows, number = np.vstack([queries, points]), np.concatenate([query_ids, ids])
    order = np.lexsort((number, rows[:, 2], rows[:, 1], rows[:, 0]))
    rows, number = rows[order], number[order]
    new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    mixed = np.minimum.reduceat(number, first) != np.maximum.reduceat(number, first)
    out = np.zeros(len(rows), bool)
    out[order] = mixed[group]
    return out[:len(queries)]
