"""Sums over points in disks, by distance and sector, without the pairs.

Points of a tile lie in cells, with running sums along each row. Of a row, cells wholly inside a disk and a sector take two
sums; only points of cells at an edge are tested, with the distance and bearing that any pair would have.
"""

from __future__ import annotations

import numpy as np

from terraloom.operators.spatial import MERCATOR_RADIUS

PER_RADIUS = 40  # cells in the largest radius
CHUNK = 200  # places worked on at once


class Cells:
    """Points in cells of a width; sums: running sums of weights (n, k) in the order of the cells."""

    def __init__(self, px: np.ndarray, py: np.ndarray, weights: np.ndarray, width: float) -> None:
        self.width, self.x0, self.y0 = width, px.min(initial=0.0 if not len(px) else np.inf), py.min(initial=0.0 if not len(py) else np.inf)
        col, row = ((p - low) // width for p, low in ((px, self.x0), (py, self.y0)))
        self.cols, self.rows = (int(v.max(initial=-1)) + 1 for v in (col, row))
        at = (row * self.cols + col).astype(np.int64)
        self.order = np.argsort(at, kind="stable")
        self.px, self.py, self.weights = px[self.order], py[self.order], weights[self.order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=self.rows * self.cols))])
        self.sums = np.concatenate([np.zeros((1, weights.shape[1]), weights.dtype), np.cumsum(self.weights, axis=0)])

    def first(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """The place in order where a cell begins; col may be one beyond the last."""
        return self.start[row * self.cols + col]


def turns(dl: np.ndarray, here: tuple[np.ndarray, np.ndarray], there: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sector 0 to 3 (north, east, south, west) by the bearing of a point; here, there: sine and cosine of both latitudes."""
    (sa, ca), (sb, cb) = here, there
    turn = np.degrees(np.arctan2(np.sin(dl) * cb, ca * sb - sa * cb * np.cos(dl))) + 405.0
    return np.floor((turn - 360.0 * np.floor(turn / 360.0)) / 90.0).astype(np.int64)


def sums_in_disks(px: np.ndarray, py: np.ndarray, weights: np.ndarray, cx: np.ndarray, cy: np.ndarray, limits: tuple[tuple[float, bool], ...], points: tuple[np.ndarray, ...] | None = None, places: tuple[np.ndarray, ...] | None = None, largest: float | None = None) -> np.ndarray:
    """(places, limits, sectors, k): sums of weights (n, k) at distances of at most each limit, or below it if the limit is open.

    points, places: lat and lon in degrees; with them there are four sectors, else one. largest: half size of the boxes that points lie in.
    """
    sectors = 4 if points else 1
    out = np.zeros((len(cx), len(limits), sectors, weights.shape[1]), weights.dtype)
    if not len(px) or not len(cx):
        return out
    largest = largest or max(r for r, _ in limits)
    cells = Cells(px, py, weights, max(r for r, _ in limits) / PER_RADIUS)
    if points:
        rad, lon = np.radians(points[0])[cells.order], points[1][cells.order]
        there = (np.sin(rad), np.cos(rad))
    for a in range(0, len(cx), CHUNK):
        part = slice(a, a + CHUNK)
        x, y = cx[part], cy[part]
        here = None
        if points:
            lat = np.radians(places[0][part])
            here = (np.sin(lat), np.cos(lat))
        for i, (r, open_) in enumerate(limits):
            def label(at: np.ndarray, of: np.ndarray) -> np.ndarray:
                dx, dy = cells.px[at] - x[of], cells.py[at] - y[of]
                d = np.sqrt(dx * dx + dy * dy)
                inside = (d < r) if open_ else (d <= r)
                if r == largest:  # as in the join by boxes of that half size
                    inside &= (cells.px[at] >= x[of] - r) & (cells.px[at] <= x[of] + r) & (cells.py[at] >= y[of] - r) & (cells.py[at] <= y[of] + r)
                keep = np.flatnonzero(inside)
                if not points:
                    return keep, np.zeros(len(keep), np.int64)
                k, o = at[keep], of[keep]
                return keep, turns(np.radians(lon[k] - places[1][part][o]), (here[0][o], here[1][o]), (there[0][k], there[1][k]))

            out[part, i] = _disk(cells, x, y, r, sectors, here, label)
    return out


def _disk(cells: Cells, x: np.ndarray, y: np.ndarray, r: float, sectors: int, here: tuple | None, label) -> np.ndarray:
    g, n, k = cells.width, len(x), cells.weights.shape[1]
    slack = 1e-6 * (1.0 + r)  # more than what rounding moves
    low = np.floor((y - r - slack - cells.y0) / g)
    rows = low[:, None] + np.arange(int(np.ceil(2 * (r + slack) / g)) + 1)
    bottom = cells.y0 + rows * g
    top = bottom + g
    x, y = x[:, None], y[:, None]
    near, far = np.maximum(np.maximum(bottom - y, y - top), 0.0), np.maximum(np.abs(bottom - y), np.abs(top - y))
    live = (rows >= 0) & (rows < cells.rows) & (near <= r + slack)
    reach = np.sqrt(np.maximum((r + slack) ** 2 - near**2, 0.0))
    sure = np.sqrt(np.maximum((r - slack) ** 2 - far**2, 0.0)) - slack
    held = far < r - slack
    col = lambda v, f: f((v - cells.x0) / g)
    o0, o1 = col(x - reach - slack, np.floor), col(x + reach + slack, np.floor) + 1
    i0, i1 = col(x - sure, np.ceil), col(x + sure, np.floor)
    definite = [(0, i0, i1)]
    if sectors == 4:
        above = bottom - y >= slack
        held &= above | (y - top >= slack)  # a row that the place lies in is tested throughout
        sa, ca = here[0][:, None], here[1][:, None]
        edges = cells.y0 + (low[:, None] + np.arange(rows.shape[1] + 1)) * g
        # where the bearing is 45 degrees or one of its mirror images, at the latitude of a row's edge
        away = np.abs(np.arcsin(np.clip(ca * np.sinh(edges / MERCATOR_RADIUS) / np.sqrt(1 + sa * sa), -1, 1)) - np.arctan(sa)) * MERCATOR_RADIUS
        lesser, greater = np.minimum(away[:, :-1], away[:, 1:]) - slack, np.maximum(away[:, :-1], away[:, 1:]) + slack
        middle = np.where(above, 0, 2)
        definite = [(3, i0, np.minimum(i1, col(x - greater, np.floor))), (middle, np.maximum(i0, col(x - lesser, np.ceil)), np.minimum(i1, col(x + lesser, np.floor))), (1, np.maximum(i0, col(x + greater, np.ceil)), i1)]
    which, line = np.nonzero(live)
    pick = lambda v: np.clip(v[which, line], 0, cells.cols).astype(np.int64)
    row, at, last, held = rows[which, line].astype(np.int64), pick(o0), pick(o1), held[which, line]
    out = np.zeros((n, sectors, k), cells.weights.dtype)
    tests, owners = [], []

    def test(first: np.ndarray, until: np.ndarray) -> None:
        begin, size = cells.first(row, first), cells.first(row, until) - cells.first(row, first)
        some = np.flatnonzero(size > 0)
        begin, size = begin[some], size[some]
        tests.append(np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum()))
        owners.append(np.repeat(which[some], size))

    for name, first, until in definite:
        first = np.where(held, np.minimum(np.maximum(pick(first), at), last), at)
        until = np.where(held, np.maximum(np.minimum(pick(until), last), first), first)
        test(at, first)
        some = np.flatnonzero(until > first)
        if len(some):
            got = cells.sums[cells.first(row[some], until[some])] - cells.sums[cells.first(row[some], first[some])]
            groups = which[some] * sectors + (name[which[some], line[some]] if isinstance(name, np.ndarray) else name)
            _add(out, groups, got)
        at = until
    test(at, last)
    tests, owners = np.concatenate(tests), np.concatenate(owners)
    keep, sector = label(tests, owners)
    groups = owners[keep] * sectors + sector
    order = np.argsort(groups, kind="stable")
    _add(out, groups[order], cells.weights[tests[keep][order]])
    return out


def _add(out: np.ndarray, groups: np.ndarray, values: np.ndarray) -> None:
    """Adds values to the rows of out; equal groups stand in runs, which may repeat."""
    if not len(groups):
        return
    begins = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    np.add.at(out.reshape(-1, out.shape[-1]), groups[begins], np.add.reduceat(values, begins, axis=0))
