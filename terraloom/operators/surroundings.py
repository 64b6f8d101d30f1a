"""What lies in the boxes around locations, measured tile by tile without the pairs of features and locations.

Points stand in the order of x, their rows in the order of y, in a wavelet matrix: counts of each tag pair, outermost
points and the occupied cells of a grid between them are a few steps a bit. Distinct labels in boxes of one size are the
labelled points less the pairs of neighbours, in y, of the same label: points of a label that a box holds are a run of
those its width holds, and a run of n has n - 1 pairs of neighbours. A pair stays one while both are in the box's width
and none between is, which is one interval of locations in x and one in y; there are a few such rectangles for a point.
"""

from __future__ import annotations

import numpy as np

from terraloom.operators.ranges import Packed, reach

BLOCK = 64  # locations of a block in sums over rectangles
PART = 8_192  # locations at most whose rectangles are summed together
WORDS = 8  # packed sums at a time


class Matrix:
    """The wavelet matrix of a sequence of whole numbers below `limit`: from the highest bit, zeros go before ones."""

    def __init__(self, values: np.ndarray, limit: int) -> None:
        self.levels = []
        for bit in range(max(1, int(limit).bit_length()) - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
            self.levels.append((bit, np.concatenate([[0], np.cumsum(zero)]), order))
            values = values[order]

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the places left to right (without it) hold less than bound."""
        out = np.zeros(len(left), np.int64)
        for bit, before, _ in self.levels:
            zl, zr = before[left], before[right]
            up = (bound >> bit) & 1 == 1
            out += np.where(up, zr - zl, 0)
            left, right = np.where(up, before[-1] + left - zl, zl), np.where(up, before[-1] + right - zr, zr)
        return out

    def nth(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with n lesser or equal ones before it in the order of the values from left to right."""
        out = np.zeros(len(left), np.int64)
        for bit, before, _ in self.levels:
            zl, zr = before[left], before[right]
            up = n >= zr - zl
            out |= up.astype(np.int64) << bit
            n = np.where(up, n - (zr - zl), n)
            left, right = np.where(up, before[-1] + left - zl, zl), np.where(up, before[-1] + right - zr, zr)
        return out

    def sums(self, weights: np.ndarray, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """(k, queries): below(), with weights (k, n) summed in place of ones."""
        out, total = np.zeros((len(weights), len(left)), np.int64), np.zeros(weights.shape[1] + 1, np.int64)
        for bit, before, order in self.levels:
            weights, ones = weights.take(order, axis=1), before[-1]
            zl, zr = before[left], before[right]
            up = (bound >> bit) & 1 == 1
            at = np.flatnonzero(up)
            first, last = zl[at], zr[at]
            for own, found in zip(weights, out, strict=True):
                np.cumsum(own[:ones], out=total[1 : ones + 1])
                found[at] += total[last] - total[first]
            left, right = np.where(up, ones + left - zl, zl), np.where(up, ones + right - zr, zr)
        return out


def bounds(values: np.ndarray, centre: np.ndarray, size: float, largest: float) -> tuple[np.ndarray, np.ndarray]:
    low, high = reach(values, centre, size, largest)
    return low, np.maximum(low, high)


class Boxes:
    """Points in the order of x, and the places and rows that the boxes of half sizes around centres hold (all of one size, then the next)."""

    def __init__(self, px: np.ndarray, py: np.ndarray, cx: np.ndarray, cy: np.ndarray, sizes: tuple[float, ...]) -> None:
        self.order = np.argsort(px, kind="stable")
        self.xs, self.start, at = np.unique(px[self.order], return_index=True, return_inverse=True)
        self.start, self.column = np.append(self.start, len(px)), at
        self.ys, self.row = np.unique(py[self.order], return_inverse=True)
        self.matrix = Matrix(self.row, max(1, len(self.ys)))
        self.x, self.y = ([bounds(values, c, s, max(sizes)) for s in sizes] for values, c in ((self.xs, cx), (self.ys, cy)))
        self.x0, self.x1, self.y0, self.y1 = (np.concatenate([b[i] for b in side]) for side in (self.x, self.y) for i in (0, 1))
        self.left, self.right = self.start[self.x0], self.start[self.x1]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Per box the sums of weights (n, k), of points in the order they came in."""
        both = lambda a, b: np.concatenate([a, b])
        got = self.matrix.sums(weights.T.take(self.order, axis=1), both(self.left, self.left), both(self.right, self.right), both(self.y0, self.y1))
        return (got[:, len(self.left) :] - got[:, : len(self.left)]).T


def cuts(values: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, grid: int) -> list[np.ndarray]:
    """Places in values, from first to last + 1, at which the cells of a grid between low and high begin and the last one ends."""
    step = (high - low) / grid
    cell = lambda at: np.clip(np.ceil((values[at] - low) / step) - 1, 0, grid - 1)
    out = [first]
    for j in range(1, grid):
        b = np.clip(np.searchsorted(values, low + j * step, "right"), first, last + 1)
        while (move := (b > first) & (cell(np.maximum(b - 1, 0)) >= j)).any():
            b = b - move
        while (move := (b <= last) & (cell(np.minimum(b, last)) < j)).any():
            b = b + move
        out.append(b)
    return [*out, last + 1]


def occupied(boxes: Boxes, lon: np.ndarray, lat: np.ndarray, grid: int) -> np.ndarray:
    """Per box the cells with a point in a grid between its outermost points; 0 where these are one place in lon or lat."""
    out, n = np.zeros(len(boxes.left), np.int64), len(lon)
    if not n:
        return out
    x_lon, x_lat = lon[boxes.order], lat[boxes.order]
    upward = np.lexsort((x_lat, boxes.row))
    by_lon = np.lexsort((x_lon, boxes.column))
    if (np.diff(x_lat[upward]) < 0).any() or (np.diff(x_lon[by_lon]) < 0).any():
        return _occupied_by_box(boxes, x_lon, x_lat, grid)  # rounding turned the order of two places about
    place = np.empty(n, np.int64)  # in the order of x and lon
    place[by_lon] = np.arange(n)
    lons, lon_start, lon_of = np.unique(x_lon[by_lon], return_index=True, return_inverse=True)
    lats, lat_start, lat_of = np.unique(x_lat[upward], return_index=True, return_inverse=True)
    lon_start, lat_start = np.append(lon_start, n), np.append(lat_start, n)
    row = np.empty(n, np.int64)
    row[upward] = lat_of
    rows = Matrix(row[by_lon], len(lats))
    columns = Matrix(lon_of[place[upward]], len(lons))
    first_row = np.append(lat_of[np.searchsorted(boxes.row[upward], np.arange(len(boxes.ys)))], len(lats))
    r0, r1 = first_row[boxes.y0], first_row[boxes.y1]
    inside = rows.below(boxes.left, boxes.right, r1)
    low = rows.below(boxes.left, boxes.right, r0)
    full = np.flatnonzero(inside > low)
    left, right, r0, r1, low, inside = (a[full] for a in (boxes.left, boxes.right, r0, r1, low, inside))
    south, north = rows.nth(left, right, low), rows.nth(left, right, inside - 1)
    down, up = lat_start[r0], lat_start[r1]
    less = columns.below(down, up, lon_of[left])
    west, east = columns.nth(down, up, less), columns.nth(down, up, less + inside - low - 1)
    wide = np.flatnonzero((lons[east] - lons[west] >= 1e-9) & (lats[north] - lats[south] >= 1e-9))
    full, west, east, south, north = (a[wide] for a in (full, west, east, south, north))
    xs, ys = cuts(lons, lons[west], lons[east], west, east, grid), cuts(lats, lats[south], lats[north], south, north, grid)
    # a coarse grid tells of most cells that they hold a point; the others are counted
    g = 1 << max(1, int(np.sqrt(2 * n)).bit_length())
    height = np.empty(n, np.int64)
    height[upward] = np.arange(n)
    held = np.zeros((g + 1, g + 1), np.int32)
    held[1:, 1:] = np.bincount(place * g // n * g + height * g // n, minlength=g * g).reshape(g, g).cumsum(0).cumsum(1)
    edge = lambda at, up: at * g // n if up else -(-at * g // n)
    for i in range(grid):
        a, b = lon_start[xs[i]], lon_start[xs[i + 1]]
        ga, gb = edge(a, False), edge(b, True)
        for j in range(grid):
            c, d = lat_start[ys[j]], lat_start[ys[j + 1]]
            gc, gd = edge(c, False), edge(d, True)
            some = (gb > ga) & (gd > gc) & (held[gb, gd] - held[ga, gd] - held[gb, gc] + held[ga, gc] > 0)
            open_ = np.flatnonzero(~some & (b > a) & (d > c))
            some[open_] = rows.below(a[open_], b[open_], ys[j + 1][open_]) > rows.below(a[open_], b[open_], ys[j][open_])
            out[full] += some
    return out


def _occupied_by_box(boxes: Boxes, lon: np.ndarray, lat: np.ndarray, grid: int) -> np.ndarray:
    out = np.zeros(len(boxes.left), np.int64)
    for q, (a, b, y0, y1) in enumerate(zip(boxes.left, boxes.right, boxes.y0, boxes.y1, strict=True)):
        at = a + np.flatnonzero((boxes.row[a:b] >= y0) & (boxes.row[a:b] < y1))
        if len(at) and np.ptp(lon[at]) >= 1e-9 and np.ptp(lat[at]) >= 1e-9:
            cell = [np.clip(np.ceil((v - v.min()) / ((v.max() - v.min()) / grid)) - 1, 0, grid - 1) for v in (lon[at], lat[at])]
            out[q] = len(np.unique(cell[0] * grid + cell[1]))
    return out


def in_rectangles(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """For places (i, at_y[i]), at_y a permutation: how many rectangles x0 to x1, y0 to y1 (ends without) hold each."""
    m = len(at_y)
    blocks = -(-(m + 1) // BLOCK)
    seat = np.arange(m)
    own = np.zeros((blocks, m + 1), np.int16)  # places of a block below a y
    own[seat // BLOCK, at_y + 1] = 1
    own = own.cumsum(1, dtype=np.int16)
    wide = BLOCK + 1
    small = np.int32 if 2 * len(x0) < 2**31 else np.int64
    before, inner = np.zeros(blocks * (m + 1), small), np.zeros(blocks * BLOCK * wide, np.int64)
    for sign, x, y in ((1, np.concatenate([x0, x1]), np.concatenate([y0, y1])), (-1, np.concatenate([x1, x0]), np.concatenate([y0, y1]))):
        block = x // BLOCK
        before += (sign * np.bincount(block * (m + 1) + y, minlength=len(before))).astype(small)
        inner += sign * np.bincount(x * wide + own[block, y], minlength=len(inner))
    before = before.reshape(blocks, m + 1).cumsum(1, dtype=small)
    before = before.cumsum(0, dtype=small) - before
    inner = inner.reshape(blocks, BLOCK, wide).cumsum(1).cumsum(2)
    return before[seat // BLOCK, at_y] + inner[seat // BLOCK, seat % BLOCK, own[seat // BLOCK, at_y]]


def neighbours(label: np.ndarray, x: np.ndarray, ex: np.ndarray, lx: np.ndarray, ey: np.ndarray, ly: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rectangles (x0, x1, y0, y1) of the places that see two points of a label and none of it between them in y.

    Points come by label, then y, and are seen by the places ex to lx and ey to ly, whose order follows that of the points.
    """
    found = []
    act, lo, hi, k = np.arange(len(label)), ex.copy(), lx.copy(), 0
    while len(act):
        k += 1
        fine = act + k < len(label)
        act, lo, hi = act[fine], lo[fine], hi[fine]
        to = act + k
        fine = (label[to] == label[act]) & (ey[to] < ly[act])
        act, lo, hi, to = act[fine], lo[fine], hi[fine], to[fine]
        a, b = np.maximum(lo, ex[to]), np.minimum(hi, lx[to])
        some = np.flatnonzero(a < b)
        found.append((a[some], b[some], ey[to[some]], ly[act[some]]))
        right = x[to] > x[act]
        hi, lo = np.where(right, np.minimum(hi, ex[to]), hi), np.where(right, lo, np.maximum(lo, lx[to]))
        fine = lo < hi
        act, lo, hi = act[fine], lo[fine], hi[fine]
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))


def repeated_labels(boxes: Boxes, label: np.ndarray, cx: np.ndarray, cy: np.ndarray, parts: list[int]) -> np.ndarray:
    """Per box its labelled points less their distinct labels; label: a number from 0, -1 without one; parts of the places for each size."""
    label = label[boxes.order]
    by = np.lexsort((boxes.row, label))
    by = by[label[by] >= 0]
    label, column, row = label[by], boxes.column[by], boxes.row[by]
    out, along = np.zeros((len(boxes.x), len(cx)), np.int64), np.argsort(cx, kind="stable")
    for i, ((x0, x1), (y0, y1)) in enumerate(zip(boxes.x, boxes.y, strict=True)):
        for part in np.array_split(along, max(parts[i], -(-len(cx) // PART))):
            rise = part[np.argsort(cy[part], kind="stable")]
            seat = np.empty(len(cx), np.int64)
            seat[rise] = np.arange(len(part))
            ex, lx = (np.searchsorted(b[part], np.arange(len(boxes.xs)), "right")[column] for b in (x1, x0))
            ey, ly = (np.searchsorted(b[rise], np.arange(len(boxes.ys)), "right")[row] for b in (y1, y0))
            seen = np.flatnonzero((ex < lx) & (ey < ly))
            found = neighbours(*(a[seen] for a in (label, column, ex, lx, ey, ly)))
            out[i, part] = in_rectangles(*found, seat[part])
    return out.reshape(-1)


def tag_sums(boxes: Boxes, code: np.ndarray, pairs: list[list[int]], key: np.ndarray, category: np.ndarray, total: np.ndarray) -> dict[str, np.ndarray]:
    """Per box: pairs with a point, bits of their keys and categories, entropy of the pairs' counts (total: their sum).

    code: the set of pairs, numbers from 0, of each point; pairs: those of each set; key, category (-1: none) of each pair.
    """
    n, q = len(code), len(boxes.left)
    found, keys, categories, entropy = (np.zeros(q, t) for t in (np.int64, np.int64, np.int64, np.float64))
    pack = Packed(n)
    at = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    pair = np.array([x for p in pairs for x in p], np.int64)
    for low in range(0, len(key), pack.per * WORDS):
        here = (pair >= low) & (pair < low + pack.per * WORDS)
        count = min(pack.per * WORDS, len(key) - low)
        words = boxes.sums(pack.put(len(pairs), at[here], pair[here] - low, count)[code])
        for c in range(count):
            own = pack.take(words, c)
            some = own > 0
            found += some
            keys |= some.astype(np.int64) << key[low + c]
            if category[low + c] >= 0:
                categories |= some.astype(np.int64) << category[low + c]
            share = own[some] / total[some]
            entropy[some] -= share * np.log(share + 1e-12)
    return {"pairs": found, "keys": keys, "categories": categories, "entropy": np.where(found <= 1, 0.0, entropy)}
