"""Counts of points in boxes without the pairs: a location meets the points of its tile in a wavelet matrix.

Tiles are wider than the boxes; a point goes to each tile whose locations may reach it, a location to one. There the
points stand in the order of x, and their places in the order of y are halved bit by bit, with running sums of what is
counted; a box takes a few sums a bit, however many points it holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.spatial import tiles

WIDTH = 8  # of a tile, in half sizes of the largest box
REACH = 1.0  # metres beyond the largest box, for rounding


def reach(values: np.ndarray, centre: np.ndarray, size: float, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in sorted, distinct values of those with |value - centre| <= size and between centre - largest and centre + largest, as floats compare."""
    low, high = np.searchsorted(values, centre - size, "left"), np.searchsorted(values, centre + size, "right")
    if size < largest:
        held = np.concatenate([[np.inf], values, [np.inf]])  # one place on
        off = lambda at: np.abs(held[np.clip(at + 1, 0, len(values) + 1)] - centre)
        for move, side in ((-1, off(low - 1) <= size), (1, (off(low) > size) & (low < high))):
            while side.any():
                low = low + move * side
                side = off(low - 1) <= size if move < 0 else (off(low) > size) & (low < high)
        for move, side in ((1, off(high) <= size), (-1, (off(high - 1) > size) & (high > low))):
            while side.any():
                high = high + move * side
                side = off(high) <= size if move > 0 else (off(high - 1) > size) & (high > low)
        return low, high
    # of the largest, both conditions hold: the first has the values inside, the other may lack the outermost
    first, last = values[np.minimum(low, len(values) - 1)], values[np.maximum(high - 1, 0)]
    while (out := (low < high) & (np.abs(first - centre) > size)).any():
        low = low + out
        first = values[np.minimum(low, len(values) - 1)]
    while (out := (high > low) & (np.abs(last - centre) > size)).any():
        high = high - out
        last = values[np.maximum(high - 1, 0)]
    return low, high


def between(values: np.ndarray, centre: np.ndarray, size: float, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in sorted, distinct values of those from centre - size to centre + size."""
    return np.searchsorted(values, centre - size, "left"), np.searchsorted(values, centre + size, "right")


class Packed:
    """Columns of small numbers as fields of 64-bit words; sums over all points fit a field."""

    def __init__(self, points: int, most: int = 1) -> None:
        self.bits = max(1, (points * most).bit_length())
        self.per = max(1, 63 // self.bits)

    def words(self, columns: int) -> int:
        return -(-columns // self.per)

    def put(self, rows: int, at: np.ndarray, column: np.ndarray, columns: int, value: np.ndarray | int = 1) -> np.ndarray:
        """(rows, words) with value added in the fields (at, column)."""
        out = np.zeros((rows, self.words(columns)), np.int64)
        np.add.at(out, (at, column // self.per), np.int64(value) << (self.bits * (column % self.per)))
        return out

    def marks(self, flags: np.ndarray, columns: int) -> np.ndarray:
        """(words, rows) with the bits of flags as fields."""
        out = np.zeros((self.words(columns), len(flags)), np.int64)
        for c in range(columns):
            out[c // self.per] += (flags >> c & 1) << (self.bits * (c % self.per))
        return out

    def take(self, words: np.ndarray, column: int) -> np.ndarray:
        return (words[:, column // self.per] >> (self.bits * (column % self.per))) & ((1 << self.bits) - 1)


def sums_in_ranges(row: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray, below: np.ndarray) -> np.ndarray:
    """(k, queries): sums of weights (k, n) over places left to right (without it) whose row is less than below."""
    out = np.zeros((len(weights), len(left)), weights.dtype)
    sums = np.zeros(len(row) + 1, weights.dtype)
    for bit in range(max(int(row.max(initial=0)) + 1, int(below.max(initial=0))).bit_length() - 1, -1, -1):
        zero = (row >> bit) & 1 == 0
        before = np.concatenate([[0], np.cumsum(zero)])
        ones = before[-1]
        order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        row = row[order]
        zl, zr = before[left], before[right]
        up = (below >> bit) & 1 == 1
        take = np.flatnonzero(up)
        first, last = zl[take], zr[take]
        weights = weights.take(order, axis=1)  # a column after another stays in the processor's cache
        for own, found in zip(weights, out, strict=True):
            np.cumsum(own[:ones], out=sums[1 : ones + 1])
            found[take] += sums[last] - sums[first]
        left, right = np.where(up, ones + left - zl, zl), np.where(up, ones + right - zr, zr)
    return out


def sums_in_boxes(px: np.ndarray, py: np.ndarray, weights: np.ndarray, cx: np.ndarray, cy: np.ndarray, sizes: tuple[float, ...], bounds: Callable) -> np.ndarray:
    """(locations, sizes * k): sums of weights (n, k) in each box."""
    k = weights.shape[1]
    out = np.zeros((len(cx), len(sizes) * k), np.int64)
    if not len(px) or not len(cx):
        return out
    order = np.argsort(px, kind="stable")
    xs, start = np.unique(px[order], return_index=True)
    start = np.append(start, len(px))
    ys, row = np.unique(py[order], return_inverse=True)
    corners = []
    for s in sizes:
        (x0, x1), (y0, y1) = bounds(xs, cx, s, max(sizes)), bounds(ys, cy, s, max(sizes))
        corners.append((start[x0], start[np.maximum(x0, x1)], y0, np.maximum(y0, y1)))
    left, right = (np.concatenate([c[i] for c in corners for _ in (0, 1)]) for i in (0, 1))
    below = np.concatenate([c[i] for c in corners for i in (2, 3)])
    got = sums_in_ranges(row, weights.T.take(order, axis=1), left, right, below).reshape(k, len(sizes), 2, len(cx))
    for i in range(len(sizes)):
        out[:, i * k : (i + 1) * k] = (got[:, i, 1] - got[:, i, 0]).T
    return out


def by_tile(points: DataFrame, places: DataFrame, half: float, work: Callable[[pa.Table, pa.Table], list[pa.Array]], columns: str, along: tuple[str, str] = ("px", "cx"), leave: tuple[str, ...] = ()) -> DataFrame:
    """loc_id and `columns` of each of places (loc_id, cx, cy, ...): work has the points (px, py, ...) that it may reach in x and y, and the places of a tile.

    Both come to it in the order of the columns `along`; it doesn't get those to leave out, which aren't shuffled.
    """
    size, pad = WIDTH * half, half + REACH
    c = F.col
    # null or NaN, said so that Spark infers no filter of what the points are made of: their shuffle can serve other uses
    known = points.where("NOT isnan(coalesce(px, double('NaN'))) AND NOT isnan(coalesce(py, double('NaN')))")
    spread = known.withColumns({"_x0": c("px") - pad, "_x1": c("px") + pad, "_y0": c("py") - pad, "_y1": c("py") + pad})
    tile = F.shiftleft(c("tx"), 32) + c("ty")  # one number, which is sorted without comparing rows
    spread = tiles(spread, "_x0", "_y0", "_x1", "_y1", size).select(*[x for x in points.columns if x not in leave], tile.alias("tile"))
    own = places.where("cx IS NOT NULL AND cy IS NOT NULL AND NOT isnan(cx) AND NOT isnan(cy)").withColumn("tx", F.floor(c("cx") / size)).withColumn("ty", F.floor(c("cy") / size))
    own = own.select(*[x for x in places.columns if x not in leave], tile.alias("tile"))
    schema = f"loc_id {places.schema['loc_id'].dataType.simpleString()}, {columns}"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[x.split()[1]] for x in columns.split(", ")]

    def run(near: pa.Table, here: pa.Table) -> pa.Table:
        if not len(here):
            return pa.table({n: pa.array([], t) for n, t in zip(names, [here["loc_id"].type, *types], strict=True)})
        # what stands together is looked up together: neighbours in x find their steps in the processor's cache
        near, here = (t.take(pc.sort_indices(t[x])).combine_chunks() for t, x in zip((near, here), along, strict=True))
        return pa.table([here["loc_id"], *work(near, here)], names=names)

    return spread.groupBy("tile").cogroup(own.groupBy("tile")).applyInArrow(run, schema)


def counts_in_boxes(points: DataFrame, places: DataFrame, sizes: tuple[float, ...], kinds: dict[str, Column], nested: bool = False) -> DataFrame:
    """(loc_id, {kind}_{i}, ...): points (px, py) of each kind in boxes of half sizes[i] around places (loc_id, cx, cy); zero or no row where none.

    Bounds count as inside. nested: the distance in x and y is compared with the size, inside the bounds of the largest box.
    """
    flags = F.lit(0).cast("long")
    for i, test in enumerate(kinds.values()):
        flags = flags + F.when(test, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    marked = points.select("px", "py", flags.alias("flags"))
    n, rule = len(kinds), reach if nested else between

    def work(near: pa.Table, here: pa.Table) -> list[pa.Array]:
        px, py, bits, cx, cy = (t[c].to_numpy() for t, c in ((near, "px"), (near, "py"), (near, "flags"), (here, "cx"), (here, "cy")))
        pack = Packed(len(px))
        got = sums_in_boxes(px, py, pack.marks(bits, n).T, cx, cy, sizes, rule)
        each = pack.words(n)
        return [pa.array(pack.take(got[:, i * each : (i + 1) * each], k)) for i in range(len(sizes)) for k in range(n)]

    names = [f"{k}_{i}" for i in range(len(sizes)) for k in kinds]
    found = by_tile(marked, places.select("loc_id", "cx", "cy"), max(sizes), work, ", ".join(f"{x} long" for x in names))
    return found.groupBy("loc_id").agg(*[F.sum(x).alias(x) for x in names])
