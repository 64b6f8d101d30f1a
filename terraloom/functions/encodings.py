"""Encodings of latitude and longitude, in degrees, as arrays of doubles; all of them are column expressions.

A null coordinate gives null components.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def frequencies(count: int, shortest: float = 1.0, longest: float = 360.0) -> list[float]:
    """One over wavelengths in geometric steps from shortest to longest; one frequency is that of the shortest."""
    if count < 1:
        raise ValueError("one frequency at least")
    step = math.log(longest / shortest) / (count - 1) if count > 1 else 0.0
    return [1.0 / (shortest * math.exp(i * step)) for i in range(count)]


def direct(lat: Column, lon: Column) -> Column:
    return F.array(F.radians(lon) - math.pi, F.radians(lat) - math.pi)


def cartesian(lat: Column, lon: Column) -> Column:
    return F.array(F.cos(F.radians(lon)) * F.cos(F.radians(lat)), F.sin(F.radians(lon)) * F.cos(F.radians(lat)), F.sin(F.radians(lat)))


def wrap(lat: Column, lon: Column) -> Column:
    return F.array(*[f(F.radians(x)) for x in (lon, lat) for f in (F.cos, F.sin)])


def _each(freqs: list[float], body: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(F.array(*map(F.lit, freqs)), body))


def grid(lat: Column, lon: Column, freqs: list[float]) -> Column:
    """Sine and cosine of each frequency times the degrees, of lon and then of lat."""
    waves = lambda x: _each(freqs, lambda f: F.array(F.sin(x * f), F.cos(x * f)))
    return F.concat(waves(lon), waves(lat))


def _sphere(name: str, lat: Column, lon: Column, freqs: list[float]) -> Column:
    """Products of the angles at each frequency; each term stands twice. The m kinds mix in the degrees, unscaled."""

    def terms(f: Column) -> Column:
        sp, cp, sl, cl = F.sin(F.radians(lat) * f), F.cos(F.radians(lat) * f), F.sin(F.radians(lon) * f), F.cos(F.radians(lon) * f)
        if "m" in name:
            mixed = [cp * F.cos(lon), F.cos(lat) * cl, cp * F.sin(lon), F.cos(lat) * sl]
        else:
            mixed = [cp * cl, cp * sl]
        plain = [sp, cp, sl, cl] if name.endswith("plus") else [sp]
        return F.array(*[t for term in plain + mixed for t in (term, term)])

    return _each(freqs, terms)


def theory(lat: Column, lon: Column, freqs: list[float]) -> Column:
    """Projections on three directions at 120 degrees, twice each, by frequency; in each half sines and cosines alternate."""
    half = math.sqrt(3.0) / 2.0
    along = F.array(*[x for a in (lon, -0.5 * lon + half * lat, -0.5 * lon - half * lat) for x in (a, a)])
    angles = _each(freqs, lambda f: F.transform(along, lambda a: a * f))
    return F.transform(angles, lambda a, i: F.when(i % (3 * len(freqs)) % 2 == 0, F.sin(a)).otherwise(F.cos(a)))


def harmonics(lat: Column, lon: Column, degrees: int) -> Column:
    """Real spherical harmonics, closed form, of degree l below `degrees` and order m from -l to l, at l * l + l + m.

    Each order is one fold over the degrees, so no expression is repeated.
    """
    phi, theta = F.radians(lon + 180.0), F.radians(lat + 90.0)
    x = F.cos(theta)

    def order(m: int) -> Column:
        first = F.pow(F.sqrt((1.0 - x) * (1.0 + x)), F.lit(float(m))) * float((-1) ** m * math.prod(range(1, 2 * m, 2)))
        own = F.array(first)
        if m + 1 < degrees:
            start = F.struct(F.lit(0.0).alias("last"), first.alias("now"), own.alias("all"))

            def step(acc: Column, deg: Column) -> Column:
                nxt = ((2 * deg - 1) * x * acc["now"] - (deg + (m - 1)) * acc["last"]) / (deg - m)
                return F.struct(acc["now"].alias("last"), nxt.alias("now"), F.concat(acc["all"], F.array(nxt)).alias("all"))

            own = F.aggregate(F.array(*[F.lit(float(d)) for d in range(m + 1, degrees)]), start, step, lambda acc: acc["all"])
        norms = [math.sqrt((2 * d + 1) * math.factorial(d - m) / (4 * math.pi * math.factorial(d + m))) * (math.sqrt(2.0) if m else 1.0) for d in range(m, degrees)]
        norm = F.array(*map(F.lit, norms))

        def placed(p: Column, k: Column) -> Column:
            deg = k + m
            at = lambda sign, v: F.struct((deg * deg + deg + sign * m).alias("i"), (F.element_at(norm, k + 1) * v * p).alias("v"))
            return F.array(at(1, F.cos(m * phi)), at(-1, F.sin(m * phi))) if m else F.array(at(1, F.lit(1.0)))

        return F.flatten(F.transform(own, placed))

    return F.transform(F.array_sort(F.concat(*map(order, range(degrees)))), lambda s: s["v"])


def encoding(name: str, lat: Column, lon: Column, *, count: int = 16, shortest: float = 1.0, longest: float = 360.0, degrees: int = 10) -> Column:
    """The encoding of that name; ValueError if there is none."""
    if name in ("direct", "cartesian3d", "wrap"):
        return {"direct": direct, "cartesian3d": cartesian, "wrap": wrap}[name](lat, lon)
    if name == "sphericalharmonics":
        return harmonics(lat, lon, degrees)
    freqs = frequencies(count, shortest, longest)
    if name in ("spherec", "spherecplus", "spherem", "spheremplus"):
        return _sphere(name, lat, lon, freqs)
    if name in ("grid", "theory"):
        return {"grid": grid, "theory": theory}[name](lat, lon, freqs)
    raise ValueError(f"no encoding {name!r}")
