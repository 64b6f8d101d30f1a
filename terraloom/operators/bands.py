"""Features in disks around locations: densities, fractions and distances of the whole disk, its rings and its sectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.tags import CATEGORIES, DISTANCES, LANDUSE_CLASSES, MAJOR, ROADS, category, landuse_class, road_class
from terraloom.operators.disks import sums_in_disks
from terraloom.operators.ranges import by_tile
from terraloom.operators.spatial import mercator, points_in_boxes
from terraloom.sources.views import TAGS

SECTORS, RINGS = 4, 2


def bearing() -> Column:
    """Degrees clockwise from north, of the feature (flat, flon) seen from the location (llat, llon)."""
    dl, a, b = F.radians(F.col("flon") - F.col("llon")), F.radians("llat"), F.radians("flat")
    return F.degrees(F.atan2(F.sin(dl) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dl)))


def measured(features: DataFrame, locations: DataFrame, radii: tuple[float, ...]) -> DataFrame:
    """Sums by (loc_id, r, ring, sector), from one join at the largest radius; all other measures follow from these rows."""
    fx, fy = mercator(F.col("lat"), F.col("lon"))
    tags = list(TAGS)
    points = features.select("geom_type", F.col("lat").alias("flat"), F.col("lon").alias("flon"), fx.alias("px"), fy.alias("py"), category(tags).alias("category"), F.when(F.col("geom_type") == "polygon", landuse_class(tags)).alias("landuse_class"), F.when(F.col("geom_type") == "line", road_class(F.col("highway"))).alias("road_class"), F.when(F.col("geom_type") == "polygon", F.col("area")).otherwise(0.0).alias("area"), F.when(F.col("geom_type") == "line", F.col("length")).otherwise(0.0).alias("length"))
    x, y = mercator(F.col("lat"), F.col("lon"))
    half = max(radii)
    boxes = locations.select("loc_id", F.col("lat").alias("llat"), F.col("lon").alias("llon"), x.alias("cx"), y.alias("cy"), (x - half).alias("xmin"), (y - half).alias("ymin"), (x + half).alias("xmax"), (y + half).alias("ymax"))
    dx, dy = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
    near = points_in_boxes(points, boxes, 2 * half).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= half)
    near = near.withColumn("turn", bearing() + 405.0).withColumn("sector", F.floor((F.col("turn") - 360.0 * F.floor(F.col("turn") / 360.0)) / 90.0).cast("int"))
    every = F.array(*[F.lit(float(r)) for r in sorted(radii)])
    near = near.withColumn("r", F.explode(F.filter(every, lambda r: r >= F.col("d")))).withColumn("ring", (F.col("d") >= F.col("r") / 2).cast("int"))
    c, when = F.col, F.when
    sums = [F.count("*").alias("n"), *[F.count_if(c("geom_type") == k).alias(f"n_{k}") for k in ("point", "line", "polygon")], F.sum("area").alias("area")]
    sums += [F.count_if(c("category") == k).alias(f"cat_{k}") for k in CATEGORIES]
    sums += [F.sum(when(c("landuse_class") == k, c("area")).otherwise(0.0)).alias(f"lu_{k}") for k in LANDUSE_CLASSES]
    sums += [F.sum(when(c("road_class") == k, c("length")).otherwise(0.0)).alias(f"road_{k}") for k in ROADS]
    sums += [x for k in DISTANCES for x in (F.min(when(c("category") == k, c("d"))).alias(f"min_{k}"), F.sum(when(c("category") == k, c("d"))).alias(f"dist_{k}"))]
    return near.groupBy("loc_id", "r", "ring", "sector").agg(*sums)


def rolled(parts: DataFrame, locations: DataFrame, radii: tuple[float, ...], by: str | None = None, bins: int = 1) -> DataFrame:
    """The rows of parts summed by (loc_id, r, by), with zeros for places without features."""
    keys = ["loc_id", "r", *([by] if by else [])]
    names = [n for n in parts.columns if n not in ("loc_id", "r", "ring", "sector")]
    some = parts.groupBy(*keys).agg(*[(F.min(n) if n.startswith("min_") else F.sum(n)).alias(n) for n in names])
    places = locations.select("loc_id", F.explode(F.array(*[F.lit(float(r)) for r in sorted(radii)])).alias("r"))
    if by:
        places = places.withColumn(by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    zero = [n for n in names if not n.startswith(("min_", "dist_"))]
    return places.join(some, keys, "left").fillna(0, zero)


def counts_in_disks(features: DataFrame, locations: DataFrame, radii: tuple[float, ...]) -> DataFrame:
    """(loc_id, r, n): features at distances of at most r, without the pairs; no row where none."""
    fx, fy = mercator(F.col("lat"), F.col("lon"))
    x, y = mercator(F.col("lat"), F.col("lon"))
    limits = tuple((float(r), False) for r in sorted(radii))

    def work(near: pa.Table, here: pa.Table) -> list[pa.Array]:
        px, py, cx, cy = (t[c].to_numpy() for t, c in ((near, "px"), (near, "py"), (here, "cx"), (here, "cy")))
        got = sums_in_disks(px, py, np.ones((len(px), 1), np.int64), cx, cy, limits)
        return [pa.array(got[:, i, 0, 0]) for i in range(len(limits))]

    found = by_tile(features.select(fx.alias("px"), fy.alias("py")), locations.select("loc_id", x.alias("cx"), y.alias("cy")), limits[-1][0], work, ", ".join(f"n_{i} long" for i in range(len(limits))))
    found = found.groupBy("loc_id").agg(*[F.sum(f"n_{i}").alias(f"n_{i}") for i in range(len(limits))])
    rows = F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"n_{i}").alias("n")) for i, (r, _) in enumerate(limits)])
    return found.select("loc_id", F.inline(rows)).where("n > 0")


def summed_in_bins(features: DataFrame, locations: DataFrame, radii: tuple[float, ...], by: str) -> DataFrame:
    """The rows of `rolled` by ring or sector with the sums that `binned` needs, without the pairs."""
    fx, fy = mercator(F.col("lat"), F.col("lon"))
    x, y = mercator(F.col("lat"), F.col("lon"))
    tags, radii = list(TAGS), sorted(map(float, radii))
    place = lambda value, names: sum((F.when(value == k, i + 1).otherwise(0) for i, k in enumerate(names)), F.lit(0))
    polygon = F.col("geom_type") == "polygon"
    points = features.select(fx.alias("px"), fy.alias("py"), F.coalesce(place(category(tags), CATEGORIES), F.lit(0)).alias("cat"), "lat", "lon")
    names = ["n", *[f"cat_{k}" for k in CATEGORIES]]
    if by == "ring":  # sums of areas are shares of rings alone
        area = F.when(polygon, F.coalesce("area", F.lit(0.0))).otherwise(0.0)
        points = features.select(fx.alias("px"), fy.alias("py"), F.coalesce(place(category(tags), CATEGORIES), F.lit(0)).alias("cat"), F.when(polygon, F.coalesce(place(landuse_class(tags), LANDUSE_CLASSES), F.lit(0))).otherwise(0).alias("lu"), area.alias("area"))
        names += ["area", *[f"lu_{k}" for k in LANDUSE_CLASSES]]
    bins = RINGS if by == "ring" else SECTORS
    n_cat, n_lu = len(CATEGORIES), len(LANDUSE_CLASSES)

    def work(near: pa.Table, here: pa.Table) -> list[pa.Array]:
        px, py, cat, cx, cy = (t[c].to_numpy() for t, c in ((near, "px"), (near, "py"), (near, "cat"), (here, "cx"), (here, "cy")))
        weights = [np.ones((len(px), 1)), np.eye(n_cat + 1)[cat][:, 1:]]
        if by == "sector":
            weights = np.concatenate(weights, axis=1).astype(np.int32)
            got = sums_in_disks(px, py, weights, cx, cy, tuple((r, False) for r in radii), (near["lat"].to_numpy(), near["lon"].to_numpy()), (here["llat"].to_numpy(), here["llon"].to_numpy()))
        else:
            area = near["area"].to_numpy()[:, None]
            weights = np.concatenate([*weights, area, np.eye(n_lu + 1)[near["lu"].to_numpy()][:, 1:] * area], axis=1)
            inner, whole_ = (sums_in_disks(px, py, weights, cx, cy, tuple((r / part, part == 2) for r in radii), largest=radii[-1]) for part in (2, 1))
            got = np.concatenate([inner, whole_ - inner], axis=2)
        got = got.reshape(len(cx), -1)
        return [pa.FixedSizeListArray.from_arrays(pa.array(got.ravel().astype(np.float64)), got.shape[1]).cast(pa.list_(pa.float64()))]

    width = len(radii) * bins * len(names)
    places = locations.select("loc_id", x.alias("cx"), y.alias("cy"), F.col("lat").alias("llat"), F.col("lon").alias("llon"))
    found = by_tile(points, places, radii[-1], work, "sums array<double>")
    found = found.groupBy("loc_id").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    cell = lambda i, r, b: F.struct(F.lit(r).alias("r"), F.lit(b).alias(by), *[F.coalesce(f"s{(i * bins + b) * len(names) + j}", F.lit(0.0)).alias(n) for j, n in enumerate(names)])
    rows = F.array(*[cell(i, r, b) for i, r in enumerate(radii) for b in range(bins)])
    return locations.select("loc_id").join(found, "loc_id", "left").select("loc_id", F.inline(rows))


def _km2(share: Column | float = 1.0) -> Column:
    return F.greatest(F.lit(3.141592653589793) * F.col("r") * F.col("r") * share / 1e6, F.lit(1e-9))


def _fractions() -> list[Column]:
    return [F.when(F.col("area") < 1, 0.0).otherwise(F.col(f"lu_{k}") / F.col("area")).alias(f"lu_{k}_frac") for k in LANDUSE_CLASSES]


def whole(rows: DataFrame) -> DataFrame:
    """The 47 measures of a disk, by name."""
    c, km2 = F.col, _km2()
    out = [(c(n) / km2).alias(f"{k}_density") for k, n in (("total", "n"), ("point", "n_point"), ("line", "n_line"), ("polygon", "n_polygon"))]
    out += [(c(f"cat_{k}") / km2).alias(f"cat_{k}_density") for k in CATEGORIES] + [(c(f"cat_{k}") / F.greatest(c("n"), F.lit(1))).alias(f"cat_{k}_frac") for k in CATEGORIES]
    out += _fractions() + [(c(f"road_{k}") / 1000.0 / km2).alias(f"road_{k}_density") for k in ROADS]
    total, major = sum((c(f"road_{k}") for k in ROADS), F.lit(0.0)), sum((c(f"road_{k}") for k in MAJOR), F.lit(0.0))
    out.append((major / F.greatest(total, F.lit(1e-3))).alias("road_major_ratio"))
    out += [F.coalesce(f"min_{k}", "r").alias(f"dist_min_{k}_m") for k in DISTANCES] + [F.coalesce(c(f"dist_{k}") / F.nullif(c(f"cat_{k}"), F.lit(0)), c("r")).alias(f"dist_mean_{k}_m") for k in DISTANCES]
    return rows.select("loc_id", "r", *out)


def binned(rows: DataFrame, by: str) -> DataFrame:
    """The 16 measures of rings (the inner one has a quarter of the disk) or the 11 of sectors, by name."""
    c = F.col
    km2 = _km2(F.when(c("ring") == 0, 0.25).otherwise(0.75) if by == "ring" else 0.25)
    out = [(c(f"cat_{k}") / km2).alias(f"cat_{k}_density") for k in CATEGORIES] + (_fractions() if by == "ring" else []) + [(c("n") / km2).alias("feature_density")]
    return rows.select("loc_id", "r", by, *out)
