"""Richness of the features around locations at several box sizes, and the choice of a size by it."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.tags import CATEGORIES
from terraloom.operators import surroundings
from terraloom.operators.ranges import by_tile, counts_in_boxes
from terraloom.operators.spatial import MERCATOR_RADIUS, mercator, points_in_boxes
from terraloom.sources.views import TAGS

TRUE = ("true", "yes", "1")
GRID = 4
# fixed values: weights of the composite score, and what each part is divided by before it is capped at 1
WEIGHTS = {"tag_entropy": (0.30, 3.912023005428146), "category_coverage": (0.25, 1.0), "unique_kv_pairs": (0.15, 30.0), "geometry_entropy": (0.10, 1.0986122886681098), "spatial_coverage": (0.10, 1.0), "semantic_depth": (0.05, 8.0), "idf_score": (0.05, 4.0)}
# fixed values: default weights of the level selection
SELECTION = {"richness_score": 1.0, "tag_entropy": 0.0, "category_coverage": 0.1, "spatial_coverage": 0.0, "idf_score": 0.0, "semantic_depth": 0.2, "size": 0.1, "nodes": 0.5}
MIN_NODES = 10


def _total(values: Column, each) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + each(x))


def _folded(values: list[Column]) -> Column:
    """Their sum, the first being a fold of an array, which Spark leaves out of whole stages: it compiles the projection by itself, in small methods.

    As plain sums the measures of several levels are one method of a whole stage, too long for the JVM to compile.
    """
    return sum(values[1:], _total(F.array(values[0]), lambda x: x))


def category_of_tag(key: Column, value: Column) -> Column:
    out = F
    for name, rules in CATEGORIES.items():
        for k, allowed in rules:
            out = out.when((key == k) & (F.lit(True) if allowed is None else value.isin(*allowed)), name)
    return out.otherwise(None)


def levelled(features: DataFrame, locations: DataFrame, sizes: tuple[float, ...]) -> DataFrame:
    """A row for each location, box of half size in sizes (level from 1) and feature inside, bounds included."""
    fx, fy = mercator(F.col("lat"), F.col("lon"))
    points = features.select("feature_id", "geom_type", "lat", "lon", *TAGS, fx.alias("px"), fy.alias("py"))
    x, y = mercator(F.col("lat"), F.col("lon"))
    half = max(sizes)
    boxes = locations.select("loc_id", x.alias("cx"), y.alias("cy"), (x - half).alias("xmin"), (y - half).alias("ymin"), (x + half).alias("xmax"), (y + half).alias("ymax"))
    near = points_in_boxes(points, boxes, 2 * half).withColumn("m", F.greatest(F.abs(F.col("px") - F.col("cx")), F.abs(F.col("py") - F.col("cy"))))
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(s)).alias("size")) for i, s in enumerate(sorted(sizes), 1)])
    return near.withColumn("l", F.explode(F.filter(levels, lambda v: v["size"] >= F.col("m")))).select("loc_id", "l.level", "l.size", "feature_id", "geom_type", "lat", "lon", *TAGS)


def level_counts(features: DataFrame, locations: DataFrame, sizes: tuple[float, ...]) -> DataFrame:
    """(loc_id, level, size, n_points, n_lines, n_polygons, total_nodes), those columns of level_metrics, without the pairs."""
    fx, fy = mercator(F.col("lat"), F.col("lon"))
    x, y = mercator(F.col("lat"), F.col("lon"))
    kinds = {f"n_{k}s": F.col("geom_type") == k for k in ("point", "line", "polygon")}
    found = counts_in_boxes(features.withColumn("px", fx).withColumn("py", fy), locations.select("loc_id", x.alias("cx"), y.alias("cy")), tuple(sorted(sizes)), kinds, nested=True)
    level = lambda i, s: F.struct(F.lit(i + 1).alias("level"), F.lit(float(s)).alias("size"), *[F.coalesce(f"{k}_{i}", F.lit(0)).alias(k) for k in kinds])
    out = locations.select("loc_id").join(found, "loc_id", "left").select("loc_id", F.inline(F.array(*[level(i, s) for i, s in enumerate(sorted(sizes))])))
    return out.withColumn("total_nodes", sum((F.col(k) for k in kinds), F.lit(0)))


def normal(value: Column) -> Column:
    """The value of a tag, that of any true one "yes"."""
    return F.when(F.lower(value).isin(*TRUE), "yes").otherwise(value)


@lru_cache(maxsize=1 << 14)  # tiles hold much the same sets
def _tags_of(text: str) -> tuple[tuple[int, str], ...]:
    """Numbers of keys and normal values, from the text that `_measured` makes of them."""
    out, at = [], 0
    while at < len(text):
        key, size, _ = text[at:].split(":", 2)
        at += len(key) + len(size) + 2
        out.append((int(key), text[at : at + int(size)]))
        at += int(size)
    return tuple(out)


def _category_of(key: int, value: str) -> int:
    """The place of a tag's category, -1 without one; as category_of_tag."""
    for i, rules in enumerate(CATEGORIES.values()):
        if any(k == TAGS[key] and (allowed is None or value in allowed) for k, allowed in rules):
            return i
    return -1


_KINDS = ("point", "line", "polygon")
_MEASURED = (*(f"n_{k}s" for k in _KINDS), "total_kv_instances", "unique_labels", "cells", "pairs", "keys", "categories", "entropy")


def _mercator(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As spatial.mercator, so that two numbers of a point are shuffled and not four; by the C library, once for each latitude."""
    each, at = np.unique(lat, return_inverse=True)
    tangent = [math.tan(0.7853981633974483 + x / 2) for x in np.radians(each).tolist()]
    return np.radians(lon) * MERCATOR_RADIUS, (np.array([math.log(x) if x > 0 else math.nan for x in tangent]) * MERCATOR_RADIUS)[at]


def _in_tile(near: pa.Table, here: pa.Table, sizes: tuple[float, ...], labels: bool) -> np.ndarray:
    """(places, sizes, _MEASURED) of the places of one tile and the points around."""
    out = np.zeros((len(sizes) * len(here), len(_MEASURED)))
    if len(near) and len(here):
        lat, lon, kind = (near[c].to_numpy() for c in ("lat", "lon", "kind"))
        (px, py), (cx, cy) = _mercator(lat, lon), _mercator(here["lat"].to_numpy(), here["lon"].to_numpy())
        coded = near["tags"].combine_chunks().dictionary_encode()
        sets, code = [_tags_of(x) for x in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64)
        known = list(dict.fromkeys(t for s in sets for t in s))
        number = {t: i for i, t in enumerate(known)}
        names = [";".join(TAGS[k] if v == "yes" else f"{TAGS[k]}:{v}" for k, v in s) for s in sets]
        label_number = {x: i for i, x in enumerate(dict.fromkeys(x for x in names if x))}
        boxes = surroundings.Boxes(px, py, cx, cy, sizes)
        pack, count = surroundings.Packed(len(px), len(TAGS)), np.array([len(s) for s in sets], np.int64)
        words = pack.put(len(px), np.arange(len(px)), np.full(len(px), 3), 5, count[code]) + pack.put(len(px), np.arange(len(px)), np.full(len(px), 4), 5, (count > 0)[code].astype(np.int64))
        words += pack.put(len(px), at := np.flatnonzero(kind >= 0), kind[at].astype(np.int64), 5)
        got = boxes.sums(words)
        for i in range(4):
            out[:, i] = pack.take(got, i)
        if labels:
            label = np.array([label_number.get(x, -1) for x in names], np.int64)[code]
            out[:, 4] = pack.take(got, 4) - surroundings.repeated_labels(boxes, label, cx, cy, [round(max(sizes) / s) for s in sizes])
        out[:, 5] = surroundings.occupied(boxes, lon, lat, GRID)
        per = surroundings.tag_sums(boxes, code, [[number[t] for t in s] for s in sets], np.array([k for k, _ in known], np.int64), np.array([_category_of(k, v) for k, v in known], np.int64), out[:, 3])
        for i, name in enumerate(("pairs", "keys", "categories", "entropy"), 6):
            out[:, i] = per[name]
    return out.reshape(len(sizes), len(here), len(_MEASURED)).swapaxes(0, 1)


def _measured(features: DataFrame, locations: DataFrame, sizes: tuple[float, ...], labels: bool) -> DataFrame:
    """(loc_id, lat, lon, m): _MEASURED of each size, ascending, one after another; of locations with coordinates."""
    fx, fy = mercator(F.col("lat"), F.col("lon"))
    kind = F.lit(-1)
    for i, k in enumerate(_KINDS):
        kind = F.when(F.col("geom_type") == k, i).otherwise(kind)
    # a tag is its key's number, its value's length and its value
    tags = F.concat(*[F.coalesce(F.concat(F.lit(f"{i}:"), F.length(normal(F.col(t))).cast("string"), F.lit(":"), normal(F.col(t))), F.lit("")) for i, t in enumerate(TAGS)])
    points = features.select("lat", "lon", fx.alias("px"), fy.alias("py"), kind.cast("byte").alias("kind"), tags.alias("tags"))
    x, y = mercator(F.col("lat"), F.col("lon"))

    def work(near: pa.Table, here: pa.Table) -> list[pa.Array]:
        got = _in_tile(near, here, tuple(sorted(sizes)), labels)
        width = len(sizes) * len(_MEASURED)
        return [here["lat"], here["lon"], pa.ListArray.from_arrays(pa.array(np.arange(len(here) + 1, dtype=np.int32) * width), pa.array(got.reshape(-1)))]

    places = locations.select("loc_id", "lat", "lon", x.alias("cx"), y.alias("cy"))
    return by_tile(points, places, max(sizes), work, "lat double, lon double, m array<double>", ("lon", "lon"), ("px", "py", "cx", "cy"))


def _every_level(locations: DataFrame, sizes: tuple[float, ...], *keep: str) -> DataFrame:
    return locations.select("loc_id", *keep, F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(s)).alias("size")) for i, s in enumerate(sorted(sizes), 1)])).alias("l")).select("loc_id", *keep, "l.level", "l.size")


def _by_pairs(features: DataFrame, locations: DataFrame, idf: DataFrame, sizes: tuple[float, ...], labels: bool) -> DataFrame:
    """(loc_id, level, size, counted measures) from every pair; boxes of one loc_id are measured together."""
    inside = levelled(features, locations, sizes)
    own = Window.partitionBy("loc_id", "level")
    label = F.concat_ws(";", *[F.when(F.lower(F.col(t)).isin(*TRUE), F.lit(t)).otherwise(F.concat(F.lit(f"{t}:"), F.col(t))) for t in TAGS])
    west, east, south, north = F.min("lon").over(own), F.max("lon").over(own), F.min("lat").over(own), F.max("lat").over(own)

    def cell(at: Column, low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(GRID - 1), F.ceil((at - low) / ((high - low) / GRID)).cast("int") - 1))

    placed = inside.withColumn("w", west).withColumn("e", east).withColumn("s", south).withColumn("n", north)
    wide = (F.col("e") - F.col("w") >= 1e-9) & (F.col("n") - F.col("s") >= 1e-9)
    placed = placed.withColumn("cell", F.when(wide, cell(F.col("lon"), F.col("w"), F.col("e")) * GRID + cell(F.col("lat"), F.col("s"), F.col("n"))))
    told = [F.size(F.collect_set(F.when(label != "", label))).alias("unique_labels")] if labels else []
    shape = placed.groupBy("loc_id", "level").agg(*[F.count_if(F.col("geom_type") == k).alias(f"n_{k}s") for k in _KINDS], *told, (F.size(F.collect_set("cell")) / float(GRID * GRID)).alias("spatial_coverage"))
    tags = inside.select("loc_id", "level", F.explode(F.array(*[F.struct(F.lit(t).alias("k"), normal(F.col(t)).alias("v")) for t in TAGS])).alias("t")).where("t.v IS NOT NULL")
    per_tag = tags.groupBy("loc_id", "level", "t.k", "t.v").agg(F.count("*").alias("n")).crossJoin(F.broadcast(idf))  # one row
    per_tag = per_tag.withColumn("idf", F.coalesce(*[F.when(F.col("k") == t, F.col(f"_idf_{i}")) for i, t in enumerate(TAGS)])).withColumn("category", category_of_tag(F.col("k"), F.col("v")))
    kv = per_tag.groupBy("loc_id", "level").agg(F.collect_list(F.col("n").cast("double")).alias("counts"), F.collect_set(F.struct("k", "idf")).alias("keys"), F.size(F.collect_set("category")).alias("n_categories"))
    total = _total(F.col("counts"), lambda x: x)
    kv = kv.select(
        "loc_id", "level", F.size("counts").alias("unique_kv_pairs"), F.size("keys").alias("unique_keys"), total.cast("long").alias("total_kv_instances"), (F.col("n_categories") / 10.0).alias("category_coverage"),
        F.when(F.size("counts") <= 1, 0.0).otherwise(-_total(F.col("counts"), lambda x: x / total * F.log(x / total + 1e-12))).alias("tag_entropy"),
        (_total(F.col("keys"), lambda x: F.coalesce(x["idf"], F.lit(0.0))) / F.greatest(F.size("keys"), F.lit(1))).alias("idf_score"),
    )
    return _every_level(locations, sizes).join(shape, ["loc_id", "level"], "left").join(kv, ["loc_id", "level"], "left").fillna(0)


_COUNTED = (*(f"n_{k}s" for k in _KINDS), "unique_labels", "spatial_coverage", "unique_kv_pairs", "unique_keys", "total_kv_instances", "category_coverage", "tag_entropy", "idf_score")
Named = Callable[[str], str]  # the column that holds a measure
PLAIN: Named = str


def _at_level(i: int) -> Named:
    return lambda name: f"{name}_{i}"


def _by_tiles(features: DataFrame, locations: DataFrame, idf: DataFrame, sizes: tuple[float, ...], labels: bool) -> DataFrame:
    """A row for each location, whose loc_id is there once: loc_id, lat, lon and, for each level i from 1, size_i and the counted measures, without the pairs."""
    x, y = mercator(F.col("lat"), F.col("lon"))
    nowhere = locations.where(F.isnan(F.coalesce(x, F.lit(math.nan))) | F.isnan(F.coalesce(y, F.lit(math.nan)))).select("loc_id", "lat", "lon", F.lit(None).cast("array<double>").alias("m"))
    out = _measured(features, locations, sizes, labels).unionByName(nowhere).withColumn("m", F.when(F.col("loc_id").isNotNull(), F.col("m")))  # null meets nothing
    levels = range(1, len(sizes) + 1)
    at = lambda i, name: F.coalesce(F.get("m", F.lit((i - 1) * len(_MEASURED) + _MEASURED.index(name))), F.lit(0.0)).cast("double" if name == "entropy" else "long").alias(f"{name}_{i}")
    out = out.select("loc_id", "lat", "lon", *[at(i, name) for i in levels for name in _MEASURED])

    def counted(i: int, size: float) -> list[Column]:
        c = lambda name: F.col(f"{name}_{i}")
        held = [c("keys").bitwiseAND(F.lit(1 << k).cast("long")) != 0 for k in range(len(TAGS))]
        idf_sum = _folded([F.when(h, F.coalesce(f"_idf_{k}", F.lit(0.0))).otherwise(0.0) for k, h in enumerate(held)])
        found = [F.lit(float(size)).alias("size"), *[c(f"n_{k}s").alias(f"n_{k}s") for k in _KINDS], *([c("unique_labels").cast("int").alias("unique_labels")] if labels else []), (c("cells") / float(GRID * GRID)).alias("spatial_coverage")]
        found += [c("pairs").cast("int").alias("unique_kv_pairs"), F.bit_count(c("keys")).alias("unique_keys"), c("total_kv_instances").alias("total_kv_instances"), (F.bit_count(c("categories")) / 10.0).alias("category_coverage"), c("entropy").alias("tag_entropy")]
        found.append((idf_sum / F.greatest(F.bit_count(c("keys")), F.lit(1))).alias("idf_score"))
        return [x.alias(f"{n}_{i}") for x, n in zip(found, ("size", *[n for n in _COUNTED if labels or n != "unique_labels"]), strict=True)]

    return out.crossJoin(F.broadcast(idf)).select("loc_id", "lat", "lon", *[x for i, s in zip(levels, sorted(sizes), strict=True) for x in counted(i, s)])  # one row


def _rows(wide: DataFrame, levels: int, labels: bool) -> DataFrame:
    """A row for each location and level of the columns of each level."""
    names = ("size", *[n for n in _COUNTED if labels or n != "unique_labels"])
    return wide.select("loc_id", F.inline(F.array(*[F.struct(F.lit(i).alias("level"), *[F.col(f"{n}_{i}").alias(n) for n in names]) for i in range(1, levels + 1)])))


def _derived(out: DataFrame, *names: Named) -> DataFrame:
    """With the measures that follow from those counted, for each of names."""
    counted, per_area = {}, {}
    for named in names:
        c = lambda name, named=named: F.col(named(name))
        nodes = c("n_points") + c("n_lines") + c("n_polygons")
        share = [F.when(c(f"n_{k}s") > 0, c(f"n_{k}s") / nodes * F.log(c(f"n_{k}s") / nodes)).otherwise(0.0) for k in _KINDS]
        some = F.greatest(*[c(f"n_{k}s") for k in _KINDS])
        counted |= {named("total_nodes"): nodes, named("geometry_entropy"): F.when((nodes == 0) | (some == nodes), 0.0).otherwise(-_folded(share))}
        nodes = c("total_nodes")
        per_area |= {named("feature_density"): nodes / ((2 * c("size") / 1000.0) * (2 * c("size") / 1000.0)), named("semantic_depth"): F.when(nodes > 0, c("total_kv_instances") / nodes).otherwise(0.0)}
    return out.withColumns(counted).withColumns(per_area).withColumns({named("richness_score"): composite(named) for named in names})


def level_metrics(features: DataFrame, locations: DataFrame, frequencies: DataFrame, sizes: tuple[float, ...], *, labels: bool = True, wide: bool = False) -> DataFrame:
    """The richness measures of each location and level, zero where nothing lies; frequencies: (k, freq) of tag keys.

    labels: whether unique_labels is among them. Features and locations meet in pairs only where a loc_id is there more than once.
    wide: if none is, a row for each location (loc_id, lat, lon) with size_i and the measures of each level i as {name}_i: a choice among the levels then needs no shuffle.
    """
    top = F.max("freq").over(Window.partitionBy())  # over a row for each key of the schema
    idf = frequencies.select("k", F.log(top / F.col("freq") + 1).alias("idf")).agg(*[F.max(F.when(F.col("k") == t, F.col("idf"))).alias(f"_idf_{i}") for i, t in enumerate(TAGS)])
    again = locations.groupBy("loc_id").agg(F.count("*").alias("n")).where("n > 1").select("loc_id")
    if again.isEmpty():  # asked first, as features would be shuffled once more for no location
        out = _by_tiles(features, locations, idf, sizes, labels)
        if wide:
            return _derived(out, *[_at_level(i) for i in range(1, len(sizes) + 1)])
        out = _rows(out, len(sizes), labels)
    else:
        out = _rows(_by_tiles(features, locations.join(again, "loc_id", "left_anti"), idf, sizes, labels), len(sizes), labels)
        out = out.unionByName(_by_pairs(features, locations.join(again, "loc_id", "left_semi"), idf, sizes, labels))
    return _derived(out, PLAIN)


def composite(named: Named = PLAIN) -> Column:
    return F.least(F.lit(1.0), _folded([w * F.least(F.col(named(c)) / cap, F.lit(1.0)) for c, (w, cap) in WEIGHTS.items()]))


def _names(metrics: DataFrame) -> list[Named]:
    """One for each level of metrics with a row for each location; none where each level has a row."""
    return [] if "level" in metrics.columns else [_at_level(i) for i in range(1, 1 + sum(n.startswith("size_") for n in metrics.columns))]


def selected_level(metrics: DataFrame, weights: dict[str, float] | None = None, min_nodes: int = MIN_NODES) -> DataFrame:
    """(loc_id, level, score): the level with the best score of each location, the lower one of equals. metrics: in either form."""
    w, own, levels = SELECTION | (weights or {}), Window.partitionBy("loc_id"), _names(metrics)

    def spread(value: Callable[[Named], Column], named: Named) -> Column:
        if levels:
            every = F.array(*[value(n) for n in levels])
            low, high = F.array_min(every), F.array_max(every)
        else:
            low, high = F.min(value(PLAIN)).over(own), F.max(value(PLAIN)).over(own)
        return F.when(high == low, 1.0).otherwise((value(named) - low) / (high - low))

    def score(named: Named) -> Column:
        plain = _folded([w[c] * F.col(named(c)) for c in ("richness_score", "category_coverage", "spatial_coverage")])
        spread_out = _folded([w[c] * spread(lambda n, c=c: F.col(n(c)), named) for c in ("tag_entropy", "idf_score", "semantic_depth")])
        cost = w["size"] * spread(lambda n: F.log(n("size")), named) + w["nodes"] * spread(lambda n: F.log(F.greatest(F.col(n("total_nodes")), F.lit(1)).cast("double")), named)
        return plain + spread_out - cost - F.when((F.lit(min_nodes) > 0) & (F.col(named("total_nodes")) < min_nodes), 2.0).otherwise(0.0)

    if levels:
        scored = metrics.select("loc_id", *[score(n).alias(n("score")) for n in levels])
        best = F.array_min(F.array(*[F.struct((-F.round(n("score"), 9)).alias("least"), F.lit(i).alias("level"), F.col(n("score")).alias("score")) for i, n in enumerate(levels, 1)]))
        return scored.select("loc_id", best.alias("best")).select("loc_id", "best.level", "best.score")
    ranked = metrics.withColumn("score", score(PLAIN)).withColumn("r", F.row_number().over(own.orderBy(F.desc(F.round("score", 9)), "level")))
    return ranked.where("r = 1").select("loc_id", "level", "score")


def first_rich(metrics: DataFrame, *, nodes: int = 5, labels: int = 3, score: float | None = 0.2, keep: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """(loc_id, level, size, accepted): the least level that is rich enough; else the largest if it holds anything; else none.

    metrics: in either form. keep: more metrics of that level. carry: columns of the location, with a row for each alone.
    """
    rich = lambda n: (F.col(n("total_nodes")) >= nodes) & (F.col(n("unique_labels")) >= labels) & (F.lit(True) if score is None else F.round(n("richness_score"), 9) >= score)
    chosen, levels = ("level", "size", *keep), _names(metrics)
    if levels:
        at = [F.struct(F.lit(i).alias("level"), *[F.col(n(c)).alias(c) for c in ("size", *keep)]) for i, n in enumerate(levels, 1)]
        per = metrics.select("loc_id", *carry, F.coalesce(*[F.when(rich(n), x) for n, x in zip(levels, at, strict=True)]).alias("rich"), at[-1].alias("last"), F.col(levels[-1]("total_nodes")).alias("nodes"))
    else:
        per = metrics.groupBy("loc_id").agg(F.min(F.when(rich(PLAIN), F.struct(*chosen))).alias("rich"), F.max(F.struct("level", "size", F.col("total_nodes").alias("nodes"), *keep)).alias("last")).withColumn("nodes", F.col("last.nodes"))
    held = F.col("nodes") > 0
    pick = lambda c: F.coalesce(F.col(f"rich.{c}"), F.when(held, F.col(f"last.{c}"))).alias(c)
    out = [*map(pick, chosen), F.when(F.col("rich").isNotNull(), "rich").when(held, "ceiling").otherwise("none").alias("accepted")]
    # by a generator, as Spark would write the measures out again in every filter on what is chosen
    return per.select("loc_id", *carry, F.inline(F.array(F.struct(*out))))


def levels_with_data(metrics: DataFrame) -> DataFrame:
    """(loc_id, level): the first level with a feature and all larger ones."""
    first = F.min(F.when(F.col("total_nodes") > 0, F.col("level"))).over(Window.partitionBy("loc_id"))
    return metrics.withColumn("first", first).where("level >= first").select("loc_id", "level")


def levels_within(metrics: DataFrame, limit: int) -> DataFrame:
    """(loc_id, level): levels up to the first whose features of one geometry type exceed limit."""
    breach = (F.greatest("n_points", "n_lines", "n_polygons") > limit).cast("int")
    hit = F.max(breach).over(Window.partitionBy("loc_id").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return metrics.withColumn("hit", hit).where("hit = 0").select("loc_id", "level")
