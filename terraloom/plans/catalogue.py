"""Queries of the location analytics, by operator; one text serves both engines where the plan is plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators import bands, scoring, spatial
from terraloom.plans import measures
from terraloom.sources.views import duck_sql, spark_sql, view

Query = Callable[[SparkSession, str], DataFrame]
HALF = 200_000.0

MERC = "radians({p}lon) * 6378137.0D AS {q}x, ln(tan(0.7853981633974483D + radians({p}lat) / 2.0D)) * 6378137.0D AS {q}y"
_JOINED = f"""WITH fm AS (SELECT *, {MERC.format(p='', q='p')} FROM feat), lm AS (SELECT *, {MERC.format(p='', q='c')} FROM loc),
pairs AS (SELECT loc_id, feature_id, geom_type, f.lat AS flat, f.lon AS flon, l.lat AS llat, l.lon AS llon, amenity, shop, highway, "natural", landuse, building, waterway, tourism, area, length,
  sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) AS d FROM fm f JOIN lm l ON px BETWEEN cx - 200000.0D AND cx + 200000.0D AND py BETWEEN cy - 200000.0D AND cy + 200000.0D)"""
# the same pairs for Spark, by tiles as wide as the boxes: an equi-join in place of a nested loop
_TILED = f"""WITH fm AS (SELECT *, floor(px / 400000.0D) AS tx, floor(py / 400000.0D) AS ty FROM (SELECT *, {MERC.format(p='', q='p')} FROM feat) f0m), lm AS (SELECT *, {MERC.format(p='', q='c')} FROM loc),
lx AS (SELECT *, {{seq:floor((cx - 200000.0D) / 400000.0D);floor((cx + 200000.0D) / 400000.0D)}} AS tx FROM lm), lt AS (SELECT *, {{seq:floor((cy - 200000.0D) / 400000.0D);floor((cy + 200000.0D) / 400000.0D)}} AS ty FROM lx),
pairs AS (SELECT loc_id, feature_id, geom_type, f.lat AS flat, f.lon AS flon, l.lat AS llat, l.lon AS llon, amenity, shop, highway, "natural", landuse, building, waterway, tourism, area, length,
  sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) AS d FROM fm f JOIN lt l ON f.tx = l.tx AND f.ty = l.ty AND px BETWEEN cx - 200000.0D AND cx + 200000.0D AND py BETWEEN cy - 200000.0D AND cy + 200000.0D)"""
_IN = "JOIN fm f ON px BETWEEN cx - 200000.0D AND cx + 200000.0D AND py BETWEEN cy - 200000.0D AND cy + 200000.0D AND geom_type"


def _per_type(kind: str) -> str:
    own = ", ".join(f'count("{t}") AS n_{t}' for t in scoring.COUNTED[kind])
    return f"SELECT loc_id, count(*) AS n_{kind}s, {own} FROM lm l {_IN} = '{kind}' GROUP BY loc_id"


# one aggregate for each geometry type, as the tables of a map database have it
_COUNTS = f"""WITH fm AS (SELECT *, {MERC.format(p='', q='p')} FROM feat), lm AS (SELECT loc_id, {MERC.format(p='', q='c')} FROM loc),
 cp AS ({_per_type('point')}), cl AS ({_per_type('line')}), cg AS ({_per_type('polygon')}),
 counts AS (SELECT loc.loc_id, lat, lon, {', '.join(f'coalesce({c}, 0) AS {c}' for c in scoring.COUNTERS)} FROM loc LEFT JOIN cp ON loc.loc_id = cp.loc_id LEFT JOIN cl ON loc.loc_id = cl.loc_id LEFT JOIN cg ON loc.loc_id = cg.loc_id)"""
_CATS = " + ".join(f"CASE WHEN {' + '.join('n_' + t for t in own)} > 0 THEN 1 ELSE 0 END" for own in scoring.GROUPS)
_ENT = " + ".join(f"CASE WHEN {c} > 0 THEN {c} * 1.0D / t * ln({c} * 1.0D / t) ELSE 0.0D END" for c in ("n_points", "n_lines", "n_polygons"))
_SCORED = _COUNTS + f""", s AS (SELECT *, CASE WHEN t = 0 THEN 0.0D ELSE least(1.0D, 0.3D * cats / 9.0D + 0.25D * cats / 10.0D + 0.2D * least(t / 50.0D, 1.0D) + 0.15D * -({_ENT}) / 1.0986122886681098D + 0.1D * least(t / 20.0D, 1.0D)) END AS richness
 FROM (SELECT *, n_points + n_lines + n_polygons AS t, {_CATS} AS cats FROM counts)), scored AS (SELECT *, CASE WHEN richness < 0.2D THEN 'very_low' WHEN richness < 0.4D THEN 'low' WHEN richness < 0.65D THEN 'medium' ELSE 'high' END AS bucket, concat(cast(cast(floor(lat / 10.0D) AS int) AS varchar(9)), '_', cast(cast(floor(lon / 10.0D) AS int) AS varchar(9))) AS cell FROM s)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = scoring.location_counts(view(spark, sf_dir, "feat"), view(spark, sf_dir, "loc"), HALF)
    out = counts.withColumn("richness", scoring.proxy_richness())
    cell = F.concat_ws("_", F.floor(F.col("lat") / 10).cast("int").cast("string"), F.floor(F.col("lon") / 10).cast("int").cast("string"))
    return out.withColumn("bucket", scoring.bucket(F.col("richness"))).withColumn("cell", cell)


def location_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.location_counts(view(spark, sf_dir, "feat"), view(spark, sf_dir, "loc"), HALF).drop("lat", "lon")


def score_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("loc_id", F.round("richness", 6).alias("richness"), "bucket").orderBy(F.array_position(F.array(*[F.lit(n) for n, _, _ in scoring.BUCKETS]), F.col("bucket")), "richness", "loc_id")


def select_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.stratified(_scored(spark, sf_dir), 40, 2, 42).select("loc_id", "bucket", "cell")


def box_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.related_boxes(view(spark, sf_dir, "box"), 16.0)


def feature_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.feature_density(view(spark, sf_dir, "feat"), view(spark, sf_dir, "loc"), HALF).select("loc_id", F.round("density", 9).alias("density"))


def multi_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.counts_in_disks(view(spark, sf_dir, "feat"), view(spark, sf_dir, "loc"), (50_000.0, 100_000.0, HALF))


def relation_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.related_boxes(view(spark, sf_dir, "box"), 16.0).where("src < dst AND rel NOT IN (1, 7)")
    kinds = {"touches": 2, "overlaps": 3, "covered": 4, "covers": 5}
    return pairs.select("src", "dst", *[F.when(F.col("rel") == code, 1.0).otherwise(0.0).alias(n) for n, code in kinds.items()])


def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.corners_in_boxes(view(spark, sf_dir, "box"), 16.0)


def hash_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.hash_ranked(view(spark, sf_dir, "loc").select("loc_id"), "loc_id", 17).select("loc_id", "place")


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = scoring.hash_ranked(view(spark, sf_dir, "loc").select("loc_id"), "loc_id", 17)
    return ranked.select("loc_id", F.when(F.col("place") <= F.floor(F.col("total") * 0.1), "val").otherwise("train").alias("split"))


_REL = """CASE WHEN a.xmin > b.xmax OR b.xmin > a.xmax OR a.ymin > b.ymax OR b.ymin > a.ymax THEN 1
 WHEN a.xmin = b.xmax OR b.xmin = a.xmax OR a.ymin = b.ymax OR b.ymin = a.ymax THEN 2
 WHEN b.xmin <= a.xmin AND b.ymin <= a.ymin AND b.xmax >= a.xmax AND b.ymax >= a.ymax THEN 5
 WHEN a.xmin <= b.xmin AND a.ymin <= b.ymin AND a.xmax >= b.xmax AND a.ymax >= b.ymax THEN 4 ELSE 3 END"""
_PAIRS = f"WITH r AS (SELECT a.box_id AS src, b.box_id AS dst, {_REL} AS rel FROM box a JOIN box b ON a.box_id < b.box_id AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax)"
_TILED_PAIRS = f"""WITH bx AS (SELECT *, {{seq:floor(xmin / 16.0D);floor(xmax / 16.0D)}} AS tx FROM box), bt AS (SELECT *, {{seq:floor(ymin / 16.0D);floor(ymax / 16.0D)}} AS ty FROM bx),
 r AS (SELECT a.box_id AS src, b.box_id AS dst, {_REL} AS rel FROM bt a JOIN bt b ON a.tx = b.tx AND a.ty = b.ty AND a.box_id < b.box_id AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax
  AND a.tx = floor(greatest(a.xmin, b.xmin) / 16.0D) AND a.ty = floor(greatest(a.ymin, b.ymin) / 16.0D))"""
_QUOTA = " ".join(f"WHEN '{n}' THEN {q}" for n, q in scoring.quotas(40).items())

#: name: (DataFrame query, SQL for DuckDB)
FRAMES: dict[str, tuple[Query, str]] = {
    "location_counts": (location_counts, f"{_COUNTS} SELECT loc_id, {', '.join(scoring.COUNTERS)} FROM counts"),
    "score_locations": (score_locations, f"{_SCORED} SELECT loc_id, round(richness, 6) AS richness, bucket FROM scored"),
    "select_diverse": (select_diverse, f"""{_SCORED}, c AS (SELECT *, row_number() OVER (PARTITION BY bucket, cell ORDER BY md5(concat('42:', cast(loc_id AS varchar(20))))) AS r FROM scored),
 k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(concat('42:', cast(loc_id AS varchar(20))))) AS k FROM c WHERE r <= 2) SELECT loc_id, bucket, cell FROM k WHERE k <= CASE bucket {_QUOTA} END"""),
    "box_relations": (box_relations, f"{_PAIRS} SELECT src, dst, rel FROM r UNION ALL SELECT dst, src, CASE rel WHEN 5 THEN 4 WHEN 4 THEN 5 ELSE rel END FROM r"),
    "point_in_box": (point_in_box, "SELECT b.box_id, count(*) AS n FROM box b JOIN box p ON p.xmin BETWEEN b.xmin AND b.xmax AND p.ymin BETWEEN b.ymin AND b.ymax WHERE p.box_id <> b.box_id GROUP BY b.box_id"),
    "hash_permutation": (hash_permutation, "SELECT loc_id, cast(row_number() OVER (ORDER BY md5(concat('17:', cast(loc_id AS varchar(20))))) AS bigint) AS place FROM loc"),
    "train_val_split": (train_val_split, "SELECT loc_id, CASE WHEN k <= floor(n * 0.1D) THEN 'val' ELSE 'train' END AS split FROM (SELECT loc_id, row_number() OVER (ORDER BY md5(concat('17:', cast(loc_id AS varchar(20))))) AS k, count(*) OVER () AS n FROM loc) a"),
}

_KVN = "WITH c AS (SELECT cast(floor(lat / 10.0D) AS int) AS cell, k, v, count(*) AS n FROM kv GROUP BY cast(floor(lat / 10.0D) AS int), k, v)"
_CATEGORY = """CASE WHEN k = 'amenity' AND v IN ('restaurant', 'cafe', 'bar', 'fast_food', 'pub', 'food_court', 'ice_cream', 'biergarten', 'bbq') THEN 'food_drink' WHEN k = 'shop' THEN 'retail'
 WHEN k IN ('highway', 'railway', 'public_transport') THEN 'transport' WHEN k = 'amenity' AND v IN ('school', 'university', 'college', 'kindergarten', 'library', 'research_institute') THEN 'education'
 WHEN k = 'natural' OR k = 'landuse' AND v IN ('forest', 'meadow', 'farmland', 'grass', 'heath', 'orchard', 'vineyard', 'scrub') THEN 'nature_green' WHEN k = 'leisure' THEN 'leisure' WHEN k IN ('waterway', 'water') THEN 'water'
 WHEN k = 'tourism' THEN 'tourism' WHEN k = 'building' THEN 'built_environment' WHEN k = 'amenity' AND v IN ('hospital', 'clinic', 'doctors', 'pharmacy', 'dentist', 'nursing_home', 'veterinary') THEN 'health' END"""
_BEAR = "atan2(sin(radians(flon - llon)) * cos(radians(flat)), cos(radians(llat)) * sin(radians(flat)) - sin(radians(llat)) * cos(radians(flat)) * cos(radians(flon - llon)))"
SQL: dict[str, str] = {
    # expressions
    "mercator_xy": f"SELECT feature_id, round(x, 3) AS x, round(y, 3) AS y FROM (SELECT feature_id, {MERC.format(p='', q='')} FROM feat)",
    "bbox_degrees": "SELECT loc_id, round(lat - degrees(500.0D / 6371009.0D), 9) AS south, round(lat + degrees(500.0D / 6371009.0D), 9) AS north, round(lon - degrees(500.0D / 6371009.0D) / cos(radians(lat)), 9) AS west, round(lon + degrees(500.0D / 6371009.0D) / cos(radians(lat)), 9) AS east FROM loc",
    "bearing_sector": _JOINED + f" SELECT loc_id, feature_id, round(degrees({_BEAR}) + 360.0D - 360.0D * floor((degrees({_BEAR}) + 360.0D) / 360.0D), 6) AS bearing FROM pairs WHERE d > 0.0D",
    "distance_decay": _JOINED + " SELECT loc_id, feature_id, round(exp(-3.0D * d / greatest(200000.0D, 1.0D)), 9) AS weight FROM pairs",
    "jitter_wrap": "SELECT loc_id, greatest(-89.9D, least(89.9D, lat + 0.1D * ({u:concat('a', cast(loc_id AS varchar(20)))} - 0.5D))) AS lat2, lon + 200.0D + 180.0D - 360.0D * floor((lon + 380.0D) / 360.0D) - 180.0D AS lon2 FROM loc",
    "density_bucket": "SELECT feature_id, CASE WHEN x < 0.2D THEN 'very_low' WHEN x < 0.4D THEN 'low' WHEN x < 0.65D THEN 'medium' ELSE 'high' END AS bucket FROM (SELECT feature_id, {u:cast(feature_id AS varchar(20))} AS x FROM feat)",
    "missing_values": "SELECT k, count(*) AS rows_all, count(CASE WHEN trim(v) <> '' AND lower(trim(v)) NOT IN ('nan', 'none') THEN 1 END) AS present FROM kv GROUP BY k",
    "feature_labels": """SELECT feature_id, CASE WHEN label = '' THEN 'unknown:unknown' ELSE label END AS label FROM (SELECT feature_id, concat_ws(';', CASE WHEN amenity IS NOT NULL THEN concat('amenity:', amenity) END, CASE WHEN building IN ('yes', 'true', '1') THEN 'building' END, CASE WHEN highway IS NOT NULL THEN concat('highway:', highway) END, CASE WHEN shop IS NOT NULL THEN concat('shop:', shop) END) AS label FROM feat)""",
    "pixel_affine": "SELECT box_id, xmin * 0.5D + 10.0D AS px, 300.0D - ymin * 0.5D AS py FROM box",
    "normalised_coords": "SELECT box_id, round((xmin - w) / greatest(e - w, 0.00000001D), 9) AS nx, round(1.0D - (ymin - s) / greatest(n - s, 0.00000001D), 9) AS ny FROM box JOIN (SELECT min(xmin) AS w, max(xmax) AS e, min(ymin) AS s, max(ymax) AS n FROM box) b ON 1 = 1",
    "box_measures": "SELECT box_id, (xmax - xmin) * (ymax - ymin) AS area, 2.0D * (xmax - xmin + ymax - ymin) AS perimeter, (xmin + xmax) / 2.0D AS cx, (ymin + ymax) / 2.0D AS cy FROM box",
    "clip_to_box": "SELECT box_id, greatest(xmin, 100.0D) AS xmin, greatest(ymin, 50.0D) AS ymin, least(xmax, 200.0D) AS xmax, least(ymax, 150.0D) AS ymax FROM box WHERE xmin <= 200.0D AND xmax >= 100.0D AND ymin <= 150.0D AND ymax >= 50.0D",
    "city_grid": "SELECT i AS iy, j AS ix, round(52.3D + i * 0.05D, 6) AS lat, round(13.0D + j * 0.08D, 6) AS lon FROM (SELECT i, {seq:0;8} AS j FROM (SELECT {seq:0;7} AS i FROM region WHERE r_regionkey = 0) a) b",
    "equal_area_cells": "SELECT feature_id, cast(least(floor((lon + 180.0D) / 360.0D * 288.0D), 287.0D) AS int) AS ix, cast(least(floor((sin(radians(lat)) + 1.0D) / 2.0D * 144.0D), 143.0D) AS int) AS iy FROM feat",
    "cell_parents": "SELECT cast(floor(ix / 7.0D) AS int) AS px, cast(floor(iy / 7.0D) AS int) AS py, count(*) AS n FROM (SELECT floor((lon + 180.0D) / 360.0D * 2016.0D) AS ix, floor((sin(radians(lat)) + 1.0D) / 2.0D * 1008.0D) AS iy FROM feat) GROUP BY cast(floor(ix / 7.0D) AS int), cast(floor(iy / 7.0D) AS int)",
    # encodings
    "encode_direct": "SELECT loc_id, round(radians(lon) - pi(), 9) + 0.0D AS a, round(radians(lat) - pi(), 9) + 0.0D AS b FROM loc",
    "encode_cartesian": "SELECT loc_id, round(cos(radians(lon)) * cos(radians(lat)), 9) + 0.0D AS x, round(sin(radians(lon)) * cos(radians(lat)), 9) + 0.0D AS y, round(sin(radians(lat)), 9) + 0.0D AS z FROM loc",
    "encode_wrap": "SELECT loc_id, round(cos(radians(lon)), 9) + 0.0D AS a, round(sin(radians(lon)), 9) + 0.0D AS b, round(cos(radians(lat)), 9) + 0.0D AS c, round(sin(radians(lat)), 9) + 0.0D AS d FROM loc",
    # richness
    "tag_counts": "SELECT k, CASE WHEN lower(v) IN ('true', 'yes', '1') THEN 'yes' ELSE v END AS v, count(*) AS n FROM kv GROUP BY k, CASE WHEN lower(v) IN ('true', 'yes', '1') THEN 'yes' ELSE v END",
    "tag_distinct": _KVN + " SELECT cell, count(DISTINCT k) AS n_keys, count(*) AS n_pairs, cast(sum(n) AS bigint) AS n_instances FROM c GROUP BY cell",
    "tag_entropy": _KVN + " SELECT cell, CASE WHEN count(*) <= 1 THEN 0.0D ELSE round(-sum(n / t * ln(n / t + 0.000000000001D)), 9) END AS entropy FROM (SELECT c.cell, n * 1.0D AS n, t FROM c JOIN (SELECT cell, sum(n) * 1.0D AS t FROM c GROUP BY cell) s ON c.cell = s.cell) x GROUP BY cell",
    "mean_idf": _KVN + ", f AS (SELECT k, sum(n) * 1.0D AS freq FROM c GROUP BY k), m AS (SELECT max(freq) AS top FROM f) SELECT cell, round(sum(ln(top / freq + 1.0D)) / greatest(count(*), 1), 9) AS idf FROM (SELECT DISTINCT cell, k FROM c) d JOIN f ON d.k = f.k JOIN m ON 1 = 1 GROUP BY cell",
    "category_coverage": f"SELECT cell, count(DISTINCT category) / 10.0D AS coverage FROM (SELECT cast(floor(lat / 10.0D) AS int) AS cell, {_CATEGORY} AS category FROM kv) GROUP BY cell",
    "geometry_entropy": "SELECT cell, round(CASE WHEN count(*) <= 1 THEN 0.0D ELSE -sum(p * ln(p)) END, 9) AS entropy FROM (SELECT cell, n / sum(n) OVER (PARTITION BY cell) AS p FROM (SELECT cast(floor(lat / 10.0D) AS int) AS cell, geom_type, count(*) * 1.0D AS n FROM feat GROUP BY cast(floor(lat / 10.0D) AS int), geom_type) a) b GROUP BY cell",
    "density_raster": "SELECT cast(floor(lat) AS int) AS lat_bin, cast(floor(lon) AS int) AS lon_bin, count(*) AS cnt FROM feat WHERE geom_type = 'point' GROUP BY cast(floor(lat) AS int), cast(floor(lon) AS int) HAVING count(*) >= 1",
    "unique_labels": "SELECT count(DISTINCT concat(k, ':', v)) AS n FROM kv WHERE concat(k, ':', v) <> 'unknown:unknown'",
    "semantic_depth": "SELECT round(count(*) * 1.0D / max(n), 9) AS depth FROM kv JOIN (SELECT count(*) AS n FROM feat) f ON 1 = 1",
    "feature_density": _JOINED + " SELECT l.loc_id, round(coalesce(n, 0) / ((2.0D * 200000.0D / 1000.0D) * (2.0D * 200000.0D / 1000.0D)), 9) AS density FROM loc l LEFT JOIN (SELECT loc_id, count(*) AS n FROM pairs GROUP BY loc_id) c ON l.loc_id = c.loc_id",
    # bands
    "total_bounds": "SELECT coalesce(min(xmin), 1.0D) AS west, coalesce(max(xmax), 0.0D) AS east, coalesce(min(ymin), 1.0D) AS south, coalesce(max(ymax), 0.0D) AS north FROM box",
    # joins, sets, windows, sampling
    "semi_density": "SELECT loc_id FROM loc WHERE EXISTS (SELECT 1 FROM feat WHERE cast(floor(feat.lat) AS int) = cast(floor(loc.lat) AS int) AND cast(floor(feat.lon) AS int) = cast(floor(loc.lon) AS int))",
    "cache_anti_join": "SELECT loc_id, 'new' AS state FROM loc l WHERE NOT EXISTS (SELECT 1 FROM loc c WHERE c.loc_id % 3 = 0 AND round(c.lat, 6) = round(l.lat, 6) AND round(c.lon, 6) = round(l.lon, 6)) UNION ALL SELECT loc_id, 'cached' FROM loc WHERE loc_id % 3 = 0",
    "multi_radius": _JOINED + " SELECT loc_id, r, count(*) AS n FROM pairs JOIN (SELECT 50000.0D AS r UNION ALL SELECT 100000.0D UNION ALL SELECT 200000.0D) q ON d <= r GROUP BY loc_id, r",
    "relation_one_hot": _PAIRS + " SELECT src, dst, CASE WHEN rel = 2 THEN 1.0D ELSE 0.0D END AS touches, CASE WHEN rel = 3 THEN 1.0D ELSE 0.0D END AS overlaps, CASE WHEN rel = 4 THEN 1.0D ELSE 0.0D END AS covered, CASE WHEN rel = 5 THEN 1.0D ELSE 0.0D END AS covers FROM r WHERE rel NOT IN (1, 7)",
    "graph_self_edges": "SELECT box_id AS src, box_id AS dst, 0 AS rel FROM box",
    "finest_level": "SELECT loc_id % 50 AS g, min_by(loc_id, k) AS first_id, min_by(score, k) FILTER (WHERE score IS NOT NULL) AS score, count(*) AS levels FROM (SELECT loc_id, CASE WHEN loc_id % 3 > 0 THEN lat END AS score, row_number() OVER (PARTITION BY loc_id % 50 ORDER BY lon, loc_id) AS k FROM loc) a GROUP BY loc_id % 50",
    "weighted_sample": "SELECT feature_id FROM (SELECT feature_id, ln({u:concat('w', cast(feature_id AS varchar(20)))} + 0.0000000001D) / (0.5D + feature_id % 10) AS w FROM feat) a ORDER BY w DESC, feature_id LIMIT 100",
    "bucket_quotas": "SELECT bucket, cast(base + CASE WHEN k <= 97 - sum(base) OVER () THEN 1 ELSE 0 END AS bigint) AS quota FROM (SELECT bucket, floor(97 * f) AS base, row_number() OVER (ORDER BY 97 * f - floor(97 * f) DESC, o) AS k FROM (SELECT 'very_low' AS bucket, 0.02D AS f, 0 AS o UNION ALL SELECT 'low', 0.12D, 1 UNION ALL SELECT 'medium', 0.77D, 2 UNION ALL SELECT 'high', 0.09D, 3) a) b",
    "insert_or_ignore": "SELECT k, loc_id FROM (SELECT loc_id % 40 AS k, loc_id, row_number() OVER (PARTITION BY loc_id % 40 ORDER BY loc_id) AS n FROM loc) a WHERE n = 1 AND k NOT IN (SELECT r_regionkey FROM region)",
    "resume_pending": "SELECT loc_id FROM loc EXCEPT SELECT loc_id FROM loc WHERE loc_id % 4 = 0 EXCEPT SELECT loc_id FROM loc WHERE loc_id % 9 = 1",
    "prefix_union": "SELECT concat('osm_', cast(loc_id AS varchar(20))) AS prefix FROM loc WHERE loc_id % 2 = 0 UNION SELECT concat('osm_', cast(loc_id AS varchar(20))) FROM loc WHERE loc_id % 3 = 0",
    "nodata_ttl": "SELECT event_type, count(*) AS expired FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL '24' HOUR GROUP BY event_type",
    "distinct_edges": _PAIRS + " SELECT DISTINCT src % 50 AS s, dst % 50 AS t FROM r",
    "same_location_pairs": "SELECT a.loc_id AS i, b.loc_id AS j FROM loc a JOIN loc b ON cast(a.lat AS float) = cast(b.lat AS float) AND cast(a.lon AS float) = cast(b.lon AS float)",
    "zero_filled_bands": _JOINED + " SELECT l.loc_id, coalesce(n, 0) AS n, n IS NULL AS is_zero FROM loc l LEFT JOIN (SELECT loc_id, count(*) AS n FROM pairs WHERE d < 40000.0D GROUP BY loc_id) p ON l.loc_id = p.loc_id",
}


def _plain(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text in Spark, its range joins by tiles; DuckDB runs them as they are written."""
    return spark.sql(spark_sql(sql.replace(_JOINED, _TILED).replace(_PAIRS, _TILED_PAIRS), sf_dir))


def _per_pair(value: str, name: str, digits: int, where: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pair, value rounded to digits (not below zero) by floor: round goes by way of decimal text, which costs more than the rest of the row.

    The join is named: the planner sees no growth in tiles and would broadcast a location once for each that it covers.
    """
    pairs, scale = _TILED.replace("pairs AS (SELECT ", "pairs AS (SELECT /*+ MERGE(f, l) */ "), f"{10**digits}.0D"
    return spark.sql(spark_sql(f"{pairs} SELECT loc_id, feature_id, floor(({value}) * {scale} + 0.5D) / {scale} AS {name} FROM pairs WHERE {where}", sf_dir))


_DEGREES = f"degrees({_BEAR}) + 360.0D - 360.0D * floor((degrees({_BEAR}) + 360.0D) / 360.0D)"
#: Spark's side of texts above that another program answers
PROGRAMS: dict[str, Query] = {
    "relation_one_hot": relation_one_hot, "feature_density": feature_density, "multi_radius": multi_radius,
    "bearing_sector": partial(_per_pair, _DEGREES, "bearing", 6, "d > 0.0D"),
    "distance_decay": partial(_per_pair, "exp(-3.0D * d / greatest(200000.0D, 1.0D))", "weight", 9, "true"),
}


def queries() -> dict[str, Query]:
    return {n: q for n, (q, _) in (FRAMES | measures.FRAMES).items()} | {n: partial(_plain, s) for n, s in SQL.items()} | PROGRAMS


def oracles() -> dict[str, str]:
    return {n: duck_sql(s) for n, (_, s) in (FRAMES | measures.FRAMES).items()} | {n: duck_sql(s) for n, s in SQL.items()}
