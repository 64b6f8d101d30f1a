"""Queries whose Spark side is a DataFrame program and whose SQL twin is written apart, from rule tables and plain joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.functions import encodings, tags
from terraloom.operators import bands, richness, scoring, similarity
from terraloom.sources.views import TAGS, view

Query = Callable[[SparkSession, str], DataFrame]
SIZES = (50_000.0, 100_000.0, 200_000.0)
RADII = (50_000.0, 200_000.0)


def _views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(n, 3 if n.startswith("dist_") else digits) + 0.0).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "feat").select("feature_id", tags.description(list(TAGS)).alias("description"))


def first_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "feat").select("feature_id", tags.category(list(TAGS)).alias("category"))


def road_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "feat").where("highway IS NOT NULL").select("feature_id", tags.road_class(F.col("highway")).alias("class"))


def landuse_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "feat").where("geom_type = 'polygon'").select("feature_id", tags.landuse_class(list(TAGS)).alias("class"))


def _metrics(spark: SparkSession, sf_dir: str, labels: bool = True, wide: bool = False) -> DataFrame:
    feat, loc, kv = _views(spark, sf_dir, "feat", "loc", "kv")
    return richness.level_metrics(feat, loc, kv.groupBy("k").agg(F.count("*").cast("double").alias("freq")), SIZES, labels=labels, wide=wide)


def richness_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_metrics(spark, sf_dir).withColumnRenamed("size", "bbox_size"))


def level_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(richness.selected_level(_metrics(spark, sf_dir, labels=False, wide=True)))


def adaptive_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return richness.first_rich(_metrics(spark, sf_dir, wide=True))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations with their box size, the richness measured there, bucket and cell; those without features are left out."""
    cell = F.concat_ws("_", F.floor(F.col("lat") / 10).cast("int").cast("string"), F.floor(F.col("lon") / 10).cast("int").cast("string"))
    metrics = _metrics(spark, sf_dir, wide=True)
    place = tuple(c for c in ("lat", "lon") if c in metrics.columns)  # none where a loc_id is there more than once
    found = richness.first_rich(metrics, keep=("richness_score",), carry=place).where("level IS NOT NULL")
    if not place:
        found = found.join(view(spark, sf_dir, "loc"), "loc_id")
    found = found.select("loc_id", "size", F.round("richness_score", 9).alias("richness"), cell.alias("cell"))
    return found.withColumn("bucket", scoring.bucket(F.col("richness")))


def select_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.diverse(_accepted(spark, sf_dir), 120, 1, 42, 0.5))


def first_level_with_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return richness.levels_with_data(richness.level_counts(*_views(spark, sf_dir, "feat", "loc"), SIZES))


def take_while_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return richness.levels_within(richness.level_counts(*_views(spark, sf_dir, "feat", "loc"), SIZES), 20)


def _bands(spark: SparkSession, sf_dir: str, by: str | None, bins: int) -> DataFrame:
    feat, loc = _views(spark, sf_dir, "feat", "loc")
    return bands.rolled(bands.measured(feat, loc, RADII), loc, RADII, by, bins)


def band_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(bands.whole(_bands(spark, sf_dir, None, 1)), 9)


def band_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(bands.binned(bands.summed_in_bins(*_views(spark, sf_dir, "feat", "loc"), RADII, "ring"), "ring"), 9)


def band_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(bands.binned(bands.summed_in_bins(*_views(spark, sf_dir, "feat", "loc"), RADII, "sector"), "sector"), 9)


def spatial_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied share of a 4 x 4 grid by bands of 10 degrees: extents are a row for each band, and broadcast."""
    feat = view(spark, sf_dir, "feat").select(F.floor(F.col("lat") / 10).cast("int").alias("cell"), "lat", "lon")
    extent = feat.groupBy("cell").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))  # 18 rows at most
    bin_ = lambda at, low, high: F.greatest(F.lit(0), F.least(F.lit(3), F.ceil((F.col(at) - F.col(low)) / ((F.col(high) - F.col(low)) / 4.0)).cast("int") - 1))
    rows = feat.join(F.broadcast(extent), "cell").where("e - w >= 0.000000001D AND n - s >= 0.000000001D")
    return rows.select("cell", (bin_("lon", "w", "e") * 4 + bin_("lat", "s", "n")).alias("g")).distinct().groupBy("cell").agg((F.count("*") / 16.0).alias("coverage"))


def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 features of each geometry type; one row more tells of an overflow, so no task sees a whole type."""
    own = Window.partitionBy("geom_type")
    first = view(spark, sf_dir, "feat").select("geom_type", "feature_id").withColumn("k", F.row_number().over(own.orderBy("feature_id"))).where("k <= 101")
    return first.withColumn("overflow", F.max("k").over(own) > 100).where("k <= 100").select("geom_type", "feature_id", "overflow")


def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding IS NOT NULL AND label IS NOT NULL")
    return _rounded(similarity.contrastive_loss(rows.select("label", "vec_id", "embedding"), batch=32))


def _encoded(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of every location, with four frequencies or degrees."""
    value = encodings.encoding(name, F.col("lat"), F.col("lon"), count=4, degrees=4)
    rows = view(spark, sf_dir, "loc").select("loc_id", F.posexplode(value).alias("i", "value"))
    return rows.select("loc_id", "i", (F.round("value", 6) + 0.0).alias("value"))


# SQL twins ------------------------------------------------------------------------------------------------------
def _values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_CATEGORY_RULES = _values([(k, v, name, i) for i, (name, rules) in enumerate(tags.CATEGORIES.items()) for k, allowed in rules for v in (allowed or (None,))])
_LANDUSE_RULES = _values([(k, v, name, i) for i, (k, name, allowed) in enumerate(tags.LANDUSE) for v in (allowed or (None,))])
_ROAD_RULES = _values([(v, name) for name, values in tags.ROADS.items() for v in values])
_TEMPLATES = _values([(k, t, i) for i, (k, t) in enumerate(tags.TEMPLATES.items())])
_LIVE = "live AS (SELECT * FROM kv WHERE trim(v) <> '' AND lower(trim(v)) NOT IN ('nan', 'none'))"
_CATEGORY = f"cat AS (SELECT feature_id, arg_min(category, prio) AS category FROM live JOIN (VALUES {_CATEGORY_RULES}) r(rk, rv, category, prio) ON k = rk AND (rv IS NULL OR trim(v) = rv) GROUP BY feature_id)"
_LANDUSE = f"lu AS (SELECT feature_id, arg_min(class, prio) AS class FROM live JOIN (VALUES {_LANDUSE_RULES}) r(rk, rv, class, prio) ON k = rk AND (rv IS NULL OR lower(trim(v)) = rv) WHERE geom_type = 'polygon' GROUP BY feature_id)"
_ROAD = f"road AS (SELECT feature_id, class FROM feat LEFT JOIN (VALUES {_ROAD_RULES}) r(rv, class) ON lower(trim(highway)) = rv WHERE highway IS NOT NULL)"
_XY = "radians({p}lon) * 6378137.0D AS {q}x, ln(tan(0.7853981633974483D + radians({p}lat) / 2.0D)) * 6378137.0D AS {q}y"
_NEAR = f"""fm AS (SELECT *, {_XY.format(p='', q='p')} FROM feat), lm AS (SELECT loc_id, lat AS llat, lon AS llon, {_XY.format(p='', q='c')} FROM loc),
 near AS (SELECT * FROM fm JOIN lm ON px BETWEEN cx - 200000.0D AND cx + 200000.0D AND py BETWEEN cy - 200000.0D AND cy + 200000.0D)"""
_SIZES = "(VALUES (1, 50000.0D), (2, 100000.0D), (3, 200000.0D)) z(level, size)"
_YES = "CASE WHEN lower({v}) IN ('true', 'yes', '1') THEN 'yes' ELSE {v} END"
_QUOTED = {t: f'"{t}"' for t in TAGS}
_LABEL = "concat_ws(';', " + ", ".join(f"CASE WHEN lower({q}) IN ('true', 'yes', '1') THEN '{t}' ELSE '{t}:' || {q} END" for t, q in _QUOTED.items()) + ")"
_KEYS = "{p}loc_id, {p}level"
_METRICS = f"""WITH {_NEAR}, inside AS (SELECT loc_id, level, size, feature_id, geom_type, lat, lon, {_LABEL} AS label FROM near JOIN {_SIZES} ON greatest(abs(px - cx), abs(py - cy)) <= size),
 ext AS (SELECT loc_id, level, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM inside GROUP BY loc_id, level),
 occ AS (SELECT loc_id, level, count(*) / 16.0D AS spatial_coverage FROM (SELECT DISTINCT i.loc_id, i.level, greatest(0, least(3, ceil((lon - w) / ((e - w) / 4.0D)) - 1)) AS gx, greatest(0, least(3, ceil((lat - s) / ((n - s) / 4.0D)) - 1)) AS gy
  FROM inside i JOIN ext ON i.loc_id = ext.loc_id AND i.level = ext.level WHERE e - w >= 0.000000001D AND n - s >= 0.000000001D) GROUP BY loc_id, level),
 shape AS (SELECT loc_id, level, count(*) FILTER (WHERE geom_type = 'point') AS n_points, count(*) FILTER (WHERE geom_type = 'line') AS n_lines, count(*) FILTER (WHERE geom_type = 'polygon') AS n_polygons, cast(count(DISTINCT label) FILTER (WHERE label <> '') AS int) AS unique_labels FROM inside GROUP BY loc_id, level),
 pair AS (SELECT loc_id, level, k, {_YES.format(v='v')} AS v, count(*) * 1.0D AS n FROM inside JOIN kv USING (feature_id) GROUP BY loc_id, level, k, {_YES.format(v='v')}),
 freq AS (SELECT k, count(*) * 1.0D AS freq FROM kv GROUP BY k), idf AS (SELECT k, ln((SELECT max(freq) FROM freq) / freq + 1.0D) AS idf FROM freq),
 tot AS (SELECT loc_id, level, sum(n) AS t FROM pair GROUP BY loc_id, level),
 ent AS (SELECT p.loc_id, p.level, cast(count(*) AS int) AS unique_kv_pairs, cast(max(t) AS bigint) AS total_kv_instances, CASE WHEN count(*) <= 1 THEN 0.0D ELSE -sum(n / t * ln(n / t + 0.000000000001D)) END AS tag_entropy FROM pair p JOIN tot ON p.loc_id = tot.loc_id AND p.level = tot.level GROUP BY p.loc_id, p.level),
 keyed AS (SELECT loc_id, level, cast(count(*) AS int) AS unique_keys, avg(idf) AS idf_score FROM (SELECT DISTINCT loc_id, level, k FROM pair) JOIN idf USING (k) GROUP BY loc_id, level),
 cov AS (SELECT loc_id, level, count(DISTINCT category) / 10.0D AS category_coverage FROM pair JOIN (VALUES {_CATEGORY_RULES}) r(rk, rv, category, prio) ON k = rk AND (rv IS NULL OR v = rv) GROUP BY loc_id, level),
 joined AS (SELECT l.loc_id, l.level, l.size, coalesce(n_points, 0) AS n_points, coalesce(n_lines, 0) AS n_lines, coalesce(n_polygons, 0) AS n_polygons, coalesce(unique_labels, 0) AS unique_labels, coalesce(spatial_coverage, 0.0D) AS spatial_coverage, coalesce(unique_kv_pairs, 0) AS unique_kv_pairs, coalesce(unique_keys, 0) AS unique_keys,
   coalesce(total_kv_instances, 0) AS total_kv_instances, coalesce(category_coverage, 0.0D) AS category_coverage, coalesce(tag_entropy, 0.0D) AS tag_entropy, coalesce(idf_score, 0.0D) AS idf_score, coalesce(n_points + n_lines + n_polygons, 0) AS total_nodes
  FROM (SELECT loc_id, level, size FROM loc, {_SIZES}) l LEFT JOIN shape ON l.loc_id = shape.loc_id AND l.level = shape.level LEFT JOIN occ ON l.loc_id = occ.loc_id AND l.level = occ.level LEFT JOIN ent ON l.loc_id = ent.loc_id AND l.level = ent.level LEFT JOIN keyed ON l.loc_id = keyed.loc_id AND l.level = keyed.level LEFT JOIN cov ON l.loc_id = cov.loc_id AND l.level = cov.level),
 m0 AS (SELECT *, coalesce((SELECT -sum(c * 1.0D / total_nodes * ln(c * 1.0D / total_nodes)) FROM (SELECT unnest([n_points, n_lines, n_polygons]) AS c) u WHERE c > 0), 0.0D) + 0.0D AS geometry_entropy, total_nodes / power(2.0D * size / 1000.0D, 2) AS feature_density, CASE WHEN total_nodes > 0 THEN total_kv_instances * 1.0D / total_nodes ELSE 0.0D END AS semantic_depth FROM joined),
 m AS (SELECT *, least(1.0D, 0.3D * least(tag_entropy / ln(50.0D), 1.0D) + 0.25D * category_coverage + 0.15D * least(unique_kv_pairs / 30.0D, 1.0D) + 0.1D * least(geometry_entropy / ln(3.0D), 1.0D) + 0.1D * spatial_coverage + 0.05D * least(semantic_depth / 8.0D, 1.0D) + 0.05D * least(idf_score / 4.0D, 1.0D)) AS richness_score FROM m0)"""
_MEASURES = ("category_coverage", "feature_density", "geometry_entropy", "idf_score", "richness_score", "semantic_depth", "spatial_coverage", "tag_entropy")
_SPREAD = "CASE WHEN max({x}) OVER w = min({x}) OVER w THEN 1.0D ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END"
_BEAR = "degrees(atan2(sin(radians(lon - llon)) * cos(radians(lat)), cos(radians(llat)) * sin(radians(lat)) - sin(radians(llat)) * cos(radians(lat)) * cos(radians(lon - llon))))"
_BANDS = f"""WITH {_LIVE}, {_CATEGORY}, {_LANDUSE}, {_ROAD}, {_NEAR}, f AS (SELECT n.*, category, lu.class AS luc, road.class AS rc, sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) AS d, {_BEAR} AS b
  FROM near n LEFT JOIN cat ON n.feature_id = cat.feature_id LEFT JOIN lu ON n.feature_id = lu.feature_id LEFT JOIN road ON n.feature_id = road.feature_id AND n.geom_type = 'line'),
 p AS (SELECT *, CASE WHEN d < r / 2.0D THEN 0 ELSE 1 END AS ring, cast(floor(((b + 405.0D) - 360.0D * floor((b + 405.0D) / 360.0D)) / 90.0D) AS int) AS sector FROM f JOIN (VALUES (50000.0D), (200000.0D)) q(r) ON d <= r)"""


def _band_sql(by: str | None, bins: int, share: str, columns: list[str]) -> str:
    key = f", {by}" if by else ""
    places = f"(SELECT loc_id, r{key} FROM loc, (VALUES (50000.0D), (200000.0D)) q(r){f', (SELECT unnest(range({bins})) AS {by})' if by else ''}) l"
    own = [f"count(*) AS n, sum(CASE WHEN geom_type = 'polygon' THEN area ELSE 0.0D END) AS area", *[f"count(*) FILTER (WHERE geom_type = '{k}') AS n_{k}" for k in ("point", "line", "polygon")]]
    own += [f"count(*) FILTER (WHERE category = '{k}') AS cat_{k}" for k in tags.CATEGORIES] + [f"sum(CASE WHEN luc = '{k}' THEN area ELSE 0.0D END) AS lu_{k}" for k in tags.LANDUSE_CLASSES]
    own += [f"sum(CASE WHEN rc = '{k}' THEN length ELSE 0.0D END) AS road_{k}" for k in tags.ROADS] + [f"min(d) FILTER (WHERE category = '{k}') AS dmin_{k}, avg(d) FILTER (WHERE category = '{k}') AS dmean_{k}" for k in tags.DISTANCES]
    on = " AND ".join(f"l.{c} = a.{c}" for c in ("loc_id", "r", *([by] if by else [])))
    picked = ", ".join(f"round({c.rsplit(' AS ', 1)[0]}, {3 if ' AS dist_' in c else 9}) + 0.0D AS {c.rsplit(' AS ', 1)[1]}" for c in columns).replace("{km2}", f"(pi() * l.r * l.r * {share} / 1000000.0D)")
    return f"{_BANDS}, a AS (SELECT loc_id, r{key}, {', '.join(own)} FROM p GROUP BY loc_id, r{key}) SELECT l.loc_id, l.r{f', cast(l.{by} AS int) AS {by}' if by else ''}, {picked} FROM {places} LEFT JOIN a ON {on}"


_CAT_DENSITY = [f"coalesce(cat_{k}, 0) / {{km2}} AS cat_{k}_density" for k in tags.CATEGORIES]
_LU_FRAC = [f"CASE WHEN coalesce(area, 0.0D) < 1.0D THEN 0.0D ELSE lu_{k} / area END AS lu_{k}_frac" for k in tags.LANDUSE_CLASSES]
_WHOLE = [f"coalesce({n}, 0) / {{km2}} AS {k}_density" for k, n in (("total", "n"), ("point", "n_point"), ("line", "n_line"), ("polygon", "n_polygon"))]
_WHOLE += _CAT_DENSITY + [f"coalesce(cat_{k}, 0) * 1.0D / greatest(coalesce(n, 0), 1) AS cat_{k}_frac" for k in tags.CATEGORIES] + _LU_FRAC
_WHOLE += [f"coalesce(road_{k}, 0.0D) / 1000.0D / {{km2}} AS road_{k}_density" for k in tags.ROADS]
_WHOLE += ["coalesce((" + " + ".join(f"road_{k}" for k in tags.MAJOR) + ") / greatest(" + " + ".join(f"road_{k}" for k in tags.ROADS) + ", 0.001D), 0.0D) AS road_major_ratio"]
_WHOLE += [f"coalesce(d{m}_{k}, l.r) AS dist_{m}_{k}_m" for m in ("min", "mean") for k in tags.DISTANCES]

_WAVES = "w AS (SELECT k, 1.0D / exp(k * ln(360.0D) / 3.0D) AS f FROM (VALUES (0), (1), (2), (3)) q(k))"
_ANGLES = f"WITH {_WAVES}, a AS (SELECT loc_id, k, lat, lon, radians(lat) * f AS p, radians(lon) * f AS l, f FROM loc, w)"
_MIXED = {"": ["cos(p) * cos(l)", "cos(p) * sin(l)"], "m": ["cos(p) * cos(lon)", "cos(lat) * cos(l)", "cos(p) * sin(lon)", "cos(lat) * sin(l)"]}
_SPHERES = {f"sphere{kind}{plus}": [*(["sin(p)", "cos(p)", "sin(l)", "cos(l)"] if plus else ["sin(p)"]), *_MIXED[kind.strip("c")]] for kind in ("c", "m") for plus in ("", "plus")}


def _sphere_sql(terms: list[str]) -> str:
    values = " UNION ALL ".join(f"SELECT loc_id, k, {t} AS t, {sql} AS v FROM a" for t, sql in enumerate(terms))
    return f"{_ANGLES} SELECT loc_id, cast({2 * len(terms)} * k + 2 * t + twin AS int) AS i, round(v, 6) + 0.0D AS value FROM ({values}) b, (VALUES (0), (1)) d(twin)"


# the real harmonics below degree 4 as polynomials of the unit vector (x, y, z), with the square root's constant apart
_HARMONICS = ["1 / 4", "3 / 4 @ -y", "3 / 4 @ z", "3 / 4 @ -x", "15 / 4 @ x * y", "15 / 4 @ -y * z", "5 / 16 @ 3 * z * z - 1", "15 / 4 @ -x * z", "15 / 16 @ x * x - y * y",
              "35 / 32 @ -y * (3 * x * x - y * y)", "105 / 4 @ x * y * z", "21 / 32 @ -y * (5 * z * z - 1)", "7 / 16 @ z * (5 * z * z - 3)", "21 / 32 @ -x * (5 * z * z - 1)", "105 / 16 @ z * (x * x - y * y)", "35 / 32 @ -x * (x * x - 3 * y * y)"]
_HARMONIC_SQL = " UNION ALL ".join(f"SELECT loc_id, {i} AS i, round(sqrt({c} / pi()) * ({body or 1}), 6) + 0.0D AS value FROM v" for i, (c, _, body) in enumerate(h.partition(" @ ") for h in _HARMONICS))

FRAMES: dict[str, tuple[Query, str]] = {
    **{f"encode_{n}": (partial(_encoded, n), _sphere_sql(terms)) for n, terms in _SPHERES.items()},
    "encode_grid": (partial(_encoded, "grid"), f"WITH {_WAVES}, a AS (SELECT loc_id, k, f, c, CASE c WHEN 0 THEN lon ELSE lat END AS x FROM loc, w, (VALUES (0), (1)) q(c)) SELECT loc_id, cast(8 * c + 2 * k AS int) AS i, round(sin(x * f), 6) + 0.0D AS value FROM a UNION ALL SELECT loc_id, cast(8 * c + 2 * k + 1 AS int), round(cos(x * f), 6) + 0.0D FROM a"),
    "encode_theory": (partial(_encoded, "theory"), f"WITH {_WAVES}, a AS (SELECT loc_id, k, d, f * (cos(radians(120.0D * d)) * lon + sin(radians(120.0D * d)) * lat) AS x FROM loc, w, (VALUES (0), (1), (2)) q(d)) SELECT loc_id, cast(6 * k + 2 * d AS int) AS i, round(sin(x), 6) + 0.0D AS value FROM a UNION ALL SELECT loc_id, cast(6 * k + 2 * d + 1 AS int), round(cos(x), 6) + 0.0D FROM a"),
    "encode_harmonics": (partial(_encoded, "sphericalharmonics"), f"WITH v AS (SELECT loc_id, sin(radians(lat + 90.0D)) * cos(radians(lon + 180.0D)) AS x, sin(radians(lat + 90.0D)) * sin(radians(lon + 180.0D)) AS y, cos(radians(lat + 90.0D)) AS z FROM loc) {_HARMONIC_SQL}"),
    "descriptions": (descriptions, f"WITH {_LIVE} SELECT feature_id, coalesce(arg_min(replace(t, '{{value}}', replace(lower(trim(v)), '_', ' ')), prio), 'an unclassified feature') AS description FROM feat LEFT JOIN live USING (feature_id) LEFT JOIN (VALUES {_TEMPLATES}) r(rk, t, prio) ON k = rk GROUP BY feature_id"),
    "first_category": (first_category, f"WITH {_LIVE}, {_CATEGORY} SELECT feature_id, category FROM feat LEFT JOIN cat USING (feature_id)"),
    "road_class": (road_class, f"WITH {_ROAD} SELECT feature_id, class FROM road"),
    "landuse_class": (landuse_class, f"WITH {_LIVE}, {_LANDUSE} SELECT feature_id, class FROM feat LEFT JOIN lu USING (feature_id) WHERE geom_type = 'polygon'"),
    "richness_bundle": (richness_bundle, f"{_METRICS} SELECT loc_id, level, size AS bbox_size, n_points, n_lines, n_polygons, total_nodes, unique_labels, unique_kv_pairs, unique_keys, total_kv_instances, {', '.join(f'round({c}, 6) + 0.0D AS {c}' for c in _MEASURES)} FROM m"),
    "level_selection": (level_selection, f"""{_METRICS}, s AS (SELECT *, richness_score + 0.1D * category_coverage + 0.2D * {_SPREAD.format(x='semantic_depth')} - 0.1D * {_SPREAD.format(x='ln(size)')} - 0.5D * {_SPREAD.format(x='ln(greatest(total_nodes, 1) * 1.0D)')} - CASE WHEN total_nodes < 10 THEN 2.0D ELSE 0.0D END AS score FROM m WINDOW w AS (PARTITION BY loc_id))
 SELECT loc_id, level, round(score, 6) + 0.0D AS score FROM (SELECT *, row_number() OVER (PARTITION BY loc_id ORDER BY round(score, 9) DESC, level) AS k FROM s) WHERE k = 1"""),
    "adaptive_expansion": (adaptive_expansion, f"""{_METRICS}, rich AS (SELECT loc_id, min(level) AS level FROM m WHERE total_nodes >= 5 AND unique_labels >= 3 AND round(richness_score, 9) >= 0.2D GROUP BY loc_id)
 SELECT m.loc_id, CASE WHEN rich.level IS NOT NULL THEN rich.level WHEN total_nodes > 0 THEN 3 END AS level, CASE WHEN rich.level IS NOT NULL THEN [50000.0D, 100000.0D, 200000.0D][rich.level] WHEN total_nodes > 0 THEN 200000.0D END AS size, CASE WHEN rich.level IS NOT NULL THEN 'rich' WHEN total_nodes > 0 THEN 'ceiling' ELSE 'none' END AS accepted FROM m LEFT JOIN rich USING (loc_id) WHERE m.level = 3"""),
    "select_weighted": (select_weighted, f"""{_METRICS}, rich AS (SELECT loc_id, min(level) AS level FROM m WHERE total_nodes >= 5 AND unique_labels >= 3 AND round(richness_score, 9) >= 0.2D GROUP BY loc_id),
 acc AS (SELECT m.loc_id, size, round(richness_score, 9) AS richness FROM m LEFT JOIN rich ON m.loc_id = rich.loc_id WHERE m.level = coalesce(rich.level, 3) AND (rich.level IS NOT NULL OR total_nodes > 0)),
 b AS (SELECT acc.*, md5(concat('42:', cast(acc.loc_id AS varchar))) AS h, concat(cast(cast(floor(lat / 10.0D) AS int) AS varchar), '_', cast(cast(floor(lon / 10.0D) AS int) AS varchar)) AS cell, CASE WHEN richness < 0.2D THEN 'very_low' WHEN richness < 0.4D THEN 'low' WHEN richness < 0.65D THEN 'medium' ELSE 'high' END AS bucket FROM acc JOIN loc ON acc.loc_id = loc.loc_id),
 c AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.bucket = b.bucket AND o.cell = b.cell AND o.h < b.h)),
 g AS (SELECT bucket, share, count(loc_id) AS n, min(size) AS low, max(size) AS high FROM (VALUES {_values(list(scoring.quotas(120).items()))}) q(bucket, share) LEFT JOIN c USING (bucket) GROUP BY bucket, share),
 t AS (SELECT 120 - sum(least(n, share)) AS lack, sum(n - share) FILTER (WHERE n > share) AS spare FROM g),
 k AS (SELECT g.*, least(n, share) + CASE WHEN n > share AND lack > 0 THEN least(n - share, round_even(lack * 1.0D * (n - share) / spare, 0)) ELSE 0 END AS quota FROM g, t),
 d AS (SELECT c.*, quota, row_number() OVER (PARTITION BY c.bucket ORDER BY ln(cast(cast(concat('0x', substr(h, 25, 8)) AS bigint) AS double) / 4294967296.0D + 0.0000000001D) / (0.5D * (CASE WHEN high > low THEN (size - low) / (high - low) ELSE 1.0D END) + 0.5D * richness + 0.00000001D) DESC, loc_id) AS pos FROM c JOIN k ON c.bucket = k.bucket)
 SELECT loc_id, bucket, cell, size, round(richness, 6) + 0.0D AS richness FROM d WHERE pos <= quota"""),
    "first_level_with_data": (first_level_with_data, f"{_METRICS} SELECT a.loc_id, a.level FROM m a WHERE EXISTS (SELECT 1 FROM m b WHERE b.loc_id = a.loc_id AND b.level <= a.level AND b.total_nodes > 0)"),
    "take_while_limit": (take_while_limit, f"{_METRICS} SELECT a.loc_id, a.level FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.loc_id = a.loc_id AND b.level <= a.level AND greatest(b.n_points, b.n_lines, b.n_polygons) > 20)"),
    "band_global": (band_global, _band_sql(None, 1, "1.0D", _WHOLE)),
    "band_rings": (band_rings, _band_sql("ring", 2, "CASE l.ring WHEN 0 THEN 0.25D ELSE 0.75D END", [*_CAT_DENSITY, *_LU_FRAC, "coalesce(n, 0) / {km2} AS feature_density"])),
    "band_sectors": (band_sectors, _band_sql("sector", 4, "0.25D", [*_CAT_DENSITY, "coalesce(n, 0) / {km2} AS feature_density"])),
    "spatial_coverage": (spatial_coverage, "SELECT cell, count(DISTINCT gx * 100 + gy) / 16.0D AS coverage FROM (SELECT cell, greatest(0, least(3, cast(ceil((lon - w) / ((e - w) / 4.0D)) AS int) - 1)) AS gx, greatest(0, least(3, cast(ceil((lat - s) / ((n - s) / 4.0D)) AS int) - 1)) AS gy FROM (SELECT cast(floor(lat / 10.0D) AS int) AS cell, lat, lon, min(lon) OVER v AS w, max(lon) OVER v AS e, min(lat) OVER v AS s, max(lat) OVER v AS n FROM feat WINDOW v AS (PARTITION BY cast(floor(lat / 10.0D) AS int))) a WHERE e - w >= 0.000000001D AND n - s >= 0.000000001D) b GROUP BY cell"),
    "row_cap": (row_cap, "SELECT geom_type, feature_id, n > 100 AS overflow FROM (SELECT geom_type, feature_id, row_number() OVER (PARTITION BY geom_type ORDER BY feature_id) AS k, count(*) OVER (PARTITION BY geom_type) AS n FROM feat) a WHERE k <= 100"),
    "contrastive_loss": (contrastive_loss, """WITH e AS (SELECT label, vec_id, [x::DOUBLE for x in embedding] AS v, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 32 AS batch FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
 n AS (SELECT label, batch, vec_id, [x / (sqrt(list_dot_product(v, v)) + 0.00000001D) for x in v] AS g FROM e),
 t AS (SELECT label, batch, vec_id, g, [x / (sqrt(list_dot_product(c, c)) + 0.00000001D) for x in c] AS c FROM (SELECT *, list_concat(g[2:], g[1:1]) AS c FROM n)),
 l AS (SELECT a.label, a.batch, a.vec_id AS i, b.vec_id AS j, (1.0D / 0.07D) * list_dot_product(a.g, b.c) AS z FROM t a JOIN t b ON a.label = b.label AND a.batch = b.batch),
 r AS (SELECT label, batch, i, -(max(CASE WHEN i = j THEN z END) - max(mx) - ln(sum(exp(z - mx)))) AS loss FROM (SELECT *, max(z) OVER (PARTITION BY label, batch, i) AS mx FROM l) GROUP BY label, batch, i),
 c AS (SELECT label, batch, j, -(max(CASE WHEN i = j THEN z END) - max(mx) - ln(sum(exp(z - mx)))) AS loss FROM (SELECT *, max(z) OVER (PARTITION BY label, batch, j) AS mx FROM l) GROUP BY label, batch, j)
 SELECT label, batch, round((a + b) / 2.0D, 6) + 0.0D AS loss, n FROM (SELECT label, batch, avg(loss) AS a, count(*) AS n FROM r GROUP BY label, batch) JOIN (SELECT label, batch, avg(loss) AS b FROM c GROUP BY label, batch) USING (label, batch)"""),
}
