"""Files: locations as CSV, map features as GeoJSON, and catalogs to which only new keys are added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FEATURE = "geometry STRUCT<type: STRING, coordinates: STRING>, properties MAP<STRING, STRING>"


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon) of a CSV with a header; columns lat or latitude and lon or longitude, in any case, order and company.

    Rows without two numbers are left out. Raises ValueError where a column is missing or no row is left.
    """
    raw = spark.read.option("header", True).csv(path)
    names = {c.lstrip("\ufeff").strip().lower(): c for c in raw.columns}
    lat, lon = (next((names[n] for n in own if n in names), None) for own in (("lat", "latitude"), ("lon", "longitude")))
    if lat is None or lon is None:
        raise ValueError(f"no latitude or longitude among {raw.columns}")
    number = lambda c, n: F.trim(F.col(f"`{c}`")).try_cast("double").alias(n)
    out = raw.select(number(lat, "lat"), number(lon, "lon")).where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    if out.isEmpty():
        raise ValueError(f"no location in {path}")
    return out


def read_geojson(spark: SparkSession, path: str, geom_types: tuple[str, ...] = (), *, lines: bool = False) -> DataFrame:
    """(file, geom_type, coordinates, tags) of GeoJSON, plain or gzip: collections, or with lines a feature on each line.

    coordinates stay JSON text; tags without a value are left out, and so are files and lines that are not GeoJSON
    and features without a geometry. geom_types: those to keep (all, if none are named).
    """
    if lines:
        rows = spark.read.schema(_FEATURE).json(path).select(F.input_file_name().alias("file"), "geometry", "properties")
    else:
        item = _FEATURE.replace("geometry ", "geometry: ").replace("properties ", "properties: ")
        raw = spark.read.schema(f"features ARRAY<STRUCT<{item}>>").option("multiLine", True).json(path)
        rows = raw.select(F.input_file_name().alias("file"), F.explode("features").alias("f")).select("file", "f.geometry", "f.properties")
    tags = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    out = rows.select("file", F.col("geometry.type").alias("geom_type"), F.col("geometry.coordinates").alias("coordinates"), tags.alias("tags"))
    out = out.where("geom_type IS NOT NULL AND coordinates IS NOT NULL AND coordinates <> '[]'")
    return out.where(F.col("geom_type").isin(*geom_types)) if geom_types else out


def write_geojson(features: DataFrame, path: str) -> None:
    """Write features (geom_type, coordinates, tags) as gzip lines, one feature each, in a folder for each geometry type."""
    text = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), F.col("geom_type"), F.lit('","coordinates":'), F.col("coordinates"), F.lit('},"properties":'), F.coalesce(F.to_json("tags"), F.lit("{}")), F.lit("}"))
    features.select(F.col("geom_type").alias("kind"), text.alias("value")).where("value IS NOT NULL").write.partitionBy("kind").option("compression", "gzip").text(path)


def write_csv(df: DataFrame, path: str, ordered: tuple[str, ...]) -> None:
    """Write the columns of ordered that df has, in that order, with a header in each part."""
    df.select(*[c for c in ordered if c in df.columns]).write.option("header", True).csv(path)


def new_rows(batch: DataFrame, known: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of batch to add to a catalog: keys that known lacks, of each key the row that is first by order.

    Rows with a null key are never equal to others, so all of them are new.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    null = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    fresh = batch.join(known.select(*keys), keys, "left_anti")
    return fresh.where(~null).withColumn("_first", first).where("_first = 1").drop("_first").unionByName(fresh.where(null))
