"""Map features, locations, tags and rectangles as views over the star-schema tables, for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "part", "events", "embeddings", "nation", "region", "documents", "supplier")

TAGS = ("amenity", "shop", "highway", "natural", "landuse", "building", "waterway", "tourism", "leisure", "historic", "railway")
VIEWS = {
    "f0": "SELECT l_orderkey AS ok, l_linenumber AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "feat": """SELECT ok * 8 + ln AS feature_id, CASE ln % 3 WHEN 0 THEN 'polygon' WHEN 1 THEN 'line' ELSE 'point' END AS geom_type,
  ((pk * 7919) % 120000) / 1000.0D - 60.0D AS lat, ((sk * 104729 + ok * 31) % 360000) / 1000.0D - 180.0D AS lon,
  CASE pk % 7 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'school' WHEN 2 THEN 'hospital' END AS amenity, CASE WHEN pk % 5 = 0 THEN 'bakery' END AS shop,
  CASE sk % 9 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary' WHEN 2 THEN ' Motorway_Link' WHEN 3 THEN 'steps' WHEN 5 THEN 'tertiary' WHEN 7 THEN 'corridor' END AS highway, CASE WHEN pk % 11 = 3 THEN 'tree' END AS "natural",
  CASE pk % 12 WHEN 4 THEN 'forest' WHEN 5 THEN 'retail' WHEN 7 THEN 'Housing' WHEN 8 THEN 'port' WHEN 10 THEN 'cemetery' WHEN 11 THEN 'allotments' END AS landuse, CASE sk % 6 WHEN 1 THEN 'yes' WHEN 4 THEN 'warehouse' WHEN 5 THEN 'nan' END AS building,
  CASE pk % 19 WHEN 4 THEN 'park' WHEN 9 THEN 'sports_centre' END AS leisure, CASE WHEN sk % 23 = 5 THEN 'castle' END AS historic, CASE WHEN sk % 29 = 3 THEN 'rail' END AS railway, CASE WHEN sk % 13 = 0 THEN 'river' END AS waterway,
  CASE WHEN pk % 17 = 0 THEN 'museum' END AS tourism, 1.0D + pk % 50 AS area, 1.0D + sk % 40 AS length FROM f0""",
    "loc": "SELECT o_orderkey AS loc_id, ((o_custkey * 7919) % 120000) / 1000.0D - 60.0D AS lat, ((o_orderkey * 104729) % 360000) / 1000.0D - 180.0D AS lon FROM orders",
    "kv": " UNION ALL ".join(f"""SELECT feature_id, geom_type, lat, lon, '{k}' AS k, {q} AS v FROM feat WHERE {q} IS NOT NULL""" for k, q in ((t, f'"{t}"' if t == "natural" else t) for t in TAGS)),
    "box": """SELECT p_partkey AS box_id, cast((p_partkey * 37) % 400 AS double) AS xmin, cast((p_partkey * 91) % 300 AS double) AS ymin,
  cast((p_partkey * 37) % 400 + 1 + p_size % 7 AS double) AS xmax, cast((p_partkey * 91) % 300 + 1 + p_size % 5 AS double) AS ymax FROM part""",
}


# Spark unfolds the tags of a feature in one pass
_KV = "SELECT feature_id, geom_type, lat, lon, k, v FROM feat LATERAL VIEW stack({n}, {pairs}) t AS k, v WHERE v IS NOT NULL".format(n=len(TAGS), pairs=", ".join(f"'{t}', `{t}`" for t in TAGS))


def _needed(sql: str) -> list[str]:
    """Views that a query names, those they need first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in order and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text, re.I):
                visit(body)
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def _with(sql: str, first: list[str]) -> str:
    views = first + [f"{n} AS ({VIEWS[n]})" for n in _needed(sql)]
    body = re.sub(r"^\s*WITH\s", "", sql) if re.match(r"\s*WITH\s", sql) else sql
    if not views:
        return sql
    return f"WITH {', '.join(views)}{', ' if body is not sql else ' '}{body}"


def spark_sql(sql: str, sf_dir: str) -> str:
    """The text for Spark, tables read from sf_dir."""
    used = " ".join([sql, *(VIEWS[n] for n in _needed(sql))])
    tables = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if re.search(rf"\b(?:FROM|JOIN|,)\s+{t}\b", used, re.I)]
    text = _with(sql, tables).replace(VIEWS["kv"], _KV).replace('"natural"', "`natural`")
    text = re.sub(r"\{u:(.+?)\}", r"(cast(conv(substr(md5(\1), 1, 8), 16, 10) AS double) / 4294967296.0D)", text)
    return re.sub(r"\{seq:(.+?);(.+?)\}", r"explode(sequence(\1, \2))", text)


def duck_sql(sql: str) -> str:
    """The same for DuckDB, over its registered tables."""
    text = re.sub(r"\{u:(.+?)\}", r"(cast(cast(concat('0x', substr(md5(\1), 1, 8)) AS bigint) AS double) / 4294967296.0D)", _with(sql, []))
    text = re.sub(r"\{seq:(.+?);(.+?)\}", r"unnest(range(\1, \2 + 1))", text)
    return re.sub(r"(\d+(?:\.\d+)?)D\b", r"\1::DOUBLE", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(spark_sql(f"SELECT * FROM {name}", sf_dir))
